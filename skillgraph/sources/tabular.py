"""Reading of delimited files with unsteady headers into one fixed schema of texts."""

from __future__ import annotations

import codecs
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.config import ALIASES, MISSING_TOKENS, REQUIRED
from skillgraph.functions.text import header_name, header_names
from skillgraph.storage import stored

_OVERFLOW = "_overflow_"
_SNIFF_BYTES = 512_000
#: Places up to so many are broadcast (about 200 bytes each, 40 MB); more join by shuffle.
BROADCAST_PLACES = 200_000


def _head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, or of the first file of a folder or pattern, from any store."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s for s in store.globStatus(place) or []), key=lambda s: s.getPath().toString())
    if found and found[0].isDirectory():
        found = sorted((s for s in store.listStatus(found[0].getPath()) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda s: s.getPath().toString())
    if not found:
        return b""
    stream = store.open(found[0].getPath())
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(size, found[0].getLen()))))
    finally:
        stream.close()


def sniff_encoding(spark: SparkSession, path: str, candidates: tuple[str, ...] = ("utf-8-sig", "utf-8", "latin-1")) -> str:
    """The first candidate that decodes the file's beginning, else latin-1. Only the beginning is read."""
    data = _head(spark, path, _SNIFF_BYTES)
    for name in candidates:
        try:
            codecs.getincrementaldecoder(name)().decode(data, final=len(data) < _SNIFF_BYTES)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def _files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files whose cells stay within lines, files with a quoted cell that goes on over a line's end: there, a line has an odd number of quotes)."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    found = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(quotes % 2).alias("odd")).collect()  # a row for each file
    return tuple([unquote(r["file"]) for r in found if r["odd"] == odd] for odd in (0, 1))


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """All columns as text, a header line, quoted line breaks; rows with too many cells are left out, short ones filled with NULL.

    Cell texts that stand for a missing value are NULL. _row_ numbers the rows from 0, files in order of their paths. A file is
    read in parallel splits unless a quoted cell of its own goes on over a line's end, or its encoding forbids it.
    """
    charset = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}.get(encoding, encoding)
    reader = spark.read.option("encoding", charset).option("escape", '"').option("mode", "PERMISSIVE").option("header", True)
    headers = [h.lstrip("\ufeff") for h in reader.option("multiLine", True).option("inferSchema", False).csv(path).columns]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*[f"c{i}" for i in range(len(headers))], _OVERFLOW]])
    split, whole = _files(spark, path) if charset in ("UTF-8", "ISO-8859-1") else ([], [path])
    whole = whole if split or whole else [path]
    # The extra column tells long rows from whole ones.
    read = [reader.option("multiLine", over).option("enforceSchema", True).schema(schema).csv(files) for over, files in ((False, split), (True, whole)) if files]
    places = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("_place_"), F.monotonically_increasing_id().alias("_id_")]
    cells = [F.when(~F.col(c).isin(*MISSING_TOKENS), F.col(c)).alias(c) for c in schema.names[:-1]]
    known = reduce(DataFrame.unionByName, [r.where(F.col(_OVERFLOW).isNull()).select(*cells, *places) for r in read])
    return _counted_on(stored(known, "numbered"), "_place_").toDF(*headers, "_row_")


def _counted_on(placed: DataFrame, place: str) -> DataFrame:
    """``placed`` (columns, a place, _id_) without the last two, and a number from 0 in the order of places, within one by _id_.

    Rows of a place have consecutive _id_, for they lie in one partition; each place begins at the sum of those before it.
    Places are splits of files or partitions: few enough to be put in order at once.
    """
    columns = [c for c in placed.columns if c not in (place, "_id_")]
    sizes = placed.groupBy(F.col(place).alias("_of_")).agg(F.count("*").alias("_n_"), F.min("_id_").alias("_least_"))
    before = F.sum("_n_").over(Window.orderBy("_of_").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(sizes.select("_of_", (F.coalesce(before, F.lit(0)) - F.col("_least_")).alias("_start_")), "places")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_PLACES else starts
    return placed.join(starts, F.col(place) == F.col("_of_")).select(*columns, (F.col("_id_") + F.col("_start_")).alias("_row_"))


def numbered(df: DataFrame, name: str = "_row_") -> DataFrame:
    """Rows numbered from 0 in the order of their partitions: each partition's start is the sum of those before it.

    They are written first, with their places, so that counting and numbering see the same partitions (a sort that runs again
    may cut its ranges elsewhere).
    """
    inner = [f"c{i}" for i in range(len(df.columns))]  # Parquet takes any content, but not any name
    placed = stored(df.toDF(*inner).withColumns({"_id_": F.monotonically_increasing_id(), "_place_": F.spark_partition_id()}), "numbered")
    return _counted_on(placed, "_place_").toDF(*df.columns, name)


@dataclass(frozen=True)
class Canonical:
    rows: DataFrame
    present: frozenset[str]
    missing: tuple[str, ...]


def resolve(columns: list[str]) -> dict[str, str]:
    """The column that stands for each canonical one: the first, in file order, with one of its names."""
    names = {c: {header_name(a) for a in aliases} for c, aliases in ALIASES.items()}
    out: dict[str, str] = {}
    for column, name in zip(columns, header_names(columns), strict=True):
        for canonical, aliases in names.items():
            if canonical not in out and name in aliases:
                out[canonical] = column
    return out


#: Rows up to so many are limited in one task; of more, the first ones are told by their numbers.
LIMITED_ROWS = 100_000

# What a list of skill objects looks like.
_LOOKS = "(?i)(['\"]skill['\"]\\s*:|['\"]bucket['\"]\\s*:|\\[\\s*\\{)"


def cell_rates(df: DataFrame, columns: list[str], sample: int = 3_000) -> dict[str, float]:
    """Of the first ``sample`` cells of each column that aren't NULL, the share that looks like lists of skill objects.

    One job for all columns whose first ``sample`` rows hold enough cells; one more for each of the others.
    """
    cell = lambda c: F.col(f"`{c}`")
    rate = lambda c: F.coalesce(F.avg(cell(c).rlike(_LOOKS).cast("int")), F.lit(0.0))
    head = lambda d: d.limit(sample) if sample <= LIMITED_ROWS else numbered(d, "_at_").where(F.col("_at_") < sample)
    whole = sample > LIMITED_ROWS and df.count() <= sample
    first = (df if whole else head(df)).agg(F.count("*"), *[m for c in columns for m in (F.count(cell(c)), rate(c))]).first()
    known = {c: (first[1 + 2 * i], first[2 + 2 * i]) for i, c in enumerate(columns)}
    return {c: r if whole or n == sample or first[0] < sample else head(df.where(cell(c).isNotNull())).agg(rate(c)).first()[0] for c, (n, r) in known.items()}


def infer_cell_column(df: DataFrame, columns: list[str], sample: int = 3_000, least: float = 0.2) -> str | None:
    """The column whose cells most often look like lists of skill objects, the first of equal ones; None below ``least``."""
    rates = cell_rates(df, columns, sample)
    best = max(columns, key=lambda c: rates[c], default=None)
    return best if best is not None and rates[best] >= least else None


def canonical(df: DataFrame, row: str = "_row_") -> Canonical:
    """The canonical columns, in order of their names, and row_idx; the cell column is inferred where the named one is blank."""
    columns = [c for c in df.columns if c != row]
    found = resolve(columns)
    blank = "skills" not in found or not df.where(F.trim(F.coalesce(F.col(f"`{found['skills']}`"), F.lit(""))) != "").limit(1).count()
    if blank and (inferred := infer_cell_column(df, columns)):
        found["skills"] = inferred
        blank = False
    picked = [(F.col(f"`{found[c]}`") if c in found else F.lit(None)).cast("string").alias(c) for c in sorted(ALIASES)]
    missing = tuple(c for c in REQUIRED if c not in found or (c == "skills" and blank))
    return Canonical(df.select(F.col(row).cast("long").alias("row_idx"), *picked), frozenset(found), missing)
