"""Parsing of semi-structured cells: a list of objects that name a skill, a bucket and a similarity.

A strict JSON list of flat objects, whose names and buckets are texts and whose
similarities are numbers, is read by Spark's JSON parser. Only other cells (Python
literals, text around a list, nested or broken objects) go through one Arrow UDF.
Both give the same: an object's further fields are kept as texts, strings as they are,
NULL for null, anything else as compact JSON.
"""

from __future__ import annotations

import ast
import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.functions.text import strip

ITEM = T.StructType([T.StructField("text", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])
RESULT = T.StructType([T.StructField("items", T.ArrayType(ITEM)), T.StructField("reason", T.StringType())])
NO_PARSE, NO_ITEMS = "unable_to_parse_skills", "parsed_but_no_valid_skill_objects"

# The keys that an object's name may have, in order, and those of its bucket and similarity.
NAME_KEYS = ("skill", "name", "skill_name")
KNOWN_KEYS = (*NAME_KEYS, "bucket", "mapping_similarity")

_VALUE = r"""['"]?{key}['"]?\s*:\s*(?:"(?P<a>[^"]+)"|'(?P<b>[^']+)'|(?P<c>[^,}}\]]+))"""
_FIELDS = {key: re.compile(_VALUE.format(key=key), re.IGNORECASE) for key in ("skill", "bucket")}
_NUMBER = re.compile(r"""['"]?mapping_similarity['"]?\s*:\s*([0-9]*\.?[0-9]+)""", re.IGNORECASE)


def _literal(text: str) -> Any:
    """A JSON or Python literal, or None."""
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return None


#: No list or object begins so: it is a word, a number, a text, or several of them.
_BARE = re.compile("[A-Za-z0-9'\"]")


def _listed(value: Any) -> list | None:
    return [value] if isinstance(value, dict) else value if isinstance(value, list) else None


def _recovered(fragment: str) -> dict | None:
    """What can be read of a broken object."""
    value = _literal(fragment)
    if isinstance(value, dict):
        return value
    found = {}
    for key, pattern in _FIELDS.items():
        if hit := pattern.search(fragment):
            found[key] = next(g for g in hit.groups() if g).strip()
    if "skill" not in found:
        return None
    if hit := _NUMBER.search(fragment):
        found["mapping_similarity"] = hit[1]
    return found


def _number(value: Any) -> float | None:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return None if x != x else x


def _text(value: Any) -> str:
    """As text; half a surrogate pair, which UTF-8 can't hold, becomes a question mark."""
    return str(value).encode("utf-8", "replace").decode()


def _further(value: dict) -> dict[str, str | None]:
    """The fields of an object that have no meaning of their own, as texts."""
    return {_text(k): None if x is None else _text(x if isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False, default=str)) for k, x in value.items() if k not in KNOWN_KEYS}


def parse_cell(text: str) -> tuple[list[tuple[str, str | None, float | None, dict[str, str | None]]], str | None]:
    """Items of one cell (already stripped, quotes straightened), and the reason if there are none."""
    whole = re.search(r"\[.*\]", text, re.DOTALL)
    tried = (text, whole[0]) if whole and whole[0] != text else (text,)
    values = next((x for t in tried if not _BARE.match(t) and (x := _listed(_literal(t))) is not None), None)
    if values is None:
        values = [x for f in re.findall(r"\{[^{}]*\}", text) if (x := _recovered(f))]
        if not values:
            return [], NO_PARSE
    items = []
    for value in values:
        if not isinstance(value, dict):
            continue
        name = next((x for k in NAME_KEYS if (x := value.get(k))), None)
        name = "" if name is None else _text(name).strip()
        if name:
            bucket = value.get("bucket")
            items.append((name, None if bucket is None else _text(bucket).strip(), _number(value.get("mapping_similarity")), _further(value)))
    return items, NO_ITEMS if values and not items else None


_ARROW_ITEM = pa.struct([("text", pa.string()), ("bucket", pa.string()), ("similarity", pa.float64()), ("extra", pa.map_(pa.string(), pa.string()))])
_ARROW = pa.struct([("items", pa.list_(_ARROW_ITEM)), ("reason", pa.string())])


@F.arrow_udf(RESULT)
def _parse_hard(cells: pa.Array) -> pa.Array:
    if cells.null_count == len(cells):  # all were easy
        return pa.nulls(len(cells), _ARROW)
    columns: tuple[list, ...] = ([], [], [])
    keys, values, reasons, ends, key_ends = [], [], [], [0], [0]
    for c in cells.to_pylist():
        items, reason = parse_cell(c) if c is not None else ((), None)
        for *known, extra in items:
            for column, value in zip(columns, known, strict=True):
                column.append(value)
            keys.extend(extra)
            values.extend(extra.values())
            key_ends.append(len(keys))
        ends.append(len(columns[0]))
        reasons.append(reason)
    further = pa.MapArray.from_arrays(pa.array(key_ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
    known = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)]
    item = pa.StructArray.from_arrays([*known, further], names=ITEM.names)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item), pa.array(reasons, pa.string())], names=RESULT.names)


_FLAT = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
#: Values that read differently as Python objects: names and buckets that aren't texts, similarities that aren't finite
#: numbers, objects within objects, and further numbers that aren't whole.
_TYPED = r'"(?:(?:skill|name|skill_name|bucket)"\s*+:\s*+[^"\sn]|mapping_similarity"\s*+:\s*+(?:["tf\[{IN+]|-\s*+I)|(?!mapping_similarity")[^"]*+"\s*+:\s*+(?:-?[0-9]++[.eE]|[+IN]|-\s*+I))|:\s*+\{'


def _flat_items(cell: Column) -> Column:
    """Items of a cell that is a list of flat objects, else NULL. No bracket closes before the last one, so nothing follows the list."""
    simple = F.startswith(cell, F.lit("[")) & (F.instr(cell, "]") == F.length(cell)) & ~cell.rlike(_TYPED)
    return F.from_json(F.when(simple, cell), _FLAT, {"allowSingleQuotes": "false"})


def _item(x: Column) -> Column:
    named = F.coalesce(*[F.when(x[n] != "", x[n]) for n in NAME_KEYS])
    similarity = x["mapping_similarity"].try_cast("double")
    extra = F.map_filter(x, lambda k, _: ~k.isin(*KNOWN_KEYS))
    return F.struct(strip(named).alias("text"), strip(x["bucket"]).alias("bucket"), F.when(~F.isnan(similarity), similarity).alias("similarity"), extra.alias("extra"))


def parse_cells(df: DataFrame, cell: str = "skills") -> DataFrame:
    """``df`` with items (array of text, bucket, similarity, extra) and reason (NULL, or why a cell has no items).

    Columns of ``df`` may have any names; those called items or reason give way.
    """
    inner = [f"c{i}" for i in range(len(df.columns))]
    at = inner[df.columns.index(cell)]
    # Quotes are straightened, and words looked at, only where there can be any: other characters than ASCII, short texts.
    bare = strip(F.col(at))
    straight = F.when(F.octet_length("bare") == F.length("bare"), F.col("bare")).otherwise(F.translate("bare", "“”‘’", "\"\"''"))
    text = F.replace(straight, F.lit("\x00"), F.lit(""))
    usable = F.when((F.length("text") > 4) | ~F.lower("text").isin("", "nan", "none", "null"), F.col("text"))
    read = df.toDF(*inner).withColumn("bare", bare).withColumn("text", text).drop("bare").withColumn("text", usable).withColumn("flat", _flat_items(F.col("text")))
    # A key that an object has twice counts by its last value, which a map doesn't tell.
    whole = F.col("flat").isNotNull() & F.forall("flat", lambda x: x.isNotNull() & (F.size(F.map_keys(x)) == F.size(F.array_distinct(F.map_keys(x)))))
    marked = read.withColumn("easy", F.coalesce(whole, F.lit(False)))
    parsed = marked.withColumn("hard", _parse_hard(F.when(~F.col("easy"), F.col("text"))))
    good = F.filter(F.transform("flat", _item), lambda i: i["text"].isNotNull() & (F.length(i["text"]) > 0))
    items = F.when(F.col("easy"), good).otherwise(F.coalesce(F.col("hard.items"), F.array().cast(T.ArrayType(ITEM))))
    reason = F.when(~F.col("easy"), F.col("hard.reason")).when((F.size("flat") > 0) & (F.size("items") == 0), NO_ITEMS)
    kept = [(c, name) for c, name in zip(inner, df.columns, strict=True) if name.lower() not in ("items", "reason")]
    return parsed.withColumn("items", items).withColumn("reason", reason).select(*[c for c, _ in kept], "items", "reason").toDF(*[name for _, name in kept], "items", "reason")


def items_of(parsed: DataFrame, *columns: str) -> DataFrame:
    """A row for each item, with its place and the item. An outer explode, for a plain one would have cells parsed again to see if they have items."""
    return parsed.select(*columns, F.posexplode_outer("items").alias("place", "item")).where("place is not null")


def faults_of(parsed: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and reason of the cells without items. An explode, for Spark would split a plain filter and read the cells again below, by a formula that holds the whole cell hundreds of times."""
    return parsed.select(*columns, F.explode_outer(F.array("reason")).alias("reason")).where("reason is not null")


def split_query(text: str) -> list[str]:
    """Parts of a query between commas, semicolons and line ends; of parts that differ in case only, the first."""
    parts: dict[str, str] = {}
    for part in re.split(r"[,;\n]+", text):
        if part.strip():
            parts.setdefault(part.strip().lower(), part.strip())
    return list(parts.values())
