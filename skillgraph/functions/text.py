"""Scalar functions on text and numbers, as column expressions that stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillgraph.config import BUCKET_SCORES

#: White space of any script.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"[{_WHITE}]+"
#: That of ASCII, which is found much faster.
_PLAIN_WHITE = "".join(c for c in _WHITE if c < "\x80")
_PLAIN_SPACE = f"[{_PLAIN_WHITE}]+"


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value made once however often it is used there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(c: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.when(_ascii(c), F.btrim(c, F.lit(_PLAIN_WHITE))).otherwise(F.btrim(c, F.lit(_WHITE)))


def _spaced(c: Column) -> Column:
    """Any white space as one space."""
    return F.when(_ascii(c), F.regexp_replace(c, _PLAIN_SPACE, " ")).otherwise(F.regexp_replace(c, _SPACE, " "))


def clean(c: Column) -> Column:
    """Stripped; blank and the words nan, none and null become NULL."""
    return once(strip(c.cast("string")), lambda text: F.when(~F.lower(text).isin("", "nan", "none", "null"), text))


def normalize_text(c: Column) -> Column:
    """Lower case, single spaces, no space or punctuation at the end; NULL is empty."""
    text = _spaced(F.lower(strip(F.coalesce(c, F.lit("")))))
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r.,;:!?-_/"))


def pretty_label(c: Column) -> Column:
    """Each word with a capital; empty is Unknown Skill."""
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown Skill").otherwise(F.initcap(c))


def header_name(text: str) -> str:
    """A header as a column name: lower snake case."""
    text = re.sub(r"[-/]+", "_", text.strip().replace("–", "-"))
    text = re.sub(r"[^0-9a-zA-Z_]", "", re.sub(r"\s+", "_", text))
    return re.sub(r"_+", "_", text).strip("_").lower()


def header_names(headers: list[str]) -> list[str]:
    """Column names of a header line; repeats get _1, _2, ..."""
    seen: dict[str, int] = {}
    out = []
    for h in headers:
        name = header_name(h)
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
    return out


def header_expression(c: Column) -> Column:
    """``header_name`` of a column of texts."""
    text = F.regexp_replace(F.regexp_replace(strip(c), "–", "-"), "[-/]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, _SPACE, "_"), "[^0-9a-zA-Z_]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_+|_+$", ""))


def _bucket_score(c: Column) -> Column:
    pairs = [F.lit(x) for item in BUCKET_SCORES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


def bucket(c: Column) -> Column:
    """struct(text, score): a bucket's normal spelling and its score of 0 to 4; an unknown one scores by the words in it."""
    text = _spaced(F.replace(F.lower(strip(F.coalesce(c, F.lit("unknown")))), F.lit("_"), F.lit(" ")))
    known = _bucket_score(text)
    by_words = once(text, lambda t: once(F.trim(F.regexp_replace(t, "[^0-9a-z]+", " ")), lambda plain: _scored(t, plain)))
    return F.when(known.isNotNull(), F.struct(text.alias("text"), known.cast("int").alias("score"))).otherwise(by_words)


def _scored(text: Column, plain: Column) -> Column:
    found = _bucket_score(text)
    by_word = (
        F.when(plain.contains("mission") | plain.contains("critical"), 4).when(plain.contains("advanced"), 3).when(plain.contains("proficient"), 2).when(plain.contains("working knowledge"), 1).otherwise(0)
    )
    name = F.when(found.isNotNull(), text).when(plain == "", "unknown").otherwise(plain)
    return F.struct(name.alias("text"), F.coalesce(found, _bucket_score(plain), by_word).cast("int").alias("score"))


def clip_similarity(c: Column) -> Column:
    """A number within 0 to 1; what isn't one, NaN too, is NULL."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def edge_weight(score: Column, similarity: Column, default: float = 0.5) -> Column:
    """0.7 similarity + 0.3 bucket share, or half bucket share and half the default; six decimals."""
    share = F.least(F.lit(4), F.greatest(F.lit(0), score)) / F.lit(4.0)
    return F.round(F.when(similarity.isNotNull(), 0.7 * clip_similarity(similarity) + 0.3 * share).otherwise(0.5 * share + 0.5 * F.lit(default)), 6)


def parse_number(c: Column) -> Column:
    """A number that may have thousands commas; NULL if it isn't one."""
    x = F.replace(strip(c.cast("string")), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x), x)


def hashed_id(prefix: str, c: Column, digits: int = 16) -> Column:
    return F.concat(F.lit(f"{prefix}::"), F.substring(F.sha1(c), 1, digits))


def fallback_id(title: Column, company: Column, posted: Column, row: Column) -> Column:
    """An id for a row without one: a hash of title, company and date, or of the row's number if all are blank."""
    parts = [F.lower(strip(F.coalesce(x, F.lit("")))) for x in (title, company, posted)]
    joined = F.concat_ws("|", *parts)
    seed = F.when(F.replace(joined, F.lit("|"), F.lit("")) == "", F.concat(F.lit("row_"), row.cast("string"))).otherwise(joined)
    return hashed_id("job_fallback", seed, 20)


def unit_hash(seed: int, row: Column) -> Column:
    """A fixed number within 0 to 1 for each row."""
    digits = F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), row.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967295.0)


def salary_band(c: Column, present: bool = True) -> Column:
    """The band of a monthly salary. A blank cell counts as the highest band, one that can't be read (or no column) as unknown."""
    if not present:
        return F.lit("unknown")
    x = parse_number(c)
    return F.when(c.isNull(), "ge_50k").when(x.isNull(), "unknown").when(x < 10_000, "lt_10k").when(x < 20_000, "10k_20k").when(x < 50_000, "20k_50k").otherwise("ge_50k")


def compact_json(*names: str, **columns: Column) -> Column:
    """A JSON object of columns, without those that are NULL or NaN."""
    fields = {n: F.col(n) for n in names} | columns
    nan = lambda c: F.typeof(c).isin("double", "float") & (c.cast("string") == "NaN")
    return F.to_json(F.struct(*[F.when(~F.coalesce(nan(c), F.lit(False)), c).alias(n) for n, c in fields.items()]))
