"""Small documents and plain versions of the rules, for comparison."""

from __future__ import annotations

import random
import re

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text: str | None) -> str:
    return (text or "").encode().translate(_TABLE).decode()


def spaced_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(("ba", "né", "ko", "Ti", "ru", "sha")) for _ in range(1 + draw.randrange(vocabulary) % 4)) + draw.choice(("", "", ".", ",")) for _ in range(n))


def with_odd_rows(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str | None]]:
    """Null and empty texts, a null id, odd characters and a very long text besides."""
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (903, "日本語 ñandú ÉCOLE 😀 x y"), (904, prose(77, 6000)), (905, "one"), (None, "no id here at all")]


def documents(spark, rows):
    """A table with more columns, some with names that operators use themselves."""
    full = [(i, t, "en", "s", len(t or ""), 1.0, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, part string")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return {n: min(g) for g in groups.values() for n in g}
