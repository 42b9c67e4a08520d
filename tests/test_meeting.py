"""Pairs that are added up and ranked as arrays, against plain counting."""

import collections
import random

import pyarrow as pa
import pytest

from skillgraph.functions import meeting


def _rows(least, most, seed=1):
    draw = random.Random(seed)
    ids = [draw.randrange(least, most) for _ in range(20)]
    return [(draw.choice(ids), draw.randrange(1, 50), [draw.choice(ids) for _ in range(n)], [draw.randrange(1, 50) for _ in range(n)]) for n in (draw.randrange(9) for _ in range(80))]


def _batches(rows, size):
    kinds = {"a": pa.int64(), "w": pa.int8(), "bs": pa.list_(pa.int64()), "vs": pa.list_(pa.int8())}
    return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), kinds.values(), strict=True)], list(kinds)) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("held", [30, 4_000_000])
@pytest.mark.parametrize("least,most", [(0, 50), (-50, 5_000), (10**17, 10**18), (-(10**18), 10**18)])
def test_pairs_are_added_up_and_ranked(monkeypatch, held, least, most):
    monkeypatch.setattr(meeting, "HELD", held)
    rows, count, total = _rows(least, most), collections.Counter(), collections.Counter()
    for a, w, bs, vs in rows:
        for b, v in zip(bs, vs, strict=True):
            count[a, b] += 1
            total[a, b] += min(w, v)
    batches = _batches(rows, 30)
    assert [tuple(r.values()) for batch in meeting.added(batches) for r in batch.to_pylist()] == [(a, b, count[a, b], total[a, b]) for a, b in sorted(count)]
    for room in (0, 3):
        want = []
        for method, found, least_value in (("unweighted", count, 1.2), ("weighted", total, 12)):
            for a in sorted({a for a, _ in count}):
                best = sorted((-found[p], str(p[1]), p[1]) for p in count if p[0] == a and found[p] >= least_value)
                want += [(a, b, -s, i, method) for i, (s, _, b) in enumerate(best, 1) if room == 0 or i <= room]
        assert [tuple(r.values()) for batch in meeting.ranked(batches, ["unweighted", "weighted"], room, 1.2, 10.0) for r in batch.to_pylist()] == want
    assert not list(meeting.added([])) and not list(meeting.ranked(iter([]), ["unweighted"], 3, 0.0, 1.0))
