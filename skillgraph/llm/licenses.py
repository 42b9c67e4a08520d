"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text's words make shingles of ``shingle`` words. Templates are classed by
their number of shingles; a class whose largest has M lays windows of 2M
shingles at a step of M, so a template's occurrence of M shingles lies within
some window. ``bands`` is the number of bands that makes a window and a template
of the wanted containment share one with the wanted probability: the lowest Jaccard
similarity that they can have follows from the class's sizes. A shared band
retrieves the template for that window; it stands if the window holds at least
``containment`` of the template's distinct shingles.

Defined cases: a null text has no words; a template of fewer words than a
shingle raises ValueError; repeated rows have rows each; texts that match
nothing have no row; a null id is kept; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import find_words, lower_bytes, mixed, text_slices, window_hashes, word_hashes

#: The wording of public licence notices.
TEMPLATES: dict[str, str] = {
    "mit-short": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def bands_needed(similarity: float, probability: float) -> int:
    """Bands of one row each after which two sets of this Jaccard similarity share one with this probability."""
    return max(1, math.ceil(math.log(1 - probability) / math.log(1 - min(similarity, 1 - 1e-9))))


@dataclass(frozen=True)
class _Class:
    step: int
    names: tuple[str, ...]
    shingles: tuple[np.ndarray, ...]
    seeds: np.ndarray
    minima: np.ndarray  # bands x templates


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes at the words that begin one, and where each text's begin."""
    data = lower_bytes(data)
    starts, ends, first = find_words(data, offsets, _WORD)
    hashes = window_hashes(word_hashes(data, starts, ends), size)
    counts = np.maximum(np.diff(first) - size + 1, 0)
    keep = np.arange(len(starts)) <= np.repeat(first[1:] - size, np.diff(first))
    return hashes[np.flatnonzero(keep)], np.concatenate([[0], np.cumsum(counts)])


def classes(templates: Mapping[str, str], shingle: int, containment: float, probability: float) -> list[_Class]:
    sized = defaultdict(list)
    for name, text in sorted(templates.items()):
        raw = np.frombuffer(text.encode(), np.uint8)
        own = np.unique(_shingles(raw, np.array([0, len(raw)]), shingle)[0])
        if not len(own):
            raise ValueError(f"template {name} has fewer than {shingle} words")
        sized[max(4, 1 << (len(own) - 1).bit_length())].append((name, own))
    out = []
    for step, some in sorted(sized.items()):
        shared = min(math.ceil(containment * len(x)) / (2 * step + len(x) - math.ceil(containment * len(x))) for _, x in some)
        seeds = mixed(np.arange(1, bands_needed(shared, probability) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        minima = np.array([[(x * s).min() for _, x in some] for s in seeds])
        out.append(_Class(step, tuple(n for n, _ in some), tuple(x for _, x in some), seeds, minima))
    return out


def _windows(one: _Class, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first shingle, shingle after the last) of every window."""
    counts = np.diff(starts)
    blocks = -(-counts // one.step)
    text = np.repeat(np.arange(len(counts)), blocks)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = starts[text] + rank * one.step
    return text, begin, np.minimum(begin + 2 * one.step, starts[text + 1])


def _matches(one: _Class, hashes: np.ndarray, starts: np.ndarray, containment: float) -> Iterator[tuple[int, str, float, int]]:
    text, begin, end = _windows(one, hashes, starts)
    if not len(text):
        return
    follows = np.append(text[1:] == text[:-1], False)  # the next block belongs to the same text
    found = np.zeros((len(text), len(one.names)), bool)
    for seed, minima in zip(one.seeds, one.minima, strict=True):
        block = np.minimum.reduceat(hashes * seed, begin)
        least = block.copy()
        least[:-1] = np.where(follows[:-1], np.minimum(block[:-1], block[1:]), block[:-1])
        for k, m in enumerate(minima):
            found[:, k] |= least == m
    for w, k in zip(*np.nonzero(found), strict=True):
        window = hashes[begin[w] : end[w]]
        inside = np.flatnonzero(np.isin(window, one.shingles[k]))
        share = len(np.unique(window[inside])) / len(one.shingles[k])
        if share >= containment:
            yield int(text[w]), one.names[k], share, int(begin[w] + inside[0] - starts[text[w]])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_column: str = "doc_id", text: str = "text", shingle: int = 5, containment: float = 0.8, probability: float = 0.999) -> DataFrame:
    """doc_id, license, containment, start_word: the best window of each text and template that match (of equal ones, the first)."""
    found_classes = classes(templates, shingle, containment, probability)
    shared = docs.sparkSession.sparkContext.broadcast(found_classes)
    schema = T.StructType().add("doc_id", docs.schema[id_column].dataType).add("license", T.StringType()).add("containment", T.DoubleType()).add("start_word", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, str], tuple[float, int]] = {}
            for begin, _, data, offsets in text_slices(batch.column(1)):
                hashes, starts = _shingles(data, offsets, shingle)
                for one in shared.value:
                    for row, name, share, start in _matches(one, hashes, starts, containment):
                        key = (begin + row, name)
                        best[key] = max(best.get(key, (0.0, 0)), (share, -start))
            rows = [r for r, _ in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([n for _, n in best], pa.string()), pa.array([s for s, _ in best.values()], pa.float64()), pa.array([-s for _, s in best.values()], pa.int64())], [f.name for f in schema.fields]
            )

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
