"""Rows that arrive over time: each batch updates stored entities and edges.

The batch operators do the work: of entities the first row wins and later ones fill
its gaps, of edges the greatest weight wins, so a batch merges with what is stored
by the same rules, in any number of batches. The state lies in parts by a hash of
the key: a batch reads and rewrites only those parts that its own keys fall into.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skillgraph.operators.entities import ITEMS_AT_ONCE, best_edges
from skillgraph.storage import stored, tasks_for


def merge_edges(known: DataFrame | None, new: DataFrame, entity: str = "entity", feature: str = "feature", weight: str = "weight", order: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """The best edge of each pair, of those stored and those new."""
    both = new if known is None else known.unionByName(new.select(*known.columns))
    return best_edges(both, entity, feature, weight, order)


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _lists(spark: SparkSession, folder: str) -> list[int]:
    """Batches that have finished and whose list of parts is still there, in order."""
    store, place = _store(spark, f"{folder}/parts")
    names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _parts(spark: SparkSession, folder: str, batch: int) -> dict[int, str]:
    """Where each part of the state lies after a batch: number of the part to folder."""
    store, place = _store(spark, f"{folder}/parts/{batch}.json")
    stream = store.open(place)
    try:
        return {int(k): v for k, v in json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))).items()}
    finally:
        stream.close()


def _put(spark: SparkSession, folder: str, batch: int, parts: dict[int, str]) -> None:
    """Writes the list of parts beside its place and moves it there, so that it is whole or not there."""
    store, made = _store(spark, f"{folder}/parts/{uuid.uuid4().hex}.tmp")
    stream = store.create(made)
    try:
        stream.write(bytearray(json.dumps(parts, indent=0).encode()))
    finally:
        stream.close()
    _, place = _store(spark, f"{folder}/parts/{batch}.json")
    store.delete(place, False)
    store.rename(made, place)


def _remove(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        store, place = _store(spark, path)
        store.delete(place, True)


def _remove_old(spark: SparkSession, folder: str) -> None:
    """Removes what neither the last state nor the one before it names: a reader may still be at the latter."""
    known = _lists(spark, folder)
    kept = {p for n in known[-2:] for p in _parts(spark, folder, n).values()}
    for n in known[:-2]:
        _remove(spark, {*_parts(spark, folder, n).values()} - kept)
        store, place = _store(spark, f"{folder}/parts/{n}.json")
        store.delete(place, False)


def _read(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    return spark.read.parquet(*paths) if paths else None


def apply_batch(batch: DataFrame, folder: str, number: int, parts: int = 256) -> None:
    """Merges items into the state in ``folder``. A batch that is run again gives the same state.

    ``parts`` holds for a folder's whole life. At most that many numbers come to the driver.
    """
    spark = batch.sparkSession
    known = _lists(spark, folder)
    before = _parts(spark, folder, known[-1]) if known else {}
    part = F.pmod(F.xxhash64("entity", "feature"), F.lit(parts)).cast("int")
    placed = stored(batch.withColumn("part", part), "batch")
    touched = sorted(r["part"] for r in placed.select("part").distinct().collect())
    old, new = _read(spark, [before[k] for k in touched if k in before]), placed.drop("part")
    both = new if old is None else old.unionByName(new.select(*old.columns))
    n = tasks_for(spark, placed.count() + (0 if old is None else old.count()), ITEMS_AT_ONCE)
    # A part goes to several tasks, by its pairs, where there are more tasks than parts.
    dealt = both.withColumn("part", part).withColumn("_at", F.pmod(F.xxhash64("feature", "entity"), F.lit(-(-n // parts)))).repartition(n, "part", "_at")
    version = f"{folder}/edges/{number}-{uuid.uuid4().hex}"
    best_edges(dealt, "entity", "feature", "weight", ("row_idx",), dealt=("part", "_at")).drop("_at").write.partitionBy("part").parquet(version)
    _put(spark, folder, number, before | {k: f"{version}/part={k}" for k in touched})
    if known and known[-1] == number:  # run again: what the first run has written is named no more
        earlier = {*_parts(spark, folder, known[-2]).values()} if len(known) > 1 else set()
        _remove(spark, {before[k] for k in touched if k in before} - earlier)
    _remove_old(spark, folder)


def edge_stream(spark: SparkSession, source: str, schema: StructType, folder: str, max_files: int = 100, parts: int = 256) -> StreamingQuery:
    """Keeps ``folder`` up to date with the item files (entity, feature, weight, row_idx) that appear in ``source``."""
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return items.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, folder, number, parts)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def current_edges(spark: SparkSession, folder: str) -> DataFrame | None:
    """The edges after the last finished batch; None before the first."""
    known = _lists(spark, folder)
    return _read(spark, sorted(_parts(spark, folder, known[-1]).values())) if known else None


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by window of event time; rows later than ``late`` are left out once a window has closed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
