"""Questions about a table of events or jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` events, oldest first."""
    return events.orderBy(F.desc(order)).limit(n).orderBy(order)


def current(events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """(key, state): the last state of each key."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state))


def oldest(jobs: DataFrame, condition: Column, order: str, *columns: str) -> DataFrame:
    """The row that has waited longest among those of a condition."""
    return jobs.where(condition).orderBy(order).limit(1).select(*columns)


def totals(parts: DataFrame, key: str, amount: str) -> DataFrame:
    return parts.groupBy(key).agg(F.sum(amount).alias(amount))


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; KeyError if there is none."""
    found = df.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise KeyError(value)
    return found
