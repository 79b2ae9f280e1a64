"""How queries are registered and how they reach their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Inventory id -> query names.
COVERAGE: dict[str, list[str]] = {}


class Tables:
    """The driver tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, ids: str, sql: str | None = None):
    """Register a query; ``ids`` lists the inventory entries it exercises."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        for key in ids.split():
            COVERAGE.setdefault(key, []).append(name)
        return build

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round double results so that the order of a sum does not show."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(f"`{c}`", digits) for c in columns})


# The tables hold no nulls, so null operators inject them by a rule both sides share.
def nulled(column: str, key: str = "event_id", below: int = 1) -> Column:
    return F.when(F.col(key) % 7 >= below, F.col(column))


def nulled_events(t: Tables, below: int = 1) -> DataFrame:
    return t.events.withColumns({"v": nulled("value", below=below), "kind": nulled("event_type", below=below)})


NULLED_EVENTS = """(SELECT *, CASE WHEN event_id % 7 >= 1 THEN value END AS v,
    CASE WHEN event_id % 7 >= 1 THEN event_type END AS kind FROM events)"""
