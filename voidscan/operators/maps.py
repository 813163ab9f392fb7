"""Maps and key sets as tables: upserts, look-ups, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def put(table: DataFrame, rows: DataFrame, key: str = "key", version: str | None = None) -> DataFrame:
    """table with rows added or in place of those of the same key; of several rows of a key the one of the greatest `version` counts."""
    new = rows if version is None else rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")
    new = new.select(*table.columns)
    return table.join(new, key, "left_anti").select(*table.columns).unionByName(new)


def get(table: DataFrame, asked: DataFrame, key: str = "key", value: str = "value", missing=None) -> DataFrame:
    """asked with the value of each key, `missing` where there is none."""
    out = asked.join(table.select(key, value), key, "left")
    return out if missing is None else out.withColumn(value, F.coalesce(value, F.lit(missing)))


def delete(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys, key, "left_anti")


def contains(table: DataFrame, asked: DataFrame, key: str = "key") -> DataFrame:
    """asked with `found`."""
    return asked.join(table.select(key).distinct().withColumn("found", F.lit(True)), key, "left").fillna(False, ["found"])


def replayed(log: DataFrame, order: str = "step") -> DataFrame:
    """(key, value): what a log (step, op, key, value) of insert and erase leaves."""
    last = Window.partitionBy("key").orderBy(F.desc(order))
    kept = log.where(F.col("op").isin("insert", "erase")).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return kept.where("op = 'insert'").select("key", "value")


def answers(log: DataFrame, order: str = "step") -> DataFrame:
    """log with, for each `contains` and `get`, `found` and the value at that step; a running fold of each key's own events."""
    w = Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("op").isin("insert", "erase"), F.struct("op", "value"))
    return (log.withColumn("_last", F.last(change, ignorenulls=True).over(w)).where(F.col("op").isin("contains", "get"))
            .select(*log.columns, F.coalesce(F.col("_last.op") == "insert", F.lit(False)).alias("found"), F.when(F.col("_last.op") == "insert", F.col("_last.value")).alias("answer")))
