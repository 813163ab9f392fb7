"""Sidecar filters kept up to date by a stream of keys.

A truncating filter has fixed bounds, so a key's fingerprint never changes: each micro-batch adds its new fingerprints.  Batches are written
under their number, and a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(stream: DataFrame, path: str, checkpoint: str, lo: int, hi: int, k: int, key: str = "k", once: bool = True) -> StreamingQuery:
    """Start adding the stream's keys to the sidecar at `path`.  Keys outside [lo, hi] go to a table of their own, exactly."""
    shift = max(0, (hi - lo).bit_length() - k)

    def add(batch: DataFrame, number: int) -> None:
        inside = F.col(key).between(lo, hi)
        rows = batch.where(F.col(key).isNotNull()).select(inside.alias("inside"), F.when(inside, F.shiftright(F.col(key) - lo, shift)).otherwise(F.col(key)).alias("fp")).distinct()
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(inside, fp): the distinct fingerprints so far."""
    return spark.read.parquet(path).select("inside", "fp").distinct()


def answer(spark: SparkSession, path: str, queries: DataFrame, lo: int, hi: int, k: int) -> DataFrame:
    """queries (qid, a, b) with is_empty, never true where a key was seen."""
    from voidscan.operators.exact import is_empty

    shift = max(0, (hi - lo).bit_length() - k)
    held = sidecar(spark, path)
    valid = queries.where("a <= b")
    mapped = valid.where((F.col("b") >= lo) & (F.col("a") <= hi)).select("qid", F.shiftright(F.greatest("a", F.lit(lo)) - lo, shift).alias("x"), F.shiftright(F.least("b", F.lit(hi)) - lo, shift).alias("y"))
    near = is_empty(held.where("inside"), mapped, "fp", "x", "y").select("qid", "is_empty")
    far = is_empty(held.where("not inside"), valid.select("qid", "a", "b"), "fp").select("qid", "is_empty")
    got = near.unionByName(far).groupBy("qid").agg(F.bool_and("is_empty").alias("_e"))
    return queries.join(got, "qid", "left").withColumn("is_empty", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.coalesce("_e", F.lit(True)))).drop("_e")
