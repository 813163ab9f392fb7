"""Exact range emptiness: does an interval hold any key?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscan.functions.sizes import block_bits, exact_bits
from voidscan.operators.order import located


def is_empty(keys: DataFrame, queries: DataFrame, key: str = "k", a: str = "a", b: str = "b") -> DataFrame:
    """queries with is_empty: no key lies in [a, b].  a > b is empty; a null bound gives null."""
    found = located(queries, keys, a, key)
    free = (F.col(a) > F.col(b)) | F.col("next").isNull() | (F.col("next") > F.col(b))
    return found.withColumn("is_empty", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), free)).drop("below", "upto", "next", "last")


def is_empty_by_split(keys: DataFrame, queries: DataFrame, key: str = "k", a: str = "a", b: str = "b") -> DataFrame:
    """is_empty for keys >= 0 by another way: below and above the number where a and b part (their common prefix, a one, zeros) the nearest keys
    decide.  A query needs one look-up of that number."""
    apart = F.col(a).bitwiseXOR(F.col(b))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(apart)) - 1, F.lit(0)))
    middle = F.when(apart == 0, F.col(a)).otherwise(F.col(b).bitwiseAND(-low))
    found = located(queries.withColumn("_m", middle), keys, "_m", key)
    held = F.coalesce(F.col("last") >= F.col(a), F.lit(False)) | F.coalesce(F.col("next") <= F.col(b), F.lit(False))
    answer = F.when(F.col(a) > F.col(b), True).when(F.col(a).isNotNull() & F.col(b).isNotNull(), ~held)
    return found.withColumn("is_empty", answer).drop("below", "upto", "next", "last", "_m")


def first_in(keys: DataFrame, queries: DataFrame, key: str = "k", a: str = "a", b: str = "b") -> DataFrame:
    """queries with first_key, the least key in [a, b], or null."""
    return located(queries, keys, a, key).withColumn("first_key", F.when(F.col("next") <= F.col(b), F.col("next"))).drop("below", "upto", "next", "last")


def counted(keys: DataFrame, queries: DataFrame, key: str = "k", a: str = "a", b: str = "b") -> DataFrame:
    """queries with lo and hi, the half-open interval of ranks of the keys in [a, b]."""
    low = located(queries, keys, a, key).drop("upto", "next", "last").withColumnRenamed("below", "lo")
    return located(low, keys, b, key).drop("below", "next", "last").withColumnRenamed("upto", "hi").withColumn("hi", F.greatest("lo", "hi"))


def blocks(keys: DataFrame, w: int, key: str = "k", n: int | None = None) -> DataFrame:
    """(blk, n, lo, hi, first_key, last_key): occupied blocks of w-bit keys by their first bits; lo..hi are the block's ranks.

    As many blocks as the greatest power of two up to the number of keys.
    """
    from voidscan.operators.order import ranked

    n = keys.count() if n is None else n
    shift = w - min(w, block_bits(n))
    return ranked(keys, key).groupBy(F.shiftrightunsigned(key, shift).alias("blk")).agg(
        F.count("*").alias("n"), F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def stats(keys: DataFrame, w: int, key: str = "k") -> DataFrame:
    """One row: n, blocks, occupied, average and greatest keys of an occupied block, share of empty blocks, size in bits by the model."""
    n = keys.count()
    k = min(w, block_bits(n))
    size = keys.groupBy(F.shiftrightunsigned(key, w - k).alias("blk")).agg(F.count("*").alias("n"))
    return size.agg(F.lit(n).cast("long").alias("n"), F.lit(1 << k).cast("long").alias("blocks"), F.count("*").alias("occupied"), F.avg("n").alias("avg_keys"), F.max("n").alias("max_keys"),
                    (1 - F.count("*") / F.lit(1 << k)).alias("empty_share"), F.lit(exact_bits(n, w)).cast("long").alias("size_bits"))


def checked_sorted(keys: DataFrame, key: str = "k", pos: str = "pos") -> DataFrame:
    """keys in the order of pos; an error if a key is less than the one before it.  Slices are checked apart and against their neighbours."""
    from pyspark.sql import Window

    from voidscan.operators.order import sliced

    s = sliced(keys, pos)
    before = F.lag(key).over(Window.partitionBy("slice").orderBy(pos))
    per = s.groupBy("slice").agg(F.max(F.struct(F.col(pos), F.col(key).alias("v"))).alias("e"))
    ends = per.select("slice", F.lag("e").over(Window.orderBy("slice"))["v"].alias("_e"))
    out = s.join(F.broadcast(ends), "slice").withColumn("_b", F.coalesce(before, "_e"))
    return out.withColumn(key, F.when(F.col("_b") > F.col(key), F.raise_error(F.lit("keys are not sorted")).cast(keys.schema[key].dataType)).otherwise(F.col(key))).drop("slice", "_b", "_e")
