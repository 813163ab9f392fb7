"""Deterministic key and query generators: expressions over ranges, the same rows for the same arguments on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscan.functions.bits import universal


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its parts."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))


def gaussian(seed: int, *parts: Column) -> Column:
    """A standard normal value, by two uniform ones."""
    a, b = unit(F.lit(seed), *parts, F.lit("a")), unit(F.lit(seed), *parts, F.lit("b"))
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * 3.141592653589793 * b)


def sample_gaussian(center: Column, deviation: Column, seed: int, *parts: Column) -> Column:
    """A whole number about center; below 0 or beyond 63 bits it is 0."""
    v = center + deviation * gaussian(seed, *parts)
    return F.when((v < 0) | (v >= float(2**63)), F.lit(0)).otherwise(F.floor(v)).cast("long")


def uniform(spark: SparkSession, n: int, bits: int, seed: int = 42) -> DataFrame:
    """(k): up to n distinct keys of some bits."""
    return spark.range(n).select(F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << bits) - 1)).alias("k")).distinct()


def sequential(spark: SparkSession, n: int, base: int = 1000, gap: int = 1000) -> DataFrame:
    return spark.range(n).select((F.col("id") * gap + base).alias("k"))


def zipf(spark: SparkSession, n: int, exponent: float = 1.5, top: int = 1 << 40, seed: int = 42) -> DataFrame:
    """(k): distinct keys of a power law, by inversion."""
    u = unit(F.lit(seed), F.col("id"))
    return spark.range(n).select(F.least(F.floor(F.pow(1 - u, F.lit(-1 / (exponent - 1)))), F.lit(float(top))).cast("long").alias("k")).distinct()


def clusters(spark: SparkSession, count: int = 5, bits: int = 60, seed: int = 42) -> DataFrame:
    """(cluster_id, center, deviation): centres anywhere, deviations 2**20 to 2**29."""
    return spark.range(count).select(F.col("id").cast("int").alias("cluster_id"), F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << bits) - 1)).alias("center"), F.pow(F.lit(2.0), 20 + F.pmod(F.col("id") * 7, F.lit(10))).alias("deviation"))


def clustered(spark: SparkSession, n: int, count: int = 5, uniform_share: float = 0.15, bits: int = 60, seed: int = 42) -> DataFrame:
    """(k): distinct keys, a share of them anywhere, the rest about the centres."""
    c = F.broadcast(clusters(spark, count, bits, seed).withColumnRenamed("cluster_id", "_c"))  # `count` rows
    r = spark.range(n).withColumn("_c", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(count)).cast("int")).join(c, "_c")
    anywhere = F.xxhash64("id", F.lit(seed + 2)).bitwiseAND(F.lit((1 << bits) - 1))
    return r.select(F.when(unit(F.lit(seed + 3), F.col("id")) < uniform_share, anywhere).otherwise(sample_gaussian(F.col("center"), F.col("deviation"), seed, F.col("id"))).alias("k")).distinct()


def cluster_queries(spark: SparkSession, n: int, width: int, count: int = 5, uniform_share: float = 0.15, bits: int = 60, seed: int = 42) -> DataFrame:
    """(qid, a, b): intervals of `width` points, most of them about the centres."""
    c = F.broadcast(clusters(spark, count, bits, seed).withColumnRenamed("cluster_id", "_c"))  # `count` rows
    r = spark.range(n).withColumn("_c", F.pmod(F.xxhash64("id", F.lit(seed + 11)), F.lit(count)).cast("int")).join(c, "_c")
    a = F.when(unit(F.lit(seed + 12), F.col("id")) < uniform_share, F.xxhash64("id", F.lit(seed + 13)).bitwiseAND(F.lit((1 << bits) - 1))).otherwise(sample_gaussian(F.col("center"), F.col("deviation"), seed + 14, F.col("id")))
    return r.select(F.col("id").alias("qid"), a.alias("a"), (a + (width - 1)).alias("b"))


def spread(spark: SparkSession, n: int, low_bits: int = 20, bits: int = 60, seed: int = 42) -> DataFrame:
    """(k): low bits count up, high bits are random: a map that keeps only high bits gains nothing."""
    high = F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << (bits - low_bits)) - 1))
    return spark.range(n).select(F.shiftleft(high, low_bits).bitwiseOR(F.col("id").bitwiseAND(F.lit((1 << low_bits) - 1))).alias("k")).distinct()


def shared_low_bits(spark: SparkSession, n: int, groups: int, low_bits: int = 20, bits: int = 60, seed: int = 42) -> DataFrame:
    """(k): n keys in some groups that agree in their low bits."""
    low = F.xxhash64(F.pmod("id", F.lit(groups)), F.lit(seed)).bitwiseAND(F.lit((1 << low_bits) - 1))
    return spark.range(n).select(F.shiftleft(F.xxhash64("id", F.lit(seed + 1)).bitwiseAND(F.lit((1 << (bits - low_bits)) - 1)), low_bits).bitwiseOR(low).alias("k")).distinct()


def gap_queries(keys: DataFrame, width: int, seed: int = 42, key: str = "k") -> DataFrame:
    """(qid, a, b): an interval strictly inside each gap between neighbours that has room."""
    from voidscan.operators.order import neighbours

    g = neighbours(keys, key).where(F.col(key) - F.col("prev") > 2)
    room = F.col(key) - F.col("prev") - 1
    size = F.least(F.lit(width), room)
    a = F.col("prev") + 1 + F.floor(unit(F.lit(seed), F.col("rank")) * (room - size + 1)).cast("long")
    return g.select(F.col("rank").alias("qid"), a.alias("a"), (a + size - 1).alias("b"))


def uniform_queries(spark: SparkSession, n: int, width: int, bits: int = 60, seed: int = 42) -> DataFrame:
    a = F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << bits) - 1))
    return spark.range(n).select(F.col("id").alias("qid"), a.alias("a"), (a + (width - 1)).alias("b"))


def property_queries(keys: DataFrame, key: str = "k", reach: int = 50) -> DataFrame:
    """(kind, a, b): queries that all hold a key: points, overhangs by one, spans to a later key, and the whole range."""
    from voidscan.operators.order import ranked

    r = ranked(keys.select(key).distinct(), key)
    far = r.select((F.col("rank") - universal("rank", 0) % reach - 1).alias("rank"), F.col(key).alias("b")).join(r.select("rank", F.col(key).alias("a")), "rank").select(F.lit("span").alias("kind"), "a", "b")
    one = lambda kind, a, b: r.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    k = F.col(key)
    whole = keys.agg(F.min(key).alias("a"), F.max(key).alias("b")).select(F.lit("whole").alias("kind"), "a", "b")
    return one("point", k, k).unionByName(one("left", k - 1, k)).unionByName(one("right", k, k + 1)).unionByName(far).unionByName(whole)


def bit_texts(spark: SparkSession, n: int, length: int, seed: int = 42) -> DataFrame:
    """(key): distinct texts of 0 and 1."""
    parts = [F.lpad(F.bin(F.xxhash64("id", F.lit(seed), F.lit(i)).bitwiseAND(F.lit(2**32 - 1))), 32, "0") for i in range(-(-length // 32))]
    return spark.range(n).select(F.substring(F.concat(*parts), 1, length).alias("key")).distinct()


