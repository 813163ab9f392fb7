"""Order of keys at scale: one range exchange answers rank, successor and predecessor for any number of points.

Keys and points are brought together by value with a range exchange, so every partition holds a slice of the number line whatever the
distribution of the keys.  Window functions answer within the slice; a table with a row for each slice (as many as partitions) carries
counts, first and last keys over to the others.  No partition holds more than its slice, and no join is on inequality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voidscan.functions.bits import universal
from voidscan.plans.stage import counted, release, staged

#: Rows of a slice, about.
SLICE_ROWS = 1_000_000


def slices(df: DataFrame, rows: int) -> int:
    """Partitions for a range exchange of that many rows: one while a task holds them, then at least the session's shuffle partitions."""
    parts = -(-rows // SLICE_ROWS)
    return 1 if parts <= 1 else max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)


def sliced(df: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """df dealt by ranges of `by`, with the number of the slice as `slice`; slices are in the order of `by`.

    The rows are written first and counted on the way, and the sample that the ranges come from doesn't compute them once more.  The
    result is a table as well: all that is derived from it sees the same slices.
    """
    rows, n = counted(df)
    parts = parts or slices(df, n)
    if parts == 1:
        return rows.withColumn("slice", F.lit(0))
    out = staged(rows.repartitionByRange(parts, *by).withColumn("slice", F.spark_partition_id()))
    release(rows)
    return out


def _carried(per_slice: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Window columns over the table of slices, which has a row for each partition."""
    return per_slice.select("slice", *[c.alias(n) for n, c in columns.items()])


def ranked(keys: DataFrame, *by: str) -> DataFrame:
    """keys with `rank`, 0 for the first in the order of `by`; equal keys get different ranks."""
    s = sliced(keys, *by)
    local = s.withColumn("_r", F.row_number().over(Window.partitionBy("slice").orderBy(*by)))
    counts = local.groupBy("slice").agg(F.count("*").alias("n"))
    offset = _carried(counts, {"offset": F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return local.join(F.broadcast(offset), "slice").withColumn("rank", (F.col("_r") - 1 + F.col("offset")).cast("long")).drop("slice", "_r", "offset")


def located(points: DataFrame, keys: DataFrame, point: str, key: str = "k") -> DataFrame:
    """points with `below` (keys < point), `upto` (keys <= point), `next` (least key >= point) and `last` (greatest key < point).

    Equal keys count each; null keys don't.  A null point has nulls.  Points of one value are looked up once and joined back by value.
    """
    asked = points.select(F.col(point).alias("v"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("p"))
    held = keys.select(F.col(key).alias("v"), F.lit(1).cast("long").alias("c"), F.lit(False).alias("p"))
    both = held.unionByName(asked).where("v is not null").groupBy("v").agg(F.sum("c").alias("c"), F.max("p").alias("p"))
    s = sliced(both, "v")
    before = Window.partitionBy("slice").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # a running minimum from the end: a frame to the end in ascending order would be computed anew for each row
    after = Window.partitionBy("slice").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_key = F.when(F.col("c") > 0, F.col("v"))
    local = s.select("slice", "v", "c", "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("b"), F.min(is_key).over(after).alias("n"), F.max(is_key).over(before).alias("l"))
    per = local.groupBy("slice").agg(F.sum("c").alias("t"), F.min(F.when(F.col("c") > 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("c") > 0, F.col("v"))).alias("hi"))
    w = Window.orderBy("slice")
    carried = _carried(per, {
        "t0": F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n0": F.min("lo").over(Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)), "l0": F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    found = local.where("p").join(F.broadcast(carried), "slice").select(
        F.col("v").alias(point), (F.col("b") + F.col("t0")).alias("below"), (F.col("b") + F.col("t0") + F.col("c")).alias("upto"),
        F.coalesce("n", "n0").alias("next"), F.coalesce("l", "l0").alias("last"))
    return points.join(found, point, "left")


def rank_of(keys: DataFrame, asked: DataFrame, key: str = "k") -> DataFrame:
    """asked with `rank`: the ordinal of a key in the sorted distinct keys, -1 for what is none."""
    return asked.join(ranked(keys.select(key).where(F.col(key).isNotNull()).distinct(), key), key, "left").withColumn("rank", F.coalesce("rank", F.lit(-1).cast("long")))


def rank_pairs(keys: DataFrame, pairs: DataFrame, first: str, second: str, key: str = "k") -> DataFrame:
    """pairs with rank_first and rank_second, -1 for what is no key."""
    r = ranked(keys.select(key).where(F.col(key).isNotNull()).distinct(), key)
    out = pairs.join(r.select(F.col(key).alias(first), F.col("rank").alias("rank_first")), first, "left").join(r.select(F.col(key).alias(second), F.col("rank").alias("rank_second")), second, "left")
    return out.fillna(-1, ["rank_first", "rank_second"])


def select_kth(keys: DataFrame, ordinals: DataFrame, ordinal: str = "i", key: str = "k") -> DataFrame:
    """ordinals with the key of each rank; null beyond the last."""
    return ordinals.join(ranked(keys.select(key).where(F.col(key).isNotNull()), key).withColumnRenamed("rank", ordinal), ordinal, "left")


def slots(keys: DataFrame, key: str = "k") -> DataFrame:
    """(key, slot): a minimal perfect hash, each distinct key its own number of 1..n in the order of hashes."""
    h = keys.select(key).where(F.col(key).isNotNull()).distinct()
    h = h.withColumn("_h", universal(F.col(key), 0) if dict(h.dtypes)[key] == "bigint" else F.xxhash64(key))
    return ranked(h, "_h", key).select(key, (F.col("rank") + 1).alias("slot"))


def slot_of(table: DataFrame, asked: DataFrame, key: str = "k") -> DataFrame:
    """asked with its slot; 0 for what is no key."""
    return asked.join(table, key, "left").withColumn("slot", F.coalesce("slot", F.lit(0).cast("long")))


# ---- bit vectors: rows (pos, bit)


def bit_ranks(bits: DataFrame) -> DataFrame:
    """bits with ones and zeros before each position."""
    s = sliced(bits.select("pos", F.col("bit").cast("int").alias("bit")), "pos")
    before = Window.partitionBy("slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumns({"_o": F.coalesce(F.sum("bit").over(before), F.lit(0)), "_n": F.row_number().over(Window.partitionBy("slice").orderBy("pos")) - 1})
    per = local.groupBy("slice").agg(F.sum("bit").alias("o"), F.count("*").alias("n"))
    w = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    off = _carried(per, {"o0": F.coalesce(F.sum("o").over(w), F.lit(0)), "n0": F.coalesce(F.sum("n").over(w), F.lit(0))})
    out = local.join(F.broadcast(off), "slice")
    ones = F.col("_o") + F.col("o0")
    return out.select("pos", "bit", ones.alias("ones_before"), (F.col("_n") + F.col("n0") - ones).alias("zeros_before"))


def bit_totals(bits: DataFrame) -> DataFrame:
    """One row: num, ones, zeros."""
    return bits.agg(F.count("*").alias("num"), F.coalesce(F.sum(F.col("bit").cast("long")), F.lit(0)).alias("ones"), F.coalesce(F.sum(1 - F.col("bit").cast("long")), F.lit(0)).alias("zeros"))


def bit_select(bits: DataFrame, asked: DataFrame, ordinal: str = "i", of: str = "bit") -> DataFrame:
    """asked (i, bit) with the position of the (i + 1)-th such bit; the vector's length if there are no more."""
    r = bit_ranks(bits)
    places = r.select(F.when(F.col("bit") == 1, F.col("ones_before")).otherwise(F.col("zeros_before")).alias(ordinal), F.col("bit").alias(of), "pos")
    num = bit_totals(bits).select("num")  # one row
    return asked.join(places, [ordinal, of], "left").join(F.broadcast(num)).withColumn("pos", F.coalesce("pos", "num")).drop("num")


def bit_rank_at(bits: DataFrame, asked: DataFrame, pos: str = "pos") -> DataFrame:
    """asked with ones and zeros before pos; the totals beyond the end."""
    totals = F.broadcast(bit_totals(bits))  # one row
    out = asked.join(bit_ranks(bits).withColumnRenamed("pos", pos), pos, "left").join(totals)
    return out.select(*asked.columns, "bit", F.coalesce("ones_before", "ones").alias("ones_before"), F.coalesce("zeros_before", "zeros").alias("zeros_before"))


def runs(bits: DataFrame) -> DataFrame:
    """(first, last, bit, length): maximal runs of equal bits, within and across slices."""
    r = bit_ranks(bits)
    island = F.when(F.col("bit") == 1, F.col("zeros_before") * 2).otherwise(F.col("ones_before") * 2 + 1)
    return r.groupBy(island.alias("_i"), "bit").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("length")).drop("_i")


# ---- neighbours, running sums, order statistics


def neighbours(keys: DataFrame, key: str = "k", *keep: str) -> DataFrame:
    """Distinct keys with `prev`, the key before, and `rank`; null for the first."""
    some = keys.select(key, *keep).where(F.col(key).isNotNull()).dropDuplicates([key])
    s = sliced(some, key)
    w = Window.partitionBy("slice").orderBy(key)
    local = s.withColumns({"_p": F.lag(key).over(w), "_r": F.row_number().over(w)})
    per = s.groupBy("slice").agg(F.count("*").alias("n"), F.max(key).alias("hi"))
    o = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    off = _carried(per, {"n0": F.coalesce(F.sum("n").over(o), F.lit(0)), "p0": F.max("hi").over(o)})
    return local.join(F.broadcast(off), "slice").select(key, *keep, F.coalesce("_p", "p0").alias("prev"), (F.col("_r") - 1 + F.col("n0")).cast("long").alias("rank"))


def running_sum(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """df with the sum of `value` over all rows up to each, in the order of the distinct column `by`."""
    s = sliced(df, by)
    local = s.withColumn("_s", F.sum(value).over(Window.partitionBy("slice").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
    per = s.groupBy("slice").agg(F.sum(value).alias("t"))
    off = _carried(per, {"t0": F.coalesce(F.sum("t").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return local.join(F.broadcast(off), "slice").withColumn(out, F.col("_s") + F.col("t0")).drop("slice", "_s", "t0")


def kth_smallest(df: DataFrame, column: str, k: int):
    """The value of rank k (0 the least) of a column, or None.  Equal values are counted before they are put in order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    upto = running_sum(counts, column, "_n", "_upto")
    return upto.where(F.col("_upto") > k).agg(F.min(column)).first()[0] if k >= 0 else None
