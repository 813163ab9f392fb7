"""Approximate range emptiness: no false negatives, false positives at a chosen rate.

A filter maps keys to fingerprints of K bits, keeps the distinct ones, and maps a query interval to intervals of fingerprints; the exact
operator answers those.  Filters are tables (fp), parameters plain values, so building is a projection and a distinct, and a batch of queries
one ordered look-up.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscan.functions.bits import bitlen, mask, universal
from voidscan.functions.sizes import bloom_shape, exact_bits, point_rate
from voidscan.operators.exact import is_empty


@dataclass
class Filter:
    """A filter of one key set: its distinct fingerprints and what maps a query.

    half: keys and query bounds lose that many low bits first, so that differences of the widest keys stay in a BIGINT; lo and hi are such.
    """

    kind: str
    fp: DataFrame
    k: int
    n: int
    lo: int | None = None
    hi: int | None = None
    shift: int = 0
    a: int = 1
    b: int = 0
    half: int = 0

    def size_bits(self) -> int:
        """Size model: an exact index of the distinct fingerprints."""
        return exact_bits(self.fp.count(), self.k)


def bounds(keys: DataFrame, key: str = "k") -> tuple[int, int | None, int | None]:
    """(rows, least, greatest) of the keys; null keys don't count."""
    r = keys.agg(F.count(key), F.min(key), F.max(key)).first()
    return r[0], r[1], r[2]


def halved(keys: DataFrame, key: str = "k") -> tuple[DataFrame, int, int | None, int | None, int]:
    """(keys, rows, least, greatest, half): not-null keys, without their last bit (half = 1) if their spread needs 64 bits."""
    n, lo, hi = bounds(keys, key)
    half = int(bool(n) and hi - lo >= 2**63)
    some = keys.where(F.col(key).isNotNull()).select(F.shiftright(F.col(key).cast("long"), half).alias(key))
    return some, n, lo >> half if n else None, hi >> half if n else None, half


def default_hash(n: int, length: int) -> tuple[int, int]:
    """(a odd, b): constants of the pairwise hash, fixed for a size and a length."""
    x = (n * 0x9E3779B97F4A7C15 ^ length * 0xD1342543DE82EF95) & (2**62 - 1)
    return x | 1, (x * 0x2545F4914F6CDD1D) & (2**62 - 1)


def pairwise(block: Column, a: int, b: int, k: int) -> Column:
    """Top k bits of the 128-bit number a * block + b, exact while it stays below 10**38."""
    wide = F.lit(Decimal(a)).cast("decimal(20,0)") * block.cast("decimal(19,0)") + F.lit(Decimal(b)).cast("decimal(20,0)")
    return F.call_function("div", wide.cast("decimal(38,0)"), F.lit(Decimal(2 ** (128 - k))).cast("decimal(38,0)")).cast("long") if k > 1 else F.lit(0).cast("long")


def soda_map(x: Column, k: int, a: int, b: int) -> Column:
    """Fingerprint: the offset in its block of 2**k, rotated by the block's hash."""
    return (pairwise(F.shiftright(x, k), a, b, k) + x.bitwiseAND(F.lit(mask(k)))).bitwiseAND(F.lit(mask(k)))


def trunc(keys: DataFrame, k: int, key: str = "k") -> Filter:
    """The first k bits below the top bit of the spread."""
    some, n, lo, hi, half = halved(keys, key)
    shift = max(0, (hi - lo).bit_length() - k) if n else 0
    return Filter("trunc", some.select(F.shiftright(F.col(key) - F.lit(lo or 0), shift).alias("fp")).distinct(), k, n, lo, hi, shift, half=half)


def soda(keys: DataFrame, k: int, length: int, key: str = "k", constants: tuple[int, int] | None = None) -> Filter:
    """Block-wise rotation by a pairwise hash: short intervals keep their shape."""
    n, lo, hi = bounds(keys, key)
    a, b = constants or default_hash(n, length)
    fp = keys.where(F.col(key).isNotNull()).select(soda_map(F.col(key), k, a, b).alias("fp")).distinct()
    return Filter("soda", fp, k, n, None, None, 0, a, b)


def adaptive(keys: DataFrame, k: int, length: int, key: str = "k", constants: tuple[int, int] | None = None, t: int = 0) -> Filter:
    """Exact where the spread fits k bits, else the rotation of key - least.  t: low bits that keys and query bounds lose first."""
    some, n, lo, hi, half = halved(keys, key)
    drop = max(t, half)
    if drop > half:
        some, lo, hi = some.select(F.shiftright(key, drop - half).alias(key)), lo >> (drop - half) if n else None, hi >> (drop - half) if n else None
    m = (hi - lo).bit_length() if n else 0
    x = F.col(key) - F.lit(lo or 0)
    if m <= k:
        return Filter("exact", some.select(x.alias("fp")).distinct(), m, n, lo, hi, half=drop)
    a, b = constants or default_hash(n, length)
    return Filter("soda", some.select(soda_map(x, k, a, b).alias("fp")).distinct(), k, n, lo, hi, 0, a, b, drop)


def cdf(keys: DataFrame, length: int, eps: float, step: int = 128, blend: float = 0.0, key: str = "k") -> tuple[Filter, DataFrame]:
    """A filter over a piecewise-linear map by ranks, and its knots (k0, k1, y0, y1).

    Dense stretches get more of the fingerprint space.  blend: share of a uniform map that is mixed in.  The knots are every `step`-th key; the
    map rises with the key, so order is kept and no key is lost.
    """
    from voidscan.functions.sizes import ceil_log2
    from voidscan.operators.order import neighbours, ranked
    from voidscan.plans.stage import staged

    keys, n, lo, hi, half = halved(keys, key)
    r = ranked(keys.distinct(), key)
    total = r.count()
    knots = staged(r.where((F.col("rank") % step == 0) | (F.col("rank") == total - 1)).select(F.col(key).alias("k0"), F.col("rank").alias("r0")))
    before = neighbours(knots, "k0", "r0").where("prev is not null").select(F.col("prev").alias("k0"), F.col("k0").alias("k1"), F.col("r0").alias("r1"))
    knots = knots.join(before, "k0")
    density = knots.agg(F.max((F.col("r1") - F.col("r0")) / (F.col("k1") - F.col("k0")))).first()[0] or 1.0
    span = max(1, (hi or 0) - (lo or 0))
    stretch = length * ((1 - blend) * density + blend * total / span) * span / max(1, total)
    k = min(52, max(1, ceil_log2(max(1.0, n * max(1.0, stretch) / eps)))) if n else 1
    scale = float(mask(k)) / max(1, total - 1)
    even = lambda c: (F.col(c) - F.lit(lo or 0)) / F.lit(float(span)) * (total - 1)
    knots = staged(knots.select("k0", "k1", (((1 - blend) * F.col("r0") + blend * even("k0")) * scale).alias("y0"), (((1 - blend) * F.col("r1") + blend * even("k1")) * scale).alias("y1")))
    mapped = cdf_map(keys, knots, key, "fp", lo, hi, k)
    return Filter("cdf", mapped.select("fp").distinct(), k, n, lo, hi, half=half), knots


def cdf_map(rows: DataFrame, knots: DataFrame, column: str, out: str, lo: int | None, hi: int | None, k: int) -> DataFrame:
    """rows with the mapped column, clamped to the ends; the knot of a value is found by the ordered look-up."""
    from voidscan.operators.order import located

    v = F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi))
    at = located(rows.withColumn("_v", v).withColumn("_p", F.col("_v") + 1), knots.select(F.col("k0").alias("k")), "_p").withColumnRenamed("last", "k0").drop("below", "upto", "next", "_p")
    y = F.col("y0") + (F.col("_v") - F.col("k0")) / (F.col("k1") - F.col("k0")) * (F.col("y1") - F.col("y0"))
    return at.join(knots, "k0", "left").withColumn(out, F.coalesce(F.least(F.greatest(F.floor(y), F.lit(0)), F.lit(mask(k))), F.lit(0)).cast("long")).drop("_v", "k0", "k1", "y0", "y1")


def bloom_positions(v: Column, m: int, hashes: int) -> Column:
    """Bit positions of a value: two hashes make one of 62 bits for each probe."""
    return F.array(*[((universal(v, 2 * i) * F.lit(2**31).cast("long") + universal(v, 2 * i + 1)) % m) for i in range(hashes)])


def bloom(keys: DataFrame, length: int, eps: float, key: str = "k") -> tuple[DataFrame, int, int]:
    """(words, m, hashes): a Bloom filter of the points as a table (bucket, bitmap), built by mergeable bitmap aggregates."""
    n = keys.count()
    m, hashes = bloom_shape(max(1, n), point_rate(eps, length))
    p = keys.where(F.col(key).isNotNull()).select(F.explode(bloom_positions(F.col(key), m, hashes)).alias("p"))
    return p.groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bitmap")), m, hashes


def bloom_empty(words: DataFrame, m: int, hashes: int, queries: DataFrame, a: str = "a", b: str = "b", qid: str = "qid", most: int = 1 << 16) -> DataFrame:
    """queries with is_empty: no point of [a, b] may be a key.  Intervals of more than `most` points count as not empty: they can't be missed, and a
    filter of points says little about them (at its error rate one of so many points is a false one nearly always)."""
    width = F.col(b) - F.col(a)
    parts = queries.where((width >= 0) & (width < most)).select(qid, F.col(a).alias("_s"), F.col(b).alias("_t"))
    p = parts.select(qid, F.explode(F.sequence("_s", "_t")).alias("v")).select(qid, "v", F.explode(bloom_positions(F.col("v"), m, hashes)).alias("p")).select(
        qid, "v", F.expr("bitmap_bucket_number(p)").alias("bucket"), F.expr("bitmap_bit_position(p)").alias("at"))
    at = F.col("at").cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at % 8), F.lit(0)) == 1
    points = p.join(words, "bucket", "left").groupBy(qid, "v").agg(F.bool_and(hit).alias("may"))
    maybe = points.groupBy(qid).agg(F.bool_or("may").alias("_may"))
    return queries.join(maybe, qid, "left").withColumn("is_empty", F.when(F.col(a) > F.col(b), True).when(F.col(a).isNotNull() & F.col(b).isNotNull(), ~F.coalesce("_may", F.lit(True)))).drop("_may")


def soda_intervals(k: int, a: int, b: int, qa: Column, qb: Column) -> Column:
    """Intervals (lo, hi) of fingerprints that [qa, qb] may meet: two where a rotation wraps, the whole space for full blocks between."""
    top = F.lit(mask(k))
    block_a, block_b = F.shiftright(qa, k), F.shiftright(qb, k)
    ha, hb = pairwise(block_a, a, b, k), pairwise(block_b, a, b, k)
    turn = lambda h, off: (h + off).bitwiseAND(top)
    from_, to = turn(ha, qa.bitwiseAND(top)), turn(hb, qb.bitwiseAND(top))
    piece = lambda x, y: F.when(x <= y, F.array(F.struct(x.alias("lo"), y.alias("hi")))).otherwise(
        F.array(F.struct(x.alias("lo"), top.cast("long").alias("hi")), F.struct(F.lit(0).cast("long").alias("lo"), y.alias("hi"))))
    rest_of_a, start_of_b = turn(ha, top), turn(hb, F.lit(0).cast("long"))
    return (F.when(block_a == block_b, piece(from_, to)).when(block_b > block_a + 1, F.array(F.struct(F.lit(0).cast("long").alias("lo"), top.cast("long").alias("hi"))))
            .otherwise(F.concat(piece(from_, rest_of_a), piece(start_of_b, to))))


def answer(f: Filter, queries: DataFrame, a: str = "a", b: str = "b", qid: str = "qid", knots: DataFrame | None = None) -> DataFrame:
    """queries with is_empty by a filter.  Bounds are clamped to the keys' least and greatest on both sides; a > b is empty; null gives null."""
    if not f.n:
        return queries.withColumn("is_empty", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), True))
    ca, cb = F.shiftright(F.col(a).cast("long"), f.half), F.shiftright(F.col(b).cast("long"), f.half)
    meets = F.col(a) <= F.col(b)
    if f.lo is not None:
        meets = meets & (cb >= f.lo)
        ca = F.greatest(ca, F.lit(f.lo))
    if f.hi is not None:
        meets = meets & (ca <= f.hi)
        cb = F.least(cb, F.lit(f.hi))
    live = queries.where(meets).select(qid, ca.alias("_a"), cb.alias("_b"))
    base = F.lit(f.lo or 0)
    if f.kind == "cdf":
        m = cdf_map(cdf_map(live, knots, "_a", "lo", f.lo, f.hi, f.k), knots, "_b", "hi", f.lo, f.hi, f.k)
        parts = m.select(qid, "lo", "hi")
    elif f.kind == "soda":
        parts = live.select(qid, F.inline(soda_intervals(f.k, f.a, f.b, F.col("_a") - base, F.col("_b") - base)))
    else:
        parts = live.select(qid, F.shiftright(F.col("_a") - base, f.shift).alias("lo"), F.shiftright(F.col("_b") - base, f.shift).alias("hi"))
    got = is_empty(f.fp, parts, "fp", "lo", "hi").groupBy(qid).agg(F.bool_and("is_empty").alias("_e"))
    return queries.join(got, qid, "left").withColumn("is_empty", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.coalesce("_e", F.lit(True)))).drop("_e")


def spread_bits(keys: DataFrame, key: str = "k") -> DataFrame:
    """One row: bits of the spread, whether an exact filter of k bits holds it is bits <= k."""
    return keys.agg(bitlen(F.max(key) - F.min(key)).cast("long").alias("bits"))
