"""Composite filters: a filter for each segment and one for the keys outside all segments.

Segments' fingerprints are one table, coded as seg * 2**64 + fp in DECIMAL(38), so all segments are answered by one ordered look-up.  Of the
segments that a query overlaps only the first and the last can be cut by its ends; one between them lies inside and holds keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscan.functions.bits import bitlen
from voidscan.functions.sizes import budget_bits, exact_bits_column, hybrid_bits, scan_eps
from voidscan.operators import approx, segments as sg
from voidscan.operators.exact import is_empty
from voidscan.operators.order import located
from voidscan.plans.stage import staged


@dataclass
class Composite:
    segments: DataFrame  # seg, min_k, max_k, n, m (bits of the spread)
    fp: DataFrame  # seg, fp
    k: int
    n: int
    a: int
    b: int
    rest: approx.Filter | None
    n_rest: int
    half: int = 0
    base: int = 0


def _moved(keys: DataFrame, key: str) -> tuple[DataFrame, int, int]:
    """(keys as k, half, base): keys counted from the least one; without their last bit (half = 1) if their spread needs more than 62 bits."""
    n, lo, hi = approx.bounds(keys, key)
    half = int(bool(n) and hi - lo >= 2**62) + int(bool(n) and hi - lo >= 2**63)
    base = lo >> half if n else 0
    return keys.where(F.col(key).isNotNull()).select((F.shiftright(F.col(key).cast("long"), half) - base).alias("k")), half, base


def _code(seg: Column, fp: Column) -> Column:
    return (seg.cast("decimal(18,0)") * F.lit(Decimal(2**63)) + fp.cast("decimal(20,0)")).cast("decimal(38,0)")


def build(keys: DataFrame, segments: DataFrame, k: int, length: int, policy: str = "auto", key: str = "k", eps: float = 0.01) -> Composite:
    """Segments get an exact filter where their spread fits k bits and the rotation else; the rest by policy."""
    some = staged(keys.select(F.col(key).alias("k")).where(F.col(key).isNotNull()).distinct())
    n = some.count()
    k = min(k, 62)
    segs = staged(segments.withColumn("m", bitlen(F.col("max_k") - F.col("min_k"))))
    a, b = approx.default_hash(n, length)
    at = staged(sg.placed(some, segs))
    inside = sg._inside(at, "k").join(segs, "seg")
    x = F.col("k") - F.col("min_k")
    fp = staged(inside.select("seg", F.when(F.col("m") <= k, x).otherwise(approx.soda_map(x, k, a, b)).alias("fp")).distinct())
    rest = at.where("s0 >= s1").select("k")
    n_rest = rest.count()
    f = None
    if n_rest:
        f = approx.trunc(rest, k) if sg.uses_trunc(policy, sg.gap_facts(rest, k), k, length, eps) else approx.adaptive(rest, k, length)
    return Composite(segs, fp, k, n, a, b, f, n_rest)


def answer(c: Composite, queries: DataFrame, a: str = "a", b: str = "b", qid: str = "qid") -> DataFrame:
    """queries with is_empty: empty in every segment and in the rest.  a > b is empty; a null bound gives null."""
    moved = lambda x: F.shiftright(F.col(x).cast("long"), c.half)
    # bounds beyond the keys on either side may be moved in: none lies there
    inner = lambda x: F.least(F.greatest(moved(x), F.lit(max(c.base - 1, -(2**63)))), F.lit(min(c.base + 2**62, 2**63 - 1))) - F.lit(c.base)
    live = queries.where(F.col(a) <= F.col(b)).select(qid, inner(a).alias("_a"), inner(b).alias("_b"))
    low = located(live, c.segments, "_a", "max_k").select(qid, "_a", "_b", F.col("below").alias("s0"))
    over = staged(located(low, c.segments, "_b", "min_k").select(qid, "_a", "_b", "s0", F.col("upto").alias("s1")).where("s0 < s1"))
    between = over.where("s1 - s0 > 2").select(qid, F.lit(False).alias("e"))
    ends = over.where("s1 - s0 <= 2").select(qid, "_a", "_b", F.explode(F.sequence("s0", F.col("s1") - 1)).alias("seg")).join(c.segments, "seg")
    qa, qb = F.greatest("_a", "min_k") - F.col("min_k"), F.least("_b", "max_k") - F.col("min_k")
    exact = F.array(F.struct(qa.alias("lo"), qb.alias("hi")))
    parts = ends.select(qid, "seg", F.inline(F.when(F.col("m") <= c.k, exact).otherwise(approx.soda_intervals(c.k, c.a, c.b, qa, qb))))
    coded = parts.select(qid, _code(F.col("seg"), F.col("lo")).alias("lo"), _code(F.col("seg"), F.col("hi")).alias("hi"))
    looked = is_empty(c.fp.select(_code(F.col("seg"), F.col("fp")).alias("k")), coded, "k", "lo", "hi").select(qid, F.col("is_empty").alias("e"))
    every = between.unionByName(looked)
    if c.rest is not None:
        every = every.unionByName(approx.answer(c.rest, live.select(qid, F.col("_a").alias(a), F.col("_b").alias(b)), a, b, qid).select(qid, F.col("is_empty").alias("e")))
    got = every.groupBy(qid).agg(F.bool_and("e").alias("_e"))
    return queries.join(got, qid, "left").withColumn("is_empty", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.coalesce("_e", F.lit(True)))).drop("_e")


def stats(c: Composite) -> DataFrame:
    """One row: clusters, keys outside, n, and size in bits by the model with 128 for each cluster."""
    per = c.fp.groupBy("seg").agg(F.count("*").alias("d")).join(c.segments, "seg")
    bits = per.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(exact_bits_column(F.col("d"), F.least(F.col("m"), F.lit(c.k))) + 128), F.lit(0)).alias("bits"))
    rest = c.rest.size_bits() if c.rest else 0
    return bits.select("clusters", F.lit(c.n_rest).cast("long").alias("outside"), F.lit(c.n).cast("long").alias("n"), (F.col("bits") + rest).cast("long").alias("size_bits"))


def hybrid(keys: DataFrame, length: int, eps: float = 0.01, k: int | None = None, key: str = "k", bits_per_key: float | None = None) -> Composite:
    """Segments by gaps; the rest truncated.  Bits come from k, from a budget of bits per key, or from the error rate."""
    keys, half, base = _moved(keys, key)
    return _placed(build(keys, sg.gap_segments(keys), _bits(keys, length, eps, k, bits_per_key), length, "trunc"), half, base)


def hybrid_scan(keys: DataFrame, length: int, eps: float = 0.01, k: int | None = None, policy: str = "auto", min_points: int = 10, min_size: int = 256, radius: int | None = None, key: str = "k",
                bits_per_key: float | None = None) -> Composite:
    """Segments by density; the rest by policy."""
    keys, half, base = _moved(keys, key)
    given = k if bits_per_key is None else budget_bits(bits_per_key)
    if radius is None:
        radius = int(length / eps * 10) if given is None else scan_eps(keys.count(), length, given)
    radius = min(radius, 2**61) >> half
    segs = sg.density_segments(keys, radius, min_points, min_size)
    return _placed(build(keys, segs, _bits(keys, length, eps, k, bits_per_key), length, policy), half, base)


def greedy_scan(keys: DataFrame, length: int, eps: float = 0.01, k: int | None = None, merge: bool = True, key: str = "k") -> Composite:
    """Segments by spread, merged where that is cheaper; those that outgrow k bits are pooled and truncated."""
    keys, half, base = _moved(keys, key)
    k = _bits(keys, length, eps, k, None)
    segs = sg.spread_segments(keys, min(k, 62))
    segs = staged(sg.merged_segments(segs, k) if merge else segs)
    narrow = segs.where(bitlen(F.col("max_k") - F.col("min_k")) <= k)
    return _placed(build(keys, sg._numbered(narrow), k, length, "trunc"), half, base)


def dp_scan(keys: DataFrame, length: int, eps: float = 0.01, k: int | None = None, key: str = "k") -> Composite:
    """Segments of least cost; no key is outside."""
    keys, half, base = _moved(keys, key)
    k = _bits(keys, length, eps, k, None)
    return _placed(build(keys, sg.optimal_segments(keys, k), k, length, "trunc"), half, base)


def _bits(keys: DataFrame, length: int, eps: float, k: int | None, bits_per_key: float | None) -> int:
    if bits_per_key is not None:
        return budget_bits(bits_per_key)
    return hybrid_bits(keys.count(), length, eps) if k is None else k


def _placed(c: Composite, half: int, base: int) -> Composite:
    c.half, c.base = half, base
    return c
