"""Segmentation of a key set into dense runs.

All of it is built from ordered look-ups, so a cluster may hold any share of the keys.  Segments are tables (seg, min_k, max_k, n), seg
counting from 0 in key order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voidscan.operators.order import kth_smallest, located, neighbours, ranked, running_sum, sliced
from voidscan.plans.stage import counted, importable, staged


def _islands(rows: DataFrame, cut, key: str) -> DataFrame:
    """(seg, min_k, max_k, n) of rows (key, ...) where `cut` starts a new run."""
    numbered = running_sum(rows.withColumn("_c", F.when(cut, 1).otherwise(0)), key, "_c", "_seg")
    return numbered.groupBy((F.col("_seg")).alias("_seg")).agg(F.min(key).alias("min_k"), F.max(key).alias("max_k"), F.count("*").alias("n"))


def _numbered(segments: DataFrame) -> DataFrame:
    """Segments with seg = 0, 1, ... by min_k."""
    return ranked(segments, "min_k").select(F.col("rank").alias("seg"), "min_k", "max_k", "n")


def gap_segments(keys: DataFrame, percentile: float = 0.95, share: float = 0.01, key: str = "k") -> DataFrame:
    """Runs cut at gaps above the gap of order min(floor(percentile * gaps), gaps - 1); runs of max(2, floor(share * n)) keys stay."""
    nb = staged(neighbours(keys, key))
    n = nb.count()
    if n < 2:
        return nb.select(F.lit(0).cast("long").alias("seg"), F.col(key).alias("min_k"), F.col(key).alias("max_k"), F.lit(1).cast("long").alias("n")).where("false")
    gap = F.coalesce(F.try_subtract(key, "prev"), F.lit(2**63 - 1))  # the widest gaps count as that
    limit = kth_smallest(nb.where("prev is not null").select(gap.alias("gap")), "gap", min(int(percentile * (n - 1)), n - 2))
    runs = _islands(nb, F.col("prev").isNull() | (gap > limit), key)
    return _numbered(runs.where(F.col("n") >= max(2, int(share * n))))


def density_segments(keys: DataFrame, eps: int, min_points: int = 10, min_size: int = 256, key: str = "k") -> DataFrame:
    """Density clusters: a key is a core if `min_points` keys, itself included, lie within eps on one side of it; cores at most eps apart
    are one cluster; keys within eps of its ends join it.  Clusters of fewer than min_size keys are left out.  A border key may belong to two."""
    distinct = staged(neighbours(keys, key).select(key, "rank"))
    low = lambda c: F.coalesce(F.try_subtract(c, F.lit(eps)), F.lit(-(2**63)))
    high = lambda c: F.coalesce(F.try_add(c, F.lit(eps)), F.lit(2**63 - 1))
    # of two keys min_points - 1 ranks apart both are cores if they lie within eps, and no key is a core otherwise
    far = distinct.select((F.col("rank") - (max(min_points, 1) - 1)).alias("rank"), F.col(key).alias("_far"))
    close = distinct.join(far, "rank").where(F.coalesce(F.try_subtract("_far", key), F.lit(2**63 - 1)) <= eps)
    cores = close.select(F.explode(F.array(key, "_far")).alias(key))
    nb = neighbours(cores, key)
    gap = F.coalesce(F.try_subtract(key, "prev"), F.lit(2**63 - 1))
    runs = _islands(nb, F.col("prev").isNull() | (gap > eps), key).select(low(F.col("min_k")).alias("_a"), high(F.col("max_k")).alias("_b"))
    runs = staged(runs)
    at = staged(located(runs.select(F.explode(F.array("_a", "_b")).alias("v")).distinct(), distinct, "v", key))
    begin = runs.join(at.select(F.col("v").alias("_a"), F.col("below").alias("r0"), F.col("next").alias("min_k")), "_a")
    end = begin.join(at.select(F.col("v").alias("_b"), F.col("upto").alias("r1")), "_b").select("min_k", "r1", (F.col("r1") - F.col("r0")).alias("n")).where(F.col("n") >= min_size)
    ends = end.join(distinct.select((F.col("rank") + 1).alias("r1"), F.col(key).alias("max_k")), "r1")
    return _numbered(ends.select("min_k", "max_k", "n"))


def _leaps(v: np.ndarray, k: int) -> np.ndarray:
    """For each of the sorted keys the place of the first one beyond key + 2**k - 1; len(v) if there is none."""
    top = np.iinfo(np.int64).max
    fits = v <= top - (1 << k)
    return np.where(fits, np.searchsorted(v, np.where(fits, v, 0) + (1 << k)), len(v))


def _ways(v: np.ndarray, k: int, before: int | None) -> pd.DataFrame:
    """(hi, start): where greedy runs leave a slice of sorted keys.  Runs that enter it at a key up to hi, and after the hi before, have `start` as
    the start of their last run there.  before: the greatest key of the slices before; null for the first, which is entered at its least key."""
    leap, at = _leaps(v, k), np.arange(len(v))
    last = np.where(leap < len(v), leap, at)
    while not np.array_equal(beyond := last[last], last):
        last = beyond
    # a run that started before this slice ends at before + 2**k - 1 at the latest
    most = 1 if before is None else len(v) if before + (1 << k) > int(v[-1]) else int(np.searchsorted(v, before + (1 << k))) + 1
    ends = np.flatnonzero(np.append(np.diff(last[:most]) != 0, True))
    return pd.DataFrame({"hi": v[ends], "start": v[last[ends]]})


def _entered(s: DataFrame, k: int, key: str) -> dict[int, tuple[int | None, int | None]]:
    """slice: (least key that may start a run in it, null if none does; start of the run that reaches into it, null for the first)."""
    bounds = sorted(map(tuple, s.groupBy("slice").agg(F.min(key), F.max(key)).collect()))  # a row for each slice
    first, least, _ = bounds[0]
    if len(bounds) == 1:
        return {first: (least, None)}
    before = {b[0]: a[2] for a, b in zip(bounds, bounds[1:])}

    def ways(which, p):
        return _ways(np.sort(p[key].to_numpy()), k, before.get(int(which[0]))).assign(slice=int(which[0]))

    places = staged(s.groupBy("slice").applyInPandas(ways, "slice int, hi long, start long"))
    to = F.try_add("start", F.lit(1 << k))  # null beyond the greatest number
    jump = staged(located(places.withColumn("to", to).where("to is not null"), places.select("hi"), "to", "hi").select(F.col("hi").alias("at"), "start", F.col("next").alias("to")).where("to is not null"))
    hop, seen, held = jump.select("at", "to"), staged(places.where(F.col("slice") == first).select(F.col("hi").alias("at"))), 1
    while True:  # a hop leaves a slice: the rounds are the logarithm of the number of slices at most
        seen = staged(seen.unionByName(seen.join(hop, "at").select(F.col("to").alias("at"))).distinct())
        now = seen.count()
        if now == held:
            break
        held, hop = now, staged(hop.join(hop.select(F.col("at").alias("to"), F.col("to").alias("_b")), "to").select("at", F.col("_b").alias("to")))
    into = jump.join(seen, "at").select("start", F.col("to").alias("hi")).join(places.select("slice", "hi"), "hi").select("slice", "start")
    entry = dict(map(tuple, into.collect()))  # a row for each slice at most
    reach = places.join(seen.withColumnRenamed("at", "hi"), "hi").agg(F.max("start")).first()[0]
    out = {}
    for i, *_ in reversed(bounds):
        reach = entry.get(i, reach)
        out[i] = (least, None) if i == first else (entry[i] + (1 << k) if i in entry else None, reach)
    return out


def spread_segments(keys: DataFrame, k: int, key: str = "k") -> DataFrame:
    """Greedy runs from the least key on: a new one starts at the first key beyond start + 2**k - 1.

    Keys are dealt in slices.  Each slice finds where the runs that may enter it leave it; which of these ways are taken follows by pointer
    doubling over the slices' ways, not over the keys; then each slice, told where a run enters, cuts its own.
    """
    s = sliced(keys.select(key).where(F.col(key).isNotNull()).distinct(), key)
    if s.isEmpty():
        return s.select(F.col("slice").cast("long").alias("seg"), F.col(key).alias("min_k"), F.col(key).alias("max_k"), F.col("slice").cast("long").alias("n"))
    if k >= 63:
        return s.agg(F.lit(0).cast("long").alias("seg"), F.min(key).alias("min_k"), F.max(key).alias("max_k"), F.count("*").alias("n"))
    importable(keys.sparkSession)
    entered = _entered(s, k, key)

    def cut(which, p):
        v = np.sort(p[key].to_numpy())
        (enter, reach), leap = entered[int(which[0])], _leaps(v, k).tolist()
        i = len(v) if enter is None else int(np.searchsorted(v, enter))
        starts = [0] if i else []  # keys of a run that started before this slice
        while i < len(v):
            starts.append(i)
            i = leap[i]
        at = np.array(starts)
        ends, low = np.append(at[1:], len(v)), v[at]
        if enter is None or v[0] < enter:
            low[0] = reach
        return pd.DataFrame({"min_k": low, "max_k": v[ends - 1], "n": ends - at})

    parts = s.groupBy("slice").applyInPandas(cut, "min_k long, max_k long, n long")
    return _numbered(parts.groupBy("min_k").agg(F.max("max_k").alias("max_k"), F.sum("n").alias("n")))


def run_cost(n: float, spread: float, k: int) -> float:
    """Bits of a segment by the model: n * log2(2**k / n) if the spread is below 2**k, else n * k; 128 for its bounds."""
    if n == 0:
        return 128.0
    universe = 2.0 ** min(k, 64)
    return (n * math.log2(max(1.0, universe / n)) if spread < universe else n * k) + 128


def _cost_column(n, spread, k: int):
    universe = 2.0 ** min(k, 64)
    return F.when(spread < universe, n * F.log2(F.greatest(F.lit(1.0), universe / n))).otherwise(n * k) + 128


def _merge_pass(runs: DataFrame, k: int) -> DataFrame:
    """One pass over all segments: in a chain of neighbours that would merge, every second one merges with the next."""
    r = staged(ranked(runs.select("min_k", "max_k", "n"), "min_k"))
    after = r.select((F.col("rank") - 1).alias("rank"), F.col("min_k").alias("_a"), F.col("max_k").alias("_b"), F.col("n").alias("_n"))
    cost = lambda n, a, b: _cost_column(n, (b - a + 1).cast("double"), k)
    both = cost(F.col("n") + F.col("_n"), F.col("min_k"), F.col("_b"))
    joins = F.coalesce(both < cost(F.col("n"), F.col("min_k"), F.col("max_k")) + cost(F.col("_n"), F.col("_a"), F.col("_b")), F.lit(False))
    pairs = r.join(after, "rank", "left").withColumn("_m", joins)
    chains = staged(running_sum(pairs.withColumn("_c", F.when(F.col("_m"), 0).otherwise(1)), "rank", "_c", "_chain"))
    first = chains.where("_m").groupBy("_chain").agg(F.min("rank").alias("_first"))
    takes = chains.join(first, "_chain", "left").withColumn("_t", F.col("_m") & ((F.col("rank") - F.col("_first")) % 2 == 0))
    taken = takes.where("_t").select((F.col("rank") + 1).alias("rank"))
    return takes.join(taken, "rank", "left_anti").select("min_k", F.when(F.col("_t"), F.col("_b")).otherwise(F.col("max_k")).alias("max_k"), (F.col("n") + F.when(F.col("_t"), F.col("_n")).otherwise(0)).alias("n"))


def merged_segments(segments: DataFrame, k: int, most: int = 1_000_000) -> DataFrame:
    """Neighbours merged, left to right, while that costs less by the model with spread max - min + 1; repeated until nothing changes.

    Up to `most` segments (not keys) are merged in one task.  More are merged by passes over all of them, with equal results: whether two
    neighbours merge in a pass depends on those two and on their places in a chain of such neighbours.
    """
    runs, n = counted(segments.select("min_k", "max_k", "n"))
    while n > most:
        before = n
        runs, n = counted(_merge_pass(runs, k))
        if n == before:
            return _numbered(runs)

    def merge(it):
        p = pd.concat([pd.DataFrame(columns=["min_k", "max_k", "n"]), *it], ignore_index=True)
        rows = [tuple(map(int, r)) for r in p.sort_values("min_k")[["min_k", "max_k", "n"]].itertuples(index=False)]
        cost = lambda r: run_cost(r[2], r[1] - r[0] + 1, k)
        changed = True
        while changed:
            changed, out, i = False, [], 0
            while i < len(rows):
                if i + 1 < len(rows):
                    both = (rows[i][0], rows[i + 1][1], rows[i][2] + rows[i + 1][2])
                    if cost(both) < cost(rows[i]) + cost(rows[i + 1]):
                        out.append(both)
                        i, changed = i + 2, True
                        continue
                out.append(rows[i])
                i += 1
            rows = out
        yield pd.DataFrame([(s, *r) for s, r in enumerate(rows)], columns=["seg", "min_k", "max_k", "n"]).astype("int64")

    importable(segments.sparkSession)
    return runs.coalesce(1).mapInPandas(merge, "seg long, min_k long, max_k long, n long")


def optimal_segments(keys: DataFrame, k: int, key: str = "k") -> DataFrame:
    """Segmentation of least total cost by dynamic programming over all pairs of keys, with spread max - min and costs rounded up.

    Of equal totals a key on its own comes first, then the latest start.  Its time is quadratic, its memory linear, in one task: for checks of the others.
    """
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()

    def solve(it):
        v = np.sort(np.concatenate([p[key].to_numpy() for p in it] or [np.zeros(0, np.int64)]))
        n = len(v)
        if not n:
            return
        universe = 2.0 ** min(k, 64)
        one = math.ceil(run_cost(1, 0, k) - 128) + 128
        total, parent = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(1, n + 1):
            m = np.arange(i, 0, -1).astype(float)  # keys from j to i - 1, for j = 0..i - 1
            fits = (v[i - 1] - v[:i]).astype(float) < universe
            data = np.ceil(np.where(fits, m * np.log2(np.maximum(1.0, universe / m)), m * k)).astype(np.int64) + 128
            every = total[:i] + data
            total[i], parent[i] = total[i - 1] + one, i - 1
            best = every.min()
            if best < total[i]:
                total[i], parent[i] = best, np.flatnonzero(every == best)[-1]
        cut = [n]
        while cut[-1]:
            cut.append(int(parent[cut[-1]]))
        cut = cut[::-1]
        yield pd.DataFrame({"seg": range(len(cut) - 1), "min_k": v[cut[:-1]], "max_k": v[np.array(cut[1:]) - 1], "n": np.diff(cut)}).astype("int64")

    importable(keys.sparkSession)
    return distinct.coalesce(1).mapInPandas(solve, "seg long, min_k long, max_k long, n long")


def placed(keys: DataFrame, segments: DataFrame, key: str = "k") -> DataFrame:
    """Distinct keys with s0, the segments that end before it, and s1, those that begin up to it: it lies in those from s0 to s1 - 1.

    Segments are in order at both ends.  Keys and ends are dealt by value together, once for both numbers.
    """
    ends = segments.select(F.inline(F.array(F.struct(F.col("min_k").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("c")), F.struct(F.col("max_k").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("c")))))
    asked = keys.select(F.col(key).alias("v")).where("v is not null").distinct().select("v", F.lit(0).alias("o"), F.lit(0).alias("c"))
    s = sliced(asked.unionByName(ends), "v")
    by = Window.partitionBy("slice").orderBy("v")
    upto = F.sum("o").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # a segment that ends at the key holds it: of the ends up to the key those at the key don't count
    ended = F.sum("c").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("c").over(Window.partitionBy("slice", "v"))
    local = s.select("slice", "v", "o", "c", upto.alias("_u"), ended.alias("_e"))
    w = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = s.groupBy("slice").agg(F.sum("o").alias("o"), F.sum("c").alias("c")).select("slice", F.coalesce(F.sum("o").over(w), F.lit(0)).alias("o0"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"))
    return local.where("o = 0 and c = 0").join(F.broadcast(before), "slice").select(F.col("v").alias(key), (F.col("_e") + F.col("c0")).alias("s0"), (F.col("_u") + F.col("o0")).alias("s1"))


def leftovers(keys: DataFrame, segments: DataFrame, key: str = "k") -> DataFrame:
    """Keys in no segment."""
    return placed(keys, segments, key).where("s0 >= s1").select(key)


def _inside(at: DataFrame, key: str) -> DataFrame:
    return at.where("s0 < s1").select(key, F.explode(F.sequence("s0", F.col("s1") - 1)).alias("seg"))


def assigned(keys: DataFrame, segments: DataFrame, key: str = "k") -> DataFrame:
    """(key, seg): keys with each segment they lie in; a border key of two segments comes twice."""
    return _inside(placed(keys, segments, key), key)


# ---- which filter the keys outside all segments get


def gap_facts(keys: DataFrame, k: int, key: str = "k") -> dict:
    """n, spread, its bits, phantom (spread >> k, 1 at least), the gap of order floor((n - 1) / 20), and the sum of gaps up to phantom."""
    nb = staged(neighbours(keys, key))
    r = nb.agg(F.count("*"), F.min(key), F.max(key)).first()
    n = r[0]
    spread = (r[2] - r[1]) if n else 0
    phantom = max(1, spread >> k)
    gaps = nb.where("prev is not null").select((F.col(key) - F.col("prev")).alias("gap"))
    small = gaps.where(F.col("gap") <= phantom).agg(F.sum("gap")).first()[0] or 0
    return {"n": n, "spread": spread, "bits": spread.bit_length(), "phantom": phantom, "p5": kth_smallest(gaps, "gap", min((n - 1) // 20, n - 2)) if n > 1 else None, "small": small}


def uses_trunc(policy: str, facts: dict, k: int, length: int, eps: float = 0.01) -> bool:
    """Whether a policy takes the truncating filter: auto, trunc, soda, estimate, gap_fraction or phantom."""
    n, spread, bits = facts["n"], facts["spread"], facts["bits"]
    if policy == "trunc":
        return True
    if policy == "soda":
        return False
    if policy == "estimate":
        return n / 2.0**k <= eps
    if policy not in ("auto", "gap_fraction", "phantom"):
        raise ValueError(f"unknown policy {policy}")
    if n < 2 or spread == 0 or bits <= k:
        return True
    if policy == "auto":
        return facts["p5"] > facts["phantom"]
    if policy == "gap_fraction":
        return facts["small"] / spread <= eps
    return (spread >> k) < length


__all__ = ["assigned", "density_segments", "gap_facts", "gap_segments", "leftovers", "merged_segments", "optimal_segments", "placed", "run_cost", "spread_segments", "uses_trunc"]
