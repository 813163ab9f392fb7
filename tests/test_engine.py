"""Range emptiness, order, tries, segments and filters against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidscan.functions import bits, generators, sizes
from voidscan.operators import approx, composite, exact, maps, metrics, order, segments, skipping, tries
from voidscan.plans.stage import nested_loops, physical
from voidscan.sources import benchlogs, keyfiles
from voidscan.streaming import sidecar

RNG = np.random.default_rng(3)
KEYS = np.unique(np.concatenate([RNG.integers(0, 1 << 40, 300), (1 << 38) + RNG.integers(0, 4000, 400), (1 << 39) + np.arange(300) * 7]))


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([(int(k),) for k in KEYS] + [(int(KEYS[0]),), (None,)], "k long").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    a = np.concatenate([RNG.integers(0, 1 << 40, 500), KEYS[::3], KEYS[::4] - 1, KEYS[::5] + 1, RNG.integers((1 << 38) - 50, (1 << 38) + 5000, 300)])
    rows = [(i, int(x), int(x + w)) for i, (x, w) in enumerate(zip(a, RNG.integers(0, 40, len(a))))]
    top = int(KEYS[-1])
    rows += [(9000, 5, 4), (9001, 0, 1 << 41), (9002, None, 3), (9003, 3, None), (9004, top - 1, top + 10), (9005, top + 1, top + 99), (9006, -5, int(KEYS[0])), (9007, -9, -1)]
    return spark.createDataFrame(rows, "qid long, a long, b long")


def truth(a, b):
    if a is None or b is None:
        return None
    i = np.searchsorted(KEYS, a)
    return not (a <= b and i < len(KEYS) and KEYS[i] <= b)


def judged(df):
    """False positives' share; fails on any missed key or wrong null."""
    wrong = total = 0
    for r in df.collect():
        t = truth(r["a"], r["b"])
        if t is None:
            assert r["is_empty"] is None
        elif not t:
            assert r["is_empty"] is False, r
        else:
            total, wrong = total + 1, wrong + (not r["is_empty"])
    return wrong / total


def test_exact(keys, asked, spark):
    out = exact.is_empty(keys, asked)
    assert judged(out) == 0 and nested_loops(out) == 0
    assert exact.is_empty(keys.where("false"), asked.where("qid < 9000")).where("not is_empty").count() == 0
    first = {r["qid"]: r["first_key"] for r in exact.first_in(keys, asked).collect()}
    assert first[9001] == int(KEYS[0]) and first[9005] is None and first[9006] == int(KEYS[0])


def test_literal_four_bit_keys(spark):
    held = [0b0000, 0b0010, 0b0100, 0b0111, 0b1000, 0b1011, 0b1101, 0b1111]
    pairs = [(a, b) for a in range(16) for b in range(16)]
    q = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "qid long, a long, b long")
    out = exact.is_empty(spark.createDataFrame([(k,) for k in held], "k long"), q).collect()
    assert all(r["is_empty"] == (not any(r["a"] <= k <= r["b"] for k in held)) for r in out)


def test_unsorted_keys_are_an_error(spark):
    good = spark.createDataFrame([(i, i * 2) for i in range(50)], "pos long, k long")
    assert exact.checked_sorted(good).count() == 50
    with pytest.raises(Exception, match="not sorted"):
        exact.checked_sorted(good.withColumn("k", F.when(F.col("pos") == 30, 0).otherwise(F.col("k")))).collect()


@pytest.mark.parametrize("make, most", [
    (lambda k: approx.trunc(k, 26), 0.5), (lambda k: approx.soda(k, 26, 40), 0.1), (lambda k: approx.adaptive(k, 26, 40), 0.1), (lambda k: approx.adaptive(k, 45, 40), 0.0), (lambda k: approx.trunc(k, 1), 1.0)])
def test_single_filters_miss_no_key(keys, asked, make, most):
    assert judged(approx.answer(make(keys), asked)) <= most


def test_cdf_and_bloom_miss_no_key(keys, asked):
    f, knots = approx.cdf(keys, 40, 0.05, step=32, blend=0.2)
    assert judged(approx.answer(f, asked, knots=knots)) < 0.2
    words, m, h = approx.bloom(keys, 40, 0.01)
    assert judged(approx.bloom_empty(words, m, h, asked)) < 0.05


def test_exact_mode_reaches_the_greatest_key(spark):
    k = spark.createDataFrame([(i,) for i in range(6)], "k long")
    q = spark.createDataFrame([(0, 4, 8), (1, 6, 9), (2, 5, 5)], "qid long, a long, b long")
    f = approx.adaptive(k, 8, 4)
    assert f.kind == "exact" and f.k == 3
    assert {r["qid"]: r["is_empty"] for r in approx.answer(f, q).collect()} == {0: False, 1: True, 2: False}
    same = spark.createDataFrame([(0xDEADBEEF,)] * 5, "k long")
    q = spark.createDataFrame([(0, 0xDEADBEEF, 0xDEADBEEF), (1, 0xDEADBEF0, 0xDEADBEFF), (2, 1, 2)], "qid long, a long, b long")
    assert {r["qid"]: r["is_empty"] for r in approx.answer(approx.adaptive(same, 8, 4), q).collect()} == {0: False, 1: True, 2: True}


def test_false_positive_rate_is_bounded(spark):
    k = generators.uniform(spark, 4000, 60)
    for eps, length in ((0.1, 10), (0.01, 100)):
        f = approx.soda(k, sizes.soda_bits(4000, length, eps), length)
        r = metrics.false_positive_rate(k, approx.answer(f, generators.uniform_queries(spark, 6000, length))).first()
        assert r["missed"] == 0 and r["fpr"] <= 3 * eps


def test_properties_hold_a_key(keys, asked):
    q = generators.property_queries(keys.where("k is not null")).withColumn("qid", F.xxhash64("kind", "a", "b"))
    assert q.select("kind").distinct().count() == 5
    assert exact.is_empty(keys, q).where("is_empty").count() == 0
    assert approx.answer(approx.soda(keys, 24, 40), q).where("is_empty").count() == 0
    g = generators.gap_queries(keys, 50)
    assert exact.is_empty(keys, g).where("not is_empty").count() == 0 and g.count() > 200


def test_composites_miss_no_key(keys, asked):
    some = keys.where("k is not null")
    for c in (composite.hybrid(some, 40), composite.hybrid_scan(some, 40, min_size=50), composite.hybrid_scan(some, 40, k=20, policy="soda", min_size=50), composite.greedy_scan(some, 40, k=20), composite.dp_scan(some, 40, k=20)):
        assert judged(composite.answer(c, asked)) < 0.3
        s = composite.stats(c).first()
        assert s["n"] == len(KEYS) and s["size_bits"] > 0 and s["outside"] <= len(KEYS)


def test_density_segments_against_a_sweep(spark):
    r = random.Random(5)
    for eps, least, size in ((30, 4, 1), (60, 6, 5)):
        v = sorted({r.randrange(3000) for _ in range(220)} | {r.randrange(200) + 5000 for _ in range(60)})
        n = len(v)
        core = [sum(1 for x in v if 0 <= y - x <= eps) >= least or sum(1 for x in v if 0 <= x - y <= eps) >= least for y in v]
        runs = []
        for i in range(n):
            if core[i]:
                if runs and v[i] - v[runs[-1][1]] <= eps:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
        want = []
        for a, b in runs:
            inside = [x for x in v if v[a] - eps <= x <= v[b] + eps]
            if len(inside) >= size:
                want.append((inside[0], inside[-1], len(inside)))
        got = segments.density_segments(spark.createDataFrame([(x,) for x in v], "k long"), eps, least, size).orderBy("seg").collect()
        assert [(x["min_k"], x["max_k"], x["n"]) for x in got] == want and [x["seg"] for x in got] == list(range(len(want)))


def test_other_segments(spark):
    v = sorted({int(x) for x in np.random.default_rng(8).integers(0, 5000, 150)} | set(range(9000, 9100)))
    k = spark.createDataFrame([(x,) for x in v], "k long")
    starts, s = [], None
    for x in v:
        if s is None or x - s > 255:
            s = x
            starts.append(x)
    spread = segments.spread_segments(k, 8)
    got = spread.orderBy("seg").collect()
    assert [r["min_k"] for r in got] == starts and sum(r["n"] for r in got) == len(v)
    merged = segments.merged_segments(spread, 8).collect()
    best = segments.optimal_segments(k, 8).orderBy("seg").collect()
    assert sum(r["n"] for r in merged) == sum(r["n"] for r in best) == len(v)
    cost = lambda rows, more: sum(segments.run_cost(r["n"], r["max_k"] - r["min_k"] + more, 8) for r in rows)
    assert cost(best, 0) <= cost(merged, 0) + len(best) and cost(merged, 1) <= cost(got, 1)
    passes = segments.merged_segments(spread, 8, most=0).collect()
    assert sorted(map(tuple, passes)) == sorted(map(tuple, merged))
    gaps = segments.gap_segments(k).collect()
    assert any(r["min_k"] == 9000 and r["max_k"] == 9099 for r in gaps)
    left, inside = segments.leftovers(k, segments.gap_segments(k)), segments.assigned(k, segments.gap_segments(k))
    assert left.count() + inside.count() == len(v)
    facts = segments.gap_facts(k, 8)
    assert facts["n"] == len(v) and facts["spread"] == v[-1] - v[0] and facts["p5"] == sorted(np.diff(v))[(len(v) - 1) // 20]
    assert segments.uses_trunc("trunc", facts, 8, 4) and not segments.uses_trunc("soda", facts, 8, 4)
    with pytest.raises(ValueError):
        segments.uses_trunc("nothing", facts, 8, 4)


@pytest.mark.parametrize("k, make", [
    (5, lambda r: r.integers(0, 30_000, 3000)), (9, lambda r: np.arange(4000) * 3), (14, lambda r: np.concatenate([r.integers(0, 3000, 1500), r.integers(0, 1 << 40, 1500), (1 << 39) + r.integers(0, 1 << 15, 1500)])),
    (62, lambda r: np.concatenate([r.integers(-(2**63), 2**63 - 1, 2000), [2**63 - 1, -(2**63)]])), (20, lambda r: r.integers(0, 1 << 19, 3000))])
def test_spread_segments_over_many_slices(spark, k, make):
    v = sorted({int(x) for x in make(np.random.default_rng(k))})
    want = []
    for x in v:
        if want and x - want[-1][0] < 1 << k:
            want[-1][1:] = [x, want[-1][2] + 1]
        else:
            want.append([x, x, 1])
    got = segments.spread_segments(spark.createDataFrame([(x,) for x in v] + [(v[7],), (None,)], "k long"), k).orderBy("seg").collect()
    assert [list(r) for r in got] == [[i, *w] for i, w in enumerate(want)]


def test_spread_segments_writes_in_proportion_to_the_keys(spark, monkeypatch):
    from voidscan.plans import stage

    rows = []
    monkeypatch.setattr(segments, "staged", lambda df: (lambda out: rows.append(out.count()) or out)(stage.staged(df)))
    segments.spread_segments(spark.range(6000).select((F.col("id") * 7).alias("k")), 5)
    assert sum(rows) < 6000, rows  # what is written beside the slices: rounds over all keys came to ten times the keys


def test_keys_are_placed_among_segments(spark):
    v = sorted({int(x) for x in np.random.default_rng(11).integers(0, 4000, 1500)})
    segs = [(0, v[3], v[90]), (1, v[90], v[200]), (2, v[201], v[201]), (3, v[300] + 1, v[900] - 1), (4, v[880], v[-2])]  # two share a key, two overlap
    k, s = spark.createDataFrame([(x,) for x in v] + [(v[5],), (None,)], "k long"), spark.createDataFrame(segs, "seg long, min_k long, max_k long")
    assert sorted(map(tuple, segments.assigned(k, s).collect())) == sorted((x, i) for x in v for i, a, b in segs if a <= x <= b)
    assert sorted(r["k"] for r in segments.leftovers(k, s).collect()) == [x for x in v if not any(a <= x <= b for _, a, b in segs)]
    assert segments.assigned(k, s.where("false")).count() == 0 and segments.leftovers(k, s.where("false")).count() == len(v)


def test_segments_look_up_their_ends_not_every_key(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(segments, "located", lambda points, *a: asked.append(points.count()) or order.located(points, *a))
    k = spark.range(1500).select((F.col("id") * 3 + F.floor(F.col("id") / 300) * 10_000).alias("k"))
    c = composite.hybrid_scan(k, 40, k=20, policy="trunc", min_points=4, min_size=16, radius=100)
    assert composite.stats(c).first()["clusters"] == 5 and sum(asked) <= 10, asked


def _pairs(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "qid long, a long, b long")


FILTERS = [lambda k: approx.trunc(k, 20), lambda k: approx.soda(k, 30, 40), lambda k: approx.adaptive(k, 30, 40), lambda k: approx.adaptive(k, 30, 40, t=3), lambda k: composite.hybrid(k, 40, k=20),
           lambda k: composite.hybrid_scan(k, 40, k=20, min_size=3, radius=50, min_points=2), lambda k: composite.hybrid(k, 40, bits_per_key=16), lambda k: composite.greedy_scan(k, 40, k=20), lambda k: composite.dp_scan(k, 40, k=20)]


def _asked_of(f, q):
    return composite.answer(f, q) if isinstance(f, composite.Composite) else approx.answer(f, q)


def test_empty_key_sets(spark):
    none = spark.createDataFrame([(None,)], "k long")
    q = _pairs(spark, [(1, 5), (-(2**63), 2**63 - 1), (4, 3)])
    for make in [*FILTERS[:4], lambda k: composite.hybrid(k, 40), lambda k: composite.hybrid_scan(k, 40), lambda k: composite.greedy_scan(k, 40), lambda k: composite.dp_scan(k, 40)]:
        assert all(r["is_empty"] for r in _asked_of(make(none), q).collect())
    f, knots = approx.cdf(none, 40, 0.05)
    assert all(r["is_empty"] for r in approx.answer(f, q, knots=knots).collect())
    assert sizes.trunc_bits(0, 0.01) == 1 and sizes.soda_bits(0, 10, 0.01) == sizes.adaptive_bits(0, 10, 0.01) == 0 == sizes.hybrid_bits(0, 10, 0.01)


def test_keys_over_the_whole_range(spark):
    v = [-(2**63), -(2**63) + 1, -(2**62), -5, 0, 7, 8, 9, 2**62, 2**63 - 1000, 2**63 - 500, 2**63 - 1]
    k = spark.createDataFrame([(x,) for x in v], "k long")
    asked = [(x, x) for x in v] + [(max(x - 1, -(2**63)), x) for x in v] + [(x, min(x + 1, 2**63 - 1)) for x in v] + [(-(2**63), 2**63 - 1), (100, 10**6), (2**61, 2**61 + 5), (-(2**61), -(2**60))]
    q = _pairs(spark, asked)
    f, knots = approx.cdf(k, 40, 0.05, step=2)
    for out in [_asked_of(make(k), q) for make in FILTERS[:5] + FILTERS[-2:-1]] + [approx.answer(f, q, knots=knots)]:
        for r in out.collect():
            assert not (r["is_empty"] and any(r["a"] <= x <= r["b"] for x in v)), r


def test_equal_values_count_once_in_order_statistics(spark):
    v = [5] * 700 + list(range(100)) + [None]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    s = sorted(x for x in v if x is not None)
    assert [order.kth_smallest(df, "v", i) for i in (0, 5, 300, 704, 705, 799)] == [s[i] for i in (0, 5, 300, 704, 705, 799)]
    assert order.kth_smallest(df, "v", 800) is None and order.kth_smallest(df, "v", -1) is None
    assert order.slices(df, 10) == 1 and order.slices(df, 100 * order.SLICE_ROWS) == 100


def test_staged_tables_are_deleted(spark):
    import os

    from voidscan.plans import stage

    a, n = stage.counted(spark.range(5))
    out = stage.settled(spark, lambda: stage.staged(a).union(a))
    assert n == 5 and out.count() == 10 and len([p for p in stage._made if os.path.exists(p)]) >= 2
    stage.release(out)
    assert not os.path.exists(out.staged_path) and os.path.exists(a.staged_path)


def test_order(spark, keys):
    rows = {r["k"]: r["rank"] for r in order.rank_of(keys, keys.distinct()).collect()}
    assert rows == {int(k): i for i, k in enumerate(KEYS)} | {None: -1}
    got = order.select_kth(keys.distinct(), spark.createDataFrame([(0,), (len(KEYS) - 1,), (10**6,)], "i long")).collect()
    assert {r["i"]: r["k"] for r in got} == {0: int(KEYS[0]), len(KEYS) - 1: int(KEYS[-1]), 10**6: None}
    slots = sorted(r["slot"] for r in order.slots(keys).collect())
    assert slots == list(range(1, len(KEYS) + 1))
    text = spark.createDataFrame([(w,) for w in ("b", "a", "ab", "", "é")], "k string")
    assert [r["k"] for r in order.ranked(text, "k").orderBy("rank").collect()] == ["", "a", "ab", "b", "é"]
    empty = order.located(spark.createDataFrame([(1, 5)], "q long, p long"), keys.where("false"), "p").first()
    assert empty["next"] is None and empty["below"] == 0


def test_bit_vectors(spark):
    r = random.Random(2)
    v = [r.random() < 0.3 for _ in range(500)]
    b = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "pos long, bit int").repartition(4)
    for row in order.bit_ranks(b).collect():
        assert row["ones_before"] == sum(v[: row["pos"]]) and row["zeros_before"] == row["pos"] - sum(v[: row["pos"]])
    ones = [i for i, x in enumerate(v) if x]
    asked = spark.createDataFrame([(3, 1), (0, 1), (9999, 1), (5, 0)], "i long, bit int")
    got = {(x["i"], x["bit"]): x["pos"] for x in order.bit_select(b, asked).collect()}
    assert got == {(3, 1): ones[3], (0, 1): ones[0], (9999, 1): 500, (5, 0): [i for i, x in enumerate(v) if not x][5]}
    assert {x["pos"]: x["ones_before"] for x in order.bit_rank_at(b, spark.createDataFrame([(7,), (900,)], "pos long")).collect()} == {7: sum(v[:7]), 900: sum(v)}
    assert sum(x["length"] for x in order.runs(b).collect()) == 500


def test_bit_strings(spark):
    texts = ["", "0", "1", "0101", "111", "000", "1" * 17, "0" * 9 + "1", "10110011100011110000", "1" * 70]
    t = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("s", bits.from_text("t"))
    rows = t.select("t", "s.bytes", "s.nbits", bits.text_of("s").alias("back"), bits.text_successor("t").alias("next"), bits.text_predecessor("t").alias("before"), bits.text_trimmed("t").alias("trim")).collect()
    for r in rows:
        x, n = r["t"], len(r["t"])
        assert r["back"] == x and r["nbits"] == n and bytes(r["bytes"]) == (int(x.ljust(-(-n // 8) * 8, "0"), 2).to_bytes(-(-n // 8), "big") if n else b"")
        assert r["next"] == ("1" + "0" * n if "0" not in x else bin(int(x, 2) + 1)[2:].zfill(n))
        assert r["before"] == (x if "1" not in x else bin(int(x, 2) - 1)[2:].zfill(n)) and r["trim"] == x.rstrip("0")
    assert [r["t"] for r in t.orderBy("s.bytes", "s.nbits").collect()] == sorted(texts)
    assert [r["t"] for r in t.where("length(t) < 4").orderBy(bits.trie_order("t")).collect()] == ["", "000", "0", "1", "111"]
    cut = spark.createDataFrame([(bytearray(b"\xab\xcd"), 11), (bytearray(b"\xff"), 3), (bytearray(b""), 2)], "d binary, n int").select(bits.text_of(bits.from_bytes("d", "n")).alias("t")).collect()
    assert [r["t"] for r in cut] == ["10101011110", "111", "00"]
    with pytest.raises(Exception, match="not a bit"):
        spark.createDataFrame([("012",)], "t string").select(bits.from_text("t")).collect()
    low = spark.createDataFrame([("Az",)], "t string").select(bits.text_of(bits.from_string_low_first("t")).alias("x"), bits.text_of(bits.from_string("t")).alias("y"), bits.text_lcp(F.lit("0101"), F.lit("0111")).alias("z")).first()
    assert low["x"] == "".join(f"{b:08b}"[::-1] for b in b"Az") and low["y"] == "".join(f"{b:08b}" for b in b"Az") and low["z"] == 2


def built(v, w):
    """A trie made node by node: extent -> (parent depth, leaf)."""
    texts = [f"{x:0{w}b}" for x in v]

    def node(rows, parent):
        head = rows[0]
        while any(not r.startswith(head) for r in rows):
            head = head[:-1]
        out = {head: (parent, len(rows) == 1)}
        if len(rows) > 1:
            for bit in "01":
                part = [r for r in rows if r.startswith(head + bit)]
                out |= node(part, len(head))
        return out

    return node(texts, -1)


def test_tries_against_one_built_node_by_node(spark):
    w = 12
    v = sorted(random.Random(4).sample(range(1 << w), 60))
    k = spark.createDataFrame([(x,) for x in v], "k long")
    want = built(v, w)
    trie = tries.nodes(k, w).cache()
    got = {(f"{r['extent']:0{r['len']}b}" if r["len"] else ""): (r["parent_depth"], r["is_leaf"]) for r in trie.collect()}
    assert got == want
    fattest = lambda a, b: 0 if a == b else (b >> ((a ^ b).bit_length() - 1)) << ((a ^ b).bit_length() - 1)
    for r in trie.collect():
        assert r["handle_len"] == fattest(max(r["parent_depth"], 0), r["len"]) and r["handle"] == r["extent"] >> (r["len"] - r["handle_len"])
    prefixes = [(x >> (w - n), n) for x in v for n in range(w + 1)] + [(5, 3), (2047, 11), (0, 12)]
    rows = tries.prefix_ranks(k, spark.createDataFrame(prefixes, "p long, n int").distinct(), w).collect()
    for r in rows:
        held = [i for i, x in enumerate(v) if x >> (w - r["n"]) == r["p"]]
        assert (r["lo"], r["hi"]) == ((held[0], held[-1] + 1) if held else (r["lo"], r["lo"]))
    root = min(len(e) for e, (p, _) in want.items() if p == -1)
    asked = [(x ^ (1 << (x % w)), w) for x in v] + [(x >> 3, w - 3) for x in v] + [(0, 0), (1, 1)]
    for r in tries.existing_prefix(trie, spark.createDataFrame(asked, "p long, n int").distinct()).collect():
        text = f"{r['p']:0{r['n']}b}" if r["n"] else ""
        met = [len(e) for e in want if len(e) < len(text) and text.startswith(e)]
        assert r["exit_len"] == (0 if root >= len(text) else max([root, *met]) + 1), r
    names = trie.selectExpr("shiftright(extent, len - name_len) as p", "name_len as n", "lo as l", "hi as h").unionByName(spark.createDataFrame([(0, 0, 0, 60), (4095, 12, -1, -1)], "p long, n int, l long, h long").where("p <> 4095 or p not in (4095)"))
    for r in tries.locate(trie, names.distinct(), w).collect():
        assert not r["known"] or r["n"] == 0 or (r["lo"], r["hi"]) == (r["l"], r["h"])
    entries = tries.entry_counts(trie).first()
    assert entries["true_entries"] == len({(r["handle_len"], r["handle"]) for r in trie.collect()}) <= entries["entries"]
    p = tries.boundary_set(trie, w).orderBy("rank").collect()
    cells = {}
    for e, (_, leaf) in want.items():
        more = [(e.rstrip("0"), leaf), (e + "1", False)]
        if "0" in e:
            more.append(((bin(int(e, 2) + 1)[2:].zfill(len(e)) + "0").rstrip("0"), False))
        elif not e:
            pass
        for t, x in more:
            cells[t] = cells.get(t, False) or x
    assert [(f"{r['value']:0{w + 1}b}"[: r["nbits"]], r["leaf"]) for r in p] == sorted(cells.items())
    assert tries.children(trie).count() == len(want) - 1
    t = tries.in_order(trie, w).collect()
    text = lambda r: f"{r['extent']:0{r['len']}b}" if r["len"] else ""
    assert [text(r) for r in sorted(t, key=lambda r: r["pre_order"])] == sorted(want)
    depth = {r["p"]: r["depth"] for r in tries.exit_depth(k, spark.createDataFrame([(9,), (v[7],)], "p long"), w).collect()}
    assert depth[v[7]] == w


def test_existing_prefix_of_every_pattern(spark):
    w = 7
    for v in (sorted(random.Random(6).sample(range(1 << w), 40)), [37, 38, 45], [9], [0, 127], list(range(64, 128))):
        want = built(v, w)
        root = min(len(e) for e, (p, _) in want.items() if p == -1)
        asked = [(x, n) for n in range(w + 3) for x in range(1 << n)]
        found = tries.existing_prefix(tries.nodes(spark.createDataFrame([(x,) for x in v], "k long"), w), spark.createDataFrame([*asked, asked[-1]], "p long, n int"))
        assert "sequence(" not in physical(found)  # a row for each bit of each pattern
        rows = found.collect()
        assert len(rows) == len(asked) + 1
        for r in rows:
            text = f"{r['p']:0{r['n']}b}" if r["n"] else ""
            met = [len(e) for e in want if len(e) < len(text) and text.startswith(e)]
            assert r["exit_len"] == (0 if root >= len(text) else max([root, *met]) + 1), r


def test_text_prefixes(spark):
    words = ["", "a", "ab", "abc", "b", "é", "éa", "zz"]
    k = spark.createDataFrame([(x,) for x in words + [None, "a"]], "key string")
    p = spark.createDataFrame([(x,) for x in ("", "a", "ab", "é", "q", "zzz")], "prefix string")
    s = sorted(words, key=lambda x: x.encode())
    for r in tries.text_prefix_ranks(k, p).collect():
        held = [i for i, x in enumerate(s) if x.startswith(r["prefix"])]
        assert (r["hi"] - r["lo"], r["lo"]) == (len(held), held[0] if held else r["lo"])
    assert {r["prefix"]: r["found"] for r in tries.contains_prefix(k, p).collect()} == {"": True, "a": True, "ab": True, "é": True, "q": False, "zzz": False}


def test_random_log_against_a_dict(spark):
    r, model, log, found = random.Random(1), {}, [], {}
    for step in range(1500):
        op, key = r.choice(["insert", "erase", "contains"]), f"k{r.randrange(60)}"
        log.append((step, op, key, step))
        if op == "insert":
            model[key] = step
        elif op == "erase":
            model.pop(key, None)
        else:
            found[step] = (key in model, model.get(key))
    df = spark.createDataFrame(log, "step int, op string, key string, value int").repartition(4)
    assert {x["key"]: x["value"] for x in maps.replayed(df).collect()} == model
    assert {x["step"]: (x["found"], x["answer"]) for x in maps.answers(df).collect()} == found
    t = spark.createDataFrame(list(model.items()), "key string, value int")
    assert {x["key"]: x["found"] for x in maps.contains(t, spark.createDataFrame([("k1",), ("zz",)], "key string")).collect()} == {"k1": "k1" in model, "zz": False}


def test_skip_index_reads_only_files_that_may_match(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3000).selectExpr("id as g", "id * 17 % 3000 * 1000 + id % 3 as k").repartitionByRange(6, "k").write.parquet(path)
    files, fp = skipping.index_of(spark, path, F.col("k"))
    assert files.count() == 6
    q = spark.createDataFrame([(i, int(a), int(a) + 400) for i, a in enumerate(RNG.integers(0, 3_000_000, 60))] + [(98, 5, 4), (99, -9, -1), (97, 0, 10**8)], "qid long, a long, b long")
    got = {(r["qid"], r["file"]) for r in skipping.candidates(files, fp, q).collect()}
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "k").collect()
    need = {(x["qid"], r["file"]) for x in q.collect() for r in rows if x["a"] <= r["k"] <= x["b"]}
    assert need <= got and len(got) < 6 * 63 // 2
    some = skipping.surviving(spark, files, fp, 0, 1000)
    assert some and spark.read.parquet(*some).where("k between 0 and 1000").count() == sum(0 <= r["k"] <= 1000 for r in rows)


def test_key_files(spark, tmp_path):
    v = [5, 1, 5, 2**63 + 7, 9]
    path = str(tmp_path / "keys")
    with open(path, "wb") as f:
        f.write(np.array([len(v), *v], "<u8").tobytes())
    assert sorted(r["k"] for r in keyfiles.read_keys(spark, path, bits=60).collect()) == [1, 5, 7, 9]
    wide = sorted(r["k"] for r in keyfiles.read_keys(spark, path, bits=None).collect())
    assert wide == [x - 2**63 for x in (1, 5, 9)] + [7] and len(keyfiles.read_keys(spark, path, first=2).collect()) == 2
    keyfiles.write_keys(spark.createDataFrame([(3,), (1,)], "k long"), path)
    assert [r["k"] for r in keyfiles.read_keys(spark, path).orderBy("k").collect()] == [1, 3]


def test_logs_and_reports(spark, tmp_path):
    text = ["goos: linux", "BenchmarkA/Keys=1024/Mode=fast-8 100 12.5 ns/op 88.0 bits/key 16 B/op", "BenchmarkA/Keys=1024/Mode=fast-8 50 14.5 ns/op 90.0 bits/key", "BenchmarkB 1 2", "BenchmarkC-4 7 3 ns/op 1e3 x.y/z"]
    lines = spark.createDataFrame([(x,) for x in text], "value string")
    rows = {(r["full_name"], r["samples"]): r for r in benchlogs.parse_lines(lines).collect()}
    assert len(rows) == 3 and rows["BenchmarkA/Keys=1024/Mode=fast-8", 100]["params"] == {"keys": "1024", "mode": "fast"}
    assert rows["BenchmarkA/Keys=1024/Mode=fast-8", 100]["metrics"] == {"ns_per_op": 12.5, "bits_key": 88.0, "bytes_per_op": 16.0} and rows["BenchmarkC-4", 7]["metrics"] == {"ns_per_op": 3.0, "xy_z": 1000.0}
    med = {(r["benchmark"], r["metric"]): (r["samples"], r["median"]) for r in benchlogs.medians(benchlogs.parse_lines(lines), ["keys"]).collect()}
    assert med["BenchmarkA", "ns_per_op"] == (2, 13.5)
    tree = {"name": "all", "total_bytes": 10, "children": [{"name": "bits", "total_bytes": 6, "children": [{"name": "ranks", "total_bytes": 6}]}, {"name": "keys", "total_bytes": 4}]}
    nodes = benchlogs.parse_reports(spark.createDataFrame([("x JSON: " + json.dumps(tree),), ("none",)], "value string"), "JSON").cache()
    assert nodes.count() == 4
    assert {r["component"]: r["bytes"] for r in benchlogs.flattened(nodes, {"Bits": "bits"}).collect()} == {"Bits": 6, "Other": 4}
    assert "all: 10\n  all" not in benchlogs.report_text(nodes).first()["text"] and benchlogs.report_json(nodes).count() == 1
    path = str(tmp_path / "csv")
    benchlogs.write_csv(spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.9)], "s string, x int, y double"), path)
    assert [tuple(p) for p in benchlogs.series_of(benchlogs.read_csv(spark, path, "s string, x int, y double"), "s", "x", "y").first()["points"]] == [(1, 0.9), (2, 0.5)]


def test_metrics(spark, keys):
    q = spark.createDataFrame([(0, int(KEYS[3]) - 1, int(KEYS[3])), (1, int(KEYS[3]), int(KEYS[3])), (2, 5, 4)], "qid long, a long, b long")
    assert [(r["qid"], r["b"]) for r in metrics.shrunk(keys, q).collect()] == [(0, int(KEYS[3]) - 1)]
    s = spark.createDataFrame([("x", 2.0, 0.1), ("x", 4.0, 0.001), ("y", 1.0, 0.5)], "series string, bits double, fpr double")
    got = {r["series"]: r["bits"] for r in metrics.threshold_crossings(s, 0.01).collect()}
    assert set(got) == {"x"} and abs(got["x"] - 3.0) < 1e-9
    study = metrics.build_study(spark, 400, 50, 64, 12)
    p = (1 - sizes.theory_false_positive(64, 12)) ** 50
    assert abs(study.where("attempts = 1").count() / 400 - p) < 0.1
    assert metrics.quantiles(spark.range(101).withColumnRenamed("id", "v"), "v", [0.5]).first()["value"] == 50.0


def test_sizes():
    assert sizes.trunc_bits(1 << 20, 0.001) == math.ceil(math.log2(2 * (1 << 20) / 0.001)) and sizes.trunc_bits(0 + 1, 2) == 1
    assert sizes.ceil_log2(8) == 3 and sizes.ceil_log2(8.0001) == 4
    with pytest.raises(ValueError):
        sizes.soda_bits(1 << 40, 1 << 20, 1e-6)
    assert sizes.exact_bits(8, 4) == 8 + 16 + 8 and sizes.exact_bits(0, 4) == 0
    assert [sizes.width_for_max(x) for x in (0, 255, 256, 65535, 65536, 2**32, 2**64 - 1)] == [8, 8, 16, 16, 32, 64, 64]
    assert sizes.width_candidates(9) == [16, 32, 64] and sizes.bucket_count(9, 4) == 3 and sizes.budget_bits(0) == 1 and sizes.budget_bits(99) == 64
    assert 0 < sizes.theory_build_success(10, 64, 8) <= 1 and sizes.scan_eps(1000, 10, 20) > 0


def test_generators(spark):
    assert generators.uniform(spark, 500, 30).count() == 500 and generators.clustered(spark, 800).count() > 700
    assert generators.spread(spark, 300).where("k < 0").count() == 0 and generators.zipf(spark, 300).count() > 5
    low = generators.shared_low_bits(spark, 300, 4).selectExpr("k % 1048576 as l").distinct().count()
    assert low <= 4 and generators.cluster_queries(spark, 50, 10).where("b - a <> 9").count() == 0
    assert generators.uniform(spark, 100, 30).exceptAll(generators.uniform(spark, 100, 30)).count() == 0
    assert generators.sequential(spark, 5).agg(F.max("k")).first()[0] == 5000 and generators.bit_texts(spark, 20, 70).where("length(key) <> 70").count() == 0


def test_sidecar_follows_a_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for part in np.array_split(KEYS, 3):
        spark.createDataFrame([(int(k),) for k in part], "k long").write.mode("append").parquet(src)
        s = spark.readStream.schema("k long").parquet(src)
        sidecar.follow(s, out, mark, 1 << 30, 1 << 39, 24).awaitTermination()
    q = spark.createDataFrame([(i, int(k) - 1, int(k)) for i, k in enumerate(KEYS[::9])] + [(900, -10, -5), (901, 9, 3)], "qid long, a long, b long")
    got = {r["qid"]: r["is_empty"] for r in sidecar.answer(spark, out, q, 1 << 30, 1 << 39, 24).collect()}
    assert not any(v for i, v in got.items() if i < 900) and got[900] and got[901]


def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    from voidscan.plans.catalogue import ORACLE, QUERIES

    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())
