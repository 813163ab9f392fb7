"""Registered queries over the driver's tables, and DuckDB SQL with the same result.

Keys are the distinct microseconds of events.ts; query intervals come from orders by fixed arithmetic, some of them reversed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscan.functions import bits, generators, sizes
from voidscan.operators import approx, composite, exact, maps, metrics, order, segments, skipping, tries
from voidscan.plans.stage import staged
from voidscan.sources import benchlogs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Constants of the pairwise hash in registered queries.
HASH = (4611686018427387847, 1152921504606846883)
STEP, UNIT = 829348951, 50_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return staged(_table(spark, sf, "events").select(_micros("ts").alias("k")).distinct())


def _asked(spark: SparkSession, sf: str, keys: DataFrame) -> DataFrame:
    _, lo, hi = approx.bounds(keys)
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"))
    a = F.lit(lo) + (F.col("qid") * STEP) % (hi - lo)
    return o.withColumn("a", a).withColumn("b", F.when(F.col("qid") % 50 == 0, F.col("a") - 1).otherwise(F.col("a") + F.col("qid") % 7 * UNIT))


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = _keys(spark, sf)
    return k, _asked(spark, sf, k)


_K = "k AS (SELECT DISTINCT epoch_us(ts) AS k FROM events), s AS (SELECT min(k) AS lo, max(k) AS hi, count(*) AS n FROM k)"
_Q = f"q AS (SELECT qid, a, CASE WHEN qid % 50 = 0 THEN a - 1 ELSE a + qid % 7 * {UNIT} END AS b FROM (SELECT o_orderkey AS qid, lo + (o_orderkey * {STEP}) % (hi - lo) AS a FROM orders, s))"
_T = "t AS (SELECT q.*, a > b OR k IS NULL OR k > b AS is_empty, k AS first_key FROM q ASOF LEFT JOIN k ON q.a <= k.k)"
_R = "r AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS rank, lag(k) OVER (ORDER BY k) AS prev, lead(k) OVER (ORDER BY k) AS next FROM k)"
_LEN = lambda x: f"(CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END)"


# ---- exact


@query(f"WITH {_K}, {_Q}, {_T} SELECT qid, a, b, is_empty FROM t")
def range_empty_exact(spark, sf):
    """Does an interval hold any key?"""
    k, q = _both(spark, sf)
    return exact.is_empty(k, q).select("qid", "a", "b", "is_empty")


@query(f"WITH {_K}, {_Q}, {_T} SELECT qid, is_empty FROM t")
def range_empty_by_split(spark, sf):
    """The same answers by the number where the ends of an interval part."""
    k, q = _both(spark, sf)
    return exact.is_empty_by_split(k, q).select("qid", "is_empty")


@query(f"WITH {_K}, {_Q}, {_T} SELECT qid, CASE WHEN NOT is_empty THEN first_key ELSE -1 END AS first_key FROM t")
def range_first_key(spark, sf):
    k, q = _both(spark, sf)
    return exact.first_in(k, q).select("qid", F.coalesce("first_key", F.lit(-1)).alias("first_key"))


@query(f"""WITH {_K}, {_Q}, {_R}, x AS (SELECT q.*, coalesce(r.rank, n) AS lo_ FROM q CROSS JOIN s ASOF LEFT JOIN r ON q.a <= r.k),
y AS (SELECT x.*, coalesce(r.rank + 1, 0) AS hi_ FROM x ASOF LEFT JOIN r ON x.b >= r.k) SELECT qid, lo_ AS lo, greatest(lo_, hi_) AS hi FROM y""")
def range_ranks(spark, sf):
    """Half-open interval of ranks of the keys in each interval."""
    k, q = _both(spark, sf)
    return exact.counted(k, q).select("qid", "lo", "hi")


@query(f"""WITH {_K}, p AS (SELECT n, lo, {_LEN('(hi - lo)')} AS w, greatest(1, length(bin(n)) - 1) AS kb FROM s),
c AS (SELECT (k - lo) >> greatest(w - kb, 0) AS blk, count(*) AS n FROM k, p GROUP BY 1)
SELECT any_value(p.n) AS n, (1 << any_value(kb))::BIGINT AS blocks, count(*) AS occupied, avg(c.n) AS avg_keys, max(c.n) AS max_keys, 1 - count(*) / (1 << any_value(kb)) AS empty_share,
any_value((1 << kb) + p.n + (1 << kb) + p.n * (w - kb))::BIGINT AS size_bits FROM c, p""")
def range_block_stats(spark, sf):
    """Blocks of the exact index and its size model."""
    k = _keys(spark, sf)
    _, lo, hi = approx.bounds(k)
    return exact.stats(k.select((F.col("k") - lo).alias("k")), (hi - lo).bit_length())


@query(f"""WITH {_K}, {_R}, p AS (SELECT n, lo, {_LEN('(hi - lo)')} AS w, greatest(1, length(bin(n)) - 1) AS kb FROM s)
SELECT (k - lo) >> greatest(w - kb, 0) AS blk, count(*) AS n, min(rank) AS lo, max(rank) + 1 AS hi, min(k - lo) AS first_key, max(k - lo) AS last_key FROM r, p GROUP BY 1""")
def range_blocks(spark, sf):
    k = _keys(spark, sf)
    _, lo, hi = approx.bounds(k)
    return exact.blocks(k.select((F.col("k") - lo).alias("k")), (hi - lo).bit_length())


# ---- order


@query(f"WITH {_K}, {_R} SELECT k, rank FROM r")
def rank_of_key(spark, sf):
    k = _keys(spark, sf)
    return order.rank_of(k, k).select("k", "rank")


@query(f"WITH {_K}, {_Q}, {_R} SELECT qid, coalesce(rank, -1) AS rank FROM q LEFT JOIN r ON q.a = r.k")
def rank_of_any(spark, sf):
    """-1 for what is no key."""
    k, q = _both(spark, sf)
    return order.rank_of(k, q.select("qid", F.col("a").alias("k"))).select("qid", "rank")


@query(f"WITH {_K}, {_R} SELECT x.k AS a, y.k AS b, x.rank AS rank_first, y.rank AS rank_second FROM r x JOIN r y ON x.next = y.k")
def rank_pairs(spark, sf):
    k = _keys(spark, sf)
    pairs = order.neighbours(k).where("prev is not null").select(F.col("prev").alias("a"), F.col("k").alias("b"))
    return order.rank_pairs(k, pairs, "a", "b")


@query(f"WITH {_K}, {_R} SELECT o_orderkey AS i, coalesce(k, -1) AS k FROM orders LEFT JOIN r ON r.rank = o_orderkey")
def select_kth(spark, sf):
    """-1 beyond the last key."""
    asked = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"))
    return order.select_kth(_keys(spark, sf), asked).select("i", F.coalesce("k", F.lit(-1)).alias("k"))


@query(f"WITH {_K}, {_R} SELECT k, coalesce(prev, -1) AS prev, rank FROM r")
def neighbours(spark, sf):
    return order.neighbours(_keys(spark, sf)).fillna(-1, ["prev"])


@query(f"""WITH {_K}, {_Q}, x AS (SELECT q.qid, q.a, k AS next FROM q ASOF LEFT JOIN k ON q.a <= k.k) SELECT x.qid, coalesce(next, -1) AS next, coalesce(k.k, -1) AS last FROM x ASOF LEFT JOIN k ON x.a > k.k""")
def successor_predecessor(spark, sf):
    k, q = _both(spark, sf)
    return order.located(q, k, "a").select("qid", "next", "last").fillna(-1)


_SLOTS = f"sl AS (SELECT k, row_number() OVER (ORDER BY {bits.universal_sql('k', 0)}, k) AS slot FROM k)"


@query(f"WITH {_K}, {_SLOTS} SELECT k, slot FROM sl")
def mphf_slots(spark, sf):
    """Each key its own number of 1..n."""
    return order.slots(_keys(spark, sf)).select("k", "slot")


@query(f"WITH {_K}, {_Q}, {_SLOTS} SELECT qid, coalesce(slot, 0) AS slot FROM (SELECT qid, CASE WHEN qid % 3 = 0 THEN (SELECT max(k) FROM k WHERE k <= a) ELSE a END AS k FROM q) LEFT JOIN sl USING (k)")
def mphf_lookup(spark, sf):
    """0 for what is no key; a third of the questions are keys."""
    k, q = _both(spark, sf)
    near = order.located(q.withColumn("_p", F.col("a") + 1), k, "_p").select("qid", F.when(F.col("qid") % 3 == 0, F.col("last")).otherwise(F.col("a")).alias("k"))
    return order.slot_of(order.slots(k), near).select("qid", "slot")


def _bits(spark, sf):
    return _table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") % 3 == 0).cast("int").alias("bit"))


_B = "v AS (SELECT event_id AS pos, (user_id % 3 = 0)::INT AS bit, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events), o AS (SELECT pos, bit, coalesce(sum(bit) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ones, n FROM v)"


@query(f"WITH {_B} SELECT pos, bit, ones AS ones_before, n - ones AS zeros_before FROM o")
def bitvector_rank(spark, sf):
    return order.bit_ranks(_bits(spark, sf))


@query(f"WITH {_B}, z AS (SELECT pos, bit, CASE WHEN bit = 1 THEN ones ELSE n - ones END AS i FROM o), a AS (SELECT o_orderkey AS i, (o_orderkey % 2)::INT AS bit FROM orders) SELECT a.i, a.bit, coalesce(z.pos, (SELECT count(*) FROM events)) AS pos FROM a LEFT JOIN z USING (i, bit)")
def bitvector_select(spark, sf):
    """The vector's length where there are no more such bits."""
    asked = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 2).cast("int").alias("bit"))
    return order.bit_select(_bits(spark, sf), asked).select("i", "bit", "pos")


@query("SELECT count(*) AS num, sum((user_id % 3 = 0)::BIGINT)::BIGINT AS ones, sum((user_id % 3 <> 0)::BIGINT)::BIGINT AS zeros FROM events")
def bitvector_totals(spark, sf):
    return order.bit_totals(_bits(spark, sf))


@query(f"WITH {_B}, g AS (SELECT *, n - row_number() OVER (PARTITION BY bit ORDER BY pos) AS i FROM o) SELECT bit, min(pos) AS first, max(pos) AS last, count(*) AS length FROM g GROUP BY bit, i")
def bitvector_runs(spark, sf):
    return order.runs(_bits(spark, sf))


# ---- bits


_W = 40
_X = f"x AS (SELECT o_orderkey AS id, (o_orderkey * {STEP}) % (1::BIGINT << {_W}) AS x, (o_custkey * {STEP}) % (1::BIGINT << {_W}) AS y FROM orders)"


@query(f"""WITH {_X} SELECT id, {_LEN('x')}::INT AS bits_needed, {_LEN('x')}::INT - 1 AS top, (x + y) & {bits.mask(_W)} AS added, (x - y) & {bits.mask(_W)} AS subtracted, x >> 24 AS head, x & {bits.mask(12)} AS tail,
x & {bits.mask(_W - 5)} AS dropped, (x >> 20) & {bits.mask(10)} AS middle, ((x >> {_W - 1 - 7}) & 1)::INT AS bit7, x * 2 + 1 AS appended, ({_W} - {_LEN('xor(x, y)')})::INT AS lcp,
(x >> 35) = (y >> 35) AS same_head, x + 1 AS next, greatest(x - 1, 0) AS before, (CASE WHEN x = 0 THEN 0 ELSE {_W + 1} - length(bin(x & -x)) END)::INT AS last_bit,
CASE WHEN x = 0 THEN 0 ELSE x // (x & -x) END AS trimmed, CASE WHEN least(x, y) = greatest(x, y) THEN 0 ELSE (greatest(x, y) >> (length(bin(xor(x, y))) - 1)) << (length(bin(xor(x, y))) - 1) END AS fattest,
lpad(bin(x), {_W}, '0') AS text FROM x""")
def bit_operations(spark, sf):
    """Operations on keys of 40 bits."""
    w = _W
    t = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * STEP).bitwiseAND(F.lit(bits.mask(w))).alias("x"), (F.col("o_custkey") * STEP).bitwiseAND(F.lit(bits.mask(w))).alias("y"))
    return t.select("id", bits.bitlen("x").alias("bits_needed"), bits.most_significant_bit("x").alias("top"), bits.add("x", "y", w).alias("added"), bits.sub("x", "y", w).alias("subtracted"), bits.prefix("x", 16, w).alias("head"),
                    bits.suffix("x", 12).alias("tail"), bits.drop_first("x", 5, w).alias("dropped"), bits.bit_range("x", 10, 10, w).alias("middle"), bits.bit_at("x", 7, w).cast("int").alias("bit7"), bits.append_bit("x", 1).alias("appended"),
                    bits.lcp("x", "y", w).alias("lcp"), bits.has_prefix("x", bits.prefix("y", 5, w), 5, w).alias("same_head"), bits.successor("x", w).alias("next"), bits.predecessor("x").alias("before"),
                    bits.bit_length("x", w).alias("last_bit"), bits.trim_trailing_zeros("x").alias("trimmed"), bits.two_fattest(F.least("x", "y"), F.greatest("x", "y")).alias("fattest"), bits.pretty("x", w).alias("text"))


@query(f"""WITH {_X}, t AS (SELECT id, bin(x) AS a, bin(y) AS b FROM x)
SELECT id, length(a)::INT AS nbits, rtrim(a, '0') AS trimmed, (length(a) - length(rtrim(a, '1')))::INT AS ones_at_end, CASE WHEN a = '' THEN '' ELSE a || '1' END AS in_order, substr(a, 1, 5) = substr(b, 1, 5) AS same_head,
CASE WHEN strpos(a, '0') = 0 THEN rpad('1', (length(a) + 1)::INT, '0') ELSE bin(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(a, ''), lambda c: c::BIGINT)), lambda p, c: p * 2 + c) + 1) END AS next FROM t""")
def bit_strings(spark, sf):
    """Operations on bit strings of different lengths; they survive the way to bytes and back."""
    t = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.bin((F.col("o_orderkey") * STEP).bitwiseAND(F.lit(bits.mask(_W)))).alias("a"), F.bin((F.col("o_custkey") * STEP).bitwiseAND(F.lit(bits.mask(_W)))).alias("b"))
    t = t.withColumn("s", bits.from_text("a")).withColumn("a", bits.text_of("s"))
    return t.select("id", F.col("s.nbits").alias("nbits"), bits.text_trimmed("a").alias("trimmed"), F.length(F.regexp_extract("a", "(1*)$", 1)).alias("ones_at_end"), bits.trie_order("a").alias("in_order"),
                    (F.substring("a", 1, 5) == F.substring("b", 1, 5)).alias("same_head"), bits.text_successor("a").alias("next"))


@query(f"""WITH x AS (SELECT o_orderkey AS id, (o_orderkey * {STEP}) % (1::BIGINT << 40) AS x, (o_orderkey % 40)::INT AS i FROM orders), p AS (SELECT id, list_filter(range(0, 64), lambda j: j < 40 AND ((x >> j) & 1) = 1) AS ones, i, x FROM x)
SELECT id, bit_count(x & ((1::BIGINT << i) - 1))::INT AS rank, coalesce(ones[i // 4 + 1], -1)::INT AS place, coalesce(list_filter(ones, lambda j: j >= i)[1] - i, 64 - i)::INT AS zeros FROM p""")
def word_operations(spark, sf):
    """Rank, select and zero runs inside a word."""
    t = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * STEP).bitwiseAND(F.lit(bits.mask(40))).alias("x"), (F.col("o_orderkey") % 40).cast("int").alias("i"))
    return t.select("id", bits.word_rank("x", "i").cast("int").alias("rank"), F.coalesce(bits.word_select("x", F.floor(F.col("i") / 4).cast("int")), F.lit(-1)).alias("place"), bits.word_zero_run("x", "i").alias("zeros"))


@query("SELECT o_custkey AS id, sum(o_orderkey * 2)::BIGINT AS doubled, sum(o_orderkey + length(o_orderstatus))::BIGINT AS both FROM orders GROUP BY 1")
def list_transforms(spark, sf):
    """Functions over lists, keys, values and entries."""
    m = _table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("m"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return m.select("id", total(bits.mapped_keys("m", lambda k: k * 2)).alias("doubled"), total(bits.mapped_entries("m", lambda k, v: k + F.length(v))).alias("both"))


# ---- tries and prefixes


def _trie_keys(spark, sf):
    k = _keys(spark, sf)
    _, lo, hi = approx.bounds(k)
    return k.select((F.col("k") - lo).alias("k")), (hi - lo).bit_length()


_N = f"""w AS (SELECT lo AS base, {_LEN('(hi - lo)')} AS w FROM s), r AS (SELECT k - base AS k, w, row_number() OVER (ORDER BY k) - 1 AS rank, lag(k - base) OVER (ORDER BY k) AS prev FROM k, w),
l AS (SELECT k, w, rank, CASE WHEN prev IS NULL THEN -1 ELSE w - {_LEN('xor(prev, k)')} END AS lcp FROM r)"""
_NODES = f"""{_N}, e0 AS (SELECT k AS extent, w AS len, w FROM l UNION SELECT k >> (w - lcp), lcp, w FROM l WHERE lcp >= 0),
e AS (SELECT e0.*, l.rank AS lo FROM e0 ASOF JOIN l ON (e0.extent << (e0.w - e0.len)) <= l.k), f AS (SELECT e.*, coalesce(l.rank, (SELECT count(*) FROM l)) AS hi FROM e ASOF LEFT JOIN l ON ((e.extent + 1) << (e.w - e.len)) <= l.k),
g AS (SELECT f.*, greatest(x.lcp, coalesce(y.lcp, -1)) AS parent_depth FROM f JOIN l x ON x.rank = f.lo LEFT JOIN l y ON y.rank = f.hi),
h AS (SELECT *, CASE WHEN greatest(parent_depth, 0) = len THEN 0 ELSE (len >> (length(bin(xor(greatest(parent_depth, 0), len))) - 1)) << (length(bin(xor(greatest(parent_depth, 0), len))) - 1) END AS handle_len FROM g)"""


@query(f"WITH {_K}, {_N} SELECT k, rank, lcp::INT AS lcp FROM l")
def lcp_adjacent(spark, sf):
    k, w = _trie_keys(spark, sf)
    return tries.adjacent_lcp(k, w)


@query(f"WITH {_K}, {_NODES} SELECT extent, len::INT AS len, lo, hi, parent_depth::INT AS parent_depth, (parent_depth + 1)::INT AS name_len, handle_len::INT AS handle_len, extent >> (len - handle_len) AS handle, len = w AS is_leaf FROM h")
def trie_nodes(spark, sf):
    """The compacted trie of all keys."""
    return tries.nodes(*_trie_keys(spark, sf))


@query(f"""WITH {_K}, {_NODES}, x AS (SELECT extent, len, handle_len, greatest(parent_depth, 0) AS a, unnest(range(greatest(parent_depth, 0) + 1, greatest(handle_len, 1))) AS f FROM h),
d AS (SELECT handle_len AS len, extent >> (len - handle_len) AS p, len AS e FROM h UNION SELECT f, extent >> (len - f), NULL FROM x WHERE (f >> (length(bin(xor(a, f))) - 1)) << (length(bin(xor(a, f))) - 1) = f)
SELECT count(*) AS entries, count(e) AS true_entries FROM d""")
def trie_entries(spark, sf):
    """Descriptors with and without pseudo-descriptors."""
    return tries.entry_counts(staged(tries.nodes(*_trie_keys(spark, sf))))


@query(f"""WITH {_K}, {_NODES}, p AS (SELECT DISTINCT xor(k, 1 << (rank % w)) AS p, w FROM r), z AS (SELECT p, w, unnest(range(0, w)) AS l FROM p),
m AS (SELECT p, max(z.l) AS m FROM z JOIN h ON h.len = z.l AND h.extent = z.p >> (z.w - z.l) GROUP BY p)
SELECT p.p, w::INT AS n, greatest((SELECT min(len) FROM h WHERE parent_depth = -1), coalesce(m, 0))::INT + 1 AS exit_len FROM p LEFT JOIN m USING (p)""")
def trie_existing_prefix(spark, sf):
    """Where the search for a key with one bit changed leaves the trie."""
    k, w = _trie_keys(spark, sf)
    asked = order.neighbours(k).select(F.col("k").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("rank") % w).cast("int"))).alias("p"), F.lit(w).alias("n")).distinct()
    return tries.existing_prefix(staged(tries.nodes(k, w)), asked).select("p", "n", "exit_len")


@query(f"WITH {_K}, {_NODES} SELECT extent >> (len - parent_depth) AS parent_extent, parent_depth::INT AS parent_len, extent, len::INT AS len, ((extent >> (len - parent_depth - 1)) & 1)::INT AS branch FROM h WHERE parent_depth >= 0")
def trie_children(spark, sf):
    """Every node but the root hangs under one."""
    return tries.children(staged(tries.nodes(*_trie_keys(spark, sf)))).select("parent_extent", "parent_len", "extent", "len", "branch")


_DESCRIPTORS = """x AS (SELECT extent, len, handle_len, greatest(parent_depth, 0) AS a, unnest(range(greatest(parent_depth, 0) + 1, greatest(handle_len, 1))) AS f FROM h),
d AS (SELECT handle_len AS len, extent >> (len - handle_len) AS p, len AS e FROM h UNION SELECT f, extent >> (len - f), NULL FROM x WHERE (f >> (length(bin(xor(a, f))) - 1)) << (length(bin(xor(a, f))) - 1) = f)"""


@query(f"""WITH {_K}, {_NODES}, {_DESCRIPTORS}, y AS (SELECT lo, greatest(0, {_LEN('(hi - lo)')} - 18) AS z FROM s)
SELECT 'trie' AS name, count(*) AS row_count, count(*) * 49 AS bytes FROM h UNION ALL SELECT 'descriptors', count(*), count(*) * 12 + count(e) * 4 FROM d
UNION ALL SELECT 'fingerprints', count(DISTINCT (k.k - lo) >> z), count(DISTINCT (k.k - lo) >> z) * 8 FROM k, y""")
def component_sizes(spark, sf):
    """Rows and bytes of the parts of a trie and of a filter."""
    k, w = _trie_keys(spark, sf)
    t = staged(tries.nodes(k, w))
    return metrics.component_sizes({"trie": t, "descriptors": tries.descriptors(t), "fingerprints": approx.trunc(k, 18).fp})


@query(f"WITH {_K}, {_NODES}, {_DESCRIPTORS} SELECT len::INT AS len, p AS prefix, (e - len)::INT AS delta FROM d WHERE e IS NOT NULL")
def trie_deltas(spark, sf):
    """What is stored of true descriptors: the extent's length beyond theirs."""
    return tries.deltas(staged(tries.nodes(*_trie_keys(spark, sf)))).select("len", "prefix", F.col("delta").cast("int").alias("delta"))


@query(f"WITH {_K}, {_Q}, {_N}, z AS (SELECT qid, a - base + 1 AS p, w FROM q, w), x AS (SELECT z.*, l.rank, l.k AS bound FROM z ASOF LEFT JOIN l ON z.p <= l.k) SELECT x.qid, coalesce(x.rank, (SELECT count(*) FROM l)) AS rank, coalesce(bound, -1) AS bound, greatest(CASE WHEN bound IS NULL THEN 0 ELSE w - {_LEN('xor(bound, p)')} END, CASE WHEN y.k IS NULL THEN 0 ELSE w - {_LEN('xor(y.k, p)')} END)::INT AS depth FROM x ASOF LEFT JOIN (SELECT k FROM l) y ON x.p > y.k")
def trie_lower_bound(spark, sf):
    """The key at or after a pattern, its rank, and how far the trie agrees with the pattern."""
    k, q = _both(spark, sf)
    _, lo, hi = approx.bounds(k)
    w, k = (hi - lo).bit_length(), staged(k.select((F.col("k") - lo).alias("k")))
    asked = q.select("qid", (F.col("a") - lo + 1).alias("p"))
    found = tries.exit_depth(k, tries.lower_bound(k, asked), w)
    return found.select("qid", "rank", F.coalesce("bound", F.lit(-1)).alias("bound"), "depth")


@query(f"WITH {_K}, {_NODES} SELECT extent, lo, hi, true AS known FROM h")
def trie_locate(spark, sf):
    """A node's own name leads back to its ranks."""
    t = staged(tries.nodes(*_trie_keys(spark, sf)))
    names = t.select("extent", F.call_function("shiftright", F.col("extent"), F.col("len") - F.col("name_len")).alias("p"), F.col("name_len").alias("n"))
    return tries.locate(t, names.where("n > 0").unionByName(names.where("n = 0")), 0).select("extent", "lo", "hi", "known")


_SET = lambda x: f"(CASE WHEN {x} = 0 THEN 0 ELSE w + 2 - length(bin(({x}) & -({x}))) END)"


@query(f"""WITH {_K}, {_NODES}, c AS (SELECT extent << (w + 1 - len) AS value, {_SET('(extent << (w + 1 - len))')} AS nbits, len = w AS leaf FROM h
UNION ALL SELECT (extent << (w + 1 - len)) + (1::BIGINT << (w - len)), len + 1, false FROM h
UNION ALL SELECT (extent + 1) << (w + 1 - len), {_SET('((extent + 1) << (w + 1 - len))')}, false FROM h WHERE extent <> (1::BIGINT << len) - 1),
u AS (SELECT value, nbits::INT AS nbits, bool_or(leaf) AS leaf FROM c GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY value, nbits) - 1 AS rank FROM u""")
def trie_boundaries(spark, sf):
    """The ordered boundary strings of range location, with leaves marked."""
    k, w = _trie_keys(spark, sf)
    return tries.boundary_set(staged(tries.nodes(k, w)), w)


@query(f"""WITH {_K}, {_NODES}, b AS (SELECT *, CASE WHEN len = 0 THEN -1 ELSE (extent << (w + 1 - len)) + (1::BIGINT << (w - len)) END AS i, extent << (w + 1 - len) AS p FROM h)
SELECT extent, len::INT AS len, row_number() OVER (ORDER BY i, len) - 1 AS in_order, row_number() OVER (ORDER BY p, len) - 1 AS pre_order FROM b""")
def trie_traversals(spark, sf):
    k, w = _trie_keys(spark, sf)
    return tries.in_order(staged(tries.nodes(k, w)), w).select("extent", "len", "in_order", "pre_order")


@query(f"""WITH {_K}, {_N}, p AS (SELECT DISTINCT k >> (w - n) AS p, n, w FROM r, (SELECT unnest([4, 9, 14, 20]) AS n)), a AS (SELECT p.*, coalesce(r.rank, (SELECT count(*) FROM r)) AS lo FROM p ASOF LEFT JOIN r ON (p.p << (p.w - n)) <= r.k)
SELECT a.p, a.n::INT AS n, a.lo, coalesce(r.rank, (SELECT count(*) FROM r)) AS hi FROM a ASOF LEFT JOIN r ON ((a.p + 1) << (a.w - n)) <= r.k""")
def prefix_ranks(spark, sf):
    k, w = _trie_keys(spark, sf)
    p = k.select(F.explode(F.array(*[F.struct(bits.prefix("k", n, w).alias("p"), F.lit(n).alias("n")) for n in (4, 9, 14, 20)])).alias("s")).select("s.*").distinct()
    return tries.prefix_ranks(k, p, w)


_P = "p AS (SELECT DISTINCT prefix FROM (SELECT unnest([substr(url, 1, 8), substr(url, 1, 14), substr(url, 1, 22), substr(url, 1, 9) || '~']) AS prefix FROM pages)), u AS (SELECT DISTINCT url FROM pages)"


@query(f"WITH {_P} SELECT prefix, count(*) FILTER (WHERE url < prefix) AS lo, count(*) FILTER (WHERE url < prefix OR starts_with(url, prefix)) AS hi FROM p, u GROUP BY prefix")
def weak_prefix_search(spark, sf):
    """Rank intervals of URL prefixes; an absent one has an empty interval."""
    u = _table(spark, sf, "pages").select(F.col("url").alias("key"))
    p = u.select(F.explode(F.array(F.substring("key", 1, 8), F.substring("key", 1, 14), F.substring("key", 1, 22), F.concat(F.substring("key", 1, 9), F.lit("~")))).alias("prefix")).distinct()
    return tries.text_prefix_ranks(u, p).select("prefix", "lo", "hi")


@query(f"WITH {_P} SELECT prefix, bool_or(starts_with(url, prefix)) AS found FROM p, u GROUP BY prefix")
def contains_prefix(spark, sf):
    u = _table(spark, sf, "pages").select(F.col("url").alias("key"))
    p = u.select(F.explode(F.array(F.substring("key", 1, 8), F.substring("key", 1, 14), F.substring("key", 1, 22), F.concat(F.substring("key", 1, 9), F.lit("~")))).alias("prefix")).distinct()
    return tries.contains_prefix(u, p)


# ---- approximate filters


def _trunc_sql(k: int) -> str:
    return f"""p AS (SELECT lo, hi, greatest(0, {_LEN('(hi - lo)')} - {k}) AS z FROM s), fp AS (SELECT DISTINCT (k - lo) >> z AS fp FROM k, p),
m AS (SELECT qid, a, b, (greatest(a, lo) - lo) >> z AS x, (least(b, hi) - lo) >> z AS y, a <= b AND b >= lo AND a <= hi AS meets FROM q, p), u AS (SELECT m.*, NOT meets OR fp IS NULL OR fp > y AS said FROM m ASOF LEFT JOIN fp ON m.x <= fp.fp)"""


@query(f"WITH {_K}, {_Q}, {_trunc_sql(18)} SELECT qid, said AS is_empty FROM u")
def trunc_empty(spark, sf):
    k, q = _both(spark, sf)
    return approx.answer(approx.trunc(k, 18), q).select("qid", "is_empty")


@query(f"WITH {_K}, {_Q}, {_T} SELECT qid, is_empty FROM t")
def adaptive_empty_exact_mode(spark, sf):
    """62 bits hold the spread, so the answers are exact, ends beyond the greatest key included."""
    k, q = _both(spark, sf)
    return approx.answer(approx.adaptive(k, 62, 7 * UNIT), q).select("qid", "is_empty")


def _soda_sql(k: int, base: str, clamp: bool) -> str:
    top, h = bits.mask(k), lambda x: f"((({HASH[0]}::HUGEINT * ({x} >> {k})::HUGEINT + {HASH[1]}::HUGEINT)::UHUGEINT >> {128 - k})::BIGINT)"
    ca, cb = ("greatest(a, lo)", "least(b, hi)") if clamp else ("a", "b")
    meets = "a <= b AND b >= lo AND a <= hi" if clamp else "a <= b"
    piece = lambda x, y, cond: f"SELECT qid, {x} AS x, {y} AS y FROM v WHERE {cond} AND {x} <= {y} UNION ALL SELECT qid, {x}, {top} FROM v WHERE {cond} AND {x} > {y} UNION ALL SELECT qid, 0, {y} FROM v WHERE {cond} AND {x} > {y}"
    xa, xb = f"({h('pa')} + (pa & {top})) & {top}", f"({h('pb')} + (pb & {top})) & {top}"
    return f"""fp AS (SELECT DISTINCT ({h(f'(k - {base})')} + ((k - {base}) & {top})) & {top} AS fp FROM k, s), v AS (SELECT qid, {ca} - {base} AS pa, {cb} - {base} AS pb FROM q, s WHERE {meets}),
i AS ({piece(xa, xb, f'pa >> {k} = pb >> {k}')} UNION ALL SELECT qid, 0, {top} FROM v WHERE pb >> {k} > (pa >> {k}) + 1 UNION ALL
{piece(xa, f'({h("pa")} + {top}) & {top}', f'pb >> {k} = (pa >> {k}) + 1')} UNION ALL {piece(f'{h("pb")} & {top}', xb, f'pb >> {k} = (pa >> {k}) + 1')}),
j AS (SELECT qid, bool_and(fp IS NULL OR fp > y) AS e FROM i ASOF LEFT JOIN fp ON i.x <= fp.fp GROUP BY qid)"""


@query(f"WITH {_K}, {_Q}, {_soda_sql(32, '0', False)} SELECT q.qid, coalesce(e, true) AS is_empty FROM q LEFT JOIN j USING (qid)")
def soda_empty(spark, sf):
    k, q = _both(spark, sf)
    return approx.answer(approx.soda(k, 32, 7 * UNIT, constants=HASH), q).select("qid", "is_empty")


@query(f"WITH {_K}, {_Q}, {_soda_sql(34, 'lo', True)} SELECT q.qid, coalesce(e, true) AS is_empty FROM q LEFT JOIN j USING (qid)")
def adaptive_empty(spark, sf):
    k, q = _both(spark, sf)
    return approx.answer(approx.adaptive(k, 34, 7 * UNIT, constants=HASH), q).select("qid", "is_empty")


_CDF = f"""r2 AS (SELECT k, rank FROM r), kn AS (SELECT k AS k0, rank AS r0, lead(k) OVER (ORDER BY k) AS k1, lead(rank) OVER (ORDER BY k) AS r1 FROM r2, s WHERE rank % 128 = 0 OR rank = n - 1),
kd AS (SELECT max((r1 - r0) / (k1 - k0)) AS density FROM kn WHERE k1 IS NOT NULL),
kb AS (SELECT n, lo, hi, least(52, greatest(1, ceil(log2(greatest(1.0, n * greatest(1.0, {7 * UNIT} * density * (hi - lo) / n) / 0.01)))))::INT AS kb FROM s, kd),
ks AS (SELECT *, ((1::BIGINT << kb) - 1)::DOUBLE / greatest(1, n - 1) AS scale, (1::BIGINT << kb) - 1 AS top FROM kb),
kk AS (SELECT k0, k1, r0 * scale AS y0, r1 * scale AS y1, top FROM kn, ks WHERE k1 IS NOT NULL)"""
_MAP = lambda v: f"least(greatest(floor(y0 + ({v} - k0)::DOUBLE / (k1 - k0) * (y1 - y0)), 0), top)::BIGINT"


@query(f"""WITH {_K}, {_Q}, {_R}, {_CDF}, fp AS (SELECT DISTINCT {_MAP('k.k')} AS fp FROM k ASOF JOIN kk ON k.k >= kk.k0),
m AS (SELECT qid, greatest(a, lo) AS x, least(b, hi) AS y FROM q, s WHERE a <= b AND b >= lo AND a <= hi),
mx AS (SELECT qid, y, {_MAP('x')} AS x FROM m ASOF JOIN kk ON m.x >= kk.k0), my AS (SELECT qid, x, {_MAP('y')} AS y FROM mx ASOF JOIN kk ON mx.y >= kk.k0),
u AS (SELECT qid, fp IS NULL OR fp > y AS e FROM my ASOF LEFT JOIN fp ON my.x <= fp.fp) SELECT q.qid, coalesce(e, true) AS is_empty FROM q LEFT JOIN u USING (qid)""")
def cdf_empty(spark, sf):
    """A filter over a map by ranks."""
    k, q = _both(spark, sf)
    f, knots = approx.cdf(k, 7 * UNIT, 0.01)
    return approx.answer(f, q, knots=knots).select("qid", "is_empty")


_PROBES = 14  # more than a rate of 0.2 % asks for
_BIT = lambda v: f"unnest([{', '.join('(' + bits.universal_sql(v, 2 * i) + ' * 2147483648 + ' + bits.universal_sql(v, 2 * i + 1) + ')' for i in range(_PROBES))}])"


@query(f"""WITH {_K}, {_R}, z AS (SELECT greatest(64, ceil(-n * ln(1 - pow(1 - 0.01, 1 / 5.0)) / pow(ln(2), 2)))::BIGINT AS m, n FROM s), y AS (SELECT m, greatest(1, round(m / n * ln(2)))::INT AS hashes FROM z),
q AS (SELECT rank AS qid, k - rank % 5 AS a, k - CASE WHEN rank % 3 = 0 THEN 0 ELSE 1 END AS b FROM r),
f AS (SELECT DISTINCT p % m AS p FROM (SELECT {_BIT('k')} AS p, unnest(range(0, {_PROBES})) AS i FROM k), y WHERE i < hashes),
v AS (SELECT qid, unnest(range(a, b + 1)) AS v FROM q), w AS (SELECT qid, v, p, i FROM (SELECT qid, v, {_BIT('v')} AS p, unnest(range(0, {_PROBES})) AS i FROM v)),
t AS (SELECT qid, v, bool_and(f.p IS NOT NULL) AS may FROM (SELECT w.qid, w.v, w.p % m AS p FROM w, y WHERE i < hashes) w LEFT JOIN f ON w.p = f.p GROUP BY qid, v),
u AS (SELECT qid, bool_or(may) AS may FROM t GROUP BY qid) SELECT q.qid, NOT coalesce(may, false) AS is_empty FROM q LEFT JOIN u USING (qid)""")
def bloom_empty(spark, sf):
    """Short intervals at and beside keys by a Bloom filter of points."""
    k = _keys(spark, sf)
    q = order.neighbours(k).select(F.col("rank").alias("qid"), (F.col("k") - F.col("rank") % 5).alias("a"), (F.col("k") - F.when(F.col("rank") % 3 == 0, 0).otherwise(1)).alias("b"))
    words, m, h = approx.bloom(k, 5, 0.01)
    return approx.bloom_empty(words, m, h, q).select("qid", "is_empty")


# ---- segments


@query(f"""WITH {_K}, {_R}, g AS (SELECT k, prev, k - prev AS gap FROM r), o AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i FROM g WHERE gap IS NOT NULL),
e AS (SELECT gap AS eps FROM o, s WHERE i = least(floor(0.95 * (n - 1))::BIGINT, n - 2)), c AS (SELECT k, sum(CASE WHEN prev IS NULL OR gap > eps THEN 1 ELSE 0 END) OVER (ORDER BY k) AS seg FROM g, e),
x AS (SELECT min(k) AS min_k, max(k) AS max_k, count(*) AS n FROM c GROUP BY seg) SELECT row_number() OVER (ORDER BY min_k) - 1 AS seg, min_k, max_k, x.n FROM x, s WHERE x.n >= greatest(2, floor(0.01 * s.n))""")
def gap_clusters(spark, sf):
    return segments.gap_segments(_keys(spark, sf)).select("seg", "min_k", "max_k", "n")


def _dense(spark, sf):
    """Order keys with a wide step between priorities, some of them moved away to leave gaps: real clusters."""
    o, k = _table(spark, sf, "orders"), F.col("o_orderkey")
    away = F.when(k % 97 == 0, k * 1000).when((k % 7 == 3) & (k % 100 >= 20), 400_000_000 + k * 211).otherwise(0)
    return staged(o.select((k * 3 + F.substring("o_orderpriority", 1, 1).cast("long") * 10**9 + away).alias("k")).distinct())


_D = """k AS (SELECT DISTINCT o_orderkey * 3 + substr(o_orderpriority, 1, 1)::BIGINT * 1000000000 + CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey * 1000 WHEN o_orderkey % 7 = 3 AND o_orderkey % 100 >= 20 THEN 400000000 + o_orderkey * 211 ELSE 0 END AS k FROM orders)"""


_DENSITY = """c AS (SELECT k, count(*) OVER (ORDER BY k RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS l, count(*) OVER (ORDER BY k RANGE BETWEEN CURRENT ROW AND 100 FOLLOWING) AS r FROM k),
d AS (SELECT k, k - lag(k) OVER (ORDER BY k) AS gap FROM c WHERE l >= 4 OR r >= 4), i AS (SELECT k, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS i FROM d), e AS (SELECT min(k) AS a, max(k) AS b FROM i GROUP BY i),
z AS (SELECT min(k.k) AS min_k, max(k.k) AS max_k, count(*) AS n FROM e JOIN k ON k.k BETWEEN a - 100 AND b + 100 GROUP BY a), g AS (SELECT row_number() OVER (ORDER BY min_k) - 1 AS seg, min_k, max_k, n FROM z WHERE n >= 16)"""


@query(f"WITH {_D}, {_DENSITY} SELECT seg, min_k, max_k, n FROM g")
def density_clusters(spark, sf):
    return segments.density_segments(_dense(spark, sf), 100, 4, 16).select("seg", "min_k", "max_k", "n")


_SPREAD = f"""st AS (SELECT min(k) AS a FROM k UNION ALL SELECT (SELECT min(k) FROM k WHERE k > st.a + {bits.mask(12)}) FROM st WHERE (SELECT max(k) FROM k) > st.a + {bits.mask(12)}),
z AS (SELECT k.k, st.a FROM k ASOF JOIN st ON k.k >= st.a), sp AS (SELECT a AS min_k, max(k) AS max_k, count(*) AS n FROM z GROUP BY a)"""


@query(f"WITH RECURSIVE {_D}, {_SPREAD} SELECT row_number() OVER (ORDER BY min_k) - 1 AS seg, min_k, max_k, n FROM sp")
def spread_segments(spark, sf):
    """Greedy runs of spread below 2**12."""
    return segments.spread_segments(_dense(spark, sf), 12).select("seg", "min_k", "max_k", "n")


def _cost(n: str, spread: str, k: int) -> str:
    return f"(CASE WHEN {spread} < {1 << k} THEN ({n}) * log2(greatest(1.0, {float(1 << k)} / ({n}))) ELSE ({n}) * {k} END + 128)"


def _merge_sql(k: int) -> str:
    """One pass of merging over a list of one-element lists (a, b, n, f: already merged), left to right; passes until none merges."""
    old, new = "p[len(p)]", "x[1]"
    both, apart = _cost(f"{old}.n + {new}.n", f"{new}.b - {old}.a + 1", k), f"{_cost(f'{old}.n', f'{old}.b - {old}.a + 1', k)} + {_cost(f'{new}.n', f'{new}.b - {new}.a + 1', k)}"
    one = f"CASE WHEN NOT {old}.f AND {both} < {apart} THEN list_concat(p[1:len(p) - 1], [{{'a': {old}.a, 'b': {new}.b, 'n': {old}.n + {new}.n, 'f': true}}]) ELSE list_concat(p, x) END"
    again = "list_transform(l, lambda e: [{'a': e.a, 'b': e.b, 'n': e.n, 'f': false}])"
    return f"""m0 AS (SELECT list({{'a': min_k, 'b': max_k, 'n': n, 'f': false}} ORDER BY min_k) AS l FROM sp), mg AS (SELECT 0 AS i, l, true AS more FROM m0
UNION ALL SELECT i + 1, nl, len(nl) < len(l) FROM (SELECT i, l, list_reduce({again}, lambda p, x: {one}) AS nl FROM mg WHERE more)),
ml AS (SELECT unnest(l) AS e FROM mg WHERE i = (SELECT max(i) FROM mg)), g AS (SELECT row_number() OVER (ORDER BY e.a) - 1 AS seg, e.a AS min_k, e.b AS max_k, e.n AS n FROM ml)"""


@query(f"WITH RECURSIVE {_D}, {_SPREAD}, {_merge_sql(12)} SELECT seg, min_k, max_k, n FROM g")
def merged_segments(spark, sf):
    """Neighbouring runs merged while that is cheaper."""
    return segments.merged_segments(segments.spread_segments(_dense(spark, sf), 12), 12).select("seg", "min_k", "max_k", "n")


_DP = lambda k: f"""v AS (SELECT list(k ORDER BY k) AS v FROM k), dp AS (SELECT 0 AS i, [0::BIGINT] AS total, []::BIGINT[] AS parent FROM v UNION ALL
SELECT i, list_append(total, best), list_append(parent, i - list_position(list_reverse(c), best)) FROM (SELECT i, total, parent, c, list_min(c) AS best FROM (
SELECT i + 1 AS i, total, parent, list_transform(range(0, i + 1), lambda j: total[j + 1] + ceil({_cost('(i + 1 - j)', '(v[i + 1] - v[j + 1])', k)} - 128)::BIGINT + 128) AS c FROM dp, v WHERE i < len(v)))),
fin AS (SELECT parent FROM dp WHERE i = (SELECT max(i) FROM dp)), tr AS (SELECT len(v)::BIGINT AS e, parent[len(v)] AS st FROM fin, v UNION ALL SELECT st, parent[st] FROM tr, fin WHERE st > 0),
g AS (SELECT row_number() OVER (ORDER BY e) - 1 AS seg, v[st + 1] AS min_k, v[e] AS max_k, e - st AS n FROM tr, v)"""  # noqa: E731
_S = "k AS (SELECT DISTINCT (round(s_acctbal * 100)::BIGINT + 200000) // 97 AS k FROM supplier)"


def _few(spark, sf):
    return staged(_table(spark, sf, "supplier").select(F.floor((F.round(F.col("s_acctbal") * 100).cast("long") + 200000) / 97).cast("long").alias("k")).distinct())


@query(f"WITH RECURSIVE {_S}, {_DP(12)} SELECT seg, min_k, max_k, n FROM g")
def optimal_segments(spark, sf):
    """The segmentation of least cost."""
    return segments.optimal_segments(_few(spark, sf), 12).select("seg", "min_k", "max_k", "n")


@query(f"""WITH {_K}, {_R}, f AS (SELECT n, hi - lo AS spread, {_LEN('(hi - lo)')} AS bits, greatest(1, (hi - lo) >> 18) AS phantom FROM s), g AS (SELECT k - prev AS gap FROM r WHERE prev IS NOT NULL), o AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i FROM g),
p AS (SELECT gap AS p5 FROM o, s WHERE i = least((n - 1) // 20, n - 2)), t AS (SELECT coalesce(sum(gap), 0) AS small FROM g, f WHERE gap <= phantom)
SELECT policy, CASE policy WHEN 'trunc' THEN true WHEN 'soda' THEN false WHEN 'estimate' THEN n / 262144.0 <= 0.01 WHEN 'auto' THEN bits <= 18 OR p5 > phantom WHEN 'gap_fraction' THEN bits <= 18 OR small / spread <= 0.01 ELSE bits <= 18 OR (spread >> 18) < {7 * UNIT} END AS takes_trunc
FROM f, p, t, (SELECT unnest(['auto', 'trunc', 'soda', 'estimate', 'gap_fraction', 'phantom']) AS policy)""")
def fallback_policy(spark, sf):
    facts = segments.gap_facts(_keys(spark, sf), 18)
    rows = [(p, segments.uses_trunc(p, facts, 18, 7 * UNIT)) for p in ("auto", "trunc", "soda", "estimate", "gap_fraction", "phantom")]
    return spark.createDataFrame(rows, "policy string, takes_trunc boolean")


# ---- composites: segments are exact here, as their spreads fit the bits; the rest is truncated


def _parts_sql(k: int) -> str:
    """Of keys k and segments g: keys inside (h), others (l), and the truncating filter of those (rf)."""
    return f"""h AS (SELECT DISTINCT k.k, g.seg FROM k JOIN g ON k.k BETWEEN g.min_k AND g.max_k), hk AS (SELECT DISTINCT k FROM h), l AS (SELECT k FROM k WHERE k NOT IN (SELECT k FROM hk)),
e_ AS (SELECT min(k) AS lo, max(k) AS hi, greatest(0, {_LEN('(max(k) - min(k))')} - {k}) AS z FROM l), rf AS (SELECT DISTINCT (l.k - lo) >> z AS fp FROM l, e_)"""


_ANSWER = """n_ AS (SELECT q.qid, q.a, q.b, hk.k AS next FROM q ASOF LEFT JOIN hk ON q.a <= hk.k),
m_ AS (SELECT n_.*, (greatest(a, lo) - lo) >> z AS x, (least(b, hi) - lo) >> z AS y, coalesce(a <= b AND b >= lo AND a <= hi, false) AS meets FROM n_, e_)
SELECT qid, a > b OR (coalesce(next > b, true) AND (NOT meets OR fp IS NULL OR fp > y)) AS is_empty FROM m_ ASOF LEFT JOIN rf ON m_.x <= rf.fp"""
_BITS = lambda n, w: f"(2 * (1::BIGINT << least({w}, greatest(1, length(bin(greatest({n}, 1))) - 1))::INT) + {n} + {n} * ({w} - least({w}, greatest(1, length(bin(greatest({n}, 1))) - 1))))"
_STATS = lambda name, k: f"""SELECT '{name}' AS filter, count(*) AS clusters, (SELECT count(*) FROM l) AS outside, (SELECT count(*) FROM k) AS n,
(sum({_BITS('d', f'least(w, {k})')} + 128) + (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE {_BITS('count(*)', str(k))} END FROM rf))::BIGINT AS size_bits
FROM (SELECT h.seg, count(*) AS d, any_value({_LEN('(g.max_k - g.min_k)')}) AS w FROM h JOIN g ON h.seg = g.seg GROUP BY h.seg)"""  # noqa: E731


def _steps(spark, sf):
    """Sixteen runs of order keys, and a few keys far from all others."""
    o, n = _table(spark, sf, "orders"), _table(spark, sf, "orders").count()
    run = F.floor(F.col("o_orderkey") * 16 / n).cast("long")
    far = _table(spark, sf, "supplier").select((F.col("s_suppkey") * 987654321 + 10**11).alias("k"))
    return staged(o.select((F.col("o_orderkey") + run * 10**9).alias("k")).unionByName(far).distinct())


def _steps_asked(spark, sf):
    i = F.col("o_orderkey")
    q = _table(spark, sf, "orders").select(i.alias("qid"), F.when(i % 2 == 0, i % 16 * 10**9 + i * 3).otherwise(i * STEP % (3 * 10**11)).alias("a"))
    return q.withColumn("b", F.col("a") + F.when(F.col("qid") % 2 == 0, F.col("qid") % 40 - 1).otherwise(F.col("qid") % 40 * 100000))


_G = f"k AS (SELECT DISTINCT o_orderkey + o_orderkey * 16 // (SELECT count(*) FROM orders) * 1000000000 AS k FROM orders UNION SELECT s_suppkey * 987654321 + 100000000000 FROM supplier)"
_GQ = f"q AS (SELECT qid, a, a + CASE WHEN qid % 2 = 0 THEN qid % 40 - 1 ELSE qid % 40 * 100000 END AS b FROM (SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 16 * 1000000000 + o_orderkey * 3 ELSE o_orderkey * {STEP} % 300000000000 END AS a FROM orders))"
_GAPS = """r AS (SELECT k, lag(k) OVER (ORDER BY k) AS prev FROM k), s AS (SELECT count(*) AS n FROM k), g0 AS (SELECT k, prev, k - prev AS gap FROM r), o0 AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i FROM g0 WHERE gap IS NOT NULL),
x0 AS (SELECT gap AS eps FROM o0, s WHERE i = least(floor(0.95 * (n - 1))::BIGINT, n - 2)), c0 AS (SELECT k, sum(CASE WHEN prev IS NULL OR gap > eps THEN 1 ELSE 0 END) OVER (ORDER BY k) AS seg FROM g0, x0),
x1 AS (SELECT min(k) AS min_k, max(k) AS max_k, count(*) AS n FROM c0 GROUP BY seg), g AS (SELECT row_number() OVER (ORDER BY min_k) - 1 AS seg, min_k, max_k, x1.n FROM x1, s WHERE x1.n >= greatest(2, floor(0.01 * s.n)))"""


@query(f"WITH {_G}, {_GQ}, {_GAPS}, {_parts_sql(20)}, {_ANSWER}")
def hybrid_empty(spark, sf):
    return composite.answer(composite.hybrid(_steps(spark, sf), 40, k=20), _steps_asked(spark, sf)).select("qid", "is_empty")


_DQ = "q AS (SELECT o_orderkey AS qid, a, a + o_orderkey % 40 - 1 AS b FROM (SELECT o_orderkey, (1 + o_custkey % 5) * 1000000000 + (o_orderkey * 7) % 60000 + o_orderkey % 2 * 400000000 AS a FROM orders))"


def _dense_asked(spark, sf):
    i = F.col("o_orderkey")
    q = _table(spark, sf, "orders").select(i.alias("qid"), ((1 + F.col("o_custkey") % 5) * 10**9 + i * 7 % 60000 + i % 2 * 400_000_000).alias("a"))
    return q.withColumn("b", F.col("a") + F.col("qid") % 40 - 1)


@query(f"WITH {_D}, {_DQ}, {_DENSITY}, {_parts_sql(22)}, {_ANSWER}")
def hybrid_scan_empty(spark, sf):
    c = composite.hybrid_scan(_dense(spark, sf), 40, k=22, policy="trunc", min_points=4, min_size=16, radius=100)
    return composite.answer(c, _dense_asked(spark, sf)).select("qid", "is_empty")


_GREEDY = f"{_SPREAD}, {_merge_sql(12).replace(', g AS (SELECT', ', ga AS (SELECT')}, g AS (SELECT row_number() OVER (ORDER BY min_k) - 1 AS seg, min_k, max_k, n FROM ga WHERE {_LEN('(max_k - min_k)')} <= 12)"


@query(f"WITH RECURSIVE {_D}, {_DQ}, {_GREEDY}, {_parts_sql(12)}, {_ANSWER}")
def greedy_scan_empty(spark, sf):
    return composite.answer(composite.greedy_scan(_dense(spark, sf), 40, k=12), _dense_asked(spark, sf)).select("qid", "is_empty")


@query(f"WITH {_S}, q AS (SELECT o_orderkey AS qid, (o_orderkey * 977) % 13000 AS a, (o_orderkey * 977) % 13000 + o_orderkey % 300 - 1 AS b FROM orders), {_T} SELECT qid, is_empty FROM t")
def dp_scan_empty(spark, sf):
    """Each segment's spread fits the bits here, so the answers are exact."""
    q = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") * 977 % 13000).alias("a")).withColumn("b", F.col("a") + F.col("qid") % 300 - 1)
    return composite.answer(composite.dp_scan(_few(spark, sf), 300, k=15), q).select("qid", "is_empty")


def _stats_sql(name: str, parts: str, k: int, recursive: str = "") -> str:
    return f"SELECT * FROM (WITH {recursive}{parts}, {_parts_sql(k)} {_STATS(name, k)})"


@query(" UNION ALL ".join([_stats_sql("hybrid", f"{_G}, {_GAPS}", 20), _stats_sql("hybrid_scan", f"{_D}, {_DENSITY}", 22), _stats_sql("greedy_scan", f"{_D}, {_GREEDY}", 12, "RECURSIVE ")]))
def composite_stats(spark, sf):
    """Clusters, keys outside them, and size for each composite."""
    k, out = _dense(spark, sf), None
    for name, c in (("hybrid", composite.hybrid(_steps(spark, sf), 40, k=20)), ("hybrid_scan", composite.hybrid_scan(k, 40, k=22, policy="trunc", min_points=4, min_size=16, radius=100)), ("greedy_scan", composite.greedy_scan(k, 40, k=12))):
        s = composite.stats(c).withColumn("filter", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


# ---- metrics


@query(f"""WITH {_K}, {_Q}, {_T}, {_trunc_sql(14)}, z AS (SELECT t.a <= t.b AS valid, t.is_empty, u.said FROM t JOIN u USING (qid))
SELECT count(*) AS asked, count(*) FILTER (WHERE is_empty) AS truly_empty, count(*) FILTER (WHERE is_empty AND NOT said) AS false_positives, count(*) FILTER (WHERE is_empty AND NOT said) / greatest(1, count(*) FILTER (WHERE is_empty)) AS fpr, 0::BIGINT AS missed FROM z WHERE valid""")
def fpr_trunc(spark, sf):
    k, q = _both(spark, sf)
    return metrics.false_positive_rate(k, approx.answer(approx.trunc(k, 14), q))


@query(f"WITH {_K}, {_Q}, {_T} SELECT qid, a, CASE WHEN first_key <= b THEN first_key - 1 ELSE b END AS b FROM t WHERE a <= b AND NOT coalesce(first_key <= b AND first_key = a, false)")
def fpr_shrink(spark, sf):
    """Queries that hold a key end before it."""
    k, q = _both(spark, sf)
    return metrics.shrunk(k, q).select("qid", "a", "b")


@query(f"""WITH {_K}, z AS (SELECT unnest([10, 14, 18, 22]) AS kb), f AS (SELECT kb, count(DISTINCT (k - lo) >> greatest(0, {_LEN('(hi - lo)')} - kb)) AS d FROM k, s, z GROUP BY kb)
SELECT kb::INT AS k, d AS fingerprints, ((1 << least(kb, length(bin(d)) - 1)) * 2 + d + d * (kb - least(kb, length(bin(d)) - 1)))::BIGINT AS size_bits FROM f""")
def filter_size_bits(spark, sf):
    """Distinct fingerprints and model size of the truncating filter by its bits."""
    k = _keys(spark, sf)
    out = None
    for b in (10, 14, 18, 22):
        f = approx.trunc(k, b)
        r = f.fp.agg(F.lit(b).alias("k"), F.count("*").alias("fingerprints")).withColumn("size_bits", sizes.exact_bits_column(F.col("fingerprints"), F.lit(b)).cast("long"))
        out = r if out is None else out.unionByName(r)
    return out


@query(f"""WITH {_K}, {_R}, pq AS (SELECT 'point' AS kind, k AS a, k AS b FROM r UNION ALL SELECT 'left', k - 1, k FROM r UNION ALL SELECT 'right', k, k + 1 FROM r UNION ALL SELECT 'whole', min(k), max(k) FROM r
UNION ALL SELECT 'span', x.k, y.k FROM r y JOIN r x ON x.rank = y.rank - {bits.universal_sql('y.rank', 0)} % 50 - 1), q AS (SELECT row_number() OVER () AS qid, * FROM pq), {_trunc_sql(12)} SELECT kind, q.a, q.b, said AS is_empty FROM q JOIN u USING (qid)""")
def no_miss_properties(spark, sf):
    """Queries that hold a key by construction, asked of the truncating filter."""
    k = _keys(spark, sf)
    q = staged(generators.property_queries(k).withColumn("qid", F.monotonically_increasing_id()))
    return approx.answer(approx.trunc(k, 12), q).select("kind", "a", "b", "is_empty")


@query("SELECT l_returnflag, q, value FROM (SELECT l_returnflag, unnest([0.5, 0.95, 0.99]) AS q, unnest(quantile_cont(l_extendedprice, [0.5, 0.95, 0.99])) AS value FROM lineitem GROUP BY l_returnflag)")
def quantile_study(spark, sf):
    return metrics.quantiles(_table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.95, 0.99], "l_returnflag")


# ---- skipping, maps, logs


@query(f"""WITH {_K}, {_Q}, f AS (SELECT event_type AS file, epoch_us(ts) AS k FROM events), g AS (SELECT DISTINCT file FROM f)
SELECT qid, x.file FROM (SELECT q.*, g.file FROM q, g WHERE a <= b) x ASOF JOIN f ON x.file = f.file AND x.a <= f.k WHERE f.k <= b""")
def file_skip(spark, sf):
    """Which of several key sets hold a key of each interval; the fingerprints hold all bits here, so the answer is exact."""
    _, q = _both(spark, sf)
    rows = _table(spark, sf, "events").select(F.col("event_type").alias("file"), _micros("ts").alias("k"))
    return skipping.candidates(*skipping.index(rows, bits=62), q)


_LOG = "g AS (SELECT event_id AS step, user_id AS key, CASE event_id % 5 WHEN 0 THEN 'erase' WHEN 1 THEN 'contains' ELSE 'insert' END AS op, event_id * 2 AS value FROM events)"


def _log(spark, sf):
    op = F.when(F.col("event_id") % 5 == 0, "erase").when(F.col("event_id") % 5 == 1, "contains").otherwise("insert")
    return _table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("user_id").alias("key"), op.alias("op"), (F.col("event_id") * 2).alias("value"))


@query(f"WITH {_LOG} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY step DESC) AS n FROM g WHERE op <> 'contains') WHERE n = 1 AND op = 'insert'")
def map_replay(spark, sf):
    """What a log of inserts and erases leaves."""
    return maps.replayed(_log(spark, sf))


@query(f"""WITH {_LOG}, c AS (SELECT step, key, op FROM g WHERE op <> 'contains'), a AS (SELECT g.step, g.key, c.op AS last FROM (SELECT * FROM g WHERE op = 'contains') g ASOF LEFT JOIN c ON g.key = c.key AND g.step > c.step)
SELECT step, key, coalesce(last = 'insert', false) AS found FROM a""")
def map_answers(spark, sf):
    """Look-ups in the middle of the log."""
    return maps.answers(_log(spark, sf)).select("step", "key", "found")


@query("""WITH t AS (SELECT c_custkey AS key, c_nationkey::BIGINT AS value FROM customer), n AS (SELECT o_custkey AS key, max(o_orderkey) AS value FROM orders GROUP BY 1), d AS (SELECT s_suppkey AS key FROM supplier),
p AS (SELECT * FROM t WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n) SELECT key, value FROM p WHERE key NOT IN (SELECT key FROM d)""")
def map_put_delete(spark, sf):
    t = _table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value"))
    new = _table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return maps.delete(maps.put(t, new, version="value"), _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")))


@query("""WITH t AS (SELECT c_custkey AS key, c_nationkey::BIGINT AS value FROM customer) SELECT o_orderkey, coalesce(value, -1) AS value FROM (SELECT o_orderkey, o_custkey + o_orderkey % 2 * 100000000 AS key FROM orders) LEFT JOIN t USING (key)""")
def map_get(spark, sf):
    t = _table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value"))
    asked = _table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 2 * 100000000).alias("key"))
    return maps.get(t, asked, missing=-1).select("o_orderkey", "value")


@query("SELECT 'BenchmarkLine' AS benchmark, l_returnflag AS flag, l_linestatus AS status, metric, count(*) AS samples, median(v) AS median FROM (SELECT l_returnflag, l_linestatus, unnest(['ns_per_op', 'bits_key']) AS metric, unnest([l_quantity, l_partkey::DOUBLE]) AS v FROM lineitem) GROUP BY ALL")
def bench_median(spark, sf):
    """Benchmark log lines, parsed and grouped."""
    line = F.concat(F.lit("BenchmarkLine/Flag="), "l_returnflag", F.lit("/Status="), "l_linestatus", F.lit("-8   100   "), F.col("l_quantity").cast("string"), F.lit(" ns/op  "), F.col("l_partkey").cast("string"), F.lit(".0 bits/key"))
    rows = benchlogs.parse_lines(_table(spark, sf, "lineitem").select(line.alias("value")))
    return benchlogs.medians(rows, ["flag", "status"])


@query("SELECT r_name AS name, sum(n_nationkey)::BIGINT AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def memory_report(spark, sf):
    """Report trees from JSON lines, leaves summed by component."""
    n, r = _table(spark, sf, "nation"), _table(spark, sf, "region")
    leaf = F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("total_bytes"))
    tree = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.collect_list(leaf).alias("children"), F.sum("n_nationkey").cast("long").alias("total_bytes"))
    lines = tree.select(F.concat(F.lit("REPORT: "), F.to_json(F.struct(F.col("r_name").alias("name"), "total_bytes", "children"))).alias("value"))
    nodes = staged(benchlogs.parse_reports(lines, "REPORT"))
    top = nodes.where("depth = 0").select("report", "name")
    return benchlogs.flattened(nodes, {}).join(top, "report").select("name", "bytes")


@query("SELECT r_regionkey::INT AS s, 1 - pow(1 - pow(2.0, -(r_regionkey + 4)), 6) AS false_positive, 1 - pow(1 - pow(pow(1 - pow(2.0, -(r_regionkey + 4)), 6), 10), 100) AS success FROM region")
def theory(spark, sf):
    """Closed forms of a search of 64-bit keys by signatures."""
    n = sum(1 for _ in _table(spark, sf, "region").toLocalIterator())
    rows = [(i, sizes.theory_false_positive(64, i + 4), sizes.theory_build_success(10, 64, i + 4)) for i in range(n)]
    return spark.createDataFrame(rows, "s int, false_positive double, success double")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey * 1000003 < 256 THEN 8 WHEN o_orderkey * 1000003 < 65536 THEN 16 WHEN o_orderkey * 1000003 < 4294967296 THEN 32 ELSE 64 END AS width FROM orders")
def width_selection(spark, sf):
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), sizes.width_column(F.col("o_orderkey") * 1000003).alias("width"))


def entry(spark: SparkSession) -> DataFrame:
    return range_empty_exact(spark, "/root/testdata/sf0.001")


__all__ = ["ORACLE", "QUERIES", "entry"]
