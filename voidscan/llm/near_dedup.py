"""MinHash near-dedup with sequential Bayesian verification.

1. A document's word shingles are hashed; documents of one and the same set (by two 64-bit sums of mixed hashes) form a class,
   and only the class's smallest id goes on.
2. MinHash signatures of BANDS * ROWS values; a band's values are a bucket.  A pair of similarity 0.8 misses all buckets with
   probability (1 - 0.8**ROWS)**BANDS, about 6e-5.
3. A bucket's members are paired with its smallest class and with their neighbour in order, so a bucket of m members gives 2 m pairs
   at most.  Verified links make components.  Only buckets whose members are not yet one component are looked at again: all members outside
   the bucket's largest component are compared with all members, in blocks that fit a task, and each task gives at most as many links
   as it joins components.  So no link between components is lost, and a large group of near copies never gives all its pairs.
4. A pair is verified sequentially: batches of signature values are compared, and the pair is dropped as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold falls below `miss`.  Survivors are verified exactly on
   their full sets of shingles.
5. Components come from alternating large-star and small-star steps; each step is a table in the shared folder.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voidscan.llm import textkit as tk
from voidscan.llm.frames import back, batches, id_of, own, written
from voidscan.plans.stage import release

BANDS, ROWS = 32, 6
#: Signature values that are compared before each look at the posterior.
BATCH = 32
#: Members of either side of a bucket that one task compares; larger buckets are dealt in blocks.
BLOCK = 2048
_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * 2 + 1
_ADD = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(chunk: tk.Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles (a shorter text: all its words as one), and bounds by row."""
    w = tk.words(chunk, lower=True)
    n = np.diff(w.first)
    g, bounds = tk.grams(w.hash, w.first, k)
    short = np.flatnonzero((n > 0) & (n < k))
    row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
    if len(short):
        whole = tk.Spans(w.hash).hash(w.first[short], w.first[short + 1])
        g, row = np.concatenate([g, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    # distinct by row: a sort of the hashes, row by row
    bounds = np.searchsorted(row, np.arange(chunk.rows + 1))
    out, first = [], [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        u = np.unique(g[a:b])
        out.append(u)
        first.append(first[-1] + len(u))
    return (np.concatenate(out) if out else g), np.array(first)


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of each row; rows without shingles have none that match (all ones)."""
    full = np.flatnonzero(np.diff(first))
    sig = np.full((len(first) - 1, BANDS * ROWS), 2**32 - 1, np.uint32)
    if not len(full):
        return sig
    starts = first[:-1][full]
    step = 1 << 15
    if len(sets) <= step:
        for j in range(BANDS * ROWS):
            sig[full, j] = np.minimum.reduceat(((sets * _MUL[j] + _ADD[j]) >> tk.U(32)).astype(np.uint32), starts)
        return sig
    # by pieces that stay in cache
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step)))
        hi = min(hi, len(full))
        end = first[full[hi - 1] + 1]
        part, cuts = sets[starts[lo]: end], starts[lo:hi] - starts[lo]
        for j in range(BANDS * ROWS):
            sig[full[lo:hi], j] = np.minimum.reduceat(((part * _MUL[j] + _ADD[j]) >> tk.U(32)).astype(np.uint32), cuts)
        lo = hi
    return sig


def sketches(k: int):
    schema = "id long, rk long, n long, class long, sig binary"

    def rows(it):
        for batch in it:
            ids, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for chunk in tk.chunks(batch.column(2)):
                sets, first = shingle_sets(chunk, k)
                sig = signatures(sets, first)
                n = np.diff(first)
                sums = [np.where(n > 0, np.add.reduceat(np.append(tk.mix(sets ^ tk.U(salt)), tk.U(0)), first[:-1]), tk.U(0)).astype(np.uint64) for salt in (0, 0xA5A5A5A5A5A5A5A5)]
                own_class = tk.mix(sums[0] ^ tk.mix(sums[1] + n.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[chunk.lo: chunk.hi]), pa.array(keys[chunk.lo: chunk.hi]), pa.array(n.astype(np.int64)), pa.array(own_class.view(np.int64)),
                    pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "rk", "n", "class", "sig"])

    return rows, schema


def band_rows(it):
    """A row (bucket, id) for each band of a signature."""
    for batch in it:
        ids = np.asarray(batch.column(0))
        if not len(ids):
            continue
        data, offsets, _ = tk.strings(batch.column(1))
        sig = data[offsets[0]: offsets[-1]].view(np.uint32).reshape(len(ids), BANDS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
        for j in range(ROWS):
            h = tk.mix(h * tk.U(0xD1342543DE82EF95) + sig[:, :, j])
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, BANDS))], names=["bucket", "id"])


@functools.lru_cache(maxsize=8)
def fewest_equal(threshold: float, miss: float) -> tuple[int, ...]:
    """For each number of compared values, a multiple of BATCH: the fewest equal ones of a pair that stays.

    With a uniform prior the posterior of the similarity is Beta(1 + equal, 1 + unequal); the pair goes if it puts less than
    `miss` on similarities of at least `threshold`.  That tail is a binomial sum: P(Beta(a, b) >= t) = P(Bin(a+b-1, t) <= a-1).
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        p, tail, m = (1 - threshold) ** (n + 1), 0.0, 0
        for a in range(n + 2):  # Bin(n + 1, threshold)
            tail += p
            if tail >= miss:
                m = a
                break
            p *= (n + 1 - a) / (a + 1) * threshold / (1 - threshold)
        out.append(m)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of signature pairs no batch of comparisons rules out."""
    live, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, least in enumerate(fewest_equal(threshold, miss)):
        part = slice(step * BATCH, (step + 1) * BATCH)
        equal[live] += (a[live, part] == b[live, part]).sum(1)
        live = live[equal[live] >= least]
    keep = np.zeros(len(a), bool)
    keep[live] = True
    return keep


def by_signature(threshold: float, miss: float):
    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            sides = []
            for name in ("sx", "sy"):
                data, offsets, _ = tk.strings(tk.column(batch, name))
                sides.append(data[offsets[0]: offsets[-1]].view(np.uint32).reshape(-1, BANDS * ROWS))
            keep = pa.array(plausible(*sides, threshold, miss))
            yield pa.RecordBatch.from_arrays([tk.column(batch, "x").filter(keep), tk.column(batch, "y").filter(keep)], names=["x", "y"])

    return run


def by_sets(percent: int):
    def run(it):
        for batch in it:
            (xd, xo, _), (yd, yo, _) = (tk.strings(tk.column(batch, n)) for n in ("gx", "gy"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = xd[xo[i]: xo[i + 1]].view(np.uint64), yd[yo[i]: yo[i + 1]].view(np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                if 100 * len(small) < percent * len(large) or not len(small):
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([tk.column(batch, "x").filter(pa.array(keep)), tk.column(batch, "y").filter(pa.array(keep))], names=["x", "y"])

    return run


def set_rows(k: int):
    def rows(it):
        for batch in it:
            for chunk in tk.chunks(batch.column(1)):
                sets, first = shingle_sets(chunk, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, chunk.rows), pa.array([sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["id", "grams"])

    return rows


def compared(percent: int, miss: float):
    """Links that join components of a bucket: rows of side 0 against rows of side 1.

    Pairs of one component are skipped, the others go through the sequential test and then the exact one; a link that is found joins its
    components at once.  So the links are fewer than the components, however many pairs are looked at.
    """

    def run(_, t):
        t = t.combine_chunks()
        ids, comp, side = (np.asarray(t.column(n)) for n in ("id", "comp", "side"))
        data, offsets, _ = tk.strings(t.column("sig"))
        sig = data[offsets[0]: offsets[-1]].view(np.uint32).reshape(len(ids), BANDS * ROWS)
        data, offsets, _ = tk.strings(t.column("grams"))
        first = offsets // 8
        _, code = np.unique(data.view(np.uint64), return_inverse=True)
        size = np.diff(first)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        at = np.concatenate([[0], np.cumsum(size[right])])
        codes = code[np.repeat(first[:-1][right] - at[:-1], size[right]) + np.arange(at[-1])]
        _, root = np.unique(comp, return_inverse=True)
        mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
        x, y = [], []
        for i in left:
            other = np.flatnonzero(root[right] != root[i])
            other = other[plausible(np.broadcast_to(sig[i], (len(other), BANDS * ROWS)), sig[right[other]], percent / 100, miss)]
            if not len(other):
                continue
            mine = code[first[i]: first[i + 1]]
            mark[mine] = True
            if 4 * len(other) > len(right):
                both = np.add.reduceat(mark[codes], at[:-1], dtype=np.int64)[other]
            else:
                n = size[right[other]]
                begin = np.cumsum(n) - n
                both = np.add.reduceat(mark[codes[np.repeat(at[other] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
            mark[mine] = False
            for j in right[other[100 * both >= percent * (len(mine) + size[right[other]] - both)]]:
                if root[j] != root[i]:
                    x.append(min(ids[i], ids[j]))
                    y.append(max(ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return run


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, comp): for each id of an edge (x, y), the smallest id that it reaches.

    Large-star and small-star steps in turn until neither changes an edge; both pre-aggregate the least neighbour, and the edges
    of a vertex are never gathered in one place.
    """
    edges = written(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before_, edges = edges, written(small)
        release(before_)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # a settled forest: each vertex points to its root
    return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()).groupBy("id").agg(F.min("comp").alias("comp"))


def near_links(classes: DataFrame, texts: DataFrame, k: int, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """(links, components): verified links (x, y) of classes that join every component, and (id, comp) of linked classes.

    classes: (id, sig, row: where one of its texts is); texts: (id, rk, text).
    """
    threshold = percent / 100
    member = classes.select("id", "sig").mapInArrow(band_rows, "bucket long, id long")
    size = member.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("first"), F.max("id").alias("last"),
                                        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("all")).where("first < last")
    # of buckets with the same members one is looked at
    size = size.groupBy("all", "m", "first").agg(F.min("bucket").alias("bucket")).select("bucket", "m", F.col("first").alias("x"))
    member = written(member.join(size, "bucket"))
    members = member.select("id").distinct().join(classes.select("id", "sig", "row.*"), "id")
    sigs = written(members.select("id", "sig"))
    sets = written(texts.join(members.select("id", F.col("doc").alias("__doc"), F.col("rk").alias("__rk")), (texts.id == F.col("__doc")) & (texts.rk == F.col("__rk")))
                   .select(members.id, "text").mapInArrow(set_rows(k), "id long, grams binary").dropDuplicates(["id"]))

    def side(table: DataFrame, key: str, value: str, alias: str) -> DataFrame:
        return table.select(F.col("id").alias(key), F.col(value).alias(alias))

    def exact(pairs: DataFrame) -> DataFrame:
        return written(pairs.join(side(sets, "x", "grams", "gx"), "x").join(side(sets, "y", "grams", "gy"), "y").mapInArrow(by_sets(percent), "x long, y long"))

    chain = member.select(F.lag("id").over(Window.partitionBy("bucket").orderBy("id")).alias("x"), F.col("id").alias("y"))
    pairs = member.select("x", F.col("id").alias("y")).unionByName(chain).where("x < y").distinct()
    likely = written(pairs.join(side(sigs, "x", "sig", "sx"), "x").join(side(sigs, "y", "sig", "sy"), "y").mapInArrow(by_signature(threshold, miss), "x long, y long"))
    links = exact(likely)
    comp = written(components(links))
    labelled = member.drop("x").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    # buckets whose members are not yet one component: all outside the largest one (side 0) meet all (side 1), in blocks
    sizes = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("largest"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = written(mixed.select("bucket", "main", F.ceil((F.col("n") - F.col("largest")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rights")))
    rows = labelled.join(mixed, "bucket")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = rows.where("comp <> main").select("bucket", deal("lefts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), "id", "comp", F.lit(0).alias("side"))
    right = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), deal("rights").alias("j"), "id", "comp", F.lit(1).alias("side"))
    dealt = left.unionByName(right).join(sigs, "id").join(sets, "id")
    new = written(dealt.groupBy("bucket", "i", "j").applyInArrow(compared(percent, miss), "x long, y long").distinct())
    if new.isEmpty():
        return links, comp
    links = links.unionByName(new)
    return links, written(components(links))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """The rows of docs with n_shingles, component_id and kept.

    A document's set is its distinct k-word shingles, A-Z as a-z (fewer words: all of them as one); without words it is empty and
    linked with nothing.  Documents are linked if 100 * |intersection| >= percent * |union|; component_id is the smallest id that
    links reach, itself included, and kept says whether that is the document's own.  A null text has no words.  A null id comes
    before every other (its component_id is null, and it is kept).  Rows of one id are documents of their own; of linked rows all
    with the smallest id are kept.  An empty table gives an empty table.  Other columns pass through; columns named n_shingles,
    component_id or kept are replaced.
    """
    batches(docs.sparkSession)
    docs = own(docs, "n_shingles", "component_id", "kept")
    rows, schema = sketches(k)
    texts = docs.select(id_of(id_col).alias("id"), F.xxhash64(text_col).alias("rk"), F.col(text_col).alias("text"))
    sketch = written(texts.mapInArrow(rows, schema))
    some = sketch.where("n > 0")
    classes = some.groupBy(F.col("class").alias("id")).agg(F.first("sig").alias("sig"), F.min(F.struct(F.col("id").alias("doc"), "rk")).alias("row"))
    _, comp = near_links(classes, texts, k, percent, miss)
    least = some.groupBy("class").agg(F.min("id").alias("least")).join(comp.withColumnRenamed("id", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    roots = least.groupBy("comp").agg(F.min("least").alias("component"))
    found = (sketch.join(least.join(roots, "comp").select("class", "component"), "class", "left")
             .select(F.col("id").alias("__id"), F.col("rk").alias("__rk"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("__component"))
             .dropDuplicates(["__id", "__rk"]))
    return (docs.withColumns({"__id": id_of(id_col), "__rk": F.xxhash64(text_col)}).join(found, ["__id", "__rk"])
            .withColumns({"component_id": back("__component"), "kept": F.col("__id") == F.col("__component")}).drop("__id", "__rk", "__component"))
