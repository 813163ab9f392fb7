"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window has as many words as the benchmark item it may match (a shorter text is one window).  Shingles are runs of GRAM words,
weighted by how often they occur.  The similarity is the sum of least weights over the sum of greatest weights.

For every item length, a window of each start is looked at in three steps:

1. A similarity of t needs at least 2 * m * t / (1 + t) shingles of m that some item of the benchmark holds; prefix sums give that
   count for every window, and windows below it can't match any item.
2. The window's SimHash of 128 bits is taken over its words: an edit inside costs one word but GRAM shingles, so similar windows are
   closer in words.  A fingerprint within RADIUS of an item's is within BLOCK_ERRORS in one of BLOCKS blocks (pigeonhole: RADIUS < BLOCKS *
   (BLOCK_ERRORS + 1)), and then within HALF_ERRORS in one half of that block (BLOCK_ERRORS < 2 * (HALF_ERRORS + 1)).  Items are listed by
   the value of each half; a window looks up all values at most HALF_ERRORS bits off its own, then its block and then the whole
   distance decide.  So every item within RADIUS is found, and of unrelated pairs 0.8 % pass the blocks.
3. The exact similarity verifies what is left.

RADIUS is two and a half standard deviations above the mean distance of windows of similarity 0.8 that differ by as many words as
shingles (cut off at an end, the worst case): about 1 in 150 of those just above the threshold is missed, and none in practice of others.

The documents are read once for each block of the benchmark, and nothing of them is shuffled.  A block is broadcast; it holds at
most `block_bytes` of item text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscan.llm import textkit as tk
from voidscan.llm.frames import batches

GRAM = 5
RADIUS, BLOCKS, BLOCK_ERRORS, HALF_ERRORS = 29, 5, 5, 2
_EDGES = np.linspace(0, 128, BLOCKS + 1).astype(int)
_SALT = 0xA5A5A5A5A5A5A5A5


def fingerprints(words: np.ndarray) -> np.ndarray:
    """SimHash of each row of word hashes, as two numbers of 64 bits; a word that occurs c times in the row weighs sqrt(c).  A tie gives 1."""
    out = np.zeros((len(words), 2), np.uint64)
    n = words.shape[1]
    step = max(1, (1 << 16) // max(1, n))
    for lo in range(0, len(words), step):
        part = np.sort(words[lo: lo + step], axis=1)
        new = np.ones(part.shape, bool)
        new[:, 1:] = part[:, 1:] != part[:, :-1]
        run = np.cumsum(new.reshape(-1)) - 1
        weight = (1 / np.sqrt(np.bincount(run)))[run].reshape(part.shape).astype(np.float32)
        for side in (0, 1):
            h = part if side == 0 else tk.mix(part ^ tk.U(_SALT))
            bits = np.unpackbits(h.view(np.uint8).reshape(*h.shape, 8), axis=2, bitorder="little").reshape(*h.shape, 64)
            held = (weight[:, None, :] @ bits.astype(np.float32))[:, 0]
            major = 2 * held >= weight.sum(1, keepdims=True) - 1e-4
            out[lo: lo + step, side] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _bits(prints: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits a..b - 1 of fingerprints as numbers; b - a <= 32."""
    if a >= 64 or b <= 64:
        return (prints[:, a >> 6] >> tk.U(a & 63)).astype(np.int64) & ((1 << (b - a)) - 1)
    return _bits(prints, a, 64) | _bits(prints, 64, b) << (64 - a)


def _near_values(width: int) -> np.ndarray:
    """Numbers of `width` bits with HALF_ERRORS ones at most."""
    every = np.arange(1 << width)
    return every[np.bitwise_count(every) <= HALF_ERRORS]


class Items:
    """The items of a block that have the same number of words, with their multi-index."""

    def __init__(self, length: int, ids: list, grams: list[np.ndarray], words: list[np.ndarray]):
        self.length, self.k, self.ids = length, min(GRAM, length), ids
        self.grams = [np.unique(g, return_counts=True) for g in grams]
        self.size = length - self.k + 1
        self.prints = fingerprints(np.stack(words))
        self.halves = []  # (block, half: first and last bit, items in the order of the half's value, where each value begins)
        for a, b in zip(_EDGES[:-1], _EDGES[1:]):
            for x, y in ((a, (a + b) // 2), ((a + b) // 2, b)):
                value = _bits(self.prints, x, y)
                order = np.argsort(value, kind="stable")
                self.halves.append(((a, b), (x, y), order, np.searchsorted(value[order], np.arange((1 << (y - x)) + 1))))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within RADIUS, by the blocks."""
        pairs = [np.zeros(0, np.int64)]
        n = len(self.ids)
        step = max(1, (1 << 20) // max(92, n // 50))
        for lo in range(0, len(prints), step):
            part = prints[lo: lo + step]
            for (a, b), (x, y), order, begin in self.halves:
                value = (_bits(part, x, y)[:, None] ^ _near_values(y - x)).reshape(-1)
                many = begin[value + 1] - begin[value]
                some = np.flatnonzero(many)
                many = many[some]
                w = np.repeat(some // (len(value) // len(part)), many)
                i = order[np.repeat(begin[value[some]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                ok = np.bitwise_count(_bits(part[w], a, b) ^ _bits(self.prints[i], a, b)) <= BLOCK_ERRORS
                w, i = w[ok], i[ok]
                ok = np.bitwise_count(part[w] ^ self.prints[i]).sum(1) <= RADIUS
                pairs.append((w[ok] + lo) * n + i[ok])
        every = np.unique(np.concatenate(pairs))
        return every // n, every % n

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        own, weight = self.grams[item]
        at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        both = np.minimum(np.bincount(at[own[at] == shingles], minlength=len(own)), weight).sum()
        return float(both / (len(shingles) + self.size - both))


class Benchmark:
    """A block of items: by length, and the set of all their shingles for each shingle size."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        by: dict[int, tuple[list, list, list]] = {}
        for chunk in tk.chunks(texts):
            w = tk.words(chunk, lower=True)
            for i in range(chunk.rows):
                h = w.hash[w.first[i]: w.first[i + 1]]
                if len(h):
                    ids, grams, words = by.setdefault(len(h), ([], [], []))
                    ids.append(items[chunk.lo + i][0])
                    grams.append(tk.grams(h, np.array([0, len(h)]), min(GRAM, len(h)))[0])
                    words.append(h)
        self.lengths = [Items(n, *by[n]) for n in sorted(by)]
        self.known = {}
        for x in self.lengths:
            self.known.setdefault(x.k, []).extend(g for g, _ in x.grams)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in self.known.items()}
        self.maps = {k: _bitmap(v) for k, v in self.known.items()}

    def holds(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Which shingles any item has."""
        table, shift = self.maps[k]
        hit = np.flatnonzero(table[grams >> shift])
        known = self.known[k]
        out = np.zeros(len(grams), bool)
        out[hit[known[np.minimum(np.searchsorted(known, grams[hit]), len(known) - 1)] == grams[hit]]] = True
        return out


def _bitmap(known: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    bits = max(16, int(np.ceil(np.log2(len(known) * 64))))
    table = np.zeros(1 << bits, bool)
    table[known >> tk.U(64 - bits)] = True
    return table, tk.U(64 - bits)


def found(bench: Benchmark, chunk: tk.Chunk, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(row, item id, first word, words, similarity): the best window of each row for each item that it matches."""
    w = tk.words(chunk, lower=True)
    best: dict[tuple[int, int, int], tuple[float, int, int]] = {}
    grams = {k: tk.grams(w.hash, w.first, k) for k in bench.known}
    sums = {k: np.concatenate([[0], np.cumsum(bench.holds(k, g))]) for k, (g, _) in grams.items()}
    for items in bench.lengths:
        (g, bounds), total, m = grams[items.k], sums[items.k], items.size
        if not total[-1]:
            continue
        n = np.diff(bounds)
        least = np.ceil(2 * m * threshold / (1 + threshold) - 1e-9)
        held = total[m:] - total[:-m] if len(g) >= m else np.zeros(0, np.int64)
        start = np.flatnonzero(held >= least)
        row = np.searchsorted(bounds, start, "right") - 1
        ok = start + m <= bounds[1:][row]
        _look(items, w, g, bounds, start[ok], row[ok], m, threshold, best)
        # texts of fewer words than the item are one window
        short = np.flatnonzero((n < m) & (n >= threshold * m) & (n > 0))
        held = total[bounds[1:][short]] - total[bounds[:-1][short]]
        for r in short[held * (1 + threshold) >= threshold * (n[short] + m) - 1e-9]:
            _look(items, w, g, bounds, bounds[r: r + 1], np.array([r]), int(n[r]), threshold, best)
    return [(r, item, s, size, sim) for (r, _, item), (sim, s, size) in best.items()]


def _look(items: Items, w: tk.Words, g, bounds, start, row, m, threshold, best) -> None:
    if not len(start):
        return
    step = 1 << 14
    for lo in range(0, len(start), step):
        a, r = start[lo: lo + step], row[lo: lo + step]
        begin = w.first[r] + a - bounds[r]
        for x, i in zip(*items.near(fingerprints(w.hash[begin[:, None] + np.arange(m + items.k - 1)]))):
            sim = items.similarity(i, g[a[x]: a[x] + m])
            key = (int(r[x]), items.length, items.ids[i])
            if sim >= threshold and sim > best.get(key, (0.0,))[0]:
                best[key] = (sim, int(a[x] - bounds[r[x]]), m + items.k - 1)


def _checked(threshold: float) -> None:
    if not 0.8 <= threshold <= 1:
        raise ValueError(f"a threshold of {threshold}: fingerprints are compared within a radius that suits 0.8 to 1")


def blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Benchmark]:
    """The benchmark, a bounded block at a time."""
    held, size = [], 0
    for r in bench.select(item_col, text_col).toLocalIterator():
        held.append((r[0], r[1]))
        size += 4 * len(r[1] or "") + 64
        if size >= block_bytes:
            yield Benchmark(held)
            held, size = [], 0
    if held:
        yield Benchmark(held)


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, item, start_word, n_words, similarity): documents that hold a benchmark item, with the most similar window.

    `threshold` is 0.8 at least, as the radius is made for that.  Of windows equally similar the first counts.  Words are compared with A-Z as a-z.  Null or empty texts and items match
    nothing; items of one id and different texts are looked for each by itself, and the same item twice gives its row twice; a
    null id stays null.  An empty table on either side gives no rows.  Each row of docs is a document; no other column is used.
    """
    _checked(threshold)
    spark = docs.sparkSession
    batches(spark)
    out = None
    some = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text"))
    schema = f"`{id_col}` long, `{item_col}` long, start_word long, n_words long, similarity double"
    for block in blocks(bench.select(F.col(item_col).cast("long").alias(item_col), item_text), item_col, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def rows(it, sent=sent):
            for batch in it:
                for chunk in tk.chunks(batch.column(1)):
                    got = found(sent.value, chunk, threshold)
                    if got:
                        r, item, s, n, sim = zip(*sorted(got))
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(np.array(r) + chunk.lo)), pa.array(item, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(sim, pa.float64())],
                            names=[id_col, item_col, "start_word", "n_words", "similarity"])

        part = some.mapInArrow(rows, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_text: str = "text", threshold: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, all columns as they are; see `leaks` for what is held."""
    _checked(threshold)
    spark = docs.sparkSession
    batches(spark)
    numbered = bench.select(F.lit(0).cast("long").alias("item"), F.col(item_text).alias("text"))
    for block in blocks(numbered, "item", "text", block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def clean(it, sent=sent):
            for batch in it:
                keep = np.ones(batch.num_rows, bool)
                for chunk in tk.chunks(tk.column(batch, text_col)):
                    keep[[chunk.lo + x[0] for x in found(sent.value, chunk, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
