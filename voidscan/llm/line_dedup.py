"""Line dedup: two Bloom filters single out suspected repeats; only those shuffle for exact confirmation.

1. Every task hashes the long lines of its documents.  A line seen once in the task sets its bits in a filter "once", a line
   of two documents of the task sets them in "twice" as well.  Tasks send the set bits by 4 KB block; where blocks of several
   tasks meet, a bit that two tasks set goes to "twice" too.  So "twice" holds every line that two documents hold.
2. "twice" is broadcast.  Its size is chosen from the row count and never exceeds `max_filter_bytes`; a fuller filter only lets
   more lines through to the exact step, it never loses one.
3. Documents are read again; only keys that "twice" holds are sent, grouped by the key's text itself, counted by document, and
   the largest doc_id is chosen.  A key held by a third of all documents is counted in partial sums first.
4. Each document drops the keys that others keep.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voidscan.llm import textkit as tk
from voidscan.llm.frames import batches, id_of, own, schema_of, written

BLOCK_BITS = 15
PROBES = 3


def lines(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end (without \\n) of each line, the bounds by row, and begin and end of each line's stripped key."""
    newline = np.flatnonzero(chunk.data == 0x0A)
    n = chunk.rows
    begin = np.sort(np.concatenate([chunk.starts[:-1], newline + 1]), kind="stable")
    end = np.sort(np.concatenate([newline, chunk.starts[1:]]), kind="stable")
    # a row's last \n may sit at its very end: its empty last line begins where the next row does, and sorts before it
    count = 1 + np.searchsorted(newline, chunk.starts[1:]) - np.searchsorted(newline, chunk.starts[:-1])
    first = np.concatenate([[0], np.cumsum(count)])
    assert len(begin) == first[-1] and n + 1 == len(first)
    w = tk.words(chunk, hashed=False)
    a = np.searchsorted(w.start, begin)
    b = np.searchsorted(w.end, end, "right")
    some = b > a
    if not len(w.start):
        return begin, end, first, begin, begin
    key_begin = np.where(some, w.start[np.minimum(a, len(w.start) - 1)], begin)
    key_end = np.where(some, w.end[np.maximum(b, 1) - 1], begin)
    return begin, end, first, key_begin, key_end


def keyed(chunk: tk.Chunk, min_points: int):
    """Lines, which of them are long enough to count, and the hashes of their keys."""
    begin, end, first, kb, ke = lines(chunk)
    at = tk.points(chunk.data)
    long = at[ke] - at[kb] >= min_points
    h = tk.Spans(tk.byte_codes(tk.LOWER[chunk.data])).hash(kb, ke)
    return begin, end, first, kb, ke, long, h


def positions(h: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its bits there (PROBES columns)."""
    block = (h >> tk.U(64 - (log2_bits - BLOCK_BITS))).astype(np.int64) if log2_bits > BLOCK_BITS else np.zeros(len(h), np.int64)
    g = tk.mix(h + tk.U(0x9E3779B97F4A7C15))
    bits = np.stack([((g >> tk.U(16 * j)) & tk.U((1 << BLOCK_BITS) - 1)).astype(np.uint16) for j in range(PROBES)], 1)
    return block, bits


def filter_bits(rows: int, max_filter_bytes: int, per_row: int = 256) -> int:
    """log2 of a filter's bits: `per_row` (16 lines of 16 bits) for each document, within [2**20, 8 * max_filter_bytes]."""
    top = int(np.log2(max_filter_bytes * 8))
    return int(min(top, max(20, np.ceil(np.log2(max(1, rows) * per_row)))))


def twice_filter(docs: DataFrame, id_col: str, text_col: str, min_points: int, log2_bits: int) -> DataFrame:
    """(block, bits): the filter "twice" in blocks of 4 KB; blocks without a bit are left out."""

    def once_and_twice(it):
        hashes, ids = [], []
        held = 0

        def flush():
            h, d = np.concatenate(hashes), np.concatenate(ids)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            other = np.concatenate([[False], (h[1:] == h[:-1]) & (d[1:] != d[:-1])])
            two = np.logical_or.reduceat(other, np.flatnonzero(new))
            h = h[new]
            block, bits = positions(h, log2_bits)
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            stops = np.append(cuts[1:], len(block))
            return pa.RecordBatch.from_pydict({
                "block": pa.array(block[cuts], pa.int64()),
                "once": pa.array([np.unique(bits[a:b]).tobytes() for a, b in zip(cuts, stops)], pa.binary()),
                "twice": pa.array([np.unique(bits[a:b][two[a:b]]).tobytes() for a, b in zip(cuts, stops)], pa.binary()),
            })

        for batch in it:
            doc = np.asarray(batch.column(0))
            for chunk in tk.chunks(batch.column(1)):
                _, _, first, _, _, long, h = keyed(chunk, min_points)
                row = np.repeat(np.arange(chunk.rows), np.diff(first))[long]
                hashes.append(h[long])
                ids.append(doc[chunk.lo: chunk.hi][row])
                held += len(ids[-1])
            if held > 1 << 21:  # a bounded number of lines is held; a line of two flushes is met when blocks are merged
                yield flush()
                hashes, ids, held = [], [], 0
        if held:
            yield flush()

    def merged(_, group):
        size = 1 << BLOCK_BITS
        count = np.zeros(size, np.int64)
        for once, twice in zip(group.column("once"), group.column("twice")):
            count[np.frombuffer(once.as_py(), np.uint16)] += 1
            count[np.frombuffer(twice.as_py(), np.uint16)] += 2
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(count >= 2).tobytes()], pa.binary())})

    sent = docs.select(id_of(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(once_and_twice, "block long, once binary, twice binary")
    return sent.groupBy("block").applyInArrow(lambda key, t: merged(key, t), "block long, bits binary")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = 40, min_docs: int = 5, max_filter_bytes: int = 128 << 20) -> DataFrame:
    """The rows of docs with repeated long lines taken out of their text, and n_lines, n_dropped.

    A line's key is the line without blanks at both ends, A-Z as a-z.  A key of at least `min_points` code points that at least
    `min_docs` different ids hold stays only in the largest of them, there in all its lines; other lines stay as they are.
    A null or empty text is one empty line.  Rows of one id are one document for the counts, and each is returned; a null id
    is an id of its own that comes before every other.  An empty table gives an empty table.  Other columns pass through;
    columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = own(docs, "n_lines", "n_dropped")
    log2_bits = filter_bits(docs.count(), max_filter_bytes)
    bits = np.zeros(1 << max(0, log2_bits - 3), np.uint8)
    for r in twice_filter(docs, id_col, text_col, min_points, log2_bits).toLocalIterator():
        bits[r["block"] << (BLOCK_BITS - 3): (r["block"] + 1) << (BLOCK_BITS - 3)] = np.frombuffer(r["bits"], np.uint8)
    twice = spark.sparkContext.broadcast(bits)

    def suspects(it):
        seen = twice.value
        for batch in it:
            doc = np.asarray(batch.column(0))
            for chunk in tk.chunks(batch.column(1)):
                _, _, first, kb, ke, long, h = keyed(chunk, min_points)
                at = np.flatnonzero(long)
                block, probe = positions(h[at], log2_bits)
                hit = np.ones(len(at), bool)
                for j in range(PROBES):
                    b = (block << BLOCK_BITS) + probe[:, j]
                    hit &= (seen[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
                at = at[hit]
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                _, one = np.unique(np.stack([row.astype(np.uint64), h[at]], 1), axis=0, return_index=True)
                at, row = at[one], row[one]
                text = tk.LOWER[chunk.data].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(doc[chunk.lo: chunk.hi][row], pa.int64()),
                    "hash": pa.array(h[at].view(np.int64), pa.int64()),
                    "key": pa.array([text[a:b] for a, b in zip(kb[at], ke[at])], pa.binary()),
                })

    found = docs.select(id_of(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(suspects, "id long, hash long, key binary")
    if docs.select(id_col).schema[0].dataType not in (T.LongType(), T.IntegerType()):
        raise TypeError(f"{id_col} must be an integer column")
    # one row for each key and id, then one for each key: both sum up before they shuffle
    # as a table: both sides of the join then come from a shuffle of their own, and Spark can split a key's partition
    verdict = written(found.groupBy("key", "id").agg(F.first("hash").alias("hash")).groupBy("key")
               .agg(F.count("*").alias("n"), F.max("id").alias("holder")).where(F.col("n") >= min_docs).select("key", "holder"))
    drops = (found.join(verdict, "key").where(F.col("id") != F.col("holder")).groupBy("id").agg(F.collect_set("hash").alias("__drop")))
    both = docs.withColumn("__id", id_of(id_col)).join(drops.withColumnRenamed("id", "__id"), "__id", "left").drop("__id")
    out = schema_of(docs, ("n_lines", T.LongType()), ("n_dropped", T.LongType()))
    out[text_col].nullable = True
    names = docs.columns

    def rewrite(it):
        for batch in it:
            texts = tk.column(batch, text_col)
            drop = tk.column(batch, "__drop")
            kept, n_lines, n_dropped = [], [], []
            for chunk in tk.chunks(texts):
                begin, end, first, _, _, long, h = keyed(chunk, min_points)
                text = chunk.data.tobytes()
                for i in range(chunk.rows):
                    gone, whole = drop[chunk.lo + i], text[chunk.starts[i]: chunk.starts[i + 1]]
                    a, b = first[i], first[i + 1]
                    n_lines.append(b - a)
                    if not gone.is_valid:
                        kept.append(whole)
                        n_dropped.append(0)
                        continue
                    lost = long[a:b] & np.isin(h[a:b], np.asarray(gone.values).view(np.uint64))
                    kept.append(b"\n".join(text[x:y] for x, y in zip(begin[a:b][~lost], end[a:b][~lost])))
                    n_dropped.append(int(lost.sum()))
            new = {text_col: pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(
                [new.get(c, tk.column(batch, c)) for c in names] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return both.mapInArrow(rewrite, out)
