"""Substring dedup: word windows that an earlier document holds, by matching statistics over compressed FM-indexes.

Indexing the whole corpus in every shard would compare all with all.  Instead:

1. Anchors.  In every run of window - GRAM + 1 word grams the one of least hash is an anchor (winnowing), so two documents that
   share a window share an anchor at the same place of it.  Around each anchor lies its segment: the words of all windows
   that hold the anchor, with a hash of them.  Anchors of one document only are done with.
2. Segments of shared anchors go to shards by anchor; of documents with the very same segment the smallest id sends its words, once.
   A shard builds a compressed FM-index of its segments.  Each segment is streamed through it by backward search, against
   the segments of smaller ids than its holder's, and, if other documents hold it too, against those up to the holder's.  Its matching
   statistics give the intervals of at least `window` words that an earlier document holds; nothing else removes a word.
3. An anchor of very many different segments is split over several shards; windows that none of its shards settles meet again by
   their hash, of which only the smallest id is kept before they shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voidscan.llm import textkit as tk
from voidscan.llm.fm_index import FMIndex
from voidscan.llm.frames import batches, id_of, own, schema_of, written

GRAM = 20
#: Segments of one anchor in a shard, and segments in a shard, about.
SPLIT, SHARD = 16384, 16000


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i + width] for each i, by doubling; shorter at the end."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        nxt = out.copy()
        nxt[:-step] = op(out[:-step], out[step:])
        out, have = nxt, have + step
    return out


def anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a chunk: their grams' hashes, rows, and word positions in the row.  Ties of the least hash are all anchors."""
    run = window - GRAM + 1
    g, bounds = tk.grams(hashes, first, GRAM)
    many = np.diff(bounds)
    row = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(g)) + row * run  # `run` places between rows keep their windows apart
    padded = np.full(len(g) + len(many) * run, np.iinfo(np.uint64).max, np.uint64)
    padded[at] = g
    least = sliding(padded, run, np.minimum)
    whole = np.zeros(len(padded), np.uint64)
    ok = np.arange(len(g)) + run <= bounds[1:][row]
    whole[at[ok]] = least[at[ok]]
    best = sliding(whole[::-1], run, np.maximum)[::-1]  # over the windows that hold the gram
    chosen = np.flatnonzero((best[at] == g) & (best[at] > 0))
    return g[chosen], row[chosen], chosen - bounds[:-1][row[chosen]]


def anchor_rows(window: int):
    schema = T.StructType([T.StructField(n, T.IntegerType() if n in ("lo", "hi") else T.LongType()) for n in ("anchor", "seg", "id", "rk", "lo", "hi")])

    def rows(it):
        for batch in it:
            ids, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for chunk in tk.chunks(batch.column(2)):
                w = tk.words(chunk)
                g, row, pos = anchors(w.hash, w.first, window)
                if not len(g):
                    continue
                n = np.diff(w.first)[row]
                lo, hi = np.maximum(0, pos + GRAM - window), np.minimum(n, pos + window)
                seg = tk.mix(tk.Spans(w.hash).hash(w.first[row] + lo, w.first[row] + hi) + (pos - lo).astype(np.uint64))
                r = row + chunk.lo
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), seg.view(np.int64), ids[r], keys[r], lo.astype(np.int32), hi.astype(np.int32))], names=schema.names)

    return rows, schema


def segment_words(it):
    """Words, as 64-bit hashes, of the segments that a document is asked for."""
    for batch in it:
        asked = tk.column(batch, "asked")
        ids, keys = np.asarray(tk.column(batch, "id")), np.asarray(tk.column(batch, "rk"))
        first = np.asarray(asked.offsets)
        item = asked.values
        lo, hi, shard, anchor, seg, alone, more = (np.asarray(item.field(n)) for n in ("lo", "hi", "shard", "anchor", "seg", "alone", "more"))
        for chunk in tk.chunks(tk.column(batch, "text")):
            w = tk.words(chunk)
            a, b = first[chunk.lo], first[chunk.hi]
            row = np.repeat(np.arange(chunk.rows), np.diff(first[chunk.lo: chunk.hi + 1]))
            base = w.first[row]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(shard[a:b]), "anchor": pa.array(anchor[a:b]), "seg": pa.array(seg[a:b]), "id": pa.array(ids[row + chunk.lo]),
                "alone": pa.array(alone[a:b]), "more": pa.array(more[a:b]),
                "words": pa.array([w.hash[x:y].tobytes() for x, y in zip(base + lo[a:b], base + hi[a:b])], pa.binary()),
            })


def united(piece: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, a, b): for each piece, the stretches that its intervals [a, b) cover together."""
    if not len(piece):
        return piece, a, b
    wide = np.int64(b.max()) + 1
    lo, hi = piece.astype(np.int64) * wide + a, piece.astype(np.int64) * wide + b
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    begins = np.concatenate([[True], lo[1:] > hi[:-1]])
    ends = np.concatenate([begins[1:], [True]])
    return lo[begins] // wide, lo[begins] % wide, hi[ends] % wide


def matched(window: int):
    """For a shard: intervals (a, b) of a segment that smaller ids hold; b = -1: the window at a, of hash `anchor`, is open.

    later: the interval counts for all documents with the segment but the holder; else for the holder.
    """

    def run(_, t):
        t = t.combine_chunks()
        _, offsets, _ = tk.strings(t.column("words"))
        raw = t.column("words").combine_chunks()
        data = np.frombuffer(raw.buffers()[2], np.uint64, count=int(offsets[-1]) // 8) if len(t) else np.zeros(0, np.uint64)
        first = offsets // 8
        ids, anchor, seg = (np.asarray(t.column(n)) for n in ("id", "anchor", "seg"))
        alone, more = (np.asarray(t.column(n)) for n in ("alone", "more"))
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
        index = FMIndex(data, first, rank, 2 * window)
        own_, others = np.flatnonzero(~alone), np.flatnonzero(more)
        asked, later = np.concatenate([own_, others]), np.repeat([False, True], [len(own_), len(others)])
        q, a, b = index.matches(asked, np.diff(first)[asked], rank[asked] + later, window)
        p = asked[q]
        u, start, end = united(q, a, b)  # the same words, in fewer rows
        out = [(anchor[asked[u]], seg[asked[u]], ids[asked[u]], start, end, later[u])]
        if len(ids) and t.column("shard")[0].as_py() < 0:  # one of several shards of an anchor
            many = np.maximum(np.diff(first) - window + 1, 0)
            row = np.repeat(np.arange(len(ids)), many)
            where = np.concatenate([[0], np.cumsum(many)])
            start = np.arange(where[-1]) - where[row]
            settled = np.zeros(len(row), bool)
            for s, x, y in zip(p[~later[q]], a[~later[q]], b[~later[q]]):
                settled[where[s] + x: where[s] + y - window + 1] = True
            row, start = row[~settled], start[~settled]
            h = tk.Spans(data).hash(first[row] + start, first[row] + start + window)
            out.append((h.view(np.int64), seg[row], ids[row], start, np.full(len(row), -1), np.zeros(len(row), bool)))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table({n: pa.array(c if n == "later" else c.astype(np.int64)) for n, c in zip(("anchor", "seg", "id", "a", "b", "later"), columns)})

    return run


def repeats(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, rk, cut: list of word intervals): what earlier documents hold, for each document that has any."""
    keyed = docs.select(id_of(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    rows, schema = anchor_rows(window)
    found = keyed.mapInArrow(rows, schema)
    # as a table: both sides of the join then come from a shuffle of their own, and Spark can split a hot anchor's partition
    common = written(found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("anchor"))
    occ = written(found.join(common, "anchor"))
    segs = written(occ.groupBy("anchor", "seg").agg(F.min("id").alias("holder"), F.max("id").alias("last")))
    kinds = written(segs.groupBy("anchor").agg(F.count("*").alias("kinds")))
    occ = written(occ.join(segs.join(kinds, "anchor"), ["anchor", "seg"]))

    asked = occ.where("id = holder").dropDuplicates(["anchor", "seg"])
    n = segs.count()
    shards = 1 + max(n // SHARD, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (SHARD // 4)))
    parts = F.ceil(F.col("kinds") / SPLIT)
    shard = F.when(F.col("kinds") <= SPLIT, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(
        -1 - F.pmod(F.xxhash64(F.col("anchor"), F.pmod(F.col("seg"), parts)), F.lit(1 << 40)))
    item = F.struct("lo", "hi", shard.alias("shard"), "anchor", "seg", (F.col("kinds") == 1).alias("alone"), (F.col("last") > F.col("holder")).alias("more"))
    wanted = asked.groupBy("id", "rk").agg(F.collect_list(item).alias("asked"))
    words = keyed.join(wanted, ["id", "rk"]).select("id", "rk", "asked", "text")
    sent = words.mapInArrow(segment_words, "shard long, anchor long, seg long, id long, alone boolean, more boolean, words binary")
    run = matched(window)
    hits = written(sent.groupBy("shard").applyInArrow(lambda key, t: run(key, t), "anchor long, seg long, id long, a long, b long, later boolean"))
    open_ = hits.where("b < 0").withColumnRenamed("anchor", "h")
    settled = open_.join(open_.groupBy("h").agg(F.min("id").alias("holder")), "h").where("id > holder")
    # the anchor is part of a segment's hash
    inner = hits.where("b >= 0").select("seg", "later", "a", "b").unionByName(settled.select("seg", "later", "a", (F.col("a") + window).alias("b")))
    # as a table: a passage that very many documents hold can then be split on the side of the documents
    spans = written(inner.groupBy("seg", "later").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    # a document may hold a segment more than once
    held = occ.select("seg", (F.col("id") > F.col("holder")).alias("later"), "id", "rk", "lo").join(spans, ["seg", "later"])
    cut = F.transform("spans", lambda s: F.struct((F.col("lo") + s["a"]).cast("int").alias("lo"), (F.col("lo") + s["b"]).cast("int").alias("hi")))
    return held.select("id", "rk", cut.alias("cut")).groupBy("id", "rk").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """The rows of docs with repeated passages cut from their text, and n_words, n_removed, and `cuts`, the word intervals.

    A window is `window` consecutive words of a text.  Each word is cut that a window covers whose words also start in a
    document of a smaller id; windows are those of the input.  A text of which words were cut becomes the words left, joined by
    one blank; another stays as it is.  A null or empty text has no words and stays.  Rows of one id don't cut each other; a
    null id comes before every other.  An empty table gives an empty table.  Other columns pass through; columns named n_words,
    n_removed or cuts are replaced.  A document is held in memory whole, about 30 times its bytes.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = own(docs, "n_words", "n_removed", "cuts")
    names = docs.columns
    cut = repeats(docs, id_col, text_col, window).select(F.col("id").alias("__id"), F.col("rk").alias("__rk"), F.col("cut").alias("__cut"))
    both = docs.withColumns({"__id": id_of(id_col), "__rk": F.xxhash64(id_col, text_col)}).join(cut, ["__id", "__rk"], "left").drop("__id", "__rk")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = schema_of(docs, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("cuts", spans))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rewrite(it):
        for batch in it:
            texts, cuts = tk.column(batch, text_col), tk.column(batch, "__cut")
            _, _, valid = tk.strings(texts)
            first = np.asarray(cuts.offsets)
            lo, hi = np.asarray(cuts.values.field("lo")), np.asarray(cuts.values.field("hi"))
            kept, n_words, n_removed, spans = [], [], [], []
            for chunk in tk.chunks(texts):
                w = tk.words(chunk, hashed=False)
                n = np.diff(w.first)
                a, b = first[chunk.lo], first[chunk.hi]
                row = np.repeat(np.arange(chunk.rows), np.diff(first[chunk.lo: chunk.hi + 1]))
                gone = tk.covered(w.first[row] + lo[a:b], w.first[row] + hi[a:b], len(w.start))
                removed = tk.span_sums(gone, w.first)
                left = tk.joined(chunk, w, ~gone)
                text = chunk.data.tobytes()
                for i in range(chunk.rows):
                    j = chunk.lo + i
                    kept.append(None if not valid[j] else left[i] if removed[i] else text[chunk.starts[i]: chunk.starts[i + 1]])
                    if removed[i]:
                        g = np.flatnonzero(np.diff(np.concatenate([[0], gone[w.first[i]: w.first[i + 1]].astype(np.int8), [0]])))
                        spans.append([{"start": x, "end": y} for x, y in zip(g[::2].tolist(), g[1::2].tolist())])
                    else:
                        spans.append([])
                n_words.append(n)
                n_removed.append(removed)
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.binary()).cast(pa.string()) if c == text_col else tk.column(batch, c) for c in names] + [cat(n_words), cat(n_removed), pa.array(spans, arrow)],
                names=[*names, "n_words", "n_removed", "cuts"])

    return both.mapInArrow(rewrite, out)
