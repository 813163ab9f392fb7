"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word (a run of letters, digits and non-ASCII bytes, A-Z as a-z) is the sum of a word embedding (by hash) and character embeddings (of
its hashed 4-byte runs with marked ends, summed up).  Windows of WINDOW words overlap by half and cover the whole text.  In a window a
forward and a backward gated recurrent unit read the words; attention weighs their states, and a logistic unit scores the pooled state.
A text scores as its highest window, on a scale that is calibrated on the training texts.

Training knows only which texts are toxic, not where.  It goes in rounds: of a toxic text the window that scores highest now is an
example (in the first round the one with the strongest evidence of single words), of a clean text the highest ones and some others.
The first coordinate of the embeddings starts at each word's log-odds over the training texts, where these are significant.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voidscan.llm import textkit as tk
from voidscan.llm.frames import batches, own, schema_of, written

WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS = 16, 16
WORD_DIM, CHAR_DIM, HIDDEN = 4, 4, 8
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Inputs:
    """Distinct words of some texts: their word bucket, their character buckets, and the texts as numbers of distinct words."""

    hash: np.ndarray
    bucket: np.ndarray
    chars: np.ndarray
    char_first: np.ndarray
    token: np.ndarray
    first: np.ndarray


def inputs(chunk: tk.Chunk) -> Inputs:
    data = tk.LOWER[chunk.data]
    w = tk.words(chunk, lower=True, between=_BETWEEN)
    h, index, token = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[index], w.end[index] - w.start[index]
    # all distinct words one after the other, each between two marks
    at = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.zeros(int(at[-1]) + 3, np.uint32)
    text[at[:-1]], text[at[1:] - 1] = 1, 2
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(at[:-1] + 1, size) + inner] = data[np.repeat(start, size) + inner]
    many = np.maximum(size - 1, 0)
    first = np.concatenate([[0], np.cumsum(many)])
    p = np.repeat(at[:-1], many) + np.arange(first[-1]) - np.repeat(first[:-1], many)
    key = text[p] | text[p + 1] << 8 | text[p + 2] << 16 | text[p + 3] << 24
    chars = (key * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)
    return Inputs(h, (h >> tk.U(64 - WORD_BITS)).astype(np.int64), chars.astype(np.int64), first, token.astype(np.int64), w.first)


def gathered(texts: list[str]) -> Inputs:
    """Inputs of many texts, read in chunks; a word of several chunks is one distinct word."""
    parts = [inputs(c) for c in tk.chunks(pa.array([t or "" for t in texts], pa.large_string()))]
    shift = np.cumsum([0] + [len(p.hash) for p in parts])
    h = np.concatenate([p.hash for p in parts])
    _, index, number = np.unique(h, return_index=True, return_inverse=True)
    size = np.concatenate([np.diff(p.char_first) for p in parts])
    begin = np.cumsum(size) - size
    first = np.concatenate([[0], np.cumsum(size[index])])
    chars = np.concatenate([p.chars.astype(np.int32) for p in parts])[np.repeat(begin[index] - first[:-1], size[index]) + np.arange(first[-1])]
    token = np.concatenate([number[p.token + s].astype(np.int32) for p, s in zip(parts, shift)])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])
    return Inputs(h[index], np.concatenate([p.bucket for p in parts])[index], chars, first, token, bounds)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of each window, and how many windows stand before each row: at 0, STRIDE, ... and one at the very end."""
    n = np.diff(first)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    bounds = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), many)
    nth = np.arange(bounds[-1]) - bounds[row]
    return first[row] + np.minimum(nth * STRIDE, np.maximum(n[row] - WINDOW, 0)), bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, forward pass and gradients."""

    def __init__(self, rng: np.random.Generator):
        dim, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {
            "word": (rng.normal(0, 0.01, (1 << WORD_BITS, WORD_DIM))).astype(np.float32), "char": (rng.normal(0, 0.01, (1 << CHAR_BITS, CHAR_DIM))).astype(np.float32),
            "att": draw(2 * h), "out": draw(2 * h), "bias": np.full(1, -1.0, np.float32),
        }
        for d in "fb":
            for g in "zrn":
                self.p |= {f"W{g}{d}": draw(dim, h), f"U{g}{d}": draw(h, h), f"b{g}{d}": np.zeros(h, np.float32)}

    def embed(self, x: Inputs) -> np.ndarray:
        """A row for each distinct word and an empty one at the end."""
        out = np.zeros((len(x.bucket) + 1, WORD_DIM + CHAR_DIM), np.float32)
        out[:-1, :WORD_DIM] = self.p["word"][x.bucket]
        some = np.flatnonzero(np.diff(x.char_first))
        if len(some):
            out[some, WORD_DIM:] = np.add.reduceat(self.p["char"][x.chars], x.char_first[:-1][some], axis=0)
        return out

    def projected(self, emb: np.ndarray) -> dict[str, np.ndarray]:
        """What the gates get of each distinct word."""
        return {f"{g}{d}": emb @ self.p[f"W{g}{d}"] + self.p[f"b{g}{d}"] for g in "zrn" for d in "fb"}

    def run(self, pre: dict[str, np.ndarray], idx: np.ndarray, length: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; idx: distinct words, (WINDOW, windows).  length: words of each window if any has fewer than WINDOW."""
        p, n, steps = self.p, idx.shape[1], idx.shape[0]
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                i = idx[t]
                z = pre["z" + d][i]
                z += h @ p[f"Uz{d}"]
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                r = pre["r" + d][i]
                r += h @ p[f"Ur{d}"]
                np.negative(r, out=r)
                np.exp(r, out=r)
                r += 1
                np.reciprocal(r, out=r)
                u = h @ p[f"Un{d}"]
                c = r * u
                c += pre["n" + d][i]
                np.tanh(c, out=c)
                new = h - c
                new *= z
                new += c
                if length is not None:
                    new = np.where((t < length)[:, None], new, h)
                if keep is not None:
                    keep[d, t] = (h, z, r, u, c)
                h = new
                states[t, :, k * HIDDEN: (k + 1) * HIDDEN] = h
        score = states @ p["att"]
        if length is not None:
            score = np.where(np.arange(steps)[:, None] < length, score, -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        value = states @ p["out"]
        logit = (weight * value).sum(0) + p["bias"][0]
        if keep is not None:
            keep |= {"states": states, "weight": weight, "value": value, "pooled": logit - p["bias"][0]}
        return logit

    def gradients(self, emb, x: Inputs, idx, length, target, importance) -> tuple[dict, float]:
        keep: dict = {}
        logit = self.run(self.projected(emb), idx, length, keep)
        prob = _sigmoid(logit)
        loss = float((-importance * (target * np.log(prob + 1e-9) + (1 - target) * np.log(1 - prob + 1e-9))).sum())
        d_logit = (importance * (prob - target)).astype(np.float32)
        p, steps = self.p, idx.shape[0]
        states, weight, value = keep["states"], keep["weight"], keep["value"]
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        g["bias"][0] = d_logit.sum()
        d_value = weight * d_logit
        d_score = weight * (value - keep["pooled"]) * d_logit
        g["out"] = np.einsum("tn,tnh->h", d_value, states)
        g["att"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = d_value[:, :, None] * p["out"] + d_score[:, :, None] * p["att"]
        d_emb = np.zeros_like(emb)
        for k, d in enumerate("fb"):
            dh = np.zeros((idx.shape[1], HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                dh = dh + d_states[t, :, k * HIDDEN: (k + 1) * HIDDEN]
                h, z, r, u, c = keep[d, t]
                live = dh if length is None else np.where((t < length)[:, None], dh, 0)
                dz = live * (h - c) * z * (1 - z)
                dc = live * (1 - z) * (1 - c * c)
                dr = dc * u * r * (1 - r)
                du = dc * r
                back = live * z + dz @ p[f"Uz{d}"].T + dr @ p[f"Ur{d}"].T + du @ p[f"Un{d}"].T
                i = idx[t]
                e = emb[i]
                for gate, dg, dg_u in (("z", dz, dz), ("r", dr, dr), ("n", dc, du)):
                    g[f"W{gate}{d}"] += e.T @ dg
                    g[f"b{gate}{d}"] += dg.sum(0)
                    g[f"U{gate}{d}"] += h.T @ dg_u
                np.add.at(d_emb, i, dz @ p[f"Wz{d}"].T + dr @ p[f"Wr{d}"].T + dc @ p[f"Wn{d}"].T)
                dh = back if length is None else back + (dh - live)
        g["word"] = (x.bucket, d_emb[:-1, :WORD_DIM])
        g["char"] = (x.chars, np.repeat(d_emb[:-1, WORD_DIM:], np.diff(x.char_first), axis=0))
        return g, loss

    def scores(self, x: Inputs, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, and bounds by text."""
        start, bounds = windows(x.first)
        pre = self.projected(self.embed(x))
        n = np.repeat(np.diff(x.first), np.diff(bounds))
        out = np.empty(len(start), np.float32)
        padded = np.concatenate([x.token, np.full(WINDOW, len(x.bucket))])
        for short in (False, True):
            which = np.flatnonzero((n < WINDOW) == short)
            for lo in range(0, len(which), block):
                w = which[lo: lo + block]
                idx = padded[start[w] + np.arange(WINDOW)[:, None]]
                length = n[w] if short else None
                if short:
                    idx = np.where(np.arange(WINDOW)[:, None] < length, idx, len(x.bucket))
                out[w] = self.run(pre, idx, length)
        return out, bounds


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, v in g.items():
            if isinstance(v, tuple):  # rows of a table
                rows, inverse = np.unique(v[0], return_inverse=True)
                total = np.zeros((len(rows), v[1].shape[1]), np.float32)
                np.add.at(total, inverse, v[1])
                at = rows
            else:
                total, at = v, slice(None)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * total
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * total**2
            self.p[k][at] -= self.rate * fix * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8)


@dataclass
class Model:
    network: Network
    middle: float
    scale: float

    def score(self, chunk: tk.Chunk) -> np.ndarray:
        """Score of each text: 0 to 1; a text without words scores as 0."""
        x = inputs(chunk)
        logits, bounds = self.network.scores(x)
        top = np.full(chunk.rows, -np.inf)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            top[some] = np.maximum.reduceat(logits, bounds[:-1][some])
        return np.where(np.isfinite(top), _sigmoid((top - self.middle) * self.scale), 0.0)


def _evidence(x: Inputs, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a word's and a run's presence in toxic against clean texts; 0 unless they are beyond 5 standard errors."""
    sizes = (1 << WORD_BITS, 1 << CHAR_BITS)
    count = [np.zeros((2, n)) for n in sizes]
    size = np.diff(x.char_first)
    for i in range(len(x.first) - 1):
        words = np.unique(x.token[x.first[i]: x.first[i + 1]])
        n = size[words]
        at = np.repeat(x.char_first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        count[0][label[i], np.unique(x.bucket[words])] += 1
        count[1][label[i], np.unique(x.chars[at])] += 1
    n1, n0 = max(1, int(label.sum())), max(1, int((label == 0).sum()))
    out = []
    for c0, c1 in count:
        p = (c1 + c0 + 1) / (n1 + n0 + 2)
        z = (c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        out.append(np.where(np.abs(z) > 5, np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)), 0.0))
    return out[0], out[1]


def train(texts: list[str], label: np.ndarray, seed: int = 11, rounds: int = 8, rate: float = 0.01) -> Model:
    """A model of labelled texts (1: toxic).  Without both kinds of labels it rejects nothing."""
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network(rng)
    label = np.asarray(label).astype(int)
    if not (label == 1).any() or not (label == 0).any():
        return Model(net, 1e9, 1.0)
    x = gathered(texts)
    if not len(x.token):
        return Model(net, 1e9, 1.0)
    word, char = _evidence(x, label)
    net.p["word"][:, 0] += 0.5 * word
    net.p["char"][:, 0] += 0.25 * char
    start, bounds = windows(x.first)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    n = np.diff(x.first)[row]
    emb = net.embed(x)
    padded = np.concatenate([x.token, np.full(WINDOW, len(x.bucket))])
    strength = np.concatenate([[0], np.cumsum((emb[:, 0] + emb[:, WORD_DIM])[x.token])])
    now = strength[start + np.minimum(n, WINDOW)] - strength[start]
    adam = Adam(net.p, rate)
    for turn in range(rounds):
        order = np.lexsort((-now, row))
        nth = np.arange(len(order)) - bounds[row[order]]
        toxic = label[row[order]] == 1
        chosen = order[np.where(toxic, nth < 1, (nth < 2) | (rng.random(len(order)) < 0.05))]
        y = label[row[chosen]].astype(np.float32)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for k in range(2):
            for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 256)):
                w = chosen[part]
                length = n[w] if (n[w] < WINDOW).any() else None
                idx = padded[start[w] + np.arange(WINDOW)[:, None]]
                if length is not None:
                    idx = np.where(np.arange(WINDOW)[:, None] < length, idx, len(x.bucket))
                few, idx = _some(x, idx)
                g, _ = net.gradients(net.embed(few), few, idx, length, y[part], (weight[part] / len(part)).astype(np.float32))
                adam.step(g)
        adam.rate *= 0.85
        now, _ = net.scores(x)
    some = np.flatnonzero(np.diff(bounds))
    top = np.maximum.reduceat(now, bounds[:-1][some])
    y = label[some]
    # the threshold with the least balanced error; between equal ones the middle
    cut = np.unique(top)
    mid = np.concatenate([[cut[0] - 1], (cut[1:] + cut[:-1]) / 2, [cut[-1] + 1]])
    pos, neg = np.sort(top[y == 1]), np.sort(top[y == 0])
    error = np.searchsorted(pos, mid) / max(1, len(pos)) + (len(neg) - np.searchsorted(neg, mid)) / max(1, len(neg))
    best = mid[error <= error.min() + 1e-12]
    return Model(net, float((best[0] + best[-1]) / 2), 1.0)


def _some(x: Inputs, idx: np.ndarray) -> tuple[Inputs, np.ndarray]:
    """The distinct words that idx names, and idx in terms of them; the empty one comes last."""
    used, at = np.unique(np.append(idx.ravel(), len(x.bucket)), return_inverse=True)
    used = used[:-1]
    size = np.diff(x.char_first)[used]
    first = np.concatenate([[0], np.cumsum(size)])
    chars = x.chars[np.repeat(x.char_first[used] - first[:-1], size) + np.arange(first[-1])]
    return Inputs(x.hash[used], x.bucket[used], chars, first, x.token[:0], x.first[:1]), at[:-1].reshape(idx.shape)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 4000, max_bytes: int = 16 << 20) -> Model:
    """Train on a bounded sample of labelled texts: `max_docs` / 2 of each label by the hash of their ids, `max_bytes` of text in UTF-8.

    Each label may take half of the bytes, and what the other leaves.  A text that doesn't fit is passed over, and those after it are
    read; a label whose texts with words are all too large has its smallest one, whole.  Texts of both labels of which one kind has
    no word are an error.  Null ids and labels other than 0 and 1 are passed over; an id that is labelled both ways is toxic.  Documents of
    one id are examples each; a null text is one without words.  Without labelled documents the model rejects nothing.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = None
    for label in (0, 1):
        part = some.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(max_docs // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = chosen.collect()  # max_docs pairs of numbers
    spark = docs.sparkSession
    held = F.broadcast(spark.createDataFrame(rows, "id long, label int"))
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(held, "id")
    found = written(found.select("label", "text", F.xxhash64("id").alias("at"), "id", F.xxhash64("text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"),
                                 F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7f]"), F.lit(False)).alias("words")))
    want = {r["label"]: r for r in found.groupBy("label").agg(F.sum(F.col("size").cast("long")).alias("size"), F.min(F.when(F.col("words"), F.col("size"))).alias("least")).collect()}
    if len(want) == 2 and any(r["least"] is None for r in want.values()):
        raise ValueError("the labelled texts of one kind have no words")
    quota, fits = {}, F.lit(False)
    for y, r in want.items():
        least, half = r["least"] or 0, max(max_bytes // 2, max_bytes - sum(o["size"] for x, o in want.items() if x != y))
        fits = fits | ((F.col("label") == y) & (F.col("size") <= max(half, least)))
        quota[y] = max(0, half - least)  # room is kept for the smallest text with words
    texts, kept = [], {y: r["least"] is None for y, r in want.items()}
    for r in found.where(fits).orderBy("at", "id", "hash").toLocalIterator():
        y = r["label"]
        if not kept[y] and r["words"] and r["size"] == want[y]["least"]:
            kept[y] = True
        elif r["size"] <= quota[y]:
            quota[y] -= r["size"]
        else:
            continue
        texts.append((r["text"], y))
    model = train([t for t, _ in texts], np.array([y for _, y in texts], int))
    del texts
    tk.release()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with toxicity (0 to 1) and toxic (1 if toxicity >= 0.5, else 0).

    Only the text counts: a null, empty or wordless text scores 0.  All windows of a text are scored, however long it is.  Other columns
    pass through; columns named toxicity or toxic are replaced.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = own(docs, "toxicity", "toxic")
    sent, names = spark.sparkContext.broadcast(model), docs.columns

    def rows(it):
        for batch in it:
            got = [sent.value.score(c) for c in tk.chunks(tk.column(batch, text_col))]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([tk.column(batch, c) for c in names] + [pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "toxicity", "toxic"])

    return docs.mapInArrow(rows, schema_of(docs, ("toxicity", T.DoubleType()), ("toxic", T.IntegerType())))
