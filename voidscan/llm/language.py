"""Language identification by interpolated Kneser-Ney character models.

Fitting counts the character 4-grams of every training text per language: each task sums up what it sees, Spark adds the sums.  From
those counts the driver derives continuation counts and discounts of all orders, and for each 4-gram that any language has the
smoothed log-probability in every language.  The model holds every n-gram of every language, in sorted arrays of 64-bit hashes with an
entry for each language that has it; the most frequent 4-grams also have a row of floats, ready for use.

Characters are UTF-16 units, lower-cased one by one; digits count as 0 and blanks as a space.  A text begins after three spaces.

Prediction adds up log-probabilities: one look-up a character, with back-off for 4-grams that no language has.  The language of the
least cross-entropy per character wins.  It is rejected if that cross-entropy is above what the language's own training characters
allow (their mean and variance, over the whole corpus, at `z` standard errors and `slack` nats).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voidscan.llm import textkit as tk
from voidscan.llm.frames import batches, own, schema_of

ORDER = 4
UNKNOWN = "und"
#: Neighbouring 4-grams share characters; the evidence of a text is taken as a fourth of its characters.
TEMPER = 4.0


def _tables() -> tuple[np.ndarray, np.ndarray]:
    fold, letter = np.arange(65536, dtype=np.uint16), np.zeros(65536, bool)
    for i in range(65536):
        c = chr(i)
        letter[i] = c.isalpha()
        if len(low := c.lower()) == 1:
            fold[i] = min(ord(low), 65535)
        if c.isspace():
            fold[i] = 0x20
        elif c.isdigit():
            fold[i] = 0x30
    return fold, letter


_FOLD, _LETTER = _tables()


def units(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of a chunk and bounds by row."""
    u = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-16-le", "surrogatepass"), np.uint16)
    before = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(((chunk.data & 0xC0) != 0x80).astype(np.int8) + (chunk.data >= 0xF0), out=before[1:])
    return u, before[chunk.starts]


def fourgrams(u: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key for each unit: it and the three before it in its row."""
    n = np.diff(first)
    size = len(u) + 3 * len(n)
    padded = np.full(size, 0x20, np.uint64)
    at = np.arange(len(u)) + np.repeat(3 * (np.arange(len(n)) + 1), n)
    padded[at] = _FOLD[u]
    key = padded.copy()
    for j in range(1, 4):
        key[j:] |= padded[:-j] << tk.U(16 * j)
    return key[at]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], (np.add.reduceat(counts, new) if len(new) else counts)


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, key, n) over all rows with a language."""

    def rows(it):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def sent():
            for lang, parts in held.items():
                k, n = _summed(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

        for batch in it:
            langs = np.array(batch.column(1).to_pylist(), object)
            for chunk in tk.chunks(batch.column(0)):
                u, first = units(chunk)
                key = fourgrams(u, first)
                of = langs[chunk.lo: chunk.hi]
                for lang in sorted(set(of)):
                    mine = np.repeat(of == lang, np.diff(first))
                    k, n = np.unique(key[mine], return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((k, n))
                    size += len(k)
                    if len(parts) > 16:
                        before = sum(len(p[0]) for p in parts)
                        parts[:] = [_summed(*(np.concatenate(x) for x in zip(*parts)))]
                        size += len(parts[0][0]) - before
                if size > 1 << 22:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return some.mapInArrow(rows, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Table:
    """A sorted array of hashed keys, each with a row of values; a directory of the hashes' top bits makes look-ups O(1)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = tk.mix(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], np.ascontiguousarray(values[order], np.float32)
        self.shift = tk.U(64 - max(8, int(np.ceil(np.log2(len(keys) + 1))) + 1))
        top = (self.hashes >> self.shift).astype(np.int64)
        self.start = np.searchsorted(top, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.hashes):
            return np.full(len(keys), -1)
        h = tk.mix(keys)
        top = (h >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.where((at < end) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h), at, -1)
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        step = 1
        while len(left):
            p = at[left] + step
            hit = self.hashes[p] == h[left]
            out[left[hit]] = p[hit]
            left = left[~hit]
            step += 1
            left = left[at[left] + step < end[left]]
        return out


class Sparse:
    """A value for each (key, language) that occurs."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, values: np.ndarray):
        order = np.lexsort((lang, tk.mix(keys)))
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.table = Table(keys[new], np.zeros((len(new), 0)))
        self.first = np.append(new, len(keys))
        self.lang, self.values = lang[order].astype(np.int32), values[order].astype(np.float32)

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the keys, language and value, for all that is held of them."""
        place = self.table.place(keys)
        hit = np.flatnonzero(place >= 0)
        lo = self.first[place[hit]]
        n = self.first[place[hit] + 1] - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(hit, n), self.lang[at], self.values[at]


@dataclass
class Model:
    langs: list[str]
    ready: Table  # log-probabilities in all languages of the most frequent 4-grams
    grams: list[Sparse]  # log-probabilities of all 1- to 4-grams in the languages that have them
    backoff: list[Sparse]  # log back-off weights after contexts of 0 to 3
    floor: float  # log-probability of a character that a language lacks, before its back-off weights
    mean: np.ndarray
    sd: np.ndarray

    def logs(self, key: np.ndarray) -> np.ndarray:
        """Log-probability of each 4-gram in each language."""
        if not len(self.ready.hashes):
            return self._backed(key)
        place = self.ready.place(key)
        out = self.ready.values[np.maximum(place, 0)]
        left = np.flatnonzero(place < 0)
        if len(left):
            out[left] = self._backed(key[left])
        return out

    def _backed(self, key: np.ndarray) -> np.ndarray:
        key, inverse = np.unique(key, return_inverse=True)
        out = np.zeros((len(key), len(self.langs)), np.float32)
        left = np.ones(out.shape, bool)
        for order in (4, 3, 2, 1):
            gram = key & tk.U((1 << 16 * order) - 1)
            row, lang, value = self.grams[order - 1].entries(gram)
            out[row, lang] += np.where(left[row, lang], value, 0)
            left[row, lang] = False
            row, lang, value = self.backoff[order - 1].entries(gram >> tk.U(16))
            out[row, lang] += np.where(left[row, lang], value, 0)
        out[left] += self.floor
        return out[inverse]


def _value(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


class _KneserNey:
    """One language: counts of 4-grams, continuation counts below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.grams = {4: (keys, counts)}
        for o in (3, 2, 1):
            self.grams[o] = np.unique(self.grams[o + 1][0] & tk.U((1 << 16 * o) - 1), return_counts=True)
        self.contexts, self.discount = {}, {}
        self.base = 1.0 / (alphabet + 1)
        for o in (4, 3, 2, 1):
            k, c = self.grams[o]
            one, two = int((c == 1).sum()), int((c == 2).sum())
            self.discount[o] = min(0.95, max(0.3, one / (one + 2 * two))) if one else 0.5
            ctx = k >> tk.U(16) if o > 1 else np.zeros(len(k), np.uint64)
            new = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            self.contexts[o] = (ctx[new], np.add.reduceat(c, new).astype(float), np.diff(np.append(new, len(k))).astype(float))

    def weight(self, order: int, context: np.ndarray) -> np.ndarray:
        """What is left for the lower order after a context; 1 after one never seen."""
        ctx, total, kinds = self.contexts[order]
        return _value(ctx, self.discount[order] * kinds / total, context, 1.0)

    def prob(self, order: int, key: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(key), self.base)
        context = key >> tk.U(16) if order > 1 else np.zeros(len(key), np.uint64)
        ctx, total, _ = self.contexts[order]
        k, c = self.grams[order]
        seen = np.maximum(_value(k, c, key, 0.0) - self.discount[order], 0) / _value(ctx, total, context, 1.0)
        return seen + self.weight(order, context) * self.prob(order - 1, key & tk.U((1 << 16 * (order - 1)) - 1))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_cells: int = 1 << 24) -> Model:
    """Count all rows of docs and build the model.

    The model has an entry for each 4-gram of each language, some 30 bytes; none is left out.  `max_cells` bounds the floats (64 MB) of
    the rows that are ready for use: the most frequent 4-grams have one, others are looked up language by language, with equal results.
    """
    batches(docs.sparkSession)
    from voidscan.llm.frames import written

    counts = written(count_grams(docs, text_col, lang_col))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        none = Sparse(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        return Model([], none.table, [none] * 4, [none] * 4, 0.0, np.zeros(0), np.zeros(0))
    numbers = docs.sparkSession.createDataFrame(list(zip(langs, range(len(langs)))), "lang string, number int")
    rows = counts.join(F.broadcast(numbers), "lang").select("number", "key", "n").toArrow()
    number, key, n = (np.asarray(rows.column(c)) for c in ("number", "key", "n"))
    del rows
    order = np.lexsort((key.view(np.uint64), number))
    number, key, n = number[order], key[order].view(np.uint64), n[order].astype(float)
    bounds = np.searchsorted(number, np.arange(len(langs) + 1))
    letters = len(np.unique(key & tk.U(0xFFFF)))
    own_models = [_KneserNey(key[a:b], n[a:b], letters) for a, b in zip(bounds[:-1], bounds[1:])]

    def sparse(parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        return Sparse(np.concatenate([k for k, _ in parts]), np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts]), np.log(np.concatenate([v for _, v in parts])))

    grams = [sparse([(x.grams[o][0], x.prob(o, x.grams[o][0])) for x in own_models]) for o in (1, 2, 3, 4)]
    backoff = [sparse([(x.contexts[o][0], x.weight(o, x.contexts[o][0])) for x in own_models]) for o in (1, 2, 3, 4)]
    union, total = _summed(key, n)
    most = max_cells // len(langs)
    if len(union) > most:
        union = union[np.sort(np.argsort(-total, kind="stable")[:most])]
    ready = Table(union, np.stack([np.log(x.prob(4, union)) for x in own_models], 1))
    mean, sd = np.zeros(len(langs)), np.zeros(len(langs))
    for i, x in enumerate(own_models):
        k, c = x.grams[4]
        h = -np.log(x.prob(4, k))
        mean[i] = (c * h).sum() / c.sum()
        sd[i] = np.sqrt((c * (h - mean[i]) ** 2).sum() / c.sum())
    return Model(langs, ready, grams, backoff, float(np.log(own_models[0].base)), mean, sd)


def entropies(model: Model, chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy by row and language, units of each row, and whether it has a letter."""
    u, first = units(chunk)
    n = np.diff(first)
    letter = tk.span_sums(_LETTER[u], first) > 0
    for r in np.flatnonzero(~letter & (tk.span_sums((u >= 0xD800) & (u < 0xE000), first) > 0)):
        letter[r] = any(c.isalpha() for c in chunk.data[chunk.starts[r]: chunk.starts[r + 1]].tobytes().decode("utf-8", "replace"))
    key = fourgrams(u, first)
    total = np.zeros((chunk.rows, len(model.langs)))
    step = 1 << 17
    some = np.flatnonzero(n)
    for lo in range(0, len(key), step):
        logs = model.logs(key[lo: lo + step])
        a = np.searchsorted(first[:-1][some], lo, "right") - 1
        b = np.searchsorted(first[:-1][some], min(lo + step, len(key)), "left")
        rows = some[a:b]
        cut = np.maximum(first[:-1][rows] - lo, 0)
        total[rows] += np.add.reduceat(logs, cut, axis=0)
    return -total / np.maximum(n, 1)[:, None], n, letter


def predict(docs: DataFrame, model: Model, text_col: str = "text", z: float = 6.0, slack: float = 0.5) -> DataFrame:
    """The rows of docs with lang_pred, lang_score (0 to 1) and lang_rejected.

    lang_pred is the learned language of the least cross-entropy per character (the first by name if equal), `und` if the text is null,
    empty or has no letter, or nothing was learned.  lang_score is the language's posterior, times exp(-excess) where the text is
    rejected; 0 for `und`.  Each row is judged alone; ids and other columns don't matter and pass through, columns with the three
    names are replaced.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = own(docs, "lang_pred", "lang_score", "lang_rejected")
    sent = spark.sparkContext.broadcast(model)
    names = docs.columns

    def rows(it):
        m = sent.value
        for batch in it:
            pred, score, rejected = [], [], []
            for chunk in tk.chunks(tk.column(batch, text_col)):
                if not m.langs:
                    pred += [UNKNOWN] * chunk.rows
                    score.append(np.zeros(chunk.rows))
                    rejected.append(np.ones(chunk.rows, bool))
                    continue
                h, n, letter = entropies(m, chunk)
                best = h.argmin(1)
                low = h[np.arange(len(h)), best]
                odds = np.exp(np.clip((low[:, None] - h) * n[:, None] / TEMPER, -700, 0)).sum(1)
                excess = np.maximum(0, low - m.mean[best] - slack - z * m.sd[best] / np.sqrt(np.maximum(n, 1)))
                score.append(np.where(letter, np.exp(-excess) / odds, 0.0))
                rejected.append((excess > 0) | ~letter)
                pred += [m.langs[b] if x else UNKNOWN for b, x in zip(best, letter)]
            cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            yield pa.RecordBatch.from_arrays([tk.column(batch, c) for c in names] + [pa.array(pred, pa.string()), cat(score, pa.float64()), cat(rejected, pa.bool_())], names=[*names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(rows, schema_of(docs, ("lang_pred", T.StringType()), ("lang_score", T.DoubleType()), ("lang_rejected", T.BooleanType())))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")
