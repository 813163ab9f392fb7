"""Packing: an order-preserving dynamic program chooses where the token stream is cut into sequences.

Tokens come from a public tokenizer file.  A text is split wherever the classes of ASCII and of letters of two bytes show that the
tokenizer's own pre-tokenizer starts anew, so each distinct piece is tokenized once and the ids of the rest are looked up by hash.  Of new
pieces, short ones of such characters are merged here, many at once; the tokenizers library codes the others.

The documents of a task form a stream.  Cuts may fall after a document or after a sentence; only a sentence that is longer than a whole
sequence has places inside, every STEP tokens.  A sequence of n tokens costs its padding, a cut inside a document a penalty, and a cut
inside a sentence a larger one:

    cost(j) = penalty(j) + min over i with at[j] - at[i] <= size of cost(i) + size - (at[j] - at[i])

The window of i slides, so a monotone queue of cost(i) + at[i] gives each minimum in O(1).  A half or a
quarter of the size needs no padding either; each is one more candidate, if a cut stands there.  The stream is cut after some BLOCK_TOKENS at the end of a document,
which bounds memory; nothing is shuffled.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscan.llm import textkit as tk
from voidscan.llm.frames import batches

SIZE, END = 2048, 1
#: Costs in tokens of padding: a cut after a sentence, a cut inside one, and a sequence more.
SENTENCE, INSIDE, SEQUENCE = 24.0, 96.0, 8.0
STEP = 64
BLOCK_TOKENS = 1 << 20
#: Distinct pieces whose ids a worker keeps.
KEPT_PIECES = 1 << 19

#: Longer pieces are left to the library, whose time doesn't grow with the square of a piece.
MERGED_BYTES = 32
#: Pieces merged together.
MERGED_PIECES = 1 << 15

# Classes of bytes for the pre-tokenizer: unknown, letters, digits, signs, the apostrophe (it may begin a contraction), the blank, other
# white space, and what is no white space but maybe a letter or a sign.  Known letters of two bytes are U+00C0..U+02BF but for two signs.
_ANY, _LETTER, _DIGIT, _SIGN, _QUOTE, _BLANK, _SPACE, _SOLID = range(8)
_CLASS = np.full(256, _ANY, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[ord("0"): ord("9") + 1] = _DIGIT
_CLASS[ord("A"): ord("Z") + 1] = _CLASS[ord("a"): ord("z") + 1] = _CLASS[0xC3:0xCB] = _LETTER
_CLASS[ord("'")], _CLASS[0x20], _CLASS[0x09:0x0E], _CLASS[0xCB] = _QUOTE, _BLANK, _SPACE, _SOLID
_FULL = np.isin(np.arange(8), [_LETTER, _DIGIT, _SIGN, _QUOTE, _SOLID])
_WHITE = np.isin(np.arange(8), [_BLANK, _SPACE])
# Which class after which surely begins a pre-token.
_EDGE = np.zeros((8, 8), bool)
_EDGE[np.ix_(_FULL, _WHITE)] = _EDGE[_SPACE, _FULL] = True
_EDGE[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = _EDGE[_DIGIT, [_LETTER, _SIGN, _QUOTE]] = _EDGE[_SIGN, [_LETTER, _DIGIT]] = _EDGE[_QUOTE, _DIGIT] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def classes(d: np.ndarray) -> np.ndarray:
    """Class of each byte; both bytes of a character of two have the same."""
    c = _CLASS[d]
    two = np.flatnonzero((d >= 0xC3) & (d <= 0xCB))
    if len(two):
        after = np.append(d, 0)[two + 1]
        c[two[(after & 0xC0) != 0x80]] = _ANY
        c[two[(d[two] == 0xC3) & ((after == 0x97) | (after == 0xB7))]] = _SIGN
        two = two[(after & 0xC0) == 0x80]
        c[two + 1] = c[two]
    return c


def pieces(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces begin (and the end of the last), how many stand before each row, which are surely one pre-token, which end a sentence."""
    d = chunk.data
    n = len(d)
    c = classes(d)
    row = np.zeros(n + 1, bool)
    row[chunk.starts] = True
    row[n] = True
    begins, wide, odd = row.copy(), row.copy(), c == _ANY
    odd |= c == _SOLID
    if n > 1:
        begins[1:n] |= _EDGE.ravel()[c[:-1] * np.uint8(8) + c[1:]]
        odd[1:] |= (c[:-1] == _QUOTE) & (c[1:] == _LETTER)
    if n > 2:
        white, full = _WHITE[c], _FULL[c]
        # the last of several white characters goes with what follows, if anything does in its row
        last = np.flatnonzero(white[:-2] & white[1:-1] & full[2:]) + 1
        begins[last[~row[last + 1]]] = True
        wide[1:n - 1] |= full[:-2] & (c[1:-1] == _BLANK) & full[2:]
    at = np.flatnonzero(begins)
    plain = np.ones(len(at) - 1, bool)
    plain[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = False
    end = at[1:]
    return at, np.searchsorted(at, chunk.starts), plain, wide[end] & _STOP[d[end - 1]]


class Merges:
    """Byte-pair encoding of many short pre-tokens at once: in each step every one of them merges its pair of least rank, the first of equals.

    Pre-tokens of as many symbols are a matrix with a column for each.  A step takes one symbol off a column, and the columns that have nothing
    to merge leave; the others join those of one symbol less.  For each pair the matrix `low` has its rank and place, so a minimum names both.
    """

    NONE, PLACES = np.int32(1 << 30), 5

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(x) for x in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not plain byte-pair encoding")
        vocab = model["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in a byte-level vocabulary
        other = iter(range(256, 512))
        self.byte = np.array([vocab[chr(b) if b in shown else chr(next(other))] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs] or [0], np.int32)
        key = self.key(np.array([vocab[a] for a, _ in pairs], np.int32), np.array([vocab[b] for _, b in pairs], np.int32))
        if len(np.unique(key)) < len(key) or len(np.unique(self.made)) < len(self.made) or len(key) >= 1 << 24:
            raise ValueError("pairs or what they make are not distinct")
        bits = max(4, len(key).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        # open addressing: a taken place sends a key to the next one
        self.keys, self.rank = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, self.NONE)
        left, at = np.arange(len(key)), self.place(key)
        while len(left):
            free = self.rank[at] == self.NONE
            self.rank[at[free]] = left[free] << self.PLACES
            here = free & (self.rank[at] == left << self.PLACES)
            self.keys[at[here]] = key[left[here]]
            left, at = left[~here], (at[~here] + 1) % len(self.keys)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.first = self.ranks(self.byte[a], self.byte[b])

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << tk.U(32)) | b.astype(np.uint64)

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> tk.U(29))) * tk.U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, times 2**PLACES, or NONE."""
        key = self.key(a, b)
        at = self.place(key)
        held = self.keys[at]
        out = np.where(held == key, self.rank[at], self.NONE)
        on = np.flatnonzero((held != key) & (held != ~tk.U(0)))
        while len(on):
            at[on] = (at[on] + 1) % len(self.keys)
            held = self.keys[at[on]]
            out[on] = np.where(held == key[on], self.rank[at[on]], self.NONE)
            on = on[(held != key[on]) & (held != ~tk.U(0))]
        return out

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of 1 to MERGED_BYTES bytes of data, and how many each has."""
        parts = [self.block(data, start[i: i + MERGED_PIECES], end[i: i + MERGED_PIECES]) for i in range(0, len(start), MERGED_PIECES)]
        return tuple(np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in ((0, np.uint32), (1, np.int64)))

    def block(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = end - start
        order = np.argsort(n, kind="stable")
        upto = np.searchsorted(n[order], np.arange(n.max() + 2))
        who, ids, low = order[:0], np.zeros((n.max() + 1, 0), np.int32), np.zeros((n.max(), 0), np.int32)
        size, done = np.zeros(len(n), np.int64), []
        for m in range(int(n.max()), 0, -1):
            place = np.arange(m, dtype=np.int32)[:, None]
            own = order[upto[m]: upto[m + 1]]  # those that begin with m symbols
            d = data[start[own] + place]
            who, ids = np.concatenate([who, own]), np.concatenate([ids[:m], self.byte[d]], 1)
            low = np.concatenate([low[:m - 1], self.first[d[:-1].astype(np.int32) << 8 | d[1:]] + place[:-1]], 1)
            least = low.min(0, initial=self.NONE)
            ready = least >= self.NONE >> 1
            size[who[ready]] = m
            done.append((who[ready], ids[:, ready]))
            more = np.flatnonzero(~ready)
            who, ids, low, least = who[more], ids[:, more], low[:, more], least[more]
            at, column = least & ((1 << self.PLACES) - 1), np.arange(len(more))
            made = self.made[least >> self.PLACES]
            before = place < at
            ids = np.where(before[:-1], ids[:-1], ids[1:])
            low = np.where(before[:-2], low[:-1], low[1:] - 1)
            ids[at, column] = made
            x = np.flatnonzero(at > 0)
            low[at[x] - 1, x] = self.ranks(ids[at[x] - 1, x], made[x]) + at[x] - 1
            x = np.flatnonzero(at < m - 2)
            low[at[x], x] = self.ranks(made[x], ids[at[x] + 1, x]) + at[x]
        first = np.cumsum(size) - size
        out = np.zeros(size.sum(), np.uint32)
        for w, found in done:
            out[first[w] + np.arange(len(found))[:, None]] = found
        return out, size


class Ids:
    """Ids of pieces in a sorted array of their hashes."""

    def __init__(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        self.hashes, self.size = hashes[order], size[order]
        self.first = np.cumsum(self.size) - self.size
        self.ids = ids[np.repeat(begin - self.first, self.size) + np.arange(len(ids))]

    def place(self, asked: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        return np.where(self.hashes[at] == asked, at, -1)

    def __add__(self, other: Ids) -> Ids:
        return Ids(*(np.concatenate(x) for x in ((self.hashes, other.hashes), (self.size, other.size), (self.ids, other.ids))))


def _none() -> Ids:
    return Ids(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))


class Tokens:
    """The ids of texts by a tokenizer file of byte-level BPE without a normalizer, run by the tokenizers library."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:  # the tokenizer's file, which every executor has
            d = json.load(f)
        self.special = [t["content"].encode() for t in d["added_tokens"]]
        pre = d["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or d["normalizer"] or d["model"].get("dropout"):
            raise ValueError(f"{path}: only byte-level pre-tokenizers by regular expression, without normalizer or dropout, cut texts as this module does")
        try:
            self.merges = Merges(d["model"])
        except (KeyError, ValueError):  # the library codes every piece of another kind of model
            self.merges = None
        self.known, self.fresh = _none(), _none()

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has."""
        # many pieces are one call's words, which the library codes apart from each other
        runs = [[t.decode() for t in texts[i: i + 1000]] for i in range(0, len(texts), 1000)]
        parts = self.whole.encode_batch(runs, is_pretokenized=True, add_special_tokens=False)
        size = [np.bincount(np.array(x.word_ids, np.int64), minlength=len(r)) for x, r in zip(parts, runs)]
        return np.concatenate([np.array(x.ids, np.uint32) for x in parts]), np.concatenate(size)

    def of(self, chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunk, bounds by row, and which ids end a sentence."""
        at, by_row, plain, ends = pieces(chunk)
        start, end = at[:-1], at[1:]
        h = tk.Spans(tk.byte_codes(chunk.data)).hash(start, end)
        unique, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        big, small = self.known.place(unique), self.fresh.place(unique)
        new = np.flatnonzero((big < 0) & (small < 0))
        if len(new):
            if len(self.known.hashes) + len(self.fresh.hashes) + len(new) > KEPT_PIECES:
                self.known = self.fresh = _none()
                new = np.arange(len(unique))
            a, b = start[index[new]], end[index[new]]
            short = plain[index[new]] & (b - a <= MERGED_BYTES) & (self.merges is not None)
            if short.any():
                ids, size = self.merges.of(chunk.data, a[short], b[short])
                self.fresh += Ids(unique[new[short]], size, ids)
            if not short.all():
                text = chunk.data.tobytes()
                ids, size = self.coded([text[x:y] for x, y in zip(a[~short].tolist(), b[~short].tolist())])
                self.fresh += Ids(unique[new[~short]], size, ids)
            if len(self.fresh.hashes) > max(1 << 16, len(self.known.hashes) // 3):
                self.known, self.fresh = self.known + self.fresh, _none()
            big, small = self.known.place(unique), self.fresh.place(unique)
        b, s = self.known, self.fresh
        held = np.concatenate([b.ids, s.ids])
        size = np.where(big >= 0, np.append(b.size, 0)[big], np.append(s.size, 0)[small])
        first = np.where(big >= 0, np.append(b.first, 0)[big], np.append(s.first, 0)[small] + len(b.ids))
        count = size[inverse]
        out_first = np.concatenate([[0], np.cumsum(count)])
        ids = held[np.repeat(first[inverse] - out_first[:-1], count) + np.arange(out_first[-1])]
        stop = np.zeros(len(ids), bool)
        stop[out_first[1:][ends] - 1] = True
        bounds = out_first[by_row]
        if any(x in (text := chunk.data.tobytes()) for x in self.special):
            ids, bounds, stop = self.with_special(chunk, text, ids, bounds, stop)
        return ids, bounds, stop

    def with_special(self, chunk, text, ids, bounds, stop):
        new_ids, new_stop = [], []
        for i in range(chunk.rows):
            row = text[chunk.starts[i]: chunk.starts[i + 1]]
            if any(x in row for x in self.special):
                new_ids.append(np.array(self.whole.encode(row.decode(), add_special_tokens=False).ids, np.uint32))
                new_stop.append(np.zeros(len(new_ids[-1]), bool))
            else:
                new_ids.append(ids[bounds[i]: bounds[i + 1]])
                new_stop.append(stop[bounds[i]: bounds[i + 1]])
        return np.concatenate(new_ids), np.concatenate([[0], np.cumsum([len(x) for x in new_ids])]), np.concatenate(new_stop)


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    """A worker process keeps its pieces from one task to the next."""
    return Tokens(path)


def cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indexes of the chosen cuts: at[0] = 0 and at[-1] are the stream's ends, and no two neighbours are more than size apart.

    Least total of padding, penalties and SEQUENCE for each sequence; of equal choices the one with the latest last cut.
    """
    n = len(at)
    places = {int(p): k for k, p in enumerate(at.tolist())}
    where, price = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    powers = [size // 2, size // 4]
    for j in range(1, n):
        p = where[j]
        while where[queue[0][1]] < p - size:
            queue.popleft()
        value, i = queue[0]
        best = value + size - p
        for w in powers:  # a sequence of such a length is not padded
            k = places.get(p - w)
            if k is not None and cost[k] <= best:
                best, i = cost[k], k
        cost[j] = best = best + price[j] + SEQUENCE
        back[j] = i
        value = best + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def boundaries(stop: np.ndarray, doc_end: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream may be cut and their penalties; a sentence of more than `size` tokens has places every STEP tokens."""
    n = len(stop)
    sentence = np.flatnonzero(stop) + 1
    at = np.union1d(np.append(sentence, 0), doc_end)
    gap = np.diff(at)
    wide = np.flatnonzero(gap > size)
    more = (gap[wide] - 1) // STEP
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    every = np.union1d(at, np.repeat(at[wide], more) + nth * STEP)
    penalty = np.full(len(every), INSIDE)
    penalty[np.searchsorted(every, sentence)] = SENTENCE
    penalty[np.searchsorted(every, doc_end)] = 0.0
    penalty[0] = 0.0
    assert every[-1] == n
    return every, penalty


class Stream:
    """Documents of a task until they are packed."""

    def __init__(self, shard: int):
        self.next = shard << 40
        self.clear()

    def clear(self) -> None:
        self.ids, self.stop, self.docs, self.sizes, self.held = [], [], [], [], 0

    def add(self, doc, ids: np.ndarray, stop: np.ndarray) -> None:
        self.ids.append(ids)
        self.stop.append(stop)
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.held += len(ids)

    def pack(self) -> dict[str, list]:
        ids, stop = np.concatenate(self.ids), np.concatenate(self.stop)
        end = np.cumsum(self.sizes)
        at, penalty = boundaries(stop, end)
        chosen = at[cuts(at, penalty)]
        # pieces: between all chosen cuts and document ends
        edge = np.union1d(chosen, end)
        edge = edge[edge > 0]
        begin = np.concatenate([[0], edge[:-1]])
        doc = np.searchsorted(end, begin, "right")
        seq = np.searchsorted(chosen, begin, "right") - 1
        start = begin - (end - np.array(self.sizes))[doc]
        raw = ids.astype("<u4")
        out = {
            "doc": [self.docs[k] for k in doc.tolist()], "start": start, "length": edge - begin,
            "ids_crc32": [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), edge.tolist())],
            "doc_tokens": np.array(self.sizes)[doc], "sequence_id": seq + self.next, "offset": begin - chosen[seq],
            "ids": [raw[a:b].tobytes() for a, b in zip(begin.tolist(), edge.tolist())],
        }
        self.next += len(chosen) - 1
        self.clear()
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids.

    A document's ids are the tokenizer's of its whole text, without special tokens (a special token's string in a text is its id, as the
    tokenizer reads it), and id 1 at the end.  A null or empty text is the one id 1.  Pieces of a sequence follow each other in the order
    of the input, and lengths add up to 2048 at most; shorter sequences are to be padded to 2048, but for powers of two.  sequence_id
    is the task's number * 2**40 and a count.  Rows of one id are documents of their own; a null id stays null.  An empty table gives no
    rows.  No other columns are used.  `tokenizer_path` must hold on every executor.  ids: unsigned 32-bit, little-endian.
    """
    batches(docs.sparkSession)
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def rows(it):
        tokens, stream = _tokens(tokenizer_path), Stream(TaskContext.get().partitionId())

        def sent():
            out = stream.pack()
            return pa.RecordBatch.from_arrays([pa.array(out[k], pa.binary() if k == "ids" else pa.int64()) for k in ("doc", *names[1:])], names=names)

        for batch in it:
            doc = batch.column(0).to_pylist()
            for chunk in tk.chunks(batch.column(1)):
                ids, first, stop = tokens.of(chunk)
                ids, stop = np.insert(ids, first[1:], END), np.insert(stop, first[1:], False)
                first = (first + np.arange(len(first))).tolist()
                for i in range(chunk.rows):
                    a, b = first[i], first[i + 1]
                    stream.add(doc[chunk.lo + i], ids[a:b], stop[a:b])
                    if stream.held >= BLOCK_TOKENS:
                        yield sent()
        if stream.held:
            yield sent()

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema)
