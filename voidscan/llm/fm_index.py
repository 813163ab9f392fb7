"""A compressed FM-index over integer symbols, asked for many patterns at once with numpy.

The Burrows-Wheeler transform of the text is a Huffman-shaped wavelet tree: a symbol takes as many bits as its Huffman code, so the tree
has about n * H0 bits (H0 the entropy of the symbols) and a rank walks H0 levels on average.  Ranks of bits are sampled every 64 bits.

Matching statistics come from one backward pass over a pattern: a match grows to the left by backward search, and where it can't, it
loses symbols at its right end, down to the next longer interval of suffixes (by the array of longest common prefixes).  All patterns
walk in lockstep, a step of each at a time.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Ones below each bit of a word.
_BELOW = (U(1) << np.arange(64, dtype=np.uint64)) - U(1)


class Bits:
    """A bit vector with O(1) rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        return self.before.take(w) + np.bitwise_count(self.words.take(w) & _BELOW.take(i & 63))


def huffman(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (their bits as a number) and code lengths of symbols that occur `count` times."""
    n = len(count)
    order = np.argsort(count, kind="stable")
    leaf, weight = count[order].tolist(), []
    below = np.zeros((max(n - 1, 1), 2), np.int64)  # children of each joined node; leaves are -1 - symbol
    a = b = 0  # the least of leaves and of joined nodes that have no parent yet
    for made in range(n - 1):
        total = 0
        for side in (0, 1):
            if a < n and (b >= made or leaf[a] <= weight[b]):
                total, below[made, side], a = total + leaf[a], -1 - order[a], a + 1
            else:
                total, below[made, side], b = total + weight[b], b, b + 1
        weight.append(total)
    code, length = np.zeros(n, np.int64), np.ones(n, np.int64)
    level, codes, depth = np.array([n - 2]), np.zeros(1, np.int64), 1
    while n > 1 and len(level):
        child, bits = below[level].reshape(-1), (codes[:, None] * 2 + np.arange(2)).reshape(-1)
        done = child < 0
        code[-1 - child[done]], length[-1 - child[done]] = bits[done], depth
        level, codes, depth = child[~done], bits[~done], depth + 1
    return code, length


class Wavelet:
    """Occurrences of a symbol before a position, by a Huffman-shaped wavelet tree.

    Nodes are numbered level by level, in the order of their codes; the bits of all nodes are one vector.  Symbols are 0..sigma-1.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        count = np.bincount(symbols, minlength=sigma)
        self.code, self.length = (x.astype(np.int32) for x in huffman(count))
        seq, size = symbols, np.array([len(symbols)])
        parts, starts, kids = [], [], []
        at = nodes = depth = 0
        while len(seq):
            depth += 1
            bit = ((self.code[seq] >> (self.length[seq] - depth)) & 1).astype(np.int64)
            parts.append(bit.astype(bool))
            first = np.cumsum(size) - size
            ones = np.concatenate([[0], np.cumsum(bit)])
            n1 = ones[first + size] - ones[first]
            pair = np.stack([size - n1, n1], 1)  # sizes of the children
            node = np.repeat(np.arange(len(size)), size)
            r1 = ones[:-1] - ones[first][node]
            rank = np.where(bit == 1, r1, np.arange(len(seq)) - first[node] - r1)
            child = 2 * node + bit
            keep = self.length[seq] > depth
            alive = np.zeros(2 * len(size), bool)
            alive[child[keep]] = True
            nodes += len(size)
            number = np.where(alive, nodes + np.cumsum(alive) - 1, -1)
            starts.append(first + at)
            kids.append(number.reshape(-1, 2))
            at += len(seq)
            size = pair.reshape(-1)[alive]
            begin = np.zeros(len(alive), np.int64)
            begin[alive] = np.cumsum(size) - size
            new = np.empty(int(size.sum()), seq.dtype)
            new[begin[child[keep]] + rank[keep]] = seq[keep]
            seq = new
        self.bits = Bits(np.concatenate(parts) if parts else np.zeros(0, bool))
        self.start = np.concatenate(starts).astype(np.int32) if starts else np.zeros(1, np.int32)
        self.kids = np.concatenate(kids).reshape(-1).astype(np.int32) if kids else np.zeros(2, np.int32)
        self.ones_before = self.bits.ones(self.start)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before each of the positions i; i: a row of positions for each bound, (bounds, symbols)."""
        out = np.empty_like(i)
        code, left = self.code.take(c), self.length.take(c)
        which, node = np.arange(len(c)), np.zeros(len(c), np.int32)
        while len(which):
            left = left - 1
            bit = (code >> left) & 1
            r1 = self.bits.ones(i + self.start.take(node)) - self.ones_before.take(node)
            i = np.where(bit, r1, i - r1)
            more = np.flatnonzero(left)
            if len(more) < len(which):
                done = np.flatnonzero(left == 0)
                out[:, which.take(done)] = i.take(done, 1)
                which, code, left, i, node, bit = which.take(more), code.take(more), left.take(more), i.take(more, 1), node.take(more), bit.take(more)
            node = self.kids.take(2 * node + bit)
        return out


def _sorted(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs (high, low), numbers of `bits` bits, and which pairs differ from the one before."""
    if 3 * bits <= 64:  # a pair and its place fit one number: sorting numbers is faster than finding their order
        key = np.sort((high.astype(np.uint64) << U(2 * bits)) | (low.astype(np.uint64) << U(bits)) | np.arange(len(high), dtype=np.uint64))
        return (key & U((1 << bits) - 1)).astype(np.int64), key[1:] >> U(bits) != key[:-1] >> U(bits)
    key = (high.astype(np.uint64) << U(32)) | low
    order = np.argsort(key)
    return order, key[order[1:]] != key[order[:-1]]


def suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols at least, by prefix doubling, and the longest common prefix of each with the one before.

    Symbols are small numbers.  The prefixes have an entry more than suffixes; the first and the last are -1.  They are exact up to `depth`.
    """
    n = len(text)
    bits = max(n, int(text.max(initial=0)) + 1).bit_length()
    levels = [text.astype(np.uint32) + np.uint32(1)]
    h, order = 1, np.zeros(n, np.int64)
    while h < depth:
        low = np.zeros(n, np.uint32)
        low[: n - h] = levels[-1][h:]
        order, differs = _sorted(levels[-1], low, bits)
        rank = np.empty(n, np.uint32)
        rank[order] = np.concatenate([[1], np.cumsum(differs) + 1])
        levels.append(rank)
        h *= 2
        if int(differs.sum()) == n - 1:
            break
    lcp = np.full(n + 1, -1, np.int16)
    if n > 1:
        a, b, size = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int16)
        for level in range(len(levels) - 1, -1, -1):
            padded = np.append(levels[level], np.uint32(0))
            same = (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
            step = 1 << level
            a, b = a + same * step, b + same * step
            size += (same * step).astype(np.int16)
        lcp[1:n] = size
    return order, lcp


class Least:
    """Smallest value of any range: sparse tables of ranges up to BLOCK, and of whole blocks."""

    BLOCK_LOG = 8

    def __init__(self, values: np.ndarray):
        self.near = self._table(values, self.BLOCK_LOG)
        starts = np.arange(0, len(values), 1 << self.BLOCK_LOG)
        self.far = self._table(np.minimum.reduceat(values, starts) if len(values) else values, 63)

    @staticmethod
    def _table(values: np.ndarray, most: int) -> np.ndarray:
        rows = [values]
        while len(rows) <= most and 1 << len(rows) <= len(values):
            half = 1 << (len(rows) - 1)
            row = values.copy()
            row[: len(values) - half] = np.minimum(rows[-1][:-half], rows[-1][half:])
            rows.append(row)
        return np.stack(rows)

    @staticmethod
    def _of(table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        return np.minimum(table[k, lo], table[k, hi - (np.int64(1) << k)])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo:hi]; every range has a value."""
        size = np.int64(1) << self.BLOCK_LOG
        wide = hi - lo > size
        if not wide.any():
            return self._of(self.near, lo, hi)
        out = np.empty(len(lo), self.near.dtype)
        out[~wide] = self._of(self.near, lo[~wide], hi[~wide])
        a, b = lo[wide], hi[wide]
        ends = np.minimum(self.near[self.BLOCK_LOG, a], self.near[self.BLOCK_LOG, b - size])
        x, y = -(-a // size), b // size
        some = y > x
        ends[some] = np.minimum(ends[some], self._of(self.far, x[some], y[some]))
        out[wide] = ends
        return out


class Reach:
    """How far a place may move while all values that it passes are at least d; values is -1 at both ends."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = [values]  # least of values[i : i + 2**k]
        while 1 << len(self.table) <= len(values):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[: len(last) - half], last[half:]))

    def down(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Greatest place up to `at` whose value is below d."""
        for k in range(len(self.table) - 1, -1, -1):
            to = at - (1 << k)
            ok = (to >= 0) & (self.table[k].take(np.maximum(to, -1) + 1, mode="clip") >= d)
            at = np.where(ok, to, at)
        return np.where(self.values[at] >= d, at - 1, at)

    def up(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Least place from `at` on whose value is below d."""
        for k in range(len(self.table) - 1, -1, -1):
            ok = (at < len(self.table[k])) & (self.table[k].take(at, mode="clip") >= d)
            at = np.where(ok, at + (1 << k), at)
        return at


class FMIndex:
    """Index of several pieces of text, each owned by a number.

    pieces: symbols of all pieces, one after the other; first: where each begins (one more entry than pieces).  Matches of up to `depth`
    symbols are exact.
    """

    def __init__(self, pieces: np.ndarray, first: np.ndarray, owner: np.ndarray, depth: int):
        size = np.diff(first)
        self.base = first[:-1] + np.arange(len(size))
        self.alphabet, dense = np.unique(pieces, return_inverse=True)
        sigma = len(self.alphabet) + 1
        text = np.zeros(len(pieces) + len(size), np.int64)  # 0 ends each piece
        text[np.arange(len(pieces)) + np.repeat(np.arange(len(size)), size)] = dense + 1
        self.text = text
        order, lcp = suffixes(text, depth)
        self.reach = Reach(lcp)
        self.wavelet = Wavelet(text[order - 1], sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1].astype(np.int32)
        self.least = Least(np.repeat(owner, size + 1)[order])

    def matches(self, piece: np.ndarray, size: np.ndarray, limit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in `piece`, start, end): maximal intervals of at least `least` symbols of the given pieces that a piece of an owner below `limit` holds.

        The matching statistic of an end is the longest match that ends there; an interval is given for each end where it has a start of its own.
        """
        n = len(self.text)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(size >= least)
        base, most = self.base[piece[live]], limit[live]
        end = size[live].copy()
        at = end.copy()
        lo, hi = np.zeros(len(live), np.int32), np.full(len(live), n, np.int32)
        while len(live):
            c = self.text[base + np.maximum(at - 1, 0)]
            both = self.wavelet.rank(c, np.stack([lo, hi])) + self.below[c]
            good = (both[1] > both[0]) & (at > 0)
            some = np.flatnonzero(good)
            good[some] = self.least.of(both[0][some], both[1][some]) < most[some]
            lo[good], hi[good] = both[0][good], both[1][good]
            at[good] -= 1
            stuck = np.flatnonzero(~good)
            if not len(stuck):
                continue
            held = end[stuck] - at[stuck]
            hit = held >= least
            found.append((live[stuck[hit]], at[stuck[hit]], end[stuck[hit]]))
            # the next longer interval of suffixes: that of the longest prefix which more suffixes share
            d = np.maximum(self.reach.values[lo[stuck]], self.reach.values[hi[stuck]]).astype(np.int64)
            d = np.minimum(np.maximum(d, 0), np.maximum(held - 1, 0))
            whole = d == 0
            step = stuck[~whole]
            lo[step] = self.reach.down(lo[step], d[~whole])
            hi[step] = self.reach.up(hi[step], d[~whole])
            lo[stuck[whole]], hi[stuck[whole]] = 0, n
            at[stuck] -= held == 0  # a symbol that nobody holds
            end[stuck] = at[stuck] + d
            over = np.zeros(len(live), bool)
            over[stuck] = (at[stuck] <= 0) | (end[stuck] < least)
            if over.any():
                go = ~over
                live, base, most, end, at, lo, hi = live[go], base[go], most[go], end[go], at[go], lo[go], hi[go]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))
