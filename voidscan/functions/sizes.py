"""Parameters and size models of the filters, as plain numbers and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = (8, 16, 32, 64)


def ceil_log2(x: float) -> int:
    """Least k >= 0 with 2**k >= x."""
    if x <= 1:
        return 0
    k = math.ceil(math.log2(x))
    while k > 0 and 2.0 ** (k - 1) >= x:
        k -= 1
    return k + 1 if 2.0**k < x else k


def trunc_bits(n: int, eps: float) -> int:
    return max(1, ceil_log2(2 * n / eps))


def soda_bits(n: int, length: int, eps: float) -> int:
    k = ceil_log2(n * length / eps)
    if k > 64:
        raise ValueError(f"{k} bits are asked for; at most 64 are possible")
    return k


def adaptive_bits(n: int, length: int, eps: float, t: int = 0) -> int:
    k = ceil_log2(n * ((length >> t) + 1) / eps)
    if k > 64:
        raise ValueError(f"{k} bits are asked for; at most 64 are possible")
    return k


def hybrid_bits(n: int, length: int, eps: float) -> int:
    return min(64, ceil_log2(n * (length + 1) / eps))


def budget_bits(bits_per_key: float) -> int:
    return min(64, max(1, math.ceil(bits_per_key)))


def scan_eps(n: int, length: int, k: int, multiplier: float = 10.0) -> int:
    """Neighbourhood radius of density segmentation for a filter of k bits."""
    eps = n * (length + 1) / 2.0**k
    if not 0 < eps <= 1:
        eps = 0.01
    return int(length / eps * multiplier)


def block_bits(n: int) -> int:
    """log2 of the number of blocks of n keys."""
    return max(1, n.bit_length() - 1) if n else 1


def exact_bits(n: int, w: int) -> int:
    """Size model of the exact index: occupancy, counts, and suffixes."""
    if n == 0:
        return 0
    k = min(w, block_bits(n))
    return (1 << k) + n + (1 << k) + n * (w - k)


def exact_bits_column(n: Column, w: Column) -> Column:
    """exact_bits of columns."""
    k = F.least(w, F.greatest(F.lit(1), F.length(F.bin(F.greatest(n, F.lit(1)))) - 1))
    blocks = F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(blocks + n + blocks + n * (w - k))


def point_rate(eps: float, length: int) -> float:
    """Error per point that gives eps for intervals of `length` points."""
    return 1 - (1 - eps) ** (1 / length)


def cdf_bits(knots: int) -> int:
    """Size of a piecewise-linear map: 128 bits for each knot."""
    return 128 * knots


def bloom_shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter of n entries."""
    m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return m, max(1, round(m / max(1, n) * math.log(2)))


def width_for_max(v: int) -> int:
    """Least of 8, 16, 32 and 64 bits that hold v."""
    return next(w for w in WIDTHS if v < 1 << w)


def width_for_count_with_sentinel(count: int) -> int:
    return width_for_max(count)


def width_for_bit_length(bits: int) -> int:
    return width_for_max(bits)


def width_column(v: Column) -> Column:
    return F.when(v < 1 << 8, 8).when(v < 1 << 16, 16).when(v < 1 << 32, 32).otherwise(64)


def bucket_count(n: int, size: int) -> int:
    return -(-n // size)


def delimiter_nodes(m: int) -> int:
    """Most nodes of a trie of m delimiters."""
    return 2 * m


def width_for_delimiters(m: int) -> int:
    return width_for_max(delimiter_nodes(m))


def signature_bits(w: int, eps: float) -> int:
    return max(1, math.ceil(math.log2(math.log2(w)) + math.log2(1 / eps)))


def relative_signature_bits(w: int, n: int, m: int) -> int:
    return signature_bits(w, m / n)


def width_candidates(s: int) -> list[int]:
    return [w for w in WIDTHS if w >= s]


def theory_false_positive(w: int, s: int) -> float:
    """Chance that one of the log2(w) comparisons of a search meets a false signature of s bits."""
    return 1.0 - (1.0 - 2.0**-s) ** max(1, math.ceil(math.log2(max(2, w))))


def theory_build_success(n: int, w: int, s: int, attempts: int = 100) -> float:
    """Chance that one of several independent builds has no false search among n keys."""
    return 1.0 - (1.0 - (1.0 - theory_false_positive(w, s)) ** n) ** attempts
