"""Bit operations on keys.

Two forms of a key:

- an integer of `w` bits, w <= 63, in a BIGINT column: bit 0 is the most significant, so numeric order is the order of the bits
- a bit string, a struct (bytes BINARY, nbits INT): bit 0 is the top bit of the first byte, unused bits are 0.  `ORDER BY bytes, nbits` is
  then lexicographic by bit with the shorter of equal prefixes first

Functions of integers take the width.  Bit strings of any length are handled through text of 0 and 1 (`text_of`, `from_text`), all of it
in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = Column | str


def _c(x: C | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int) else F.col(x)


def mask(w: int) -> int:
    """w ones."""
    return (1 << w) - 1


# ---- integers of w bits


def bitlen(x: C) -> Column:
    """Bits that x >= 0 needs; 0 needs none."""
    x = _c(x)
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def most_significant_bit(x: C) -> Column:
    """Index of the top bit from the right; -1 for 0."""
    return bitlen(x) - 1


def trie_key(x: C, w: int) -> Column:
    """The low w bits of a number."""
    return _c(x).bitwiseAND(F.lit(mask(w)))


def add(a: C, b: C, w: int) -> Column:
    """Modular sum."""
    return (_c(a) + _c(b)).bitwiseAND(F.lit(mask(w)))


def sub(a: C, b: C, w: int) -> Column:
    """Modular difference."""
    return (_c(a) - _c(b)).bitwiseAND(F.lit(mask(w)))


def prefix(x: C, n: int, w: int) -> Column:
    """First n bits."""
    return F.shiftrightunsigned(_c(x), w - n)


def suffix(x: C, n: int) -> Column:
    """Last n bits."""
    return _c(x).bitwiseAND(F.lit(mask(n)))


def drop_first(x: C, t: int, w: int) -> Column:
    """Without the first t bits; 0 if there are no more."""
    return _c(x).bitwiseAND(F.lit(mask(max(0, w - t))))


def bit_range(x: C, start: int, count: int, w: int) -> Column:
    """`count` bits from `start`, with zeros beyond the end."""
    over = max(0, start + count - w)
    return F.shiftleft(F.shiftrightunsigned(_c(x), w - start - count + over).bitwiseAND(F.lit(mask(count - over))), over)


def bit_at(x: C, i: C | int, w: int) -> Column:
    """Bit i, 0 the first."""
    return F.getbit(_c(x), F.lit(w - 1) - _c(i))


def append_bit(x: C, bit: C | int) -> Column:
    return F.shiftleft(_c(x), 1).bitwiseOR(_c(bit).cast("long"))


def lcp(a: C, b: C, w: int) -> Column:
    """Length of the common prefix."""
    return F.lit(w) - bitlen(_c(a).bitwiseXOR(_c(b)))


def has_prefix(x: C, p: C, n: int, w: int) -> Column:
    """Whether the n bits of p begin x."""
    return prefix(x, n, w) == _c(p)


def all_ones(x: C, w: int) -> Column:
    return (_c(x) == mask(w)) if w else F.lit(False)


def all_zeros(x: C) -> Column:
    return _c(x) == 0


def successor(x: C, w: int) -> Column:
    """The next number; all ones become 1 followed by w zeros (a bit more)."""
    return _c(x) + 1


def predecessor(x: C) -> Column:
    """The number before; 0 stays."""
    return F.greatest(_c(x) - 1, F.lit(0))


def bit_length(x: C, w: int) -> Column:
    """Index of the last set bit, counted from the first, plus 1; 0 if there is none."""
    x = _c(x)
    return F.when(x == 0, F.lit(0)).otherwise(F.lit(w + 1) - bitlen(x.bitwiseAND(-x)))


def trim_trailing_zeros(x: C) -> Column:
    """Without the zeros after the last one bit."""
    x = _c(x)
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", x.cast("long"), bitlen(x.bitwiseAND(-x)) - 1))


def two_fattest(a: C, b: C) -> Column:
    """The number in (a, b] with the most trailing zeros; 0 if a = b."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    x = a.bitwiseXOR(b)
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.expr("-1L").bitwiseAND(b) - b.bitwiseAND(_below_top(x)))


def _below_top(x: Column) -> Column:
    """Ones below the top bit of x > 0."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bitlen(x) - 1) - 1


def hashed(*x: C) -> Column:
    return F.xxhash64(*[_c(v) for v in x])


def hashed_with_seed(seed: int, *x: C) -> Column:
    return F.xxhash64(F.lit(seed), *[_c(v) for v in x])


#: A prime, and odd numbers below it that the multipliers of the universal hash come from.
_PRIME = 2**31 - 1


def universal(x: C, i: int) -> Column:
    """The i-th hash of a family for integers of 64 bits: a linear form of their three parts of 22, 21 and 21 bits, modulo 2**31 - 1.

    Plain arithmetic, the same in any SQL engine, and two keys meet with probability 2**-31.
    """
    x, part = _c(x), lambda n: (i * 7919 + n * 104729 + 1) * 48271**3 % _PRIME
    high, middle, low = F.shiftrightunsigned(x, 42), F.shiftrightunsigned(x, 21).bitwiseAND(F.lit(mask(21))), x.bitwiseAND(F.lit(mask(21)))
    return (high * part(1) + middle * part(2) + low * part(3) + part(4)) % _PRIME


def universal_sql(x: str, i: int) -> str:
    """universal for x >= 0 in other engines' SQL."""
    part = lambda n: (i * 7919 + n * 104729 + 1) * 48271**3 % _PRIME
    return f"((({x}) >> 42) * {part(1)} + ((({x}) >> 21) & {mask(21)}) * {part(2)} + (({x}) & {mask(21)}) * {part(3)} + {part(4)}) % {_PRIME}"


def pretty(x: C, w: int) -> Column:
    """Text of 0 and 1."""
    return F.lpad(F.bin(_c(x)), w, "0") if w else F.lit("")


def pack(values: C) -> Column:
    """A fixed-width array: Parquet packs the bits of integers on disk, so the array is the packed form."""
    return F.array_sort(F.collect_list(_c(values)))


def unpack(packed: C, i: C | int) -> Column:
    """The i-th packed value, 0 the first."""
    return F.get(_c(packed), _c(i))


def set_packed(packed: C, i: int, value: C | int) -> Column:
    """The array with its i-th value replaced."""
    return F.transform(_c(packed), lambda v, k: F.when(k == i, _c(value)).otherwise(v))


def first_error(*checks: C) -> Column:
    """The first message that is not null."""
    return F.coalesce(*[_c(c) for c in checks])


def check_increasing(df: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """(key, problem): rows out of order within each partition's order of `pos`; empty if all is well.

    df needs a column `pos`.  strict: equal neighbours are a problem too.
    """
    before = F.lag(key).over(Window.partitionBy(F.col("shard") if "shard" in df.columns else F.lit(0)).orderBy("pos"))
    bad = before >= F.col(key) if strict else before > F.col(key)
    return df.withColumn("problem", F.when(bad, F.concat(F.lit("not after "), before.cast("string")))).where(F.col("problem").isNotNull()).select(key, "problem")


# ---- bit strings of any length


def from_text(t: C) -> Column:
    """Bit string of a text of 0 and 1; another character raises an error."""
    t = _c(t)
    n = F.length(t)
    whole = F.rpad(t, F.ceil(n / 8).cast("int") * 8, F.lit("0"))
    bytes_ = F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(n / 8).cast("int") - 1), lambda i: F.lpad(F.conv(F.substr(whole, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), "")
    ok = F.when(~t.rlike("^[01]*$"), F.raise_error(F.concat(F.lit("not a bit: "), t)).cast("binary")).otherwise(F.when(n == 0, F.unhex(F.lit(""))).otherwise(F.unhex(bytes_)))
    return F.struct(ok.alias("bytes"), n.alias("nbits"))


def from_bytes(data: C, n: C | int) -> Column:
    """Bit string of the first n bits of some bytes; what lies beyond them is zeroed, missing bytes are zeros."""
    data, n = _c(data), _c(n)
    text = F.array_join(F.transform(F.split(F.hex(data), ""), lambda d: F.when(d == "", "").otherwise(F.lpad(F.conv(d, 16, 2), 4, "0"))), "")
    return from_text(F.rpad(F.substr(text, F.lit(1), n), n, F.lit("0")))


def text_of(x: C) -> Column:
    """Text of 0 and 1 of a bit string."""
    x = _c(x)
    digits = F.array_join(F.transform(F.split(F.hex(x["bytes"]), ""), lambda d: F.when(d == "", "").otherwise(F.lpad(F.conv(d, 16, 2), 4, "0"))), "")
    return F.substr(digits, F.lit(1), x["nbits"])


def from_string(s: C) -> Column:
    """All bits of a text's UTF-8; byte order is that of the bytes."""
    b = F.encode(_c(s), "utf-8")
    return F.struct(b.alias("bytes"), (F.length(b) * 8).alias("nbits"))


def from_string_low_first(s: C) -> Column:
    """All bits of a text's UTF-8, each byte from its lowest bit on."""
    pairs = F.transform(F.split(F.hex(F.encode(_c(s), "utf-8")), "(?<=\\G..)"), lambda h: F.when(h == "", "").otherwise(F.reverse(F.lpad(F.conv(h, 16, 2), 8, "0"))))
    return from_text(F.array_join(pairs, ""))


def from_long(x: C, w: int) -> Column:
    """w bits of a number, the most significant first."""
    return from_text(pretty(x, w))


def to_long(x: C) -> Column:
    """The first 63 bits as a number."""
    return F.conv(F.concat(F.lit("0"), F.substr(text_of(x), F.lit(1), F.lit(63))), 2, 10).cast("long")


def text_lcp(a: C, b: C) -> Column:
    """Length of the common prefix of two texts of bits."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    equal = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(equal, F.lit(0)) - 1, n))


def text_successor(t: C) -> Column:
    """+1 at the same length; all ones become 1 and as many zeros; empty becomes 1."""
    t = _c(t)
    return F.when(~t.contains("0"), F.rpad(F.lit("1"), F.length(t) + 1, F.lit("0"))).otherwise(
        F.rpad(F.concat(F.regexp_extract(t, "^(.*)01*$", 1), F.lit("1")), F.length(t), F.lit("0")))


def text_predecessor(t: C) -> Column:
    """-1 at the same length; all zeros and empty stay."""
    t = _c(t)
    return F.when(~t.contains("1"), t).otherwise(F.rpad(F.concat(F.regexp_extract(t, "^(.*)10*$", 1), F.lit("0")), F.length(t), F.lit("1")))


def text_trimmed(t: C) -> Column:
    """Without trailing zeros."""
    return F.regexp_replace(_c(t), "0+$", "")


def trie_order(t: C) -> Column:
    """Sort key of in-order traversal: a text comes before its extensions by 1 and after those by 0; the empty text is first."""
    t = _c(t)
    return F.when(t == "", F.lit("")).otherwise(F.concat(t, F.lit("1")))


def text_word(t: C, i: int) -> Column:
    """The i-th run of 64 bits."""
    return F.substr(_c(t), F.lit(64 * i + 1), F.lit(64))


# ---- words of a packed bit vector (bit 0 the lowest)


def word_rank(word: C, i: C | int) -> Column:
    """Set bits among the lowest i of a word, 0 <= i <= 63."""
    return F.bit_count(_c(word).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), _c(i).cast("int")) - 1))


def word_select(word: C, r: C | int) -> Column:
    """Place of the (r + 1)-th set bit of a word; null if it has no more."""
    w = _c(word)
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(w, i) == 1), _c(r))


def word_zero_run(word: C, i: C | int) -> Column:
    """Zeros of a word from place i up to the next set bit, or to the end."""
    w, at = _c(word), _c(i)
    return F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: (j >= at) & (F.getbit(w, j) == 1)), F.lit(0)) - at, F.lit(64) - at)


# ---- lists and maps


def mapped(values: C, f) -> Column:
    """f of each element of an array."""
    return F.transform(_c(values), f)


def mapped_keys(m: C, f) -> Column:
    return F.transform(F.map_keys(_c(m)), f)


def mapped_values(m: C, f) -> Column:
    return F.transform(F.map_values(_c(m)), f)


def mapped_entries(m: C, f) -> Column:
    """f of (key, value) of each entry."""
    return F.transform(F.map_entries(_c(m)), lambda e: f(e["key"], e["value"]))
