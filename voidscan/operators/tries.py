"""Compacted tries as tables, prefix search and range location.

For distinct keys of w bits (w <= 60) in key order, lcp_i is the common prefix of neighbours, -1 at both ends.  The trie's extents are the keys
and the common prefixes; which ranks an extent covers, how deep its parent is, and its handle all follow from look-ups, so no node is ever
linked to another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscan.functions.bits import bit_length, bitlen, lcp, mask, two_fattest
from voidscan.operators.order import located, neighbours, ranked
from voidscan.plans.stage import staged


def _low(value: Column, n: Column, w: int) -> Column:
    """Least key of w bits with a prefix of n bits."""
    return F.call_function("shiftleft", value, (F.lit(w) - n).cast("int"))


def _high(value: Column, n: Column, w: int) -> Column:
    """Least number above all keys with the prefix."""
    return F.call_function("shiftleft", value + 1, (F.lit(w) - n).cast("int"))


def _head(k: Column, n: Column, w: int) -> Column:
    """First n bits of a key."""
    return F.call_function("shiftright", k, (F.lit(w) - n).cast("int"))


def adjacent_lcp(keys: DataFrame, w: int, key: str = "k") -> DataFrame:
    """(key, rank, lcp): common prefix with the key before; -1 for the first."""
    return neighbours(keys, key).select(key, "rank", F.when(F.col("prev").isNull(), -1).otherwise(lcp(F.col("prev"), key, w)).cast("int").alias("lcp"))


def nodes(keys: DataFrame, w: int, key: str = "k") -> DataFrame:
    """(extent, len, lo, hi, parent_depth, name_len, handle_len, handle, is_leaf): a row for each node, lo..hi the ranks below it.

    parent_depth is -1 for the root.
    """
    a = staged(adjacent_lcp(keys, w, key).withColumnRenamed(key, "k"))
    extents = a.select(F.col("k").alias("extent"), F.lit(w).alias("len")).unionByName(a.where("lcp >= 0").select(_head(F.col("k"), F.col("lcp"), w).alias("extent"), F.col("lcp").alias("len"))).distinct()
    e = extents.withColumns({"_l": _low(F.col("extent"), F.col("len"), w), "_h": _high(F.col("extent"), F.col("len"), w)})
    e = located(e, a, "_l", "k").select("extent", "len", "_h", F.col("below").alias("lo"))
    e = located(e, a, "_h", "k").select("extent", "len", "lo", F.col("below").alias("hi"))
    e = e.join(a.select(F.col("rank").alias("lo"), F.col("lcp").alias("_a")), "lo").join(a.select(F.col("rank").alias("hi"), F.col("lcp").alias("_b")), "hi", "left")
    parent = F.greatest("_a", F.coalesce("_b", F.lit(-1)))
    e = e.withColumn("parent_depth", parent).withColumn("handle_len", two_fattest(F.greatest("parent_depth", F.lit(0)), F.col("len")).cast("int"))
    return e.select("extent", "len", "lo", "hi", "parent_depth", (F.col("parent_depth") + 1).alias("name_len"), "handle_len",
                    F.call_function("shiftright", F.col("extent"), F.col("len") - F.col("handle_len")).alias("handle"), (F.col("len") == w).alias("is_leaf"))


def descriptors(trie: DataFrame) -> DataFrame:
    """(len, prefix, extent_len): handles with their extents' lengths, and pseudo-descriptors (extent_len null): the 2-fattest numbers between a
    node's parent and its handle."""
    a = F.greatest("parent_depth", F.lit(0))
    pseudo = F.filter(F.sequence(a + 1, F.col("handle_len") - 1), lambda x: two_fattest(a, x) == x)
    more = trie.where(F.col("handle_len") - 1 > a).select("extent", "len", F.explode(pseudo).alias("_f"))
    return trie.select(F.col("handle_len").alias("len"), F.col("handle").alias("prefix"), F.col("len").alias("extent_len")).unionByName(
        more.select(F.col("_f").cast("int").alias("len"), F.call_function("shiftright", F.col("extent"), F.col("len") - F.col("_f")).alias("prefix"), F.lit(None).cast("int").alias("extent_len"))).distinct()


def entry_counts(trie: DataFrame) -> DataFrame:
    """One row: all descriptors and true ones."""
    return descriptors(trie).agg(F.count("*").alias("entries"), F.count("extent_len").alias("true_entries"))


def deltas(trie: DataFrame) -> DataFrame:
    """True descriptors with what is stored of them: the extent's length beyond the descriptor's."""
    return descriptors(trie).where("extent_len is not null").withColumn("delta", F.col("extent_len") - F.col("len"))


def existing_prefix(trie: DataFrame, patterns: DataFrame, value: str = "p", n: str = "n") -> DataFrame:
    """patterns (p of n bits) with exit_len: one more than the longest extent that is a shorter prefix of the pattern (the root's counts as one);
    0 if the pattern is no longer than the root's extent.

    The keys on either side of the pattern say how far the trie agrees with it.  The node that agrees so far begins at the key after the pattern
    or ends with the one before; its parent's extent is the longest.
    """
    ends = F.broadcast(trie.agg(F.min(F.when(F.col("parent_depth") == -1, F.col("len"))).alias("_root"), F.max("len").alias("_w")).where("_root is not null"))  # one row
    p = patterns.join(ends).withColumn("_n", F.least(n, "_w"))
    p = p.withColumn("_low", F.call_function("shiftleft", F.call_function("shiftright", F.col(value), (F.col(n) - F.col("_n")).cast("int")), (F.col("_w") - F.col("_n")).cast("int")))
    p = located(p, trie.where("is_leaf").select(F.col("extent").alias("k")), "_low", "k")
    agrees = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.least(F.col("_w") - bitlen(F.col(c).bitwiseXOR(F.col("_low"))), F.col("_n"))).cast("int")
    p = p.withColumns({"_a": agrees("last"), "_b": agrees("next"), "_whole": (F.col(n) > F.col("_w")) & (F.col("next") == F.col("_low"))})
    p = p.withColumns({"_d": F.greatest("_a", "_b"), "_at": F.col("below") * 2 + (F.col("_a") > F.col("_b")).cast("int")})
    sides = trie.select(F.explode(F.array(F.col("lo") * 2, F.col("hi") * 2 + 1)).alias("_at"), F.col("parent_depth").alias("_up"), F.col("len").alias("_len"))
    out = p.alias("p").join(sides.alias("s"), (F.col("p._at") == F.col("s._at")) & (F.col("_up") < F.col("_d")) & (F.col("_d") <= F.col("_len")), "left")
    longest = F.when(F.col("_whole"), F.col("_w")).otherwise(F.coalesce("_up", F.lit(0)))
    return out.select(*[F.col(f"p.{c}") for c in patterns.columns], F.when(F.col("_root") >= F.col(n), 0).otherwise(F.greatest("_root", longest) + 1).cast("int").alias("exit_len"))


def exit_depth(keys: DataFrame, patterns: DataFrame, w: int, value: str = "p", key: str = "k") -> DataFrame:
    """patterns of w bits with depth: how far the closest key agrees; null without keys."""
    at = located(patterns, keys, value, key)
    return at.withColumn("depth", F.greatest(lcp(F.col("next"), value, w), lcp(F.col("last"), value, w)).cast("int")).drop("below", "upto", "next", "last")


def prefix_ranks(keys: DataFrame, prefixes: DataFrame, w: int, value: str = "p", n: str = "n", key: str = "k") -> DataFrame:
    """prefixes (p of n bits) with lo and hi, the ranks of the keys that have the prefix; lo = hi if none has."""
    e = prefixes.withColumns({"_l": _low(F.col(value), F.col(n), w), "_h": _high(F.col(value), F.col(n), w)})
    d = staged(keys.select(key).distinct())
    e = located(e, d, "_l", key).drop("upto", "next", "last").withColumnRenamed("below", "lo")
    return located(e, d, "_h", key).drop("upto", "next", "last", "_l", "_h").withColumnRenamed("below", "hi")


def text_prefix_ranks(keys: DataFrame, prefixes: DataFrame, prefix: str = "prefix", key: str = "key") -> DataFrame:
    """prefixes (text) with lo and hi, the ranks of the distinct texts that begin with it, in the order of their UTF-8 bytes."""
    d = staged(keys.select(F.encode(F.col(key), "utf-8").alias("k")).where("k is not null").distinct())
    e = prefixes.withColumns({"_l": F.encode(F.col(prefix), "utf-8"), "_h": F.concat(F.encode(F.col(prefix), "utf-8"), F.unhex(F.lit("FF")))})
    e = located(e, d, "_l", "k").drop("upto", "next", "last").withColumnRenamed("below", "lo")
    return located(e, d, "_h", "k").drop("upto", "next", "last", "_l", "_h").withColumnRenamed("below", "hi")


def contains_prefix(keys: DataFrame, prefixes: DataFrame, prefix: str = "prefix", key: str = "key") -> DataFrame:
    """prefixes with found: whether any key begins with it."""
    return text_prefix_ranks(keys, prefixes, prefix, key).withColumn("found", F.col("lo") < F.col("hi")).drop("lo", "hi")


def boundary_set(trie: DataFrame, w: int) -> DataFrame:
    """(value, nbits, leaf, rank): for each extent e the strings e without trailing zeros, e1, and the successor of e1 without trailing zeros
    (unless e is all ones), ordered as bit strings.  value is the string, left-aligned in w + 1 bits; leaf marks those of leaves."""
    e, n = F.col("extent"), F.col("len")
    whole = F.call_function("shiftleft", e, (F.lit(w + 1) - n).cast("int"))
    one = whole + F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(w) - n).cast("int"))
    after = F.call_function("shiftleft", e + 1, (F.lit(w + 1) - n).cast("int"))  # successor of e1: e + 1 and a zero
    ones = e == F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1
    cell = lambda v, b, leaf: F.struct(v.alias("value"), b.cast("int").alias("nbits"), leaf.alias("leaf"))
    cells = F.array(cell(whole, bit_length(whole, w + 1), F.col("is_leaf")), cell(one, n + 1, F.lit(False)))
    more = F.when(ones, F.array().cast("array<struct<value:bigint,nbits:int,leaf:boolean>>")).otherwise(F.array(cell(after, bit_length(after, w + 1), F.lit(False))))
    p = trie.select(F.inline(F.concat(cells, more))).groupBy("value", "nbits").agg(F.bool_or("leaf").alias("leaf"))
    return ranked(p, "value", "nbits")


def locate(trie: DataFrame, names: DataFrame, w: int, value: str = "p", n: str = "n") -> DataFrame:
    """names (p of n bits) with lo, hi and known: the leaf ranks below a node of the trie; the empty name has all.  A name that is no prefix of an
    extent between its parent and itself is unknown, with null ranks."""
    total = F.broadcast(trie.agg(F.max("hi").alias("_n")))  # one row
    named = trie.select(F.explode(F.sequence(F.greatest("name_len", F.lit(0)), "len")).alias(n), "extent", "len", "lo", "hi")
    named = named.select(n, F.call_function("shiftright", F.col("extent"), (F.col("len") - F.col(n)).cast("int")).alias(value), "lo", "hi")
    out = names.join(named, [value, n], "left").join(total)
    empty = F.col(n) == 0
    return out.select(*names.columns, F.when(empty, 0).otherwise(F.col("lo")).cast("long").alias("lo"), F.when(empty, F.col("_n")).otherwise(F.col("hi")).cast("long").alias("hi"), (empty | F.col("lo").isNotNull()).alias("known"))


def lower_bound(keys: DataFrame, patterns: DataFrame, value: str = "p", key: str = "k") -> DataFrame:
    """patterns with the least key at or after each, and its rank."""
    return located(patterns, keys.select(key).distinct(), value, key).withColumnRenamed("next", "bound").withColumnRenamed("below", "rank").drop("upto", "last")


def signatures(trie: DataFrame, bits: int) -> DataFrame:
    """trie with a signature of its handle, for comparison with approximate tries."""
    return trie.withColumn("signature", F.xxhash64("handle_len", "handle").bitwiseAND(F.lit(mask(bits))))


def in_order(trie: DataFrame, w: int) -> DataFrame:
    """trie with in_order and pre_order, the places of its nodes in either traversal; the root's empty extent comes first in order."""
    left = F.call_function("shiftleft", F.col("extent"), (F.lit(w + 1) - F.col("len")).cast("int"))
    mid = F.when(F.col("len") == 0, F.lit(-1).cast("long")).otherwise(left + F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(w) - F.col("len")).cast("int")))
    t = ranked(trie.withColumns({"_i": mid, "_p": left}), "_i", "len").withColumnRenamed("rank", "in_order")
    return ranked(t, "_p", "len").withColumnRenamed("rank", "pre_order").drop("_i", "_p")


def children(trie: DataFrame) -> DataFrame:
    """(parent_extent, parent_len, extent, len, branch): edges, by equality of ranks and depth; branch is the first bit below the parent."""
    up = trie.where("not is_leaf").select(F.col("extent").alias("parent_extent"), F.col("len").alias("parent_len"))
    down = trie.where("parent_depth >= 0").select("extent", "len", F.col("parent_depth").alias("parent_len"), F.call_function("shiftright", F.col("extent"), F.col("len") - F.col("parent_depth")).alias("parent_extent"),
                                                  F.call_function("shiftright", F.col("extent"), F.col("len") - F.col("parent_depth") - 1).bitwiseAND(F.lit(1)).cast("int").alias("branch"))
    return down.join(up, ["parent_extent", "parent_len"])


__all__ = ["adjacent_lcp", "boundary_set", "children", "contains_prefix", "deltas", "descriptors", "entry_counts", "existing_prefix", "exit_depth", "in_order", "locate", "lower_bound", "nodes", "prefix_ranks", "signatures", "text_prefix_ranks"]
