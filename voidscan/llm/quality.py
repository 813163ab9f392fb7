"""Quality rules: counts of a text, fixed limits, and robust multivariate outliers by language and source.

Every text becomes a vector of transformed statistics.  For each language and source the minimum-covariance-determinant estimate is the mean and
covariance of the `share` of rows whose covariance has the least determinant, sought from several starts:

1. From `sample` rows of each group, by hash, many random starts are concentrated in memory, and the `starts` best ones go on.
2. Each is concentrated over all rows of the group: the nearest `share` of rows by Mahalanobis distance give the next mean and covariance, until no
   determinant falls any more.  A step is a mergeable quantile and a few sums per group, so a group that holds a third of all rows is
   summed up in parts, and no group is gathered anywhere.
3. The start of the least determinant over all rows is the group's estimate.

A group's estimate is drawn towards the medians and quartiles of its language, and those towards the ones of all rows, each with the weight of `prior` rows;
so a group of three rows has a verdict as a group of a billion has, and no size switches the rule.  Rows beyond a chi-square quantile of the distance
are rejected.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voidscan.llm import textkit as tk
from voidscan.llm.frames import batches, own, schema_of, written
from voidscan.llm.line_dedup import lines

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = 5
#: Units of the transformed statistics: no direction has a variance below 1 in them, so tight groups don't reject ordinary spread.  Each is small
#: enough that its statistic alone can pass the limit: shares of equal lines and repeated words do from some 37 % on in a group without any.
FLOOR = (0.5, 0.12, 0.6, 0.8, 0.8)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct (row, hash) pairs, and how often each occurs."""
    _, inverse, count = np.unique(tk.mix(h + row.astype(np.uint64) * tk.U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    return inverse, count


def counted(chunk: tk.Chunk) -> dict[str, np.ndarray]:
    """The counts of each row of a chunk, and its lines with a word."""
    w = tk.words(chunk)
    solid = ~tk.BLANK[chunk.data] & ((chunk.data & 0xC0) != 0x80)
    begin, end, first, kb, ke = lines(chunk)
    some = ke > kb
    row = np.repeat(np.arange(chunk.rows), np.diff(first))[some]
    inverse, count = _distinct(row, tk.Spans(tk.byte_codes(chunk.data)).hash(begin, end)[some])
    n_lines = np.bincount(row, minlength=chunk.rows)
    distinct = np.zeros(len(count), np.int64)
    distinct[inverse] = row
    g, bounds = tk.grams(w.hash, w.first, 3)
    grow = np.repeat(np.arange(chunk.rows), np.diff(bounds))
    inverse, count3 = _distinct(grow, g)
    again = np.flatnonzero(count3[inverse] > 1) if len(g) else np.zeros(0, np.int64)
    at = w.first[grow[again]] + again - bounds[grow[again]]
    return {
        "n_words": np.diff(w.first), "word_chars": tk.span_sums(solid, chunk.starts), "n_symbols": tk.span_sums(_SYMBOL[chunk.data], chunk.starts),
        "n_dup_lines": n_lines - np.bincount(distinct, minlength=chunk.rows), "n_repeat_words": tk.span_sums(tk.covered(at, at + 3, len(w.start)), w.first), "n_lines": n_lines,
    }


def statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of docs, without their text, and the counts of their text."""
    names = [c for c in docs.columns if c != text_col]

    def rows(it):
        for batch in it:
            got = [counted(c) for c in tk.chunks(tk.column(batch, text_col))]
            cat = lambda k: pa.array(np.concatenate([x[k] for x in got]).astype(np.int64) if got else [], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [tk.column(batch, c) for c in names] + [cat(k) for k in COUNTS] + [cat("n_lines")], names=[*names, *COUNTS, "__lines"])

    return docs.mapInArrow(rows, schema_of(docs.drop(text_col), *[(k, T.LongType()) for k in (*COUNTS, "__lines")]))


def vector() -> list[Column]:
    """Transformed statistics: length, word length, and shares of symbols, equal lines and repeated words, in logarithms."""
    n = F.greatest("n_words", F.lit(1))
    share = lambda c, of: F.log1p(100.0 * F.col(c) / of)
    return [F.log(n), F.log(F.greatest("word_chars", F.lit(1)) / n), share("n_symbols", n), share("n_dup_lines", F.greatest("__lines", F.lit(1))), share("n_repeat_words", n)]


def chi_square(p: float, dim: int) -> float:
    """Quantile of the chi-square distribution, by bisection of the regularised gamma series."""

    def below(x: float) -> float:
        a, t = dim / 2, x / 2
        term = total = 1 / a
        k = 0
        while term > 1e-17 * total:
            k += 1
            term *= t / (a + k)
            total += term
        return total * math.exp(-t + a * math.log(t) - math.lgamma(a))

    lo, hi = 1e-9, 200.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def consistency(share: float, dim: int) -> float:
    """Factor that makes the covariance of the nearest `share` of normal rows that of all."""
    q = chi_square(share, dim)
    lo, hi = 0.0, 1.0
    for _ in range(50):  # P(chi-square of dim + 2 <= q), by its inverse
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dim + 2) < q else (lo, mid)
    return share / hi


_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_NAMES = [*[f"m{i}" for i in range(DIM)], *[f"p{i}{j}" for i, j in _PAIRS]]
_MODEL = "group string, start int, n long, logdet double, " + ", ".join(f"{n} double" for n in _NAMES)


def floored(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariances, and logarithms of their determinants, with no variance below 1 in any direction in units of FLOOR."""
    unit = np.array(FLOOR)
    value, vector_ = np.linalg.eigh(cov / unit / unit[:, None])
    value = np.maximum(value, 1.0)
    return (vector_ * value[..., None, :]) @ np.swapaxes(vector_, -1, -2) * unit * unit[:, None], np.log(value).sum(-1)


def concentrated(x: np.ndarray, share: float, factor: float, models: tuple, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concentration steps over rows in memory, of several models (mean, inverse, logdet) at once, until no determinant falls."""
    h = max(1, math.ceil(share * len(x)))
    products = np.stack([x[:, i] * x[:, j] for i, j in _PAIRS], 1)
    mean, inverse, logdet = models
    for _ in range(most):
        c = x - mean[:, None]
        d = ((c @ inverse) * c).sum(2)
        near = (d <= np.partition(d, h - 1, axis=1)[:, h - 1: h]).astype(float)
        new = _of_sums(near.sum(1), near @ x, near @ products, factor)
        falls = new[2] < logdet - 1e-12
        mean, inverse, logdet = (np.where(falls.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in zip(new, (mean, inverse, logdet)))
        if not falls.any():
            break
    return mean, inverse, logdet


def _of_sums(n: np.ndarray, s: np.ndarray, products: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, inverse covariances and log-determinants of some sets of rows, from their numbers and sums."""
    mean = s / n[:, None]
    second = np.zeros((len(n), DIM, DIM))
    for k, (i, j) in enumerate(_PAIRS):
        second[:, i, j] = second[:, j, i] = products[:, k] / n
    cov, logdet = floored((second - mean[:, :, None] * mean[:, None, :]) * factor)
    return mean, np.linalg.inv(cov), logdet


def searched(x: np.ndarray, share: float, factor: float, starts: int, draws: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The `starts` best estimates of rows in memory, from medians and quartiles and from `draws` random sets of DIM + 1 rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    mean, inverse = mid[None], np.diag(1 / np.maximum(((high - low) / 1.349) ** 2, np.square(FLOOR)))[None]
    if len(x) > DIM + 1:
        sets = x[np.argsort(rng.random((draws, len(x))), axis=1)[:, : DIM + 1]]
        drawn_ = _of_sums(np.full(draws, DIM + 1.0), sets.sum(1), np.stack([(sets[:, :, i] * sets[:, :, j]).sum(1) for i, j in _PAIRS], 1), factor)
        mean, inverse = np.concatenate([mean, drawn_[0]]), np.concatenate([inverse, drawn_[1]])
    short = concentrated(x, share, factor, (mean, inverse, np.full(len(mean), np.inf)), 2)
    few = np.argsort(short[2], kind="stable")[:10]
    mean, inverse, logdet = concentrated(x, share, factor, tuple(m[few] for m in short), 200)
    order = np.argsort(logdet, kind="stable")
    return [(mean[k], inverse[k], float(logdet[k])) for i, k in enumerate(order) if i == 0 or logdet[k] > logdet[order[i - 1]] + 1e-9][:starts]


def _table(group: list, start: list, n: list, models: list) -> pa.RecordBatch:
    cell = lambda k: pa.array(np.array(k, np.float64))
    return pa.RecordBatch.from_arrays(
        [pa.array(group, pa.string()), pa.array(start, pa.int32()), pa.array(n, pa.int64()), cell([m[2] for m in models]), *[cell([m[0][i] for m in models]) for i in range(DIM)],
         *[cell([m[1][i, j] for m in models]) for i, j in _PAIRS]], names=["group", "start", "n", "logdet", *_NAMES])


def _matrix(t, prefix: str) -> np.ndarray:
    out = np.zeros((t.num_rows, DIM, DIM))
    for i, j in _PAIRS:
        out[:, i, j] = out[:, j, i] = np.asarray(t.column(f"{prefix}{i}{j}"))
    return out


def _vector(t, prefix: str) -> np.ndarray:
    return np.stack([np.asarray(t.column(f"{prefix}{i}")) for i in range(DIM)], 1).reshape(-1, DIM)


def _stepped(factor: float):
    """From sums of a group and a start to its next estimate."""

    def rows(it):
        for t in it:
            sums = np.stack([np.asarray(t.column(f"s{i}{j}")) for i, j in _PAIRS], 1).reshape(-1, len(_PAIRS))
            found = _of_sums(np.asarray(t.column("n")).astype(float), _vector(t, "s"), sums, factor)
            yield _table(t.column("group").to_pylist(), t.column("start").to_pylist(), t.column("n").to_pylist(), list(zip(*found)))

    return rows


def distance() -> Column:
    total = None
    for i in range(DIM):
        for j in range(i, DIM):
            part = (1 if i == j else 2) * F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
            total = part if total is None else total + part
    return total


def bounded(groups: DataFrame, rows: int, most: int = 20_000) -> DataFrame:
    """A table of `rows` rows about groups, to be broadcast if these are `most` at most (some 5 MB); else joined as Spark sees fit.  Without a
    shuffle of the data a hot group stays spread over tasks, and what follows sums it up in parts."""
    return F.broadcast(groups) if rows <= most else groups


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """`most` rows of each group, the first by hash; each task sends `most` of a group at most."""
    order = Window.partitionBy("group").orderBy("at", *[f"x{i}" for i in range(DIM)])
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def covariance_estimates(rows: DataFrame, share: float, sample: int, starts: int, steps: int) -> DataFrame:
    """(group, n, mean, inverse covariance): the minimum covariance determinant of rows (group, at, x0..x4) by group."""
    x, factor = [f"x{i}" for i in range(DIM)], consistency(share, DIM)

    def begin(key, t):
        found = searched(_vector(t, "x"), share, factor, starts, 50, zlib.crc32(key[0].as_py().encode()))
        return pa.Table.from_batches([_table([key[0].as_py()] * len(found), list(range(len(found))), [t.num_rows] * len(found), found)])

    model = written(sampled(rows, sample).select("group", *x).groupBy("group").applyInArrow(begin, _MODEL).withColumn("logdet", F.lit(math.inf)))
    step, many = _stepped(factor), model.count()
    for _ in range(steps):
        near = rows.select("group", *x).join(bounded(model.drop("n", "logdet"), many), "group").select("group", "start", *x, distance().alias("d"))
        bound = written(near.groupBy("group", "start").agg(F.percentile_approx("d", share, 5000).alias("bound")))
        sums = near.join(bounded(bound, many), ["group", "start"]).where("d <= bound").groupBy("group", "start").agg(
            F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS])
        new = written(sums.mapInArrow(step, _MODEL))
        falls = new.select("group", "start", "logdet").join(model.select("group", "start", F.col("logdet").alias("before")), ["group", "start"]).where(F.col("before") - F.col("logdet") > 1e-6)
        model = new
        if falls.isEmpty():
            break
    best = model.groupBy("group").agg(F.min_by(F.struct(*_NAMES), F.struct("logdet", "start")).alias("best"))
    return best.join(rows.groupBy("group").agg(F.count("*").alias("n")), "group").select("group", "n", "best.*")


def centres(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, q0..q4): rows and quartiles of each statistic."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIM)])


def drawn(model: DataFrame, rows: DataFrame, prior: float) -> DataFrame:
    """(group, mean, inverse covariance): estimates drawn towards the language's centre, and that towards the centre of all rows."""
    flat = lambda t, by: t.select(*by, F.col("n").alias("n" + t_), *[F.col(f"q{i}")[1].alias(f"{t_}m{i}") for i in range(DIM)], *[
        F.greatest(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2, F.lit(FLOOR[i] ** 2)).alias(f"{t_}v{i}") for i in range(DIM)])
    t_ = "a"
    every = flat(centres(rows), ())  # one row
    t_ = "b"
    langs = flat(centres(rows, "pool"), ("pool",))
    wide = model.join(rows.select("group", "pool").distinct(), "group").join(langs, "pool").join(F.broadcast(every))

    def run(it):
        for t in it:
            pull = lambda n: (np.asarray(t.column(n)) / (np.asarray(t.column(n)) + prior))[:, None]  # noqa: B023, E731
            w = pull("nb")
            centre, spread = w * _vector(t, "bm") + (1 - w) * _vector(t, "am"), w * _vector(t, "bv") + (1 - w) * _vector(t, "av")
            w = pull("n")
            mean = w * _vector(t, "m") + (1 - w) * centre
            cov, logdet = floored(w[:, :, None] * np.linalg.inv(_matrix(t, "p")) + (1 - w)[:, :, None] * spread[:, :, None] * np.eye(DIM))
            yield _table(t.column("group").to_pylist(), [0] * t.num_rows, t.column("n").to_pylist(), list(zip(mean, np.linalg.inv(cov), logdet)))

    return wide.mapInArrow(run, _MODEL).select("group", *_NAMES)


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, sample: int = 500, starts: int = 2, steps: int = 12, beyond: float = 1e-3, prior: float = 20.0, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of docs, without their text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance and kept.

    base_failed: fewer than `min_words` words, or more than `max_repeat_percent` % of them in 3-word windows that occur twice or more.
    kept: not base_failed, and the squared Mahalanobis distance within the chi-square quantile that normal rows exceed with probability
    `beyond`.  distance is null where base_failed.  A null or empty text has counts of 0 and fails.  Null languages and sources are groups of
    their own.  Ids count only for the choice of the sample that the search starts from; repeated rows count and are returned each.  An
    empty table gives an empty table.  Other columns pass through; columns with the names above are replaced.  A determinant that still
    falls after `steps` steps is taken as it is.
    """
    batches(docs.sparkSession)
    docs = own(docs, *COUNTS, "base_failed", "distance", "kept")
    group = lambda *c: F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("null")) for x in c])
    stats = statistics(docs, text_col)
    plain = [c for c, t in stats.dtypes if not t.startswith("map")]
    stats = stats.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    stats = written(stats.withColumns({"group": group(lang_col, source_col), "pool": group(lang_col), "__at": F.xxhash64(*plain)}))
    named = stats.withColumns({f"x{i}": x for i, x in enumerate(vector())})
    rows = written(named.where("not base_failed").select("group", "pool", F.col("__at").alias("at"), *[f"x{i}" for i in range(DIM)]))
    model = drawn(covariance_estimates(rows, share, sample, starts, steps), rows, prior)
    model = written(model)
    out = named.join(bounded(model, model.count()), "group", "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi_square(1 - beyond, DIM)))
    return out.select(*[c for c in docs.columns if c != text_col], *COUNTS, "base_failed", "distance", F.coalesce("kept", F.lit(False)).alias("kept"))
