"""False-positive rates, sizes and thresholds of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voidscan.operators.exact import first_in, is_empty


def false_positive_rate(keys: DataFrame, answers: DataFrame, key: str = "k", a: str = "a", b: str = "b") -> DataFrame:
    """One row: asked, truly_empty, false_positives, fpr, missed.  answers: queries with a filter's is_empty.

    Only valid queries (a <= b) that truly hold no key count; the rate is 0 without any.  missed counts answers "empty" to queries that hold one.
    """
    truth = is_empty(keys, answers.where(F.col(a) <= F.col(b)).withColumnRenamed("is_empty", "said"), key, a, b)
    n = F.count(F.when(F.col("is_empty"), 1))
    fp = F.count(F.when(F.col("is_empty") & ~F.col("said"), 1))
    return truth.agg(F.count("*").alias("asked"), n.alias("truly_empty"), fp.alias("false_positives"), F.when(n == 0, 0.0).otherwise(fp / n).alias("fpr"), F.count(F.when(~F.col("is_empty") & F.col("said"), 1)).alias("missed"))


def shrunk(keys: DataFrame, queries: DataFrame, key: str = "k", a: str = "a", b: str = "b") -> DataFrame:
    """Queries made empty: one that holds a key ends before its first; those that begin with a key are left out."""
    q = first_in(keys, queries.where(F.col(a) <= F.col(b)), key, a, b)
    return q.where(F.col("first_key").isNull() | (F.col("first_key") > F.col(a))).withColumn(b, F.coalesce(F.col("first_key") - 1, F.col(b))).drop("first_key")


def threshold_crossings(series: DataFrame, rate: float, name: str = "series", x: str = "bits", y: str = "fpr") -> DataFrame:
    """(series, x): where each series first falls to the rate, by straight lines in log(y) between its points."""
    w = Window.partitionBy(name).orderBy(x)
    s = series.withColumns({"_x": F.lag(x).over(w), "_y": F.lag(y).over(w)})
    t = (F.log(F.lit(rate)) - F.log("_y")) / (F.log(F.greatest(F.col(y), F.lit(1e-12))) - F.log("_y"))
    at = F.when(F.col("_y").isNull(), F.col(x)).otherwise(F.col("_x") + t * (F.col(x) - F.col("_x")))
    return s.where((F.col(y) <= rate) & (F.col("_y").isNull() | (F.col("_y") > rate))).groupBy(name).agg(F.min(at).alias(x))


def quantiles(df: DataFrame, column: str, qs: list[float], *by: str) -> DataFrame:
    """(by, q, value): sample quantiles, interpolated."""
    g = df.groupBy(*by).agg(F.percentile(column, qs).alias("_v"))
    return g.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("_v").alias("value"))).alias("_z")).select(*by, F.col("_z.q"), F.col("_z.value"))


def build_study(spark, trials: int, n: int, w: int, s: int, attempts: int = 100, seed: int = 1) -> DataFrame:
    """(trial, attempts, ok): simulated builds that retry until no search meets a false signature; each attempt fails by the closed form."""
    from voidscan.functions.sizes import theory_false_positive

    p = (1 - theory_false_positive(w, s)) ** n
    draw = (F.xxhash64(F.col("trial"), F.col("attempt"), F.lit(seed)).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53)))
    t = spark.range(trials).withColumnRenamed("id", "trial").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    first = t.withColumn("ok", draw < p).groupBy("trial").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("_f"))
    return first.select("trial", F.coalesce("_f", F.lit(attempts)).alias("attempts"), F.col("_f").isNotNull().alias("ok"))


def component_sizes(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, row_count, bytes): rows of each table of a structure, and the bytes of their values: the width of each number that is not null, the
    length of each text or byte string."""
    width, out = {"bigint": 8, "timestamp": 8, "double": 8, "int": 4, "float": 4, "date": 4, "smallint": 2, "tinyint": 1, "boolean": 1}, None
    for name, df in parts.items():
        size = F.lit(0)
        for c, t in df.dtypes:
            held = F.octet_length(c) if t in ("string", "binary") else F.lit(width[t]) if t in width else F.octet_length(F.to_json(F.struct(c)))
            size = size + F.when(F.col(c).isNotNull(), held).otherwise(0)
        r = df.agg(F.lit(name).alias("name"), F.count("*").alias("row_count"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))
        out = r if out is None else out.unionByName(r)
    return out
