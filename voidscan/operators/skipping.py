"""Data skipping: which files can hold a key of an interval.

A sidecar index has, for each file, its least and greatest key, and fingerprints of its keys: the first bits of key - least.  It is built in one
pass over the key column; a query is answered from the index alone.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscan.functions.bits import bitlen
from voidscan.operators.exact import is_empty
from voidscan.plans.stage import staged


def index(keys: DataFrame, bits: int = 20, file: str = "file", key: str = "k") -> tuple[DataFrame, DataFrame]:
    """(files, fingerprints) of rows (file, k): files (file, no, lo, hi, n, shift), fingerprints (no, fp)."""
    f = keys.where(F.col(key).isNotNull()).groupBy(file).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))
    f = staged(f.withColumns({"no": F.xxhash64(file).bitwiseAND(F.lit(2**40 - 1)), "shift": F.greatest(F.lit(0), bitlen(F.col("hi") - F.col("lo")) - bits)}))
    fp = keys.join(f, file).select("no", F.call_function("shiftright", F.col(key) - F.col("lo"), F.col("shift")).alias("fp")).distinct()
    return f, staged(fp)


def index_of(spark: SparkSession, path: str, column, bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """The index of Parquet files, keyed on a column expression of type BIGINT."""
    return index(spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), column.alias("k")), bits)


def _code(no, fp):
    return (no.cast("decimal(15,0)") * F.lit(Decimal(2**62)) + fp.cast("decimal(20,0)")).cast("decimal(38,0)")


def candidates(files: DataFrame, fingerprints: DataFrame, queries: DataFrame, file: str = "file") -> DataFrame:
    """(qid, file): files that may hold a key of [a, b].  Queries and files meet on cells of the number line, so that no pair is tried that shares
    none; then the fingerprints decide."""
    span = files.agg(F.min("lo"), F.max("hi")).first()
    if span[0] is None:
        return queries.select("qid").join(files.select(file), F.lit(False))
    cell = max(1, (span[1] - span[0]) // 1024)
    lo, hi = F.lit(span[0]), F.lit(span[1])
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.greatest(a, lo) - lo) / cell), F.floor((F.least(b, hi) - lo) / cell)))
    q = queries.where((F.col("a") <= F.col("b")) & (F.col("b") >= lo) & (F.col("a") <= hi)).select("qid", "a", "b", cells(F.col("a"), F.col("b")).alias("cell"))
    f = files.select(file, "no", F.col("lo"), F.col("hi"), "shift", cells(F.col("lo"), F.col("hi")).alias("cell"))
    met = q.join(f, "cell").where((F.col("a") <= F.col("hi")) & (F.col("b") >= F.col("lo"))).dropDuplicates(["qid", file])
    ask = met.select("qid", file, "no", F.call_function("shiftright", F.greatest("a", "lo") - F.col("lo"), F.col("shift")).alias("x"), F.call_function("shiftright", F.least("b", "hi") - F.col("lo"), F.col("shift")).alias("y"))
    coded = ask.select("qid", file, _code(F.col("no"), F.col("x")).alias("x"), _code(F.col("no"), F.col("y")).alias("y"))
    return is_empty(fingerprints.select(_code(F.col("no"), F.col("fp")).alias("k")), coded, "k", "x", "y").where("not is_empty").select("qid", file)


def surviving(spark: SparkSession, files: DataFrame, fingerprints: DataFrame, a: int, b: int) -> list[str]:
    """Files to read for one interval."""
    q = spark.createDataFrame([(0, a, b)], "qid long, a long, b long")
    return sorted(r[0] for r in candidates(files, fingerprints, q).select("file").collect())
