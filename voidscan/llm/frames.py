"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voidscan.plans.stage import importable, staged

#: Stands for a null id: it sorts before every other.
NO_ID = -(2**63)


def id_of(column: str = "doc_id") -> Column:
    """The id as a long; null is the smallest id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def back(column: str) -> Column:
    """The inverse of id_of."""
    return F.when(F.col(column) != F.lit(NO_ID), F.col(column))


def own(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns of the input whose names the operator's output takes."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    return staged(df)


def batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows and bytes of an Arrow batch: long documents make batches heavy, so the session's limits are lowered, never raised."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):  # the default
        spark.conf.set(key, "16m")


def schema_of(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in more]])
