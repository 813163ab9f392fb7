"""Binary key files: a 64-bit count and that many 64-bit keys, little-endian."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscan.plans.stage import importable


def read_keys(spark: SparkSession, path: str, first: int | None = None, bits: int | None = 60) -> DataFrame:
    """(file, k): distinct keys of each file, of the `first` in it if given, and of their low `bits` bits if given; else keys of 64 bits with
    the top bit flipped, so that their order as BIGINT is that of unsigned numbers.

    A file is one record here; files of this format are fixtures, tables of keys are Parquet.
    """

    def rows(it):
        for p in it:
            for path, content in zip(p["path"], p["content"]):
                n = int(np.frombuffer(content, "<u8", 1)[0]) if len(content) >= 8 else 0
                if len(content) < 8 * (n + 1):
                    raise ValueError(f"{path}: {n} keys are announced, {len(content) // 8 - 1} are there")
                v = np.frombuffer(content, "<u8", n, 8)[:first]
                v = v & np.uint64((1 << bits) - 1) if bits else v ^ np.uint64(1 << 63)
                yield pd.DataFrame({"file": path, "k": np.unique(v.view(np.int64))})

    importable(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, k long")


def write_keys(keys: DataFrame, path: str, key: str = "k") -> None:
    """One file with all keys in order, for tests and exchange."""
    v = np.sort(keys.select(key).toPandas()[key].to_numpy().astype("<u8"))
    with open(path, "wb") as f:
        f.write(np.array([len(v)], "<u8").tobytes() + v.tobytes())


def keys_of_time(df: DataFrame, column: str) -> DataFrame:
    """df with k, the microseconds of a timestamp."""
    return df.withColumn("k", F.unix_micros(F.col(column).cast("timestamp")))
