"""Tables between stages.

A result that two branches of a plan must see alike, or whose lineage would grow in a loop, is written as Parquet in the folder that driver
and executors share (spark.checkpoint.dir), and read again.  A lost executor costs nothing then.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Folders of the tables that this process wrote and has not deleted.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir.  Where that is unset, a temporary folder serves a local session; a cluster is an error."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: tables between stages need a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{top.rstrip('/')}/voidscan-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written and read again."""
    path = shared_dir(df.sparkSession)
    _made.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """(staged df, its rows); they are counted while they are written."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, seen.get["rows"]


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t.staged_path])


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a table; all tables that were staged on the way there are deleted."""
    before = len(_made)
    out = staged(make())
    _delete(spark, [p for p in _made[before:] if p != out.staged_path])
    return out


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this process, once the results that read them are written."""
    _delete(spark, list(_made))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _made:
            _made.remove(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package, wherever the driver was started.

    On a cluster whose machines don't have it under the same path, ship it with --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    held = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in held:
        env["PYTHONPATH"] = os.pathsep.join([*held, root])


def physical(df: DataFrame) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def nested_loops(df: DataFrame) -> int:
    """Nested-loop and Cartesian joins in the plan."""
    text = physical(df)
    return text.count("NestedLoopJoin") + text.count("CartesianProduct")
