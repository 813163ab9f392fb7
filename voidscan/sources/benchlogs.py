"""Benchmark logs and memory reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: A number and the unit after it, which is none itself.
_METRIC = rf"(?<=\s)({_NUMBER})\s+(?!{_NUMBER}(?:\s|$))(\S+)"
_PARAM = r"(?:^|/)([^/=]*)=([^/]*)"
#: Units of the standard columns.
_UNITS = {"ns/op": "ns_per_op", "B/op": "bytes_per_op", "allocs/op": "allocs_per_op"}


def _last_wins(keys: Column, values: Column) -> Column:
    """A map of two arrays; of a key twice the last value counts."""
    n = F.size(keys)
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(F.reverse(keys), e["k"]) == n - i))
    return F.when(F.size(F.array_distinct(keys)) == n, F.map_from_arrays(keys, values)).otherwise(last)


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(full_name, benchmark, params, samples, metrics) of lines such as
    BenchmarkX/Keys=1024/Bits=64-8  100  234 ns/op  88.0 bits/key ; other lines are left out.

    params: names in lower case, without the trailing -N.  metrics: a number before each unit; of a unit twice the last counts.
    """
    some = lines.where(F.col(line).rlike(r"^Benchmark\S*\s+\S+\s+\S+\s+\S"))
    name = F.regexp_extract(line, r"^(\S+)", 1)
    rest = F.regexp_replace(F.regexp_extract(line, r"^[^/\s]*/(\S*)", 1), r"-[0-9]+$", "")
    count = F.regexp_extract(line, r"^\S+\s+([0-9]+)(?:\s|$)", 1)
    t = some.select(
        name.alias("full_name"), F.substring_index(name, "/", 1).alias("benchmark"), F.when(count != "", count.cast("long")).alias("samples"),
        F.transform(F.regexp_extract_all(rest, F.lit(_PARAM), F.lit(1)), F.lower).alias("_pk"), F.regexp_extract_all(rest, F.lit(_PARAM), F.lit(2)).alias("_pv"),
        F.regexp_extract_all(line, F.lit(_METRIC), F.lit(2)).alias("_u"), F.regexp_extract_all(line, F.lit(_METRIC), F.lit(1)).cast("array<double>").alias("_v"))

    def named(u: Column) -> Column:
        out = F.replace(F.replace(u, F.lit("/"), F.lit("_")), F.lit("."), F.lit(""))
        for k, v in _UNITS.items():
            out = F.when(u == k, v).otherwise(out)
        return out

    t = t.withColumn("_u", F.transform("_u", named))
    return t.select("full_name", "benchmark", _last_wins(F.col("_pk"), F.col("_pv")).alias("params"), "samples", _last_wins(F.col("_u"), F.col("_v")).alias("metrics"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def medians(rows: DataFrame, params: list[str]) -> DataFrame:
    """(benchmark, params..., metric, samples, median): medians of each metric by benchmark and parameters."""
    keyed = rows.select("benchmark", *[F.col("params")[p].alias(p) for p in params], F.explode("metrics").alias("metric", "v"))
    return keyed.groupBy("benchmark", *params, "metric").agg(F.count("*").alias("samples"), F.median("v").alias("median"))


def parse_reports(lines: DataFrame, tag: str, line: str = "value", depth: int = 6) -> DataFrame:
    """(path, name, depth, total_bytes): nodes of report trees in lines "TAG: {json}"; deeper trees than `depth` are cut there."""
    node = "struct<name:string,total_bytes:bigint>"
    for _ in range(depth - 1):
        node = f"struct<name:string,total_bytes:bigint,children:array<{node}>>"
    j = lines.where(F.col(line).contains(tag)).select(F.monotonically_increasing_id().alias("report"), F.from_json(F.regexp_extract(line, tag + r"\s*:?\s*(\{.*\})", 1), node).alias("n"))
    out = level = j.select("report", F.col("n.name").alias("path"), F.lit(0).alias("depth"), "n")
    for d in range(1, depth):
        if "children" not in level.select("n.*").columns:
            break
        level = level.select("report", "path", F.explode("n.children").alias("n")).select("report", F.concat_ws("/", "path", F.col("n.name")).alias("path"), F.lit(d).alias("depth"), "n")
        out = out.select("report", "path", "depth", F.struct(F.col("n.name"), F.col("n.total_bytes")).alias("n")).unionByName(level.select("report", "path", "depth", F.struct(F.col("n.name"), F.col("n.total_bytes")).alias("n")))
    return out.select("report", "path", F.col("n.name").alias("name"), "depth", F.col("n.total_bytes").alias("total_bytes"))


def flattened(nodes: DataFrame, components: dict[str, str]) -> DataFrame:
    """(report, component, bytes): leaves' bytes summed by the component whose pattern their path matches first, else Other."""
    up = nodes.select("report", F.regexp_replace("path", "/[^/]*$", "").alias("path")).where("path is not null").distinct()
    leaves = nodes.join(up, ["report", "path"], "left_anti")
    name = F.lit(None).cast("string")
    for label, pattern in components.items():
        name = F.coalesce(name, F.when(F.col("path").rlike(pattern), label))
    return leaves.groupBy("report", F.coalesce(name, F.lit("Other")).alias("component")).agg(F.sum("total_bytes").alias("bytes"))


def report_json(nodes: DataFrame) -> DataFrame:
    """(report, json): the nodes of a report as one JSON array, in the order of their paths."""
    return nodes.groupBy("report").agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "name", "depth", "total_bytes")))).alias("json"))


def report_text(nodes: DataFrame) -> DataFrame:
    """(report, text): an indented line for each node."""
    line = F.concat(F.expr("repeat('  ', depth)"), "name", F.lit(": "), F.col("total_bytes").cast("string"))
    return nodes.groupBy("report").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def series_of(df: DataFrame, name: str, x: str, y: str) -> DataFrame:
    """(name, points): the points of each series in the order of x."""
    return df.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(x, y))).alias("points"))
