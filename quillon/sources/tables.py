"""Sources: Parquet tables as views, JSON dumps, and trace files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "region nation customer supplier part orders lineitem events".split()


def scan(spark: SparkSession, sf_dir: str, name: str, fetch: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A table's rows, by the custom fetcher where one is given."""
    return fetch(name) if fetch else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    for name in names:
        scan(spark, sf_dir, name).createOrReplaceTempView(name)


def dump_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """Rows of a dump; arrays and nulls survive since the schema is given."""
    return spark.read.schema(schema).json(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated traces: subscription, deployment, start, end, cpu, memory, count; ``>`` is dropped."""
    cells = F.split(F.trim(F.regexp_replace("value", ">", "")), r"\s+")
    names = [("sub", "long"), ("dep", "long"), ("start", "long"), ("end", "long"), ("cpu", "double"), ("mem", "double"), ("n", "long")]
    return spark.read.text(path).where("trim(value) <> ''").select(*(cells[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)))


def build_trace(df: DataFrame) -> DataFrame:
    """Rows (sub, dep, start, end, cpu, mem) of a raw trace to distinct ones with their count; empty spans go."""
    return df.where("start <> end").groupBy("sub", "dep", "start", "end", "cpu", "mem").agg(F.count("*").alias("n"))


def replay(df: DataFrame, time_scale: int, cpu_scale: float, mem_scale: float, cutoff: int, affinity: int = 0, nodes: int = 0, lifetime: int = 0, seed: int = 1) -> DataFrame:
    """A trace scaled down, up to the cut-off in its own seconds.

    ``together``: ``affinity`` in a hundred of the deployments with fewer tasks than ``nodes`` want
    their tasks on one node; chosen by a hash of the row and the seed, so a replay repeats.
    ``ends``: when a deployment is deleted, ``lifetime`` seconds after its start.
    """
    drawn = F.pmod(F.xxhash64(F.lit(seed), *(F.col(c) for c in ("sub", "dep", "start", "cpu", "mem", "n"))), F.lit(100)) < affinity
    kept = df.where(F.col("start") <= cutoff).withColumn("together", (F.col("n") < nodes) & drawn)
    scaled = kept.withColumns({"start": F.expr(f"start div {time_scale}"), "end": F.expr(f"end div {time_scale}"), "cpu": F.col("cpu") / cpu_scale, "mem": F.col("mem") / mem_scale})
    return scaled.withColumn("ends", F.col("start") + lifetime)
