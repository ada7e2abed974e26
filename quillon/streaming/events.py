"""Change events: the latest record per key, upserts, cascades and tombstones, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(df: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """The newest row of each key; ties go to the larger ``tie``."""
    w = W.partitionBy(key).orderBy(F.desc(version), F.desc(tie))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def live(df: DataFrame, key: str, version: str, tie: str, deleted: str) -> DataFrame:
    """The newest rows of the keys whose newest row isn't a deletion."""
    return latest(df, key, version, tie).where(~F.expr(deleted))


def upsert(state: DataFrame, changes: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """``state`` (one row a key) with the newest change of each key; changes no newer than the state are dropped."""
    return latest(state.unionByName(changes), key, version, tie)


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``children`` without those of ``deleted`` parents."""
    return children.join(deleted.select(key), key, "left_anti")


def after_tombstones(df: DataFrame, key: str, time: str, tie: str, deleted: str, ttl: str) -> DataFrame:
    """The events that count: those of a key within ``ttl`` after its latest deletion are ignored.

    Deletions always count. A window per key compares each event with the deletion before it.
    """
    w = W.partitionBy(key).orderBy(time, tie).rowsBetween(W.unboundedPreceding, -1)
    gone = F.last(F.when(F.expr(deleted), F.col(time)), ignorenulls=True).over(w)
    marked = df.withColumn("_gone", gone)
    return marked.where(F.expr(deleted) | F.col("_gone").isNull() | (F.col(time) > F.expr(f"_gone + INTERVAL {ttl}"))).drop("_gone")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _kept(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """Batch n writes ``path/state-n`` from ``state-(n-1)``, so a repeated batch gives the same state; older ones go."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/state-{n - 1}") if n else None
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/state-{n}")
        if n > 1:
            _delete(spark, f"{path}/state-{n - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, tie: str) -> StreamingQuery:
    """Upsert each micro-batch into the state below ``path``; stale events drop out."""
    return _kept(stream, path, checkpoint, lambda before, batch: latest(batch, key, version, tie) if before is None else upsert(before, latest(batch, key, version, tie), key, version, tie))


def keep_live(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, tie: str, deleted: str, ttl: str) -> StreamingQuery:
    """As ``keep_latest``, with deletions as tombstones: events within ``ttl`` after one are ignored.

    The state holds the newest event of each key that counts and its latest deletion; a deletion
    is dropped when it is older than ``ttl`` before the newest event seen and a newer event
    counts. Events come in the order of time, but for those of one micro-batch.
    """

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        seen = batch if before is None else before.unionByName(batch)
        counted = after_tombstones(seen, key, time, tie, deleted, ttl)
        newest = counted.agg(F.max(time).alias("_now"))
        dead = latest(counted.where(deleted), key, time, tie).crossJoin(F.broadcast(newest)).where(F.col("_now") <= F.expr(f"{time} + INTERVAL {ttl}")).drop("_now")
        return latest(counted, key, time, tie).union(dead).distinct()

    return _kept(stream, path, checkpoint, merge)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The newest state below ``path``."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)
    names = [f.getPath().getName() for f in found]
    return spark.read.parquet(f"{path}/state-{max(int(n.split('-')[1]) for n in names if n.startswith('state-'))}")
