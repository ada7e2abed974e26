"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Each table turns a vector by three rounds of random signs and a fast Hadamard transform; its
bucket is the nearest signed axis. A query probes the ``probes`` axes nearest to it in each
table, and the rows of those buckets are ranked by their exact inner product in double
precision. Every row is indexed. Rows are dealt to shards by a hash of their id, queries to
blocks, and each pair of shard and block is one task of bounded size, so neither hot buckets
nor clusters land in one place.

How many axes a query must probe depends on the width of the vectors and on how near their
neighbours are, so it is measured: a bounded sample of queries is answered exactly over all rows,
and the probes are raised until the share ``recall`` of those neighbours is in a probed bucket.
All axes are the end of that, and exact.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
with a null id. Rows that share an id count once, with the least of their vectors. Only vectors
of equal length are compared. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import common

TABLES = 4
#: The least probes; a query probes a quarter of the signed axes at least.
PROBES = 32
#: Sampled queries of each width (up to twice as many), and the share of their neighbours that probes must reach.
SAMPLE = 256
RECALL = 0.95
#: Numbers in a shard, and queries in a block.
SHARD_CELLS = 1 << 19
QUERY_BLOCK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, p = x.shape
    half = 1
    while half < p:
        y = x.reshape(n, p // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, p)
        half *= 2
    return x / math.sqrt(p)


def padded(width: int) -> int:
    """The power of two that vectors are padded to."""
    return 1 << max(1, (width - 1).bit_length())


def turn(x: np.ndarray, table: int) -> np.ndarray:
    """The rows of ``x``, padded to a power of two, in the axes of one table."""
    p = padded(x.shape[1])
    signs = np.random.default_rng([table, p]).choice([-1.0, 1.0], (3, p))
    out = np.zeros((len(x), p))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def buckets(turned: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: axis times two, plus one if negative."""
    axis = np.abs(turned).argmax(axis=1)
    return 2 * axis + (turned[np.arange(len(turned)), axis] < 0)


def signed_axes(queries: np.ndarray, table: int) -> np.ndarray:
    """How near each query is to each signed axis, by the numbers of ``buckets``."""
    turned = turn(queries, table)
    return np.stack([turned, -turned], axis=2).reshape(len(queries), -1)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def nearest(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, tables: int, probes: int) -> list[tuple]:
    """(query id, id, score) of each query's k best candidates among the rows."""
    places = [buckets(turn(rows, t)) for t in range(tables)]
    probed = []
    for t in range(tables):
        near = signed_axes(queries, t)
        mask = np.zeros(near.shape, bool)
        take = min(probes, near.shape[1])
        np.put_along_axis(mask, np.argpartition(-near, take - 1, axis=1)[:, :take], True, axis=1)
        probed.append(mask)
    found = []
    for i, query in enumerate(queries):
        seen = ids != query_ids[i]
        hit = np.zeros(len(rows), bool)
        for t in range(tables):
            hit |= probed[t][i][places[t]]
        at = np.flatnonzero(seen & hit)
        scores = (rows[at] * query).sum(axis=1)
        order = best_of(scores, ids[at], k)
        found.extend(zip([int(query_ids[i])] * len(order), ids[at[order]].tolist(), scores[order].tolist(), strict=True))
    return found


def needed_probes(valid: DataFrame, is_query: Column, k: int, tables: int, recall: float) -> dict[int, int]:
    """By width, the probes that reach the share ``recall`` of the exact k nearest of sampled queries."""
    share = F.greatest(F.lit(1), F.floor(F.col("queries") / SAMPLE))
    counts = valid.where(is_query).groupBy("size").agg(F.count("*").alias("queries"))
    picked = valid.where(is_query).join(F.broadcast(counts), "size").where(F.pmod(F.xxhash64("vec_id", F.lit(2)), share) == 0)
    sample: dict[int, list] = {}
    for r in picked.select("size", "vec_id", "embedding").toLocalIterator():
        sample.setdefault(r["size"], []).append((r.vec_id, np.array(r.embedding)))
    asked = {n: (np.array([i for i, _ in some]), np.stack([x for _, x in some])) for n, some in sample.items()}
    shared = valid.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks: dict[int, list[np.ndarray]] = {}
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n, some in batch.groupby("size"):
                if n not in shared.value:
                    continue
                query_ids, queries = shared.value[n]
                if n not in ranks:
                    near = [signed_axes(queries, t) for t in range(tables)]
                    ranks[n] = [(-x).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") for x in near]
                for at in range(0, len(some), max(1, SHARD_CELLS // n)):
                    part = some[at : at + max(1, SHARD_CELLS // n)]
                    rows, ids = np.stack(part["embedding"]), part["vec_id"].to_numpy()
                    places = [buckets(turn(rows, t)) for t in range(tables)]
                    scores = queries @ rows.T
                    for i, query_id in enumerate(query_ids):
                        other = np.flatnonzero(ids != query_id)
                        other = other[best_of(scores[i][other], ids[other], k)]
                        need = np.min([ranks[n][t][i][places[t][other]] for t in range(tables)], axis=0) + 1
                        found = scores[i][other], ids[other], need
                        if (n, i) in best:
                            found = tuple(map(np.concatenate, zip(best[n, i], found)))
                        keep = best_of(found[0], found[1], k)
                        best[n, i] = tuple(x[keep] for x in found)
        for (n, i), (scores, ids, need) in best.items():
            yield pd.DataFrame({"size": n, "query_id": shared.value[n][0][i], "vec_id": ids, "score": scores, "need": need})

    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = valid.select("size", "vec_id", "embedding").mapInPandas(run, "size int, query_id long, vec_id long, score double, need int")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    least = near.groupBy("size").agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY need)").cast("int").alias("need"))
    return {r["size"]: r.need for r in least.collect()}


def search(df: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, shard_cells: int = SHARD_CELLS, query_block: int = QUERY_BLOCK, recall: float = RECALL) -> DataFrame:
    """Of ``df`` (vec_id, embedding): for each row where ``is_query``, its k nearest others found.

    ``probes`` is the least number; more are taken where the sampled queries need them.
    Columns: query_id, rank (from 1), vec_id, score.
    """
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = df.select("vec_id", x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite & F.exists(x, lambda v: v != 0))
    valid = common.stage(df.sparkSession, valid.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("size", F.size("embedding")), "vectors")
    sizes = valid.agg(F.count("*").alias("n"), F.max("size").alias("size"), F.sum(is_query.cast("long")).alias("queries")).first()
    needed = needed_probes(valid, is_query, k, tables, recall) if sizes.queries else {}
    shards = max(1, -(-sizes.n * (sizes.size or 1) // shard_cells))
    blocks = max(1, -(-(sizes.queries or 0) // query_block))
    rows = valid.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = valid.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        width = len(left["embedding"].iloc[0])
        take = max(probes, padded(width) // 2, needed.get(width, 0))
        found = nearest(np.stack(right["embedding"]), right["vec_id"].to_numpy(), np.stack(left["embedding"]), left["vec_id"].to_numpy(), k, tables, take)
        return pd.DataFrame(found, columns=columns)

    key = ["size", "shard", "block"]
    found = queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
