"""Near-duplicate detection by bottom-k sketches from one hash function.

A document's set is its distinct shingles, each hashed once; the k least hashes are its sketch.
Equal sets are one node. Inverted lists of retained values give candidate pairs: two sets that
reach the threshold share most of their sketches, so by prefix filtering it is enough to list
each node under its rarest retained values; values that many documents hold fall away there.
Pairs are filtered by their sizes and by the estimate from the sketch of their union, then
verified by exact Jaccard similarity on the full sets.

No group is expanded into all its pairs. First each list links its members to one of them, the
one that the most lists know; the connected components of verified links make one class each.
Members of lists that still hold several components are then listed anew, under the rarest
values of their full sets (exact prefix filtering), and only members of such a list that lie in
different components are paired: every link between members of a list that could still join two
components is tested.

What sketches may lose: of the K least values of a union, the two sets share as many as a draw
without return, so fewer than ``least_shared`` of them with odds below ``MISS`` for a pair at the
threshold, and less above it. Sets of fewer than K shingles are whole in their sketches.

Lists, links and equal sets may be large: their rows are dealt out in parts, and what each row
meets is copied to every part.

Texts without words (null, empty) link with nothing. Rows that share a doc_id are one node;
rows with a null doc_id are kept and link with nothing. Repeated rows give repeated results.
Further columns are ignored, an empty table gives no rows, and a text may be as long as a row can be.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import common

K = 32
#: Odds that sketches lose a pair at the threshold, at most.
MISS = 1e-9
#: Rows of one value that go to one part of a join.
PART = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of the base, and so of a word's places in it, from the last byte on."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _BASE, np.uint64))]).astype(np.uint64)
    return _POWERS[:n]


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of lower-cased (A-Z) words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    # A polynomial of each word's bytes: sums over the place within the word.
    lead = np.concatenate([[0], starts])
    place = np.arange(len(data)) - np.repeat(lead, np.diff(np.append(lead, len(data))))
    terms = _BYTES[data] * _powers(int(place.max()) + 1)[place]
    terms[~inside[1:-1]] = 0
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    hashes = _mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
    n = max(1, len(hashes) - words + 1)
    out = np.full(n, np.uint64(min(len(hashes), words)), np.uint64)
    for j in range(min(words, len(hashes))):
        out = _mix(out * _BASE + hashes[j : j + n])
    return np.unique(out)


def signatures(df: DataFrame, words: int) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n (size of its set), sig (digest of it), sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.arrow_blocks(batches, "doc_id", "text", text="text"):
            sets = [shingles(t, words) for _, t in block]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in block], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "sig", "sketch"],
            )

    return common.texts_of(df.select("doc_id", "text")).mapInArrow(run, "doc_id long, n long, sig binary, sketch array<long>")


def least_shared(percent: int) -> int:
    """Of the K least values of a union, a pair at the threshold shares at least so many, but for odds below MISS."""
    p, below = percent / 100, 0.0
    for shared in range(K + 1):
        below += math.comb(K, shared) * p**shared * (1 - p) ** (K - shared)
        if below > MISS:
            return max(1, shared)
    return K


def least_shared_of(size: int, percent: int) -> int:
    """The retained values that a set of ``size`` shares at least with any set that reaches the threshold."""
    if size >= K:
        return least_shared(percent)
    # Sets of up to ``size / threshold`` reach it; of those beyond K values the largest are not retained.
    most = size * 100 // percent
    overlap = lambda other: -(-percent * (size + other) // (100 + percent)) - max(0, other - K)
    return max(1, min(overlap(other) for other in range(-(-size * percent // 100), most + 1)))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (value, node, c) with the part of their value that they belong to; c bounds a value's rows."""
    return rows.withColumn("part", F.pmod(F.xxhash64("node"), F.floor(F.col("c") / PART) + 1).cast("int"))


def _copied(values: DataFrame) -> DataFrame:
    """Rows (value, c) copied to every part of their value."""
    return values.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("c") / PART).cast("int"))))


def prefix_lists(rows: DataFrame, overlap: Column, total: int) -> DataFrame:
    """Of the ``total`` rows (value, node, n, k), those of each node's rarest values.

    Two nodes that share at least ``overlap`` of their values (k of them listed, the same order
    of rarity for all) share one of these. Values that one node holds are left out. ``place``:
    how many of its shared values are no rarer than this one. ``weight``: how many nodes its
    values lead to. ``c``: how many nodes hold the value.
    """
    lists = common.stage(rows.sparkSession, rows.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "values")
    shared = common.join_skewed(rows, lists, "value", hot=lists.where(F.col("c") > total // 1000).select("value"))
    w = W.partitionBy("node").orderBy(F.desc("c"), F.desc("value"))
    ranked = shared.withColumn("place", F.row_number().over(w)).withColumn("weight", F.sum("c").over(W.partitionBy("node")))
    return ranked.where(F.col("place") >= overlap).select("value", "node", "n", "place", "weight", "c")


def sketch_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """``prefix_lists`` of the retained values."""
    rows = nodes.select("node", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    least = F.element_at(F.array(*(F.lit(least_shared_of(k, percent)) for k in range(1, K + 1))), F.col("k"))
    total = nodes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    return prefix_lists(rows, least, total)


def whole_lists(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``prefix_lists`` of the full sets of some nodes (node, n): exact, and short for unlike sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, n, data in common.arrow_rows(batches, "node", "n", "set"):
            values = np.frombuffer(data, np.int64)
            for at in range(0, len(values), 50_000):
                some = values[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), node)), pa.array(np.full(len(some), n))], ["value", "node", "n"])

    rows = members.join(sets, "node").select("node", "n", "set").mapInArrow(run, "value long, node long, n long")
    return prefix_lists(rows, F.ceil(F.col("n") * percent / 100), members.agg(F.sum("n")).first()[0] or 0)


def _can_reach(a: str, b: str, percent: int) -> Column:
    """Whether two sets whose rarest common value this is can have the threshold's overlap.

    All they share is no rarer than that value, so the lower of its two places bounds it. A pair
    that reaches the threshold passes at its rarest common value, if at no other.
    """
    return F.least(f"{a}.place", f"{b}.place") * (100 + percent) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _with_partners(lists: DataFrame, percent: int) -> DataFrame:
    """Members of lists that hold several components, without those whose place reaches no size there."""
    ends = lists.groupBy("value", "c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).where("lo <> hi")
    found = _dealt(lists).join(_copied(ends).drop("c"), ["value", "part"]).where(F.col("place") * (100 + percent) >= percent * (F.col("n") + F.col("least")))
    return found.select(*lists.columns)


def _near_in_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union sketch doesn't rule them out; ``hot``: the values of a that many of them have."""
    own = nodes.select("node", "sketch")
    both = common.join_skewed(pairs, own.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a", hot=hot).join(own.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K))
    both = both.withColumn("hits", F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")))
    # A union of fewer than K values is whole.
    enough = F.when(F.size("u") < K, 100 * F.col("hits") >= percent * F.size("u")).otherwise(F.col("hits") >= least_shared(percent))
    return both.where(enough).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on the full sets; ``hot`` as for ``likely``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for a, b, x, y in common.arrow_rows([batch], "a", "b", "sa", "sb"):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common_size = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common_size >= percent * (len(x) + len(y) - common_size):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], ["a", "b"])

    both = common.join_skewed(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a", hot=hot).join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return both.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of each component of ``edges`` (a, b), by labels that jump."""
    spark = edges.sparkSession
    both = common.stage(spark, edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = common.stage(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        better = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("now"))
        jumped = better.join(labels.select(F.col("node").alias("now"), F.col("comp").alias("jump")), "now", "left")
        following = common.stage(spark, jumped.select("node", F.least("now", F.coalesce("jump", "now")).alias("comp"), "was"), "labels")
        settled = following.where("comp <> was").isEmpty()
        common.discard(labels)
        labels = following.select("node", "comp")
        labels._stored_at = following._stored_at
        if settled:
            common.discard(both)
            return labels


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The stored pairs (a, b) that are links; few of them may have a third of all."""
    spark = pairs.sparkSession
    pairs = common.stage(spark, pairs.distinct(), f"{name}-pairs")
    hot = common.stage(spark, common.hot_values(pairs, "a"), f"{name}-hot")
    links = common.stage(spark, verified(likely(pairs, nodes, percent, hot), sets, percent, hot), f"{name}-links")
    common.discard(pairs, hot)
    return links


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    docs = common.stage(spark, signatures(df, words), "signatures")
    real = docs.where("n > 0 AND doc_id IS NOT NULL")
    nodes = common.stage(spark, real.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    lists = common.stage(spark, sketch_lists(nodes, percent), "lists")

    # The full sets of nodes in any list, made anew from the texts.
    wanted = lists.select("node").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.arrow_blocks(batches, "doc_id", "text", text="text"):
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in block], pa.int64()), pa.array([shingles(t, words).tobytes() for _, t in block], pa.binary())], ["node", "set"])

    texts = df.where(F.col("text").isNotNull()).select("doc_id", "text").join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = common.stage(spark, texts.mapInArrow(run, "node long, set binary").dropDuplicates(), "sets")

    centre = lists.groupBy("value", "c").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"), F.col("n").alias("size"))).alias("to"))
    star = _dealt(lists).join(_copied(centre).drop("c"), ["value", "part"]).select((-F.col("to.m")).alias("a"), F.col("to.size").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    star = star.where((F.col("a") != F.col("b")) & _near_in_size("na", "nb", percent)).select("a", "b")
    first = _links(star, nodes, sets, percent, "star")
    classes = components(first)

    placed = common.stage(spark, lists.join(classes, "node", "left").select("value", "node", "n", "c", F.coalesce("comp", "node").alias("comp")), "placed")
    mixed = placed.groupBy("value", "c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("value", "c")
    members = _dealt(placed).join(_copied(mixed).drop("c"), ["value", "part"], "left_semi").select("node", "n", "comp").distinct()
    members = common.stage(spark, members, "mixed-members")
    common.discard(placed, lists, classes)
    whole = whole_lists(members, sets, percent).join(members.select("node", "comp"), "node")
    whole = common.stage(spark, whole, "whole-lists")
    rest = _with_partners(_with_partners(whole, percent), percent)
    rest = common.stage(spark, rest.drop("c").join(rest.groupBy("value").agg(F.count("*").alias("c")), "value"), "mixed-lists")
    left, right = _dealt(rest).alias("l"), _copied(rest).alias("r")
    across = left.join(right, (F.col("l.value") == F.col("r.value")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.comp") < F.col("r.comp")) & _near_in_size("l.n", "r.n", percent) & _can_reach("l", "r", percent))
    second = _links(across.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")), nodes, sets, percent, "cross")
    common.discard(members, whole, rest, sets)
    joined = components(first.union(second))

    by_sig = nodes.join(joined, "node", "left").select("sig", F.coalesce("comp", "node").alias("component_id"))
    # Nodes are the least doc_ids of their sets, so a component's least node is its least doc_id.
    found = common.join_skewed(docs, by_sig, "sig", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
