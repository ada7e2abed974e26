"""The placement scheduler's views: what may be placed where, as functions of DataFrames.

Tables are flat: label expressions have one row per value, terms one row per expression, and
matches are pairs rather than an array per task, so that no hot task gathers an unbounded array.

tasks (task, node, status, priority, requeued); nodes (node, ready); labels (subject, key, value);
expressions (expr, key, op) with expression_values (expr, value); terms (task, term, expr);
ports (task, ip, port, protocol); demands (task, resource, demand); capacities (node, resource,
allocatable); taints (node, key, value, effect); tolerations (task, key, op, value, effect);
spreads (task, grp, key, max_skew).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The address that stands for every address of a node (a fixed value).
ANY_ADDRESS = "0.0.0.0"

#: Rows of either side in a block of pairs, and of a tile of it; of a strip, the blocks of one side and the rows of it that meet a tile at once.
BLOCK, TILE, STRIP, RUN = 2048, 256, 64, 16


def pending(tasks: DataFrame, now: int, wait: int = 1000) -> DataFrame:
    """Tasks without a node whose last attempt is at least ``wait`` before ``now``."""
    return tasks.where((F.col("status") == "Pending") & F.col("node").isNull() & (F.col("requeued") + wait <= now))


def batch(waiting: DataFrame, limit: int = 50) -> DataFrame:
    """The next tasks to place; the order is by task, so that a batch is the same on every run."""
    return waiting.orderBy("task").limit(limit)


def placed(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("node").isNotNull())


def _with_top(tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Placed tasks with the highest priority among the chosen ones: a single row, so it is broadcast."""
    return placed(tasks).crossJoin(F.broadcast(chosen.agg(F.max("priority").alias("top"))))


def preemption_free(tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen tasks, and placed ones of lower priority that may give way."""
    return chosen.unionByName(_with_top(tasks, chosen).where("priority < top").drop("top")).distinct()


def preemption_fixed(tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Placed tasks that stay where they are during preemption."""
    return _with_top(tasks, chosen).where("priority >= top").drop("top")


def _pairs(left: DataFrame, right: DataFrame, key: str, tiled: bool = False) -> DataFrame:
    """``left.join(right, key)``, dealt out in blocks of about ``BLOCK`` times ``BLOCK`` pairs.

    A large group's pairs are so made by many tasks, and a row is copied once for ``BLOCK`` rows it meets.
    ``tiled``: each row of ``left`` in turn meets the same ``TILE`` rows of ``right`` or so, and what is
    written repeats itself within a compressor's reach; ``right`` should be the side of fewer columns.
    """
    count = F.ceil(F.count("*") / BLOCK)
    blocks = left.groupBy(key).agg(count.alias("lefts__")).join(right.groupBy(key).agg(count.alias("rights__")), key)
    by, n = [key, "left__", "right__"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        place, every = F.pmod(F.xxhash64(*df.columns), F.col(f"{own}s__")), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s__") - 1))
        return df.join(blocks, key).select(*df.columns, place.alias(f"{own}__"), every.alias(f"{other}__")).repartition(n, *by)

    lefts, rights = dealt(left, "left", "right"), dealt(right, "right", "left")
    if not tiled:
        return lefts.join(rights, by).drop("left__", "right__")
    tile, met = F.pmod(F.xxhash64(F.lit(1), *right.columns), F.lit(-(-BLOCK // TILE))), F.struct(*(c for c in right.columns if c != key))
    tiles = rights.groupBy(*by, tile.alias("tile__")).agg(F.collect_list(met).alias("rows__"))
    return tiles.join(lefts, by).select(*left.columns, F.inline("rows__"))


def _strips(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left.join(right, key)`` in an order that is written small, dealt out in strips.

    A strip is about ``BLOCK`` rows of ``left`` with up to ``STRIP`` blocks of ``right``, so a file has few of
    the former. ``TILE`` of them or fewer meet one row of ``right`` after another: their columns repeat within a
    compressor's reach in as few bits as the file has rows of ``left``, and those of ``right`` come in runs. Both
    sides are sorted by their columns as they stand, ``right`` within a block; columns of few values come first.
    """
    own, there = (F.struct(*(c for c in df.columns if c != key)) for df in (left, right))
    count = F.count("*")
    strips = left.groupBy(key).agg(F.ceil(count / BLOCK).alias("lefts__")).join(right.groupBy(key).agg(F.ceil(count / BLOCK).alias("blocks__"), F.ceil(count / (BLOCK * STRIP)).alias("rights__")), key)
    by, n = [key, "left__", "right__"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(df: DataFrame, row: Column, many: str, name: str) -> DataFrame:
        placed = df.join(strips, key).select(key, "lefts__", "rights__", F.pmod(F.xxhash64(*df.columns), F.col(many)).alias("block__"), row.alias("row__"))
        return placed.groupBy(key, "lefts__", "rights__", "block__").agg(F.sort_array(F.collect_list("row__")).alias(name))

    def each(many: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))

    def cut(name: str, size: Column) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(name), size), lambda at: F.slice(name, at, size)))

    # Tiles of a block are alike and of a multiple of 8 rows, which Parquet packs into whole bytes.
    tile = (F.ceil(F.size("lefts") / F.ceil(F.size("lefts") / TILE) / 8) * 8).cast("int")
    lefts = blocks(left, own, "lefts__", "lefts").select(key, F.col("block__").alias("left__"), "rights__", cut("lefts", tile).alias("tile"))
    lefts = lefts.withColumn("right__", each("rights__")).drop("rights__").repartition(n, *by)
    rights = blocks(right, there, "blocks__", "rights").select(key, each("lefts__").alias("left__"), F.pmod("block__", "rights__").alias("right__"), "rights").repartition(n, *by)
    # Spark's generated code holds all rows that it makes of one row at once. It ends where runs are cut, so these are few.
    met = lefts.join(rights, by).select(key, "tile", cut("rights", F.lit(RUN)).alias("run")).select(key, "tile", F.inline("run"))
    # Exploding tiles takes two thirds of inline's time.
    made = met.select(key, *(c for c in right.columns if c != key), F.explode("tile").alias("row__"))
    return made.select(*right.columns, *(f"row__.{c}" for c in left.columns if c != key))


def _kinds(rows: DataFrame, subject: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(subject, kind) and the rows (kind, *columns): subjects with the same set of rows are of one kind, named after the least."""
    sets = rows.groupBy(subject).agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("set__"))
    kinds = sets.groupBy("set__").agg(F.min(subject).alias("kind"))
    return sets.join(kinds, "set__").select(subject, "kind"), kinds.select("kind", F.explode("set__").alias("row__")).select("kind", "row__.*")


def port_conflicts(chosen: DataFrame, others: DataFrame, ports: DataFrame) -> DataFrame:
    """Pairs (task, other, node of the other) that ask for the same port of the same address.

    Conflicts are found between kinds of tasks, those that ask for the same ports; only kinds are made
    distinct, as a task is of one kind and so meets another once.
    """
    asked, known = ["ip", "port", "protocol"], ports.where("port IS NOT NULL AND protocol IS NOT NULL")
    own, own_rows = _kinds(known.join(chosen.select("task"), "task", "left_semi"), "task", asked)
    theirs, their_rows = _kinds(known.join(others.select("task"), "task", "left_semi"), "task", asked)
    same = (F.col("ip") == F.col("other_ip")) | (F.col("ip") == ANY_ADDRESS) | (F.col("other_ip") == ANY_ADDRESS)
    met = own_rows.join(their_rows.withColumnsRenamed({"kind": "other_kind", "ip": "other_ip"}), ["port", "protocol"]).where(same).select("kind", "other_kind").distinct()
    left = own.join(met, "kind").select("task", "other_kind")
    right = others.select("task", "node").distinct().join(theirs, "task").select(F.col("task").alias("other"), "node", F.col("kind").alias("other_kind"))
    return _pairs(right, left, "other_kind", tiled=True).where("task <> other").select("task", "other", "node")


def matches(expressions: DataFrame, values: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (expr, subject): label expressions and the labelled subjects they hold for.

    In and Exists are equi-joins. NotIn and DoesNotExist hold for all subjects but those the
    positive form finds, so only these operators meet every subject, as their result does.
    """
    keyed = expressions.join(labels, "key").select("expr", "op", "subject", "value")
    by_value = keyed.where("op IN ('In', 'NotIn')").join(values, ["expr", "value"], "left_semi")
    hit = by_value.unionByName(keyed.where("op IN ('Exists', 'DoesNotExist')"))
    positive = hit.where("op IN ('In', 'Exists')").select("expr", "subject").distinct()
    negated = expressions.where("op IN ('NotIn', 'DoesNotExist')").select("expr").distinct()
    against = hit.where("op IN ('NotIn', 'DoesNotExist')").select("expr", "subject")
    return positive.unionByName(negated.crossJoin(labels.select("subject").distinct()).join(against, ["expr", "subject"], "left_anti"))


def _whole_terms(chosen: DataFrame, terms: DataFrame, found: DataFrame) -> DataFrame:
    """(task, subject) where a term has all its expressions hold; any one term is enough."""
    own = terms.join(chosen.select("task"), "task", "left_semi").distinct()
    sizes = own.groupBy("task", "term").agg(F.count("*").alias("size"))
    held = own.join(found, "expr").groupBy("task", "term", "subject").agg(F.count("*").alias("held"))
    return held.join(sizes, ["task", "term"]).where("held = size").select("task", "subject").distinct()


def selector_matches(chosen: DataFrame, terms: DataFrame, node_matches: DataFrame) -> DataFrame:
    """Pairs (task, node) that the task's node selector allows."""
    return _whole_terms(chosen, terms, node_matches).select("task", F.col("subject").alias("node"))


def affinity_matches(chosen: DataFrame, others: DataFrame, terms: DataFrame, task_matches: DataFrame) -> DataFrame:
    """Triples (task, other, node of the other) that an affinity or anti-affinity term names."""
    found = _whole_terms(chosen, terms, task_matches).withColumnRenamed("subject", "other")
    return found.where("task <> other").join(others.select(F.col("task").alias("other"), "node"), "other").select("task", "other", "node")


def spare_capacity(nodes: DataFrame, capacities: DataFrame, tasks: DataFrame, demands: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, resource, capacity): what ready nodes have left, and 0 for asked resources a node lacks."""
    ready = nodes.where("ready").select("node")
    used = demands.join(placed(tasks).select("task", "node"), "task").groupBy("node", "resource").agg(F.sum("demand").alias("used"))
    left = capacities.join(ready, "node", "left_semi").join(used, ["node", "resource"], "left")
    left = left.select("node", "resource", (F.col("allocatable") - F.coalesce("used", F.lit(0))).cast("long").alias("capacity"))
    asked = demands.join(chosen.select("task"), "task", "left_semi").select("resource").distinct()
    known = capacities.select("node").distinct().join(nodes.select("node"), "node", "left_semi")
    lacking = known.crossJoin(asked).join(capacities.select("node", "resource"), ["node", "resource"], "left_anti")
    return left.unionByName(lacking.withColumn("capacity", F.lit(0).cast("long"))).distinct()


def tolerating(chosen: DataFrame, tolerations: DataFrame, taints: DataFrame) -> DataFrame:
    """Pairs (task, node) where the task tolerates every taint of the node; no effect named: any effect.

    Kinds of tasks are held against kinds of nodes, and pairs are made of the kinds that agree.
    """
    own, own_rows = _kinds(tolerations.join(chosen.select("task"), "task", "left_semi"), "task", ["key", "op", "value", "effect"])
    nodes, theirs = _kinds(taints.where("node IS NOT NULL"), "node", ["key", "value", "effect"])
    nodes, theirs = nodes.withColumnRenamed("kind", "node_kind"), theirs.withColumnRenamed("kind", "node_kind")
    sizes = theirs.groupBy("node_kind").agg(F.count("*").alias("size"))
    both = own_rows.withColumnsRenamed({"value": "t_value", "effect": "t_effect"}).join(theirs, "key").where("(t_effect IS NULL OR t_effect = effect) AND (op = 'Exists' OR t_value = value)")
    met = both.select("kind", "node_kind", "key", "value", "effect").distinct().groupBy("kind", "node_kind").agg(F.count("*").alias("met"))
    left = own.join(met.join(sizes, "node_kind").where("met = size"), "kind").select("task", "node_kind")
    return _pairs(left, nodes, "node_kind").select("task", "node")


def tainted_nodes(taints: DataFrame) -> DataFrame:
    return taints.select("node").distinct()


def allowed_nodes(spare: DataFrame) -> DataFrame:
    return spare.select("node").distinct()


def topology_channels(chosen: DataFrame, spreads: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, task, node, key, value, max_skew): the value of the spread key that each node would give a task."""
    own = spreads.join(chosen.select("task"), "task", "left_semi").select("grp", "task", "key", "max_skew").distinct()
    there = labels.select(F.col("subject").alias("node"), "key", "value").distinct()
    return _strips(own.select("key", "max_skew", "grp", "task"), there.select("key", "value", "node"), "key").select("grp", "task", "node", "key", "value", "max_skew")


def spread_bounds(fixed: DataFrame, spreads: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, node, key, value, max_skew, demand): placed tasks of each node that spread over the key.

    Demand is counted per node and key first, and joined to the groups of the key afterwards.
    """
    there = labels.withColumnRenamed("subject", "node").join(fixed.select("node", "task"), "node")
    counted = there.join(spreads.select("task", "key", F.lit(1).alias("one")).distinct(), ["task", "key"], "left")
    demand = counted.groupBy("node", "key", "value").agg(F.count("one").alias("demand"))
    return demand.join(spreads.select("grp", "key", "max_skew").distinct(), "key").select("grp", "node", "key", "value", "max_skew", "demand")


def largest(spare: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` nodes with the most left of each resource; ties go to the smaller node.

    Each task keeps its own best rows of a resource before they are dealt out (a window group limit).
    """
    best = W.partitionBy("resource").orderBy(F.desc("capacity"), "node")
    return spare.withColumn("rank__", F.row_number().over(best)).where(F.col("rank__") <= limit).select("node", "resource", "capacity")


def scoped(spare: DataFrame, named: list[DataFrame], limit: int) -> DataFrame:
    """The spare capacity of nodes that any of ``named`` (column node) or ``largest`` has."""
    kept = largest(spare, limit).select("node")
    for df in named:
        kept = kept.unionByName(df.select("node"))
    return spare.join(kept.distinct(), "node", "left_semi").distinct()
