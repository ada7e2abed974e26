"""Queries of the placement workload's functions, key checks and streams, with DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import placement
from quillon.plans.dialect import parse_all
from quillon.plans.evaluate import Evaluation, duplicates, orphans
from quillon.sources import tables
from quillon.streaming import events, shred

_UNITS = "CASE p_size % 8 WHEN 0 THEN 'm' WHEN 1 THEN '' WHEN 2 THEN 'Ki' WHEN 3 THEN 'M' WHEN 4 THEN 'Gi' WHEN 5 THEN 'T' WHEN 6 THEN 'P' ELSE 'x' END"
_QUANTITIES = f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cpu' ELSE 'memory' END AS resource, concat(CAST(p_size AS {{text}}), CASE WHEN p_partkey % 3 = 0 THEN '.25' ELSE '' END, {_UNITS}) AS q FROM part"


def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return spark.sql(_QUANTITIES.format(text="string")).select("p_partkey", "q", placement.quantity(F.col("q"), F.col("resource")).alias("amount"))


_CONTAINERS = "SELECT l_orderkey AS pod, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS int) END AS request, CASE WHEN l_linenumber % 2 = 1 AND l_quantity > 20 THEN CAST(l_quantity AS int) WHEN l_quantity > 40 THEN 50 END AS lim FROM lineitem"


def qos_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return placement.service_class(spark.sql(_CONTAINERS), "pod", "request", "lim")


_TOLD = "SELECT s_suppkey AS node, CASE s_nationkey % 7 WHEN 0 THEN 'OutOfDisk' WHEN 1 THEN 'MemoryPressure' WHEN 2 THEN 'DiskPressure' WHEN 3 THEN 'PIDPressure' WHEN 4 THEN 'NetworkUnavailable' ELSE 'Ready' END AS kind, CASE WHEN s_acctbal > 2000 THEN 'True' ELSE 'False' END AS told FROM supplier UNION ALL SELECT s_suppkey, 'Ready', 'True' FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey % 7 < 5"


def condition_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return placement.conditions(spark.sql(_TOLD), "node", "kind", "told").select("node", *(F.col(c).cast("int").alias(c) for c in placement.CONDITIONS.values()))


_REQUESTS = "SELECT l_orderkey AS pod, CASE WHEN l_linenumber = 1 THEN 'pods' WHEN l_linenumber % 2 = 0 THEN 'cpu' ELSE 'memory' END AS resource, l_partkey % 50 AS amount FROM lineitem WHERE l_linenumber > 1 OR l_orderkey % 4 = 0"
_OVERHEADS = "SELECT o_orderkey AS pod, 'cpu' AS resource, 3 AS amount FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'gpu', 1 FROM orders"


def demand_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return placement.rollup(spark.sql(_REQUESTS), spark.sql(_OVERHEADS), spark.sql("SELECT o_orderkey AS pod FROM orders"))


_MOVES = "SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 7 END AS before, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 7 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END END AS later FROM orders"


def split_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return spark.sql(_MOVES).groupBy(placement.outcome(F.col("before"), F.col("later")).alias("outcome")).agg(F.count("*").alias("n"))


def intern_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose label expressions are equal share an id: how many parts, and ids, a brand has."""
    tables.register(spark, sf_dir)
    expr = placement.interned(F.col("p_brand"), F.lit("In"), F.array("p_type", F.lit("any")))
    return spark.table("part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.count_distinct(expr).alias("exprs"))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    rows = spark.table("events").select("user_id", "event_id", "event_type", "ts")
    state = events.latest(rows.where("event_id % 2 = 0"), "user_id", "ts", "event_id")
    changes = events.latest(rows.where("event_id % 2 = 1 AND event_id % 3 > 0"), "user_id", "ts", "event_id")
    return events.upsert(state, changes, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    gone = spark.sql("SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F'")
    return events.cascade(spark.table("lineitem"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def fk_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return orphans(spark.table("lineitem"), "l_orderkey", spark.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'"), "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return duplicates(spark.table("lineitem"), ["l_partkey", "l_suppkey", "l_linenumber"])


_LOADED = "create constraint fits as select * from lineitem join supplier where lineitem.l_returnflag = 'R' group by l_linenumber check capacity_constraint(lineitem.l_suppkey, supplier.s_suppkey, lineitem.l_partkey, supplier.s_nationkey * 1000 + 5000)"
_ON_DECISION = "create constraint busy as select * from orders_held join supplier on orders_held.controllable__supplier = supplier.s_suppkey group by s_nationkey check count(*) <= 60"


def dialect_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return Evaluation(spark, parse_all([_LOADED])).violations["fits"]


def dialect_join_on_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    spark.sql("SELECT o_orderkey, (SELECT min(s_suppkey) FROM supplier) + o_custkey % (SELECT count(*) FROM supplier) AS controllable__supplier FROM orders").createOrReplaceTempView("orders_held")
    return Evaluation(spark, parse_all([_ON_DECISION])).violations["busy"]


def _place(spark: SparkSession) -> str:
    """A new folder in the shared place that the session names, a temporary one where it names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared or tempfile.mkdtemp(prefix='quillon-')}/stream-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("user_id", "event_id", "event_type", "ts")


def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a stream of the events leaves: the latest event of each user."""
    place = _place(spark)
    events.keep_latest(_event_stream(spark, sf_dir), f"{place}/state", f"{place}/checkpoint", "user_id", "ts", "event_id").awaitTermination()
    return events.state(spark, f"{place}/state").select("user_id", "event_id", "event_type")


def stream_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users whose latest event that counts isn't a purchase, which ends them for an hour."""
    place, ended = _place(spark), "event_type = 'purchase'"
    events.keep_live(_event_stream(spark, sf_dir), f"{place}/state", f"{place}/checkpoint", "user_id", "ts", "event_id", ended, "1 HOUR").awaitTermination()
    return events.live(events.state(spark, f"{place}/state"), "user_id", "ts", "event_id", ended).select("user_id", "event_id", "event_type")


def tombstone_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that count after tombstones, in batch."""
    tables.register(spark, sf_dir)
    return events.after_tombstones(spark.table("events"), "user_id", "ts", "event_id", "event_type = 'purchase'", "5 MINUTES").select("event_id")


def _pods(spark: SparkSession) -> DataFrame:
    """Orders as nested objects, through JSON as a watch would give them."""
    container = "struct(concat('part-', l_partkey % 20) AS image, struct(map('cpu', concat(l_partkey % 7 + 1, CASE WHEN l_linenumber = 1 THEN '' ELSE 'm' END)) AS requests) AS resources, CASE WHEN l_linenumber = 2 THEN array(struct(CAST(l_suppkey AS int) AS hostPort, 'TCP' AS protocol)) END AS ports)"
    one = f"SELECT to_json(struct(struct(CAST(o_orderkey AS string) AS uid, map('app', CAST(o_custkey % 9 AS string)) AS labels) AS metadata, struct(o_orderkey % 300 AS priority, CASE WHEN o_orderkey % 2 = 0 THEN map('cpu', '5m') END AS overhead, CASE WHEN o_orderkey % 3 = 0 THEN map('zone', concat('z', o_custkey % 4)) END AS nodeSelector, c AS containers) AS spec)) AS j FROM orders JOIN (SELECT l_orderkey, collect_list({container}) AS c FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"
    return spark.sql(one).select(F.from_json("j", shred.POD).alias("o")).select("o.*")


def shred_demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return shred.pods(_pods(spark))["pod_demands"]


def shred_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each child table a pod has, beside its priority."""
    tables.register(spark, sf_dir)
    found = shred.pods(_pods(spark))
    count = lambda name: found[name].groupBy("uid").agg(F.count("*").alias(name[4:]))
    joined = found["pod_info"].select("uid", "priority")
    for name in ("pod_images", "pod_ports", "pod_labels", "pod_node_terms"):
        joined = joined.join(count(name), "uid", "left").fillna(0, [name[4:]])
    return joined


_DUCK_QUANTITY = (
    "SELECT p_partkey, q, CASE WHEN resource = 'cpu' THEN CASE u WHEN 'm' THEN CAST(floor(d) AS bigint) WHEN '' THEN CAST(floor(d * 1000) AS bigint) END ELSE CASE u WHEN 'm' THEN CAST(floor(d / 1000) AS bigint) WHEN '' THEN CAST(floor(d) AS bigint) WHEN 'Ki' THEN CAST(floor(d * 1024) AS bigint) WHEN 'M' THEN CAST(d * 1000000 AS bigint) WHEN 'Gi' THEN CAST(d * 1073741824 AS bigint) WHEN 'T' THEN CAST(d * 1000000000000 AS bigint) WHEN 'P' THEN CAST(d * 1000000000000000 AS bigint) END END AS amount "
    f"FROM (SELECT *, CAST(regexp_extract(q, '^([0-9.]+)', 1) AS decimal(12,2)) AS d, regexp_extract(q, '^[0-9.]+(.*)$', 1) AS u FROM ({_QUANTITIES.format(text='varchar')}))"
)
_LATEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {rows}) WHERE r = 1"
_COUNTED = "SELECT * FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM events) WHERE event_type = 'purchase' OR gone IS NULL OR ts > gone + INTERVAL {ttl}"

#: query: (function, DuckDB SQL).
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "quantity_parse": (quantity_parse, _DUCK_QUANTITY),
    "qos_class": (qos_class, f"SELECT pod, CASE WHEN NOT bool_or(request IS NOT NULL OR lim IS NOT NULL) THEN 'BestEffort' WHEN bool_and(coalesce(coalesce(request, lim) = lim, false)) THEN 'Guaranteed' ELSE 'Burstable' END AS qos_class FROM ({_CONTAINERS}) GROUP BY pod"),
    "condition_pivot": (condition_pivot, "SELECT node, " + ", ".join(f"CAST(coalesce(bool_or(CASE WHEN kind = '{k}' THEN told = 'True' END), {str(c == 'ready').lower()}) AS int) AS {c}" for k, c in placement.CONDITIONS.items()) + f" FROM ({_TOLD}) GROUP BY node"),
    "demand_rollup": (
        demand_rollup,
        f"WITH q AS ({_REQUESTS}), o AS ({_OVERHEADS}), a AS (SELECT pod, resource, sum(amount) AS n FROM q GROUP BY pod, resource UNION ALL SELECT o_orderkey, 'pods', 1 FROM orders WHERE o_orderkey NOT IN (SELECT pod FROM q WHERE resource = 'pods')) SELECT a.pod, a.resource, CAST(n + coalesce((SELECT sum(amount) FROM o WHERE o.pod = a.pod AND o.resource = a.resource), 0) AS bigint) AS demand FROM a",
    ),
    "split_outcome": (split_outcome, f"SELECT CASE WHEN before IS NULL AND later IS NULL THEN 'UNASSIGNED' WHEN later IS NULL THEN 'PREEMPT' WHEN before = later THEN 'UNCHANGED' ELSE 'ASSIGNED' END AS outcome, count(*) AS n FROM ({_MOVES}) GROUP BY 1"),
    "intern_expr": (intern_expr, "SELECT p_brand, count(*) AS parts, count(DISTINCT p_type) AS exprs FROM part GROUP BY p_brand"),
    "upsert_merge": (upsert_merge, _LATEST.format(rows="events WHERE event_id % 2 = 0 OR event_id % 3 > 0")),
    "delete_cascade": (delete_cascade, "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey"),
    "fk_domain": (fk_domain, "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey"),
    "pk_duplicates": (pk_duplicates, "SELECT l_partkey, l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "dialect_capacity": (dialect_capacity, "SELECT l_linenumber, s_suppkey AS place, CAST(sum(l_partkey) AS bigint) AS load FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY l_linenumber, s_suppkey HAVING sum(l_partkey) > max(s_nationkey * 1000 + 5000)"),
    "dialect_join_on_decision": (dialect_join_on_decision, "SELECT s_nationkey FROM orders JOIN supplier ON s_suppkey = (SELECT min(s_suppkey) FROM supplier) + o_custkey % (SELECT count(*) FROM supplier) GROUP BY s_nationkey HAVING count(*) > 60"),
    "stream_latest_state": (stream_latest_state, _LATEST.format(rows="events")),
    "stream_tombstone": (stream_tombstone, _LATEST.format(rows="(" + _COUNTED.format(ttl="1 HOUR") + ")") + " AND event_type <> 'purchase'"),
    "tombstone_cache": (tombstone_cache, "SELECT event_id FROM (" + _COUNTED.format(ttl="5 MINUTES") + ")"),
    "shred_demands": (shred_demands, "SELECT CAST(l_orderkey AS varchar) AS pod, 'cpu' AS resource, CAST(sum((l_partkey % 7 + 1) * CASE WHEN l_linenumber = 1 THEN 1000 ELSE 1 END) + CASE WHEN l_orderkey % 2 = 0 THEN 5 ELSE 0 END AS bigint) AS demand FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey UNION ALL SELECT CAST(o_orderkey AS varchar), 'pods', 1 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    "shred_children": (shred_children, "SELECT CAST(o_orderkey AS varchar) AS uid, least(o_orderkey % 300, 100) AS priority, count(DISTINCT l_partkey % 20) AS images, CAST(count(*) FILTER (l_linenumber = 2) AS bigint) AS ports, 1 AS labels, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS node_terms FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey"),
}
