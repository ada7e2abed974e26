"""The scheduler's views over a cluster derived from the star schema, with DuckDB equivalents.

Orders are tasks, suppliers are nodes; labels, taints, ports and demands follow from their keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import cluster
from quillon.sources import tables

NOW, LIMIT, TOP = 3000, 50, 5

#: The cluster's tables, in SQL that both engines run as it is.
BASE: dict[str, str] = {
    "nodes": "SELECT s_suppkey AS node, s_suppkey % 11 <> 0 AS ready FROM supplier",
    "tasks": "SELECT o_orderkey AS task, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (SELECT min(s_suppkey) FROM supplier) + o_orderkey % (SELECT count(*) FROM supplier) END AS node, CASE WHEN o_orderkey % 5 = 0 THEN 'Pending' ELSE 'Running' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 ELSE o_orderkey % 7 END AS priority, (o_orderkey % 3) * 1200 AS requeued FROM orders",
    "node_labels": "SELECT s_suppkey AS subject, 'nation' AS key, s_nationkey % 25 AS value FROM supplier UNION ALL SELECT s_suppkey, 'region', n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, 'fast', 1 FROM supplier WHERE s_suppkey % 4 = 0",
    "task_labels": "SELECT o_orderkey AS subject, 'app' AS key, o_custkey % 40 AS value FROM orders WHERE o_orderkey % 10 < 6",
    "expressions": "SELECT n_nationkey AS expr, CASE WHEN n_nationkey % 5 = 0 THEN 'fast' WHEN n_nationkey % 5 = 1 THEN 'region' ELSE 'nation' END AS key, CASE n_nationkey % 4 WHEN 0 THEN 'In' WHEN 1 THEN 'NotIn' WHEN 2 THEN 'Exists' ELSE 'DoesNotExist' END AS op FROM nation UNION ALL SELECT n_nationkey + 100, 'app', CASE WHEN n_nationkey % 6 = 5 THEN 'Exists' ELSE 'In' END FROM nation",
    "expression_values": "SELECT n_nationkey AS expr, n_nationkey % 5 AS value FROM nation UNION ALL SELECT n_nationkey, n_nationkey FROM nation UNION ALL SELECT n_nationkey + 100, n_nationkey FROM nation",
    "terms": "SELECT o_orderkey AS task, 0 AS term, o_orderkey % 25 AS expr FROM orders WHERE o_orderkey % 10 = 5 UNION ALL SELECT o_orderkey, 0, (o_orderkey + 7) % 25 FROM orders WHERE o_orderkey % 10 = 5 UNION ALL SELECT o_orderkey, 1, (o_orderkey + 3) % 25 FROM orders WHERE o_orderkey % 20 = 5",
    "peer_terms": "SELECT o_orderkey AS task, 0 AS term, 100 + o_custkey % 25 AS expr FROM orders WHERE o_orderkey % 15 = 0",
    "ports": "SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 0 THEN '0.0.0.0' ELSE '10.0.0.1' END AS ip, o_custkey % 101 AS port, CASE WHEN o_custkey % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol FROM orders WHERE o_orderkey % 9 < 2",
    "demands": "SELECT o_orderkey AS task, 'cpu' AS resource, o_orderkey % 4 + 1 AS demand FROM orders UNION ALL SELECT o_orderkey, 'memory', o_orderkey % 9 FROM orders UNION ALL SELECT o_orderkey, 'gpu', 1 FROM orders WHERE o_orderkey % 20 = 0",
    "capacities": "SELECT s_suppkey AS node, 'cpu' AS resource, 900 AS allocatable FROM supplier UNION ALL SELECT s_suppkey, 'memory', 1500 + s_suppkey % 100 FROM supplier UNION ALL SELECT s_suppkey, 'gpu', 8 FROM supplier WHERE s_suppkey % 6 = 0",
    "taints": "SELECT s_suppkey AS node, 'owner' AS key, s_suppkey % 2 AS value, 'NoSchedule' AS effect FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'old', 1, 'NoExecute' FROM supplier WHERE s_suppkey % 4 = 0",
    "tolerations": "SELECT o_orderkey AS task, 'owner' AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'Exists' ELSE 'Equal' END AS op, o_orderkey % 2 AS value, CASE WHEN o_orderkey % 7 < 3 THEN NULL ELSE 'NoSchedule' END AS effect FROM orders WHERE o_orderkey % 10 < 6 UNION ALL SELECT o_orderkey, 'old', 'Equal', 1, 'NoExecute' FROM orders WHERE o_orderkey % 4 = 0",
    "spreads": "SELECT o_orderkey AS task, o_custkey % 3 AS grp, CASE WHEN o_custkey % 3 = 0 THEN 'nation' ELSE 'region' END AS key, 1 + o_custkey % 3 AS max_skew FROM orders WHERE o_orderkey % 5 < 2",
    "waiting": f"SELECT * FROM tasks WHERE status = 'Pending' AND node IS NULL AND requeued + 1000 <= {NOW}",
    "chosen": f"SELECT * FROM waiting ORDER BY task LIMIT {LIMIT}",
    "fixed": "SELECT * FROM tasks WHERE node IS NOT NULL",
}

#: How DuckDB states what several views share.
_HELD = "EXISTS (SELECT 1 FROM {labels} h LEFT JOIN expression_values v ON v.expr = e.expr AND v.value = h.value WHERE h.subject = l.subject AND h.key = e.key AND (e.op IN ('Exists', 'DoesNotExist') OR v.expr IS NOT NULL))"
_MATCHES = "SELECT DISTINCT e.expr, l.subject FROM expressions e CROSS JOIN {labels} l WHERE (e.op IN ('In', 'Exists')) = " + _HELD
_TERMS = "SELECT DISTINCT t.task, m.subject FROM chosen JOIN {terms} t ON chosen.task = t.task JOIN ({found}) m ON m.expr = t.expr GROUP BY t.task, t.term, m.subject HAVING count(DISTINCT t.expr) = (SELECT count(DISTINCT u.expr) FROM {terms} u WHERE u.task = t.task AND u.term = t.term)"
_NODE_MATCHES = _MATCHES.format(labels="node_labels")
_SELECTED = "SELECT task, subject AS node FROM (" + _TERMS.format(terms="terms", found=_NODE_MATCHES) + ")"
_PORTS = "SELECT DISTINCT a.task, o.task AS other, o.node FROM chosen JOIN ports a ON a.task = chosen.task JOIN ports b ON a.task <> b.task AND a.port = b.port AND a.protocol = b.protocol AND (a.ip = b.ip OR '0.0.0.0' IN (a.ip, b.ip)) JOIN {others} o ON o.task = b.task"
_PEERS = "SELECT f.task, f.subject AS other, o.node FROM (" + _TERMS.format(terms="peer_terms", found=_MATCHES.format(labels="task_labels")) + ") f JOIN {others} o ON o.task = f.subject WHERE f.task <> f.subject"
_SPARE = (
    "SELECT c.node, c.resource, CAST(allocatable - coalesce((SELECT sum(demand) FROM fixed f JOIN demands d ON d.task = f.task WHERE f.node = c.node AND d.resource = c.resource), 0) AS bigint) AS capacity FROM capacities c JOIN nodes n ON n.node = c.node WHERE ready "
    "UNION SELECT node, resource, 0 FROM (SELECT DISTINCT node FROM capacities) x CROSS JOIN (SELECT DISTINCT resource FROM demands WHERE task IN (SELECT task FROM chosen)) y WHERE NOT EXISTS (SELECT 1 FROM capacities c WHERE c.node = x.node AND c.resource = y.resource)"
)
_LARGEST = f"SELECT node, resource, capacity FROM (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY capacity DESC, node) AS r FROM ({_SPARE})) WHERE r <= {TOP}"
_TOLERATING = "SELECT o.task, t.node FROM (SELECT DISTINCT task FROM tolerations WHERE task IN (SELECT task FROM chosen)) o CROSS JOIN taints t GROUP BY o.task, t.node HAVING bool_and(EXISTS (SELECT 1 FROM tolerations q WHERE q.task = o.task AND q.key = t.key AND (q.effect IS NULL OR q.effect = t.effect) AND (q.op = 'Exists' OR q.value = t.value)))"


def _spare(t: dict[str, DataFrame]) -> DataFrame:
    return cluster.spare_capacity(t["nodes"], t["capacities"], t["tasks"], t["demands"], t["chosen"])


def _node_matches(t: dict[str, DataFrame]) -> DataFrame:
    return cluster.matches(t["expressions"], t["expression_values"], t["node_labels"])


def _task_matches(t: dict[str, DataFrame]) -> DataFrame:
    return cluster.matches(t["expressions"], t["expression_values"], t["task_labels"])


def _selected(t: dict[str, DataFrame]) -> DataFrame:
    return cluster.selector_matches(t["chosen"], t["terms"], _node_matches(t))


#: name: (view of the cluster's tables, DuckDB SQL over them).
VIEWS: dict[str, tuple[Callable[[dict[str, DataFrame]], DataFrame], str]] = {
    "cluster_pending": (lambda t: cluster.pending(t["tasks"], NOW), "SELECT * FROM waiting"),
    "cluster_batch": (lambda t: cluster.batch(cluster.pending(t["tasks"], NOW), LIMIT), "SELECT * FROM chosen"),
    "cluster_placed": (lambda t: cluster.placed(t["tasks"]), "SELECT * FROM fixed"),
    "cluster_preemption_free": (lambda t: cluster.preemption_free(t["tasks"], t["chosen"]), "SELECT * FROM chosen UNION SELECT * FROM fixed WHERE priority < (SELECT max(priority) FROM chosen)"),
    "cluster_preemption_fixed": (lambda t: cluster.preemption_fixed(t["tasks"], t["chosen"]), "SELECT * FROM fixed WHERE priority >= (SELECT max(priority) FROM chosen)"),
    "cluster_ports_pending": (lambda t: cluster.port_conflicts(t["chosen"], t["chosen"], t["ports"]), _PORTS.format(others="chosen")),
    "cluster_ports_placed": (lambda t: cluster.port_conflicts(t["chosen"], t["fixed"], t["ports"]), _PORTS.format(others="fixed")),
    "cluster_node_matches": (_node_matches, _NODE_MATCHES),
    "cluster_task_matches": (_task_matches, _MATCHES.format(labels="task_labels")),
    "cluster_selector_matches": (_selected, _SELECTED),
    "cluster_spare_capacity": (_spare, _SPARE),
    "cluster_tolerating": (lambda t: cluster.tolerating(t["chosen"], t["tolerations"], t["taints"]), _TOLERATING),
    "cluster_tainted_nodes": (lambda t: cluster.tainted_nodes(t["taints"]), "SELECT DISTINCT node FROM taints"),
    "cluster_allowed_nodes": (lambda t: cluster.allowed_nodes(_spare(t)), f"SELECT DISTINCT node FROM ({_SPARE})"),
    "cluster_peers_pending": (lambda t: cluster.affinity_matches(t["chosen"], t["chosen"], t["peer_terms"], _task_matches(t)), _PEERS.format(others="chosen")),
    "cluster_peers_placed": (lambda t: cluster.affinity_matches(t["chosen"], t["fixed"], t["peer_terms"], _task_matches(t)), _PEERS.format(others="fixed")),
    "cluster_topology_channels": (lambda t: cluster.topology_channels(t["chosen"], t["spreads"], t["node_labels"]), "SELECT DISTINCT grp, task, subject AS node, key, value, max_skew FROM chosen JOIN spreads USING (task) JOIN node_labels USING (key)"),
    "cluster_spread_bounds": (
        lambda t: cluster.spread_bounds(t["fixed"], t["spreads"], t["node_labels"]),
        "SELECT g.grp, f.node, l.key, l.value, g.max_skew, count(DISTINCT s.task) AS demand FROM fixed f JOIN node_labels l ON l.subject = f.node JOIN (SELECT DISTINCT grp, key, max_skew FROM spreads) g ON g.key = l.key LEFT JOIN spreads s ON s.task = f.task AND s.key = l.key GROUP BY g.grp, f.node, l.key, l.value, g.max_skew",
    ),
    "cluster_largest": (lambda t: cluster.largest(_spare(t), TOP), _LARGEST),
    "cluster_scoped": (lambda t: cluster.scoped(_spare(t), [t["node_labels"].where("key = 'fast' AND subject % 20 = 0").select(F.col("subject").alias("node")), cluster.tainted_nodes(t["taints"]).where("node % 12 = 0")], TOP), f"SELECT * FROM ({_SPARE}) WHERE node IN (SELECT node FROM ({_LARGEST}) UNION SELECT subject FROM node_labels WHERE key = 'fast' AND subject % 20 = 0 UNION SELECT node FROM taints WHERE node % 12 = 0)"),
}


#: Views that preemption reads, over the tasks it may move and those that stay where they are.
PREEMPTION = {f"{name}_preemption": VIEWS[name] for name in ("cluster_spare_capacity", "cluster_allowed_nodes", "cluster_tolerating", "cluster_selector_matches", "cluster_peers_pending", "cluster_peers_placed", "cluster_ports_pending", "cluster_ports_placed", "cluster_topology_channels", "cluster_spread_bounds")}


def load(spark: SparkSession, sf_dir: str, preemption: bool = False) -> dict[str, DataFrame]:
    """The cluster's tables as DataFrames; with ``preemption``, ``chosen`` holds what may move beside the batch."""
    tables.register(spark, sf_dir)
    found = {name: spark.sql(text) for name, text in BASE.items() if name not in ("waiting", "chosen", "fixed")}
    found["chosen"] = cluster.batch(cluster.pending(found["tasks"], NOW), LIMIT)
    found["fixed"] = cluster.placed(found["tasks"])
    if preemption:
        batch = found["chosen"]
        found["chosen"] = cluster.preemption_free(found["tasks"], batch)
        found["tasks"] = found["fixed"] = cluster.preemption_fixed(found["tasks"], batch)
    return found


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name in PREEMPTION:
        return lambda spark, sf_dir: PREEMPTION[name][0](load(spark, sf_dir, preemption=True))
    return lambda spark, sf_dir: VIEWS[name][0](load(spark, sf_dir))


def sql(name: str) -> str:
    """The whole DuckDB query of a view."""
    base, text = BASE, (VIEWS | PREEMPTION)[name][1]
    if name in PREEMPTION:
        top = "(SELECT max(priority) FROM batch)"
        base = {k: v for k, v in BASE.items() if k not in ("chosen", "fixed")} | {
            "batch": BASE["chosen"],
            "chosen": f"SELECT * FROM batch UNION SELECT * FROM tasks WHERE node IS NOT NULL AND priority < {top}",
            "fixed": f"SELECT * FROM tasks WHERE node IS NOT NULL AND priority >= {top}",
        }
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in base.items()) + " " + text
