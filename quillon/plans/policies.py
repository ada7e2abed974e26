"""The placement scheduler's policies as constraint statements, and their evaluation over a known placement.

``placements`` holds the tasks of a batch and those that may give way: task, priority, equivalence,
current (the node it is on, if any) and the decision ``controllable__node``; NOWHERE stands for no
node. The other tables are the scheduler's views (``cluster``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import cluster
from quillon.plans import cluster_views as views
from quillon.plans.dialect import parse_all
from quillon.plans.evaluate import Evaluation

NOWHERE = -1

#: policy: its statements.
POLICIES: dict[str, list[str]] = {
    "preemption": [
        f"create constraint stay_or_leave as select task from placements where current is not null check controllable__node = current or controllable__node = {NOWHERE}",
        f"create constraint keep_priority as select * from placements maximize priority * (controllable__node <> {NOWHERE})",
    ],
    "somewhere": [f"create constraint somewhere as select * from placements maximize controllable__node <> {NOWHERE}"],
    "domain": [f"create constraint domain as select task from placements check controllable__node in (select node from spare) or controllable__node = {NOWHERE}"],
    "selector": [f"create constraint selector as select task from placements where task in (select task from selecting) check controllable__node in (select selected.node from selected where selected.task = placements.task) or controllable__node = {NOWHERE}"],
    "affinity": [f"create constraint affinity as select * from placements join peers_placed on placements.task = peers_placed.task group by placements.task check any(placements.controllable__node = peers_placed.node) or all(placements.controllable__node = {NOWHERE})"],
    "anti_affinity": ["create constraint anti_affinity as select placements.task, peers_placed.other from placements join peers_placed on placements.task = peers_placed.task check placements.controllable__node <> peers_placed.node"],
    "anti_affinity_pending": [
        f"create constraint anti_affinity_pending as select placements.task, peers_pending.other from placements join peers_pending on placements.task = peers_pending.task join placements as mate on mate.task = peers_pending.other check placements.controllable__node <> mate.controllable__node or mate.controllable__node = {NOWHERE}"
    ],
    "capacity": ["create constraint capacity as select * from placements join demands on placements.task = demands.task join spare on spare.resource = demands.resource group by spare.resource check capacity_constraint(placements.controllable__node, spare.node, demands.demand, spare.capacity) = true"],
    "taints": ["create constraint taints as select placements.task from placements join tainted on placements.controllable__node = tainted.node check placements.controllable__node in (select tolerating.node from tolerating where tolerating.task = placements.task)"],
    "symmetry": ["create constraint symmetry as select * from placements group by equivalence check increasing(controllable__node)"],
    "ports": ["create constraint ports as select placements.task, ports_placed.other from placements join ports_placed on placements.task = ports_placed.task check placements.controllable__node <> ports_placed.node"],
    "ports_pending": [
        f"create constraint ports_pending as select placements.task, ports_pending.other from placements join ports_pending on placements.task = ports_pending.task join placements as mate on mate.task = ports_pending.other check placements.controllable__node <> mate.controllable__node or mate.controllable__node = {NOWHERE}"
    ],
    "spread": [
        "create constraint spread_loads as select channels.grp as grp, channels.value as value, max(channels.max_skew) as skew, count(placements.task) as n from channels join placements on placements.task = channels.task where placements.controllable__node = channels.node group by channels.grp, channels.value",
        "create constraint spread as select * from spread_loads group by grp check max(n) <= min(n) + max(skew)",
    ],
}

#: A known placement, in SQL that both engines run as it is.
PLACING = (
    f"SELECT task, priority, task % 3 AS equivalence, CAST(NULL AS bigint) AS current, CASE WHEN task % 13 = 0 THEN {NOWHERE} ELSE (SELECT min(s_suppkey) FROM supplier) + (task * 7) % (SELECT count(*) FROM supplier) END AS controllable__node FROM chosen "
    f"UNION ALL SELECT task, priority, task % 3, node, CASE task % 4 WHEN 0 THEN {NOWHERE} WHEN 1 THEN node + 1 ELSE node END FROM fixed WHERE priority < (SELECT max(priority) FROM chosen)"
)

_BASE = {"placements": PLACING, "spare": views._SPARE, "selected": views._SELECTED, "tolerating": views._TOLERATING}
_PEERS = {"peers_placed": views._PEERS.format(others="fixed"), "peers_pending": views._PEERS.format(others="chosen"), "ports_placed": views._PORTS.format(others="fixed"), "ports_pending": views._PORTS.format(others="chosen")}
_CHANNELS = "SELECT DISTINCT grp, task, subject AS node, key, value, max_skew FROM chosen JOIN spreads USING (task) JOIN node_labels USING (key)"

#: query: (policy, statement, DuckDB SQL over the cluster's tables).
QUERIES: dict[str, tuple[str, str, str]] = {
    "policy_preemption": ("preemption", "stay_or_leave", f"SELECT task FROM placements WHERE current IS NOT NULL AND NOT (controllable__node = current OR controllable__node = {NOWHERE})"),
    "policy_preemption_value": ("preemption", "keep_priority", f"SELECT CAST(sum(CASE WHEN controllable__node <> {NOWHERE} THEN priority ELSE 0 END) AS bigint) AS objective FROM placements"),
    "policy_somewhere": ("somewhere", "somewhere", f"SELECT CAST(count(*) FILTER (controllable__node <> {NOWHERE}) AS bigint) AS objective FROM placements"),
    "policy_domain": ("domain", "domain", f"SELECT task FROM placements WHERE controllable__node <> {NOWHERE} AND controllable__node NOT IN (SELECT node FROM spare)"),
    "policy_selector": ("selector", "selector", f"SELECT task FROM placements p WHERE task IN (SELECT task FROM terms) AND controllable__node <> {NOWHERE} AND NOT EXISTS (SELECT 1 FROM selected s WHERE s.task = p.task AND s.node = p.controllable__node)"),
    "policy_affinity": ("affinity", "affinity", f"SELECT p.task FROM placements p JOIN peers_placed q ON p.task = q.task GROUP BY p.task HAVING NOT (bool_or(controllable__node = q.node) OR bool_and(controllable__node = {NOWHERE}))"),
    "policy_anti_affinity": ("anti_affinity", "anti_affinity", "SELECT p.task, q.other FROM placements p JOIN peers_placed q ON p.task = q.task WHERE p.controllable__node = q.node"),
    "policy_anti_affinity_pending": ("anti_affinity_pending", "anti_affinity_pending", f"SELECT p.task, q.other FROM placements p JOIN peers_pending q ON p.task = q.task JOIN placements m ON m.task = q.other WHERE p.controllable__node = m.controllable__node AND m.controllable__node <> {NOWHERE}"),
    "policy_capacity": ("capacity", "capacity", "SELECT s.resource, s.node AS place, CAST(sum(d.demand) AS bigint) AS load FROM placements p JOIN demands d ON p.task = d.task JOIN spare s ON s.resource = d.resource AND s.node = p.controllable__node GROUP BY s.resource, s.node HAVING sum(d.demand) > max(s.capacity)"),
    "policy_taints": ("taints", "taints", "SELECT p.task FROM placements p JOIN (SELECT DISTINCT node FROM taints) t ON p.controllable__node = t.node WHERE NOT EXISTS (SELECT 1 FROM tolerating o WHERE o.task = p.task AND o.node = p.controllable__node)"),
    "policy_symmetry": ("symmetry", "symmetry", "SELECT equivalence FROM (SELECT equivalence, controllable__node AS n, lag(controllable__node) OVER (PARTITION BY equivalence ORDER BY task) AS b FROM placements) GROUP BY equivalence HAVING bool_or(b > n)"),
    "policy_ports": ("ports", "ports", "SELECT p.task, q.other FROM placements p JOIN ports_placed q ON p.task = q.task WHERE p.controllable__node = q.node"),
    "policy_ports_pending": ("ports_pending", "ports_pending", f"SELECT p.task, q.other FROM placements p JOIN ports_pending q ON p.task = q.task JOIN placements m ON m.task = q.other WHERE p.controllable__node = m.controllable__node AND m.controllable__node <> {NOWHERE}"),
    "policy_spread": ("spread", "spread", f"SELECT grp FROM (SELECT c.grp, c.value, max(max_skew) AS skew, count(*) AS n FROM ({_CHANNELS}) c JOIN placements p ON p.task = c.task AND p.controllable__node = c.node GROUP BY c.grp, c.value) GROUP BY grp HAVING max(n) > min(n) + max(skew)"),
}


def tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that policies read beside ``placements``, from the cluster's."""
    task_matches = cluster.matches(t["expressions"], t["expression_values"], t["task_labels"])
    node_matches = cluster.matches(t["expressions"], t["expression_values"], t["node_labels"])
    return {
        "spare": cluster.spare_capacity(t["nodes"], t["capacities"], t["tasks"], t["demands"], t["chosen"]),
        "selecting": t["terms"].select("task").distinct(),
        "selected": cluster.selector_matches(t["chosen"], t["terms"], node_matches),
        "peers_placed": cluster.affinity_matches(t["chosen"], t["fixed"], t["peer_terms"], task_matches),
        "peers_pending": cluster.affinity_matches(t["chosen"], t["chosen"], t["peer_terms"], task_matches),
        "demands": t["demands"],
        "tainted": cluster.tainted_nodes(t["taints"]),
        "tolerating": cluster.tolerating(t["chosen"], t["tolerations"], t["taints"]),
        "ports_placed": cluster.port_conflicts(t["chosen"], t["fixed"], t["ports"]),
        "ports_pending": cluster.port_conflicts(t["chosen"], t["chosen"], t["ports"]),
        "channels": cluster.topology_channels(t["chosen"], t["spreads"], t["node_labels"]),
    }


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    policy, statement, _ = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = views.load(spark, sf_dir)
        t["chosen"].createOrReplaceTempView("chosen")
        t["fixed"].createOrReplaceTempView("fixed")
        spark.sql(PLACING).createOrReplaceTempView("placements")
        for view, df in tables(t).items():
            df.createOrReplaceTempView(view)
        found = Evaluation(spark, parse_all(POLICIES[policy]), order="task")
        return (found.violations | found.objectives)[statement]

    return run


def sql(name: str) -> str:
    """The whole DuckDB query of a policy."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in (views.BASE | _BASE | _PEERS).items()) + " " + QUERIES[name][2]
