"""Relational queries over the star-schema tables, one per operator of the view layer.

Each entry is the Spark SQL, and the DuckDB SQL where that differs. Suppliers stand for nodes
(bins), orders and line items for pods (tasks), parts for labels, events for change records.
"""

from __future__ import annotations

#: name: SQL that both engines run as it is.
SAME: dict[str, str] = {
    "scan_fetch": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "fetch_filtered": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000",
    "project_star_join": "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey",
    "project_expr": "SELECT n_nationkey * 2 + 1 AS a, n_nationkey - n_regionkey AS b, n_name AS name FROM nation",
    "filter_bool": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 AND l_returnflag = 'R') OR NOT (l_linestatus = 'O' OR l_discount < 0.05)",
    "filter_null": "SELECT o_orderkey, CAST(v IS NULL AS int) AS missing FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS v FROM orders) t WHERE v IS NULL OR v IS NOT NULL",
    "unary_ops": "SELECT n_nationkey, -n_nationkey AS neg, +n_nationkey AS pos FROM nation",
    "cmp_ops": "SELECT n_nationkey, CAST(n_nationkey < 10 AS int) AS lt, CAST(n_nationkey <= 10 AS int) AS le, CAST(n_nationkey > 10 AS int) AS gt, CAST(n_nationkey >= 10 AS int) AS ge, CAST(n_nationkey = 10 AS int) AS eq, CAST(n_nationkey <> 10 AS int) AS ne FROM nation",
    "join_multi": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_self_alias": "SELECT a.n_nationkey AS k1, b.n_nationkey AS k2 FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "join_theta": "SELECT a.n_nationkey AS k1, b.n_nationkey AS k2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "join_left_cross_natural": "SELECT x.s_suppkey, x.r, coalesce(y.used, 0) AS used FROM (SELECT s_suppkey, r_regionkey AS r FROM supplier CROSS JOIN region) x LEFT JOIN (SELECT l_suppkey, CAST(l_linenumber % 5 AS int) AS m, count(*) AS used FROM lineitem GROUP BY 1, 2) y ON x.s_suppkey = y.l_suppkey AND x.r = y.m NATURAL JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0) z",
    "in_subq": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "not_in_subq": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "exists_corr": "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0)",
    "scalar_subq": "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
    "having_scalar_subq": "SELECT l_suppkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)",
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS bigint) AS q, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_multi_group": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment",
    "agg_implicit_group_empty": "SELECT count(*) AS n FROM orders WHERE o_orderkey < -1 GROUP BY o_orderkey IS NULL",
    "agg_any_all": "SELECT l_orderkey, CAST(bool_or(l_quantity > 40) AS int) AS some, CAST(bool_and(l_quantity > 5) AS int) AS every FROM lineitem GROUP BY l_orderkey",
    "agg_all_equal": "SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) <= 1 AS int) AS all_equal FROM lineitem GROUP BY l_orderkey",
    "agg_all_different": "SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) = count(l_suppkey) AS int) AS all_different FROM lineitem GROUP BY l_orderkey",
    "agg_increasing": "SELECT l_orderkey, CAST(min(CASE WHEN p IS NULL OR p <= l_suppkey THEN 1 ELSE 0 END) AS int) AS increasing FROM (SELECT l_orderkey, l_suppkey, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem) t GROUP BY l_orderkey",
    "agg_scalar_product": "SELECT n_regionkey, CAST(sum(l_quantity * CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS bigint) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey",
    "agg_having_case": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING CASE WHEN user_id % 2 = 0 THEN bool_or(event_type = 'click') ELSE bool_and(value > 1) END",
    "window_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events",
    "check_row": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(l_quantity <= 48, false)",
    "check_group": "SELECT l_suppkey, CAST(sum(l_quantity) AS bigint) AS load FROM lineitem GROUP BY l_suppkey HAVING NOT sum(l_quantity) <= 15000",
    "check_implication": "SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE NOT (s_acctbal > 0 OR l_quantity < 45)",
    "objective_sum": "SELECT CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS bigint) AS objective FROM lineitem",
    "objective_min": "SELECT CAST(min(load) AS bigint) AS objective FROM (SELECT l_suppkey, sum(l_quantity) AS load FROM lineitem GROUP BY l_suppkey) t",
    "view_chain": "WITH load AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey), spare AS (SELECT s_suppkey, s_nationkey, 20000 - coalesce(q, 0) AS left_over FROM supplier LEFT JOIN load ON s_suppkey = l_suppkey) SELECT s_nationkey, CAST(min(left_over) AS bigint) AS spare FROM spare GROUP BY s_nationkey",
    "capacity_maxload": "SELECT CAST(max(d) AS bigint) AS max_load FROM (SELECT l_suppkey, sum(l_quantity) AS d FROM lineitem GROUP BY l_suppkey) t",
    "in_array": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "pk_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "spare_capacity": "SELECT s_suppkey, CAST(20000 - coalesce(q, 0) AS bigint) AS spare FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) a ON s_suppkey = l_suppkey",
    "topology_bounds": "SELECT n_regionkey, n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) a ON n_nationkey = c_nationkey",
    "preempt_union": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority > (SELECT min(o_orderpriority) FROM orders)",
    "scope_topk": "SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) t WHERE r <= 3",
    "scope_union": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) t WHERE r <= 5",
    "batch_limit": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50",
    "latest_by_version": "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1",
    "priority_clamp": "SELECT o_orderkey, least(coalesce(nullif(o_orderkey % 300, 0), 10), 100) AS priority FROM orders",
    "trace_batch_latency": "SELECT event_type, CAST(ts AS date) AS day, count(*) AS n, round(sum(value) / count(*), 4) AS latency FROM events GROUP BY event_type, CAST(ts AS date)",
    "trace_ecdf": "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS ecdf FROM events",
    "trace_mean": "SELECT event_type, round(avg(value), 3) AS mean FROM events GROUP BY event_type",
    "trace_join_params": "SELECT e.event_id, c.c_nationkey, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey",
}

#: name: (Spark SQL, DuckDB SQL).
PAIRS: dict[str, tuple[str, str]] = {
    "int_div_mod": ("SELECT o_orderkey, o_orderkey div 7 AS d, o_orderkey % 7 AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m FROM orders"),
    "in_correlated_or": (
        "SELECT c_custkey FROM customer c WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > c.c_acctbal AND s_nationkey = c.c_nationkey) OR c_mktsegment = 'BUILDING'",
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > c.c_acctbal AND s_nationkey = c.c_nationkey) OR c_mktsegment = 'BUILDING'",
    ),
    "join_array_contains": (
        "SELECT g.n_regionkey, c_custkey FROM (SELECT n_regionkey, explode(keys) AS k FROM (SELECT n_regionkey, collect_set(n_nationkey) AS keys FROM nation GROUP BY n_regionkey)) g JOIN customer ON c_nationkey = k",
        "SELECT g.n_regionkey, c_custkey FROM (SELECT n_regionkey, list(n_nationkey) AS keys FROM nation GROUP BY n_regionkey) g JOIN customer ON list_contains(keys, c_nationkey)",
    ),
    "array_len": (
        "SELECT n_regionkey, CAST(size(collect_list(n_nationkey)) AS bigint) AS n, array_join(array_sort(collect_list(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(len(list(n_nationkey)) AS bigint) AS n, array_to_string(list_sort(list(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey",
    ),
    "window_array_agg": (
        "SELECT n_nationkey, array_join(array_sort(collect_list(n_name) OVER (PARTITION BY n_regionkey)), ',') AS peers FROM nation",
        "SELECT n_nationkey, peers FROM nation JOIN (SELECT n_regionkey AS r, array_to_string(list_sort(list(n_name)), ',') AS peers FROM nation GROUP BY n_regionkey) t ON n_regionkey = r",
    ),
    "tombstone_filter": (
        "SELECT e.event_id FROM events e LEFT ANTI JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') d ON e.user_id = d.user_id AND e.ts > d.ts AND e.ts <= d.ts + INTERVAL 5 MINUTES",
        "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND e.user_id = d.user_id AND e.ts > d.ts AND e.ts <= d.ts + INTERVAL 5 MINUTES)",
    ),
    "epoch_millis": ("SELECT event_id, unix_millis(CAST(ts AS timestamp)) AS ms FROM events", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events"),
    "trace_quantiles": (
        "SELECT event_type, round(percentile(value, 0.01), 6) AS p1, round(percentile(value, 0.25), 6) AS p25, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.75), 6) AS p75, round(percentile(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
        "SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    ),
    "trace_unpivot": (
        "SELECT p_partkey, name, v FROM (SELECT p_partkey, CAST(p_size AS double) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR name IN (size, price))",
        "SELECT p_partkey, 'size' AS name, CAST(p_size AS double) AS v FROM part UNION ALL SELECT p_partkey, 'price' AS name, p_retailprice AS v FROM part",
    ),
    "trace_expand": ("SELECT p_partkey, explode(sequence(1, p_size)) AS i FROM part WHERE p_size > 0", "SELECT p_partkey, CAST(unnest(generate_series(1, p_size)) AS int) AS i FROM part WHERE p_size > 0"),
    "trace_dictionary": (
        "SELECT event_id, dense_rank() OVER (ORDER BY event_type) AS code FROM events",
        "SELECT event_id, code FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM events) t) d USING (event_type)",
    ),
    "trace_scale": ("SELECT event_id, event_id div 100 AS start, round(value / 200, 6) AS mem FROM events WHERE event_id div 100 <= 50", "SELECT event_id, event_id // 100 AS start, round(value / 200, 6) AS mem FROM events WHERE event_id // 100 <= 50"),
}
# A window over the whole table would gather all rows in one task: codes come from the distinct values.
PAIRS["trace_dictionary"] = (PAIRS["trace_dictionary"][1], PAIRS["trace_dictionary"][1])

SPARK: dict[str, str] = SAME | {k: a for k, (a, _) in PAIRS.items()}
DUCKDB: dict[str, str] = SAME | {k: b for k, (_, b) in PAIRS.items()}
