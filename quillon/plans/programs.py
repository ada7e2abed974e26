"""Constraint programs over the star schema, evaluated through the dialect, with DuckDB equivalents."""

from __future__ import annotations

#: name: (statements, the one whose violations or value is returned, ordering key, DuckDB SQL).
PROGRAMS: dict[str, tuple[list[str], str, str | None, str]] = {
    "dialect_row_check": (
        ["create constraint small as select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' check l_quantity <= 45"],
        "small",
        None,
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45",
    ),
    "dialect_group_check": (
        ["create constraint fits as select * from supplier join lineitem on supplier.s_suppkey = lineitem.l_suppkey group by s_suppkey, s_name check sum(l_quantity) <= 15000"],
        "fits",
        None,
        "SELECT s_suppkey, s_name FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name HAVING sum(l_quantity) > 15000",
    ),
    "dialect_aggregates": (
        ["create constraint odd as select * from lineitem group by l_orderkey having count(*) > 1 check all_different(l_suppkey) and any(l_quantity > 10)"],
        "odd",
        None,
        "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 AND NOT (count(DISTINCT l_suppkey) = count(l_suppkey) AND bool_or(l_quantity > 10))",
    ),
    "dialect_increasing": (
        ["create constraint rising as select * from lineitem group by l_orderkey check increasing(l_suppkey)"],
        "rising",
        "struct(l_linenumber, l_partkey, l_suppkey)",
        "SELECT l_orderkey FROM (SELECT l_orderkey, l_suppkey, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem) t GROUP BY l_orderkey HAVING bool_or(p > l_suppkey)",
    ),
    "dialect_view_objective": (
        ["create constraint loads as select l_suppkey, sum(l_quantity) as q from lineitem group by l_suppkey", "create constraint least as select * from loads maximize min(q)"],
        "least",
        None,
        "SELECT CAST(min(q) AS bigint) AS objective FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) t",
    ),
    "dialect_in_subquery": (
        ["create constraint domain as select c_custkey from customer check c_nationkey in (select s_nationkey from supplier where s_acctbal > 3000) or c_acctbal < 0"],
        "domain",
        None,
        "SELECT c_custkey FROM customer WHERE NOT (c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000) OR c_acctbal < 0)",
    ),
}
