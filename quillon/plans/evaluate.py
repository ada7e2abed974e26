"""Evaluation of a constraint program over known assignments: violations and objective values."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import expressions
from quillon.plans.dialect import HARD, OBJECTIVE, VIEW, ModelError, Statement, items_to_spark, join_parts, rebound, source_to_spark, to_spark

Query = Callable[[str], str]


def _same(text: str) -> str:
    return text


def _where(*conditions: str | None) -> str:
    found = [f"({c})" for c in conditions if c]
    return " WHERE " + " AND ".join(found) if found else ""


def _capacity(s: Statement) -> list[str] | None:
    """The arguments of a check that is capacity_constraint(...), alone or compared with true."""
    tree = expressions.parse(s.expression) if "capacity_constraint" in s.expression.lower() else ("lit", True)
    if tree[0] == "op" and tree[1] == "=" and tree[3] == ("lit", True):
        tree = tree[2]
    if tree[:2] == ("call", "capacity_constraint"):
        return [expressions.to_sql(x) for x in tree[2]]
    if any(x[:2] == ("call", "capacity_constraint") for x in expressions.walk(tree)):
        raise ModelError(f"capacity_constraint must be the whole check of {s.name}")
    return None


def violations_sql(s: Statement, order: str | None = None, query: Query = _same) -> str:
    """The rows, or groups, for which the check of a hard constraint doesn't hold.

    A capacity constraint gives its group, the place that holds too much, and its load.
    """
    source, where = source_to_spark(s.source, query), to_spark(s.where, query=query) if s.where else None
    if (capacity := _capacity(s)) is not None:
        var, place, demand, most = capacity
        keys = [k.strip() for k in s.group.split(",")] if s.group else []
        return f"SELECT {', '.join([*keys, f'{place} AS place', f'sum({demand}) AS load'])} FROM {source}{_where(where, f'{var} = {place}')} GROUP BY {', '.join([*keys, place])} HAVING sum({demand}) > max({most})"
    previous: list[str] = []

    def increasing(x: str) -> str:
        previous.append(x)
        return f"bool_and(previous__{len(previous)} IS NULL OR {x} IS NULL OR previous__{len(previous)} <= {x})"

    if not s.grouped:
        check = f"NOT coalesce({to_spark(s.expression, order, query)}, false)"
        return f"SELECT {items_to_spark(s.items, query)} FROM {source}{_where(where, check)}"
    # Neighbours by a window keep groups out of arrays; over joins, column names could clash there.
    by_window = increasing if order and s.group and len(join_parts(s.source)[0]) == 1 else None
    check = f"NOT coalesce({to_spark(s.expression, order, query, by_window)}, false)"
    # Without rows there is no group, so a single implicit group is a grouping by a constant.
    shown, grouping = (s.group, s.group) if s.group else ("'all' AS the_group", "'all'")
    having = f"({to_spark(s.having, order, query, by_window)}) AND {check}" if s.having else check
    if previous:
        lags = ", ".join(f"lag({x}) IGNORE NULLS OVER (PARTITION BY {s.group} ORDER BY {order}) AS previous__{i + 1}" for i, x in enumerate(previous))
        source, where = f"(SELECT *, {lags} FROM {source}{_where(where)}) AS {join_parts(s.source)[0][0].split()[-1]}", None
    return f"SELECT {shown} FROM {source}{_where(where)} GROUP BY {grouping} HAVING {having}"


def objective_sql(s: Statement, query: Query = _same) -> str:
    """The summed value of an objective; booleans count as 0 or 1."""
    value, source, where = to_spark(s.expression, query=query), source_to_spark(s.source, query), to_spark(s.where, query=query) if s.where else None
    if not s.grouped:
        return f"SELECT coalesce(sum(CAST(({value}) AS bigint)), 0) AS objective FROM {source}{_where(where)}"
    grouping = s.group or "'all'"
    having = f" HAVING {to_spark(s.having, query=query)}" if s.having else ""
    return f"SELECT coalesce(sum(v), 0) AS objective FROM (SELECT CAST(({value}) AS bigint) AS v FROM {source}{_where(where)} GROUP BY {grouping}{having})"


def view_sql(s: Statement, query: Query = _same) -> str:
    grouping = f" GROUP BY {s.group}" if s.group else " GROUP BY 'all'" if s.grouped else ""
    having = f" HAVING {to_spark(s.having, query=query)}" if s.having else ""
    return f"SELECT {items_to_spark(s.items, query)} FROM {source_to_spark(s.source, query)}{_where(to_spark(s.where, query=query) if s.where else None)}{grouping}{having}"


class Evaluation:
    """Violations of each hard constraint and values of each objective, over the session's views.

    The program's own views get names of their own, so no view of the session is replaced.
    """

    def __init__(self, spark: SparkSession, statements: dict[str, Statement], order: str | None = None):
        self.spark, self.statements = spark, statements
        names: dict[str, str] = {}
        query = lambda text: rebound(text, names)
        for s in statements.values():
            if s.kind == VIEW:
                own = f"view_{uuid.uuid4().hex[:8]}_{s.name}"
                spark.sql(view_sql(s, query)).createOrReplaceTempView(own)
                names[s.name] = own
        self.violations: dict[str, DataFrame] = {s.name: spark.sql(violations_sql(s, order, query)) for s in statements.values() if s.kind == HARD}
        self.objectives: dict[str, DataFrame] = {s.name: spark.sql(objective_sql(s, query)) for s in statements.values() if s.kind == OBJECTIVE}

    def total(self) -> DataFrame:
        """One row: the sum of all objectives."""
        found = None
        for df in self.objectives.values():
            found = df if found is None else found.union(df)
        if found is None:
            return self.spark.sql("SELECT CAST(0 AS bigint) AS objective")
        return found.selectExpr("coalesce(sum(objective), 0) AS objective")

    def summary(self) -> DataFrame:
        """One row per statement: its name, kind, and number of violations or value."""
        rows = [df.selectExpr(f"'{n}' AS name", "'hard' AS kind", "1 AS v").groupBy("name", "kind").agg({"v": "sum"}).toDF("name", "kind", "value") for n, df in self.violations.items()]
        rows += [df.selectExpr(f"'{n}' AS name", "'objective' AS kind", "objective AS value") for n, df in self.objectives.items()]
        found = rows[0]
        for r in rows[1:]:
            found = found.union(r)
        return found


def orphans(child: DataFrame, column: str, parent: DataFrame, target: str) -> DataFrame:
    """Rows of ``child`` whose foreign key ``column`` no row of ``parent`` has; null refers to nothing."""
    known = parent.select(parent[target].alias(column)).distinct()
    return child.where(child[column].isNotNull()).join(known, column, "left_anti")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Values of a primary key that several rows have, and how many (``n``)."""
    return df.groupBy(*key).count().withColumnRenamed("count", "n").where("n > 1")
