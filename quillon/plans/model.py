"""Models: constraint statements over tables with decision columns, grounded by Spark and solved.

A column whose name starts with ``controllable__`` is a decision. ``Model.build`` parses the
statements, finds the tables they read and the decisions among their columns. ``solve`` fetches
the tables and replaces each decision by the name of its variable, so joins, filters and views
carry variables along as ordinary strings. The constant part of each statement (joins, filters,
subqueries, all subexpressions without a decision) runs as Spark SQL; each row or group that comes
out is a ground constraint. Conditions on decisions in WHERE and ON turn into "or else" of a row
check, and into a row's presence in a group.

Variables that share a ground constraint belong to one component; components are found by labels
in Spark and solved side by side (``applyInPandas``). A component, like the largest of a model's
groups, must fit into one task.

Primary keys that hold a decision make it all different, foreign keys are its domain. Decisions
in subqueries, and views that aggregate decisions, are refused with a ModelError.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import solve
from quillon.operators.symbolic import EITHER, FALSE, HIGH, LOW, TRUE, Capacity, Evaluator, Some, Span, both, bounds, either, negation
from quillon.plans import expressions
from quillon.plans.dialect import HARD, OBJECTIVE, VIEW, TABLE_NAME, ModelError, Statement, items_to_spark, join_parts, parse_all, rebound, tables_read, to_spark

DECISION = "controllable__"

class Unsatisfiable(Exception):
    """No assignment meets the hard constraints; ``names`` are some that conflict."""

    def __init__(self, names: list[str]):
        super().__init__(f"these can't hold together: {', '.join(names)}")
        self.names = names


class Undecided(Exception):
    """The search ended at its limit without an assignment."""


@dataclass(frozen=True)
class Options:
    """``steps``: the limit of the search of a component (None: none). ``presence``: a task may lie outside its capacity constraint's domain."""

    steps: int | None = solve.STEPS
    presence: bool = True


@dataclass(frozen=True)
class Keys:
    """Keys of a table, by column names; foreign: column to (table, column)."""

    primary: tuple[str, ...] = ()
    foreign: Mapping[str, tuple[str, str]] = field(default_factory=dict)


class Backend(Protocol):
    """Solves a component: its domains, constraints and objectives to a status and values."""

    def __call__(self, domains: dict, constraints: list[solve.Constraint], objectives: list[solve.Objective], options: Options) -> tuple[str, dict]: ...


def default_backend(domains: dict, constraints: list[solve.Constraint], objectives: list[solve.Objective], options: Options) -> tuple[str, dict]:
    return solve.search(domains, constraints, objectives, options.steps)


class Model:
    """Statements bound to tables; see ``build`` and ``solve``."""

    def __init__(self, spark: SparkSession, statements: dict[str, Statement], tables: list[str], keys: Mapping[str, Keys], backend: Backend, options: Options):
        self.spark, self.statements, self.tables, self.keys, self.backend, self.options = spark, statements, tables, keys, backend, options

    @classmethod
    def build(cls, spark: SparkSession, constraints: list[str], keys: Mapping[str, Keys] | None = None, backend: Backend = default_backend, options: Options = Options(), strict: bool = True) -> Model:
        statements = parse_all(constraints, strict)
        keys = {t.lower(): k for t, k in (keys or {}).items()}
        views = {s.name for s in statements.values() if s.kind == VIEW}
        read = [t for text in constraints for t in tables_read(text) if t not in views]
        tables = list(dict.fromkeys(read))
        tables += [parent for t in list(tables) for parent, _ in (keys[t].foreign.values() if t in keys else ()) if parent not in tables]
        tables = list(dict.fromkeys(tables))
        if not tables:
            raise ModelError("the model reads no table")
        return cls(spark, statements, tables, keys, backend, options)

    def solve(self, wanted: str | Iterable[str] | None = None, fetch: Callable[[str], DataFrame] | None = None) -> dict[str, DataFrame]:
        """Each wanted table (by default those with decisions), by its upper-case name, with its decisions made."""
        ground = Grounding(self, fetch or self.spark.table)
        chosen = ground.chosen()
        names = [wanted] if isinstance(wanted, str) else list(wanted) if wanted is not None else [t for t in self.tables if ground.decisions[t]]
        return {t.upper(): ground.filled(t.lower(), chosen) for t in names}


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets the folder that the session names for checkpoints, a temporary one where it names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillon-"))


class Grounding:
    """One solve: the fetched tables, the ground constraints, and the assignment."""

    def __init__(self, model: Model, fetch: Callable[[str], DataFrame]):
        self.model, self.spark = model, model.spark
        self.mark = uuid.uuid4().hex[:8]
        ensure_checkpoints(self.spark)
        self.frames: dict[str, DataFrame] = {}
        self.decisions: dict[str, list[str]] = {}
        self.views: dict[str, str] = {}
        for t in model.tables:
            # Row numbers must not change between grounding and writing back.
            frame = fetch(t).checkpoint().withColumn("row__id", F.monotonically_increasing_id())
            self.frames[t] = frame
            self.decisions[t] = [c for c in frame.columns if c.lower().startswith(DECISION)]
            shown = [F.concat(F.lit(f"{t}:{c}:"), F.col("row__id").cast("string")).alias(c) if c in self.decisions[t] else F.col(c) for c in frame.columns if c != "row__id"]
            self._register(t, frame.select(*shown))
        self.programs: dict[str, dict] = {}
        grounds = []
        for s in model.statements.values():
            if s.kind == VIEW:
                self._view(s)
            else:
                grounds.append(self._ground(s))
        grounds += [g for t in model.tables for g in self._keys(t)]
        found = grounds[0]
        for g in grounds[1:]:
            found = found.union(g)
        # vars: those of a ground constraint; rows: its slots.
        self.ground = found.withColumn("id", F.monotonically_increasing_id()).checkpoint()

    def _register(self, name: str, df: DataFrame) -> None:
        view = f"q_{self.mark}_{name}"
        df.createOrReplaceTempView(view)
        self.views[name] = view

    def _columns(self, source: str) -> tuple[set[str], set[str]]:
        """Names by which a FROM clause's decisions, and its other columns, may be meant."""
        decisions, plain = set(), set()
        for m in TABLE_NAME.finditer("from " + re.sub(r",", " join ", source)):
            if not m[2]:
                continue
            table, alias = m[2].lower(), (m[3] or m[4] or m[2]).lower()
            for c in self.decisions.get(table, ()):
                decisions |= {c.lower(), f"{alias}.{c.lower()}"}
            if table in self.views:
                plain |= {x for c in self.spark.table(self.views[table]).columns if c not in self.decisions[table] for x in (c.lower(), f"{alias}.{c.lower()}")}
        return decisions, plain

    def _query(self, text: str) -> str:
        """A subquery over the registered tables; it must not read a decision."""
        decisions = {c for t in tables_read(text) for c in self.decisions.get(t, ())}
        if any(re.search(rf"\b{re.escape(c)}\b", text, re.I) for c in decisions):
            raise ModelError(f"a decision in a subquery: {text[:80]}")
        return rebound(text, self.views)

    def _array(self, text: str) -> str:
        """A subquery of one column as an array of its values."""
        m = re.fullmatch(r"\s*select\s+(distinct\s+)?(.+?)\s+(from\b.*)", self._query(text), re.I | re.S)
        if not m:
            raise ModelError(f"not a subquery: {text[:80]}")
        return f"(SELECT collect_set({m[2]}) {m[3]})"

    def _symbolic(self, node: expressions.Node, decisions: set[str], slots: dict[str, str]) -> expressions.Node:
        """The tree with decisions as variables and everything constant as slots, whose SQL ``slots`` collects."""

        def unknown(x: expressions.Node) -> bool:
            return any(y[0] == "col" and y[1].lower() in decisions or y[0] == "call" and y[1] in expressions.AGGREGATES for y in expressions.walk(x))

        def slot(sql: str) -> str:
            known = next((k for k, v in slots.items() if v == sql), None)
            if known is None:
                known = f"s{len(slots)}"
                slots[known] = sql
            return known

        def turn(x: expressions.Node) -> expressions.Node:
            if x[0] in ("lit", "star"):
                return x
            if not unknown(x):
                return ("slot", slot(expressions.to_sql(x, query=self._query)))
            if x[0] == "col":
                return ("var", slot(x[1]))
            if x[0] == "in" and isinstance(x[2], str):
                return ("in", turn(x[1]), ("slot", slot(self._array(x[2]))), x[3])
            if x[0] == "in":
                return ("in", turn(x[1]), [turn(y) for y in x[2]], x[3])
            if x[0] == "call":
                return ("call", x[1], [turn(y) for y in x[2]])
            if x[0] == "op":
                return ("op", x[1], turn(x[2]), turn(x[3]))
            return (x[0], turn(x[1]), *x[2:])

        return turn(node)

    def _skeleton(self, s: Statement) -> tuple[str, list[expressions.Node], set[str]]:
        """FROM and WHERE of the constant part, and the conditions on decisions."""
        decisions, _ = self._columns(s.source)
        pieces, conditions = join_parts(s.source)
        parsed = [c for text in [*conditions, *([s.where] if s.where else [])] for c in expressions.conjuncts(expressions.parse(text))]
        on_decisions = [c for c in parsed if any(x[0] == "col" and x[1].lower() in decisions for x in expressions.walk(c))]
        constant = [c for c in parsed if c not in on_decisions]
        tables = rebound("from " + " join ".join(pieces), self.views)[5:]
        where = f" WHERE {expressions.to_sql(expressions.conjunction(constant), query=self._query)}" if constant else ""
        return tables + where, on_decisions, decisions

    def _ground(self, s: Statement) -> DataFrame:
        skeleton, on_decisions, decisions = self._skeleton(s)
        slots: dict[str, str] = {}
        check = self._symbolic(expressions.parse(s.expression), decisions, slots)
        presence = self._symbolic(expressions.conjunction(on_decisions), decisions, slots) if on_decisions else None
        having = self._symbolic(expressions.parse(s.having), decisions, slots) if s.having else None
        self.programs[s.name] = {"kind": s.kind, "grouped": s.grouped, "check": check, "presence": presence, "having": having}
        variables = [k for k, sql in slots.items() if sql.lower() in decisions]
        keys = [k.strip() for k in s.group.split(",")] if s.group else ["1"] if s.grouped else []
        columns = [f"{sql} AS {k}" for k, sql in slots.items()] + [f"{k} AS k{i}" for i, k in enumerate(keys)]
        rows = self.spark.sql(f"SELECT {', '.join(columns) or '1 AS none'} FROM {skeleton}")
        names = F.array(*(F.col(v) for v in variables)) if variables else F.array().cast("array<string>")
        rows = rows.select(F.lit(s.name).alias("name"), F.to_json(F.struct(*slots)).alias("slots") if slots else F.lit("{}").alias("slots"), F.array_compact(names).alias("vars"), *(f"k{i}" for i in range(len(keys))))
        if not s.grouped:
            return rows.select("name", F.array("slots").alias("rows"), "vars")
        by = [f"k{i}" for i in range(len(keys))]
        return rows.groupBy("name", *by).agg(F.sort_array(F.collect_list("slots")).alias("rows"), F.array_distinct(F.flatten(F.collect_list("vars"))).alias("vars")).select("name", "rows", "vars")

    def _view(self, s: Statement) -> None:
        """A view keeps decisions that it names; it may not compute with them."""
        if s.name in self.model.tables:
            raise ModelError(f"the view {s.name} has the name of a table")
        skeleton, on_decisions, decisions = self._skeleton(s)
        if on_decisions:
            raise ModelError(f"the view {s.name} filters by a decision")
        kept = []
        for item in re.split(r",(?![^()]*\))", s.items):
            m = re.fullmatch(r"\s*(.+?)(?:\s+as\s+(\w+))?\s*", item, re.I | re.S)
            names = [x[1].lower() for x in expressions.walk(expressions.parse(m[1])) if x[0] == "col"] if m[1] != "*" and not m[1].endswith(".*") else []
            if any(n in decisions for n in names):
                if len(names) > 1 or not re.fullmatch(r"[\w.]+", m[1]):
                    raise ModelError(f"the view {s.name} computes with a decision")
                kept.append(m[2] or m[1].rpartition(".")[2])
        group = f" GROUP BY {s.group}" if s.group else ""
        having = f" HAVING {to_spark(s.having)}" if s.having else ""
        frame = self.spark.sql(f"SELECT {items_to_spark(s.items)} FROM {skeleton}{group}{having}")
        starred = [c for c in frame.columns if c.lower() in decisions]
        self._register(s.name, frame)
        self.decisions[s.name] = list(dict.fromkeys(kept + starred))

    def _keys(self, table: str) -> list[DataFrame]:
        """Ground constraints of the table's keys."""
        keys, found = self.model.keys.get(table), []
        if not keys:
            return found
        mine = {c.lower() for c in self.decisions[table]}
        view = self.views[table]
        in_key = [c for c in keys.primary if c.lower() in mine]
        if len(in_key) == 1:
            name = f"{table}.primary key"
            self.programs[name] = {"kind": HARD, "grouped": True, "check": ("call", "all_different", [("var", "s0")]), "presence": None, "having": None}
            rest = [c for c in keys.primary if c.lower() not in mine]
            rows = self.spark.table(view).select(F.lit(name).alias("name"), F.to_json(F.struct(F.col(in_key[0]).alias("s0"))).alias("slots"), F.col(in_key[0]).alias("v"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(rest)))
            found.append(rows.groupBy("name", *(f"k{i}" for i in range(len(rest)))).agg(F.sort_array(F.collect_list("slots")).alias("rows"), F.collect_set("v").alias("vars")).select("name", "rows", "vars"))
        for column, (parent, target) in keys.foreign.items():
            if column.lower() not in mine:
                continue
            name = f"{table}.{column} foreign key"
            check = ("in", ("var", "s0"), ("slot", "s1"), False) if target not in self.decisions[parent] else None
            if check is None:
                raise ModelError(f"{name}: the referenced column is a decision")
            self.programs[name] = {"kind": HARD, "grouped": False, "check": check, "presence": None, "having": None}
            sql = f"SELECT {column} AS s0, (SELECT collect_set({target}) FROM {self.views[parent]}) AS s1 FROM {view}"
            rows = self.spark.sql(sql).select(F.lit(name).alias("name"), F.array(F.to_json(F.struct("s0", "s1"))).alias("rows"), F.array("s0").alias("vars"))
            found.append(rows)
        return found

    def _components(self) -> DataFrame:
        """(var, component): the least variable that is linked with it through ground constraints."""
        edges = self.ground.where(F.size("vars") > 1).select(F.explode("vars").alias("var"), F.array_min("vars").alias("hub")).where("var <> hub").distinct()
        both_ways = edges.union(edges.select(F.col("hub").alias("var"), F.col("var").alias("hub"))).checkpoint()
        every = None
        for t, columns in self.decisions.items():
            if t in self.frames:
                for c in columns:
                    one = self.spark.table(self.views[t]).select(F.col(c).alias("var"))
                    every = one if every is None else every.union(one)
        if every is None:
            raise ModelError("the model has no decision column")
        labels = every.select("var", F.col("var").alias("component"))
        while True:
            near = both_ways.join(labels.select(F.col("var").alias("hub"), "component"), "hub").groupBy("var").agg(F.min("component").alias("near"))
            better = labels.join(near, "var", "left").select("var", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was")).checkpoint()
            labels = better.select("var", "component")
            if better.where("component <> was").isEmpty():
                return labels

    def chosen(self) -> DataFrame:
        """(var, value as JSON): the assignment. Raises Unsatisfiable or Undecided."""
        labels = self._components()
        constant = self.ground.where(F.size("vars") == 0).select(F.lit("").alias("component"), "id", "name", "rows", F.lit(None).cast("string").alias("var"))
        grounds = self.ground.where(F.size("vars") > 0).withColumn("var", F.array_min("vars")).join(labels, "var").select("component", "id", "name", "rows", F.lit(None).cast("string").alias("var"))
        variables = labels.select("component", F.lit(-1).cast("long").alias("id"), F.lit("").alias("name"), F.array().cast("array<string>").alias("rows"), "var")
        types = {f"{t}:{c}": f.dataType.simpleString() for t, df in self.frames.items() for c in self.decisions[t] for f in df.schema.fields if f.name == c}
        programs, backend, options = self.programs, self.model.backend, self.model.options

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            status, values, names = solve_component(pdf, programs, types, backend, options)
            rows = [(status, ",".join(names), n, json.dumps(v)) for n, v in sorted(values.items())] or [(status, ",".join(names), None, None)]
            return pd.DataFrame(rows, columns=["status", "names", "var", "value"])

        found = grounds.union(constant).union(variables).groupBy("component").applyInPandas(run, "status string, names string, var string, value string").checkpoint()
        failed = found.where(F.col("status") == solve.INFEASIBLE).select("names").distinct().orderBy("names").limit(100).collect()
        if failed:
            raise Unsatisfiable(sorted({n for r in failed for n in r.names.split(",") if n}))
        if not found.where(F.col("status") == solve.UNKNOWN).isEmpty():
            raise Undecided(f"no assignment within {options.steps} steps")
        return found.where("var IS NOT NULL").select("var", "value")

    def filled(self, table: str, chosen: DataFrame) -> DataFrame:
        frame = self.frames[table]
        for c in self.decisions[table]:
            own = chosen.where(F.col("var").startswith(f"{table}:{c}:")).select(F.substring_index("var", ":", -1).cast("long").alias("row__id"), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("value__"))
            kind = frame.schema[c].dataType
            frame = frame.join(own, "row__id").withColumn(c, F.col("value__").cast(kind)).drop("value__")
        return frame.drop("row__id")


def _parsed_rows(texts: Iterable[str]) -> list[dict]:
    return [json.loads(t) for t in texts]


def _capacity(check: expressions.Node, rows: list[dict]) -> Capacity | None:
    """The capacity constraint that a check is, if it is one."""
    if check[0] == "op" and check[1] == "=" and check[3] == ("lit", True):
        check = check[2]
    if check[:2] != ("call", "capacity_constraint"):
        return None
    var, place, demand, most = check[2]
    known = lambda node, row: node[1] if node[0] == "lit" else row.get(node[1])
    return Capacity({r[var[1]]: known(demand, r) for r in rows}, {known(place, r): known(most, r) for r in rows})


def _literals(node, found: set) -> set:
    if isinstance(node, tuple) and node and node[0] == "lit":
        found.add(node[1])
    elif isinstance(node, (tuple, list)):
        for x in node:
            _literals(x, found)
    return found


def solve_component(pdf: pd.DataFrame, programs: Mapping[str, dict], types: Mapping[str, str], backend: Backend, options: Options) -> tuple[str, dict, list[str]]:
    """(status, values, names of conflicting constraints) of a component's variables and ground constraints."""
    variables = sorted(v for v in pdf["var"] if v is not None and v == v)
    grounds = [(name, _parsed_rows(rows)) for name, rows in pdf.loc[pdf["id"] >= 0].sort_values(["name", "id"])[["name", "rows"]].itertuples(index=False)]
    # Texts are chosen among those that the component's constraints mention.
    texts = {v for _, rows in grounds for r in rows for x in r.values() for v in (x if isinstance(x, list) else [x]) if isinstance(v, str)}
    texts |= {v for name, _ in grounds for v in _literals([programs[name]["check"], programs[name]["presence"]], set()) if isinstance(v, str)}
    texts -= set(variables)
    domains: dict[str, Some | Span] = {}
    for v in variables:
        kind = types[v.rpartition(":")[0]]
        domains[v] = Some(texts or {""}) if kind == "string" else Some([False, True]) if kind == "boolean" else (LOW, HIGH)
    constraints: list[solve.Constraint] = []
    objectives: list[solve.Objective] = []
    for name, rows in grounds:
        program = programs[name]
        used = tuple(sorted({x for r in rows for x in r.values() if isinstance(x, str) and x in domains}))
        if (capacity := _capacity(program["check"], rows)) is not None:
            constraints.append(solve.Constraint(name, used, capacity.holds))
            objectives.append(solve.Objective(used, capacity.gain))
            if not options.presence:
                inside = Some(capacity.capacity)
                constraints += [solve.Constraint(name, (v,), lambda d, v=v, inside=inside: Some([True]) if isinstance(d[v], Some) and d[v] <= inside else FALSE if isinstance(d[v], Some) and not d[v] & inside else EITHER) for v in used]
            continue
        value = _valued(program, rows)
        if program["kind"] == OBJECTIVE:
            objectives.append(solve.Objective(used, lambda d, value=value: bounds(value(Evaluator(d)))))
        else:
            constraints.append(solve.Constraint(name, used, lambda d, value=value: value(Evaluator(d))))
    status, values = backend(domains, constraints, objectives, options)
    names = solve.core(domains, constraints, options.steps) if status == solve.INFEASIBLE else []
    return status, values, names


def _valued(program: dict, rows: list[dict]) -> Callable[[Evaluator], Some | Span]:
    """A ground check's truth, or a ground objective's value, under domains."""
    check, presence, having, hard = program["check"], program["presence"], program["having"], program["kind"] == HARD

    def single(e: Evaluator) -> Some | Span:
        row = rows[0]
        there = e.value(presence, row) if presence else TRUE
        if there <= Some([False, None]):
            return TRUE if hard else Some([0])
        found = e.value(check, row)
        if hard:
            return found if there == TRUE else either(Some(x is not True for x in there), found)
        if there == TRUE:
            return found
        low, high = bounds(found)
        return min(0, low), max(0, high)

    def group(e: Evaluator) -> Some | Span:
        there = [(r, e.value(presence, r) if presence else TRUE) for r in rows]
        there = [(r, Some(x is True for x in p)) for r, p in there]
        found = e.value(check, rows[0], there)
        if having is None:
            return found
        asked = e.value(having, rows[0], there)
        if hard:
            return either(Some(x is not True for x in asked), found)
        low, high = bounds(found)
        return (low, high) if asked == TRUE else Some([0]) if True not in asked else (min(0, low), max(0, high))

    return group if program["grouped"] else single
