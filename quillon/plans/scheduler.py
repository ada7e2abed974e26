"""The placement scheduler: drains pending tasks in batches by solved models, and hands each outcome to a binder.

A drain has one time: a task that stays without a node is queued again at that time, so it is
not pending before ``wait`` has passed and every drain ends. The tasks' table isn't rewritten by a
batch; decisions are kept beside it, one row a task. A batch is bounded by ``limit``; a preemption
also solves over the placed tasks of lower priority than the batch's highest, which must fit into
one component's task (see ``model``). Scoping narrows the first solve of a batch alone: what it leaves
without a node is solved again over all nodes, with preemption.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon.functions import placement
from quillon.operators import cluster
from quillon.plans import policies, scope
from quillon.plans.dialect import parse_all
from quillon.plans.model import Model, Options, ensure_checkpoints

#: Policies that solved models may use; "spread" aggregates decisions in a view and can only be evaluated.
INITIAL = ("somewhere", "domain", "selector", "affinity", "anti_affinity", "anti_affinity_pending", "capacity", "taints", "ports", "ports_pending")
PREEMPTION = ("preemption", *INITIAL)
#: The cluster's tables, as in ``cluster``.
TABLES = ("nodes", "tasks", "node_labels", "task_labels", "expressions", "expression_values", "terms", "peer_terms", "ports", "demands", "capacities", "taints", "tolerations", "spreads")
_MOVES = "task long, node long, requeued long"


class Binder(Protocol):
    """Takes the rows (task, current, node) of a batch by their outcome."""

    def bind(self, rows: DataFrame, batch: int) -> None: ...

    def unbind(self, rows: DataFrame, batch: int) -> None: ...

    def fail(self, rows: DataFrame, batch: int) -> None: ...


@dataclass(frozen=True)
class TableBinder:
    """Appends outcomes as Parquet below ``path``, by batch and outcome; a batch may bind twice, before preemption and after it."""

    path: str

    def _write(self, rows: DataFrame, batch: int, outcome: str) -> None:
        rows.write.mode("append").parquet(f"{self.path}/batch={batch}/outcome={outcome}")

    def bind(self, rows: DataFrame, batch: int) -> None:
        self._write(rows, batch, "ASSIGNED")

    def unbind(self, rows: DataFrame, batch: int) -> None:
        self._write(rows, batch, "PREEMPT")

    def fail(self, rows: DataFrame, batch: int) -> None:
        self._write(rows, batch, "UNASSIGNED")


@dataclass(frozen=True)
class CallBinder:
    """Calls ``action(outcome, row)`` for each row on the executors; an action may be repeated and must allow that."""

    action: Callable[[str, Row], None]

    def _each(self, rows: DataFrame, outcome: str) -> None:
        action = self.action

        def part(found: Iterable[Row]) -> None:
            for row in found:
                action(outcome, row)

        rows.foreachPartition(part)

    def bind(self, rows: DataFrame, batch: int) -> None:
        self._each(rows, "ASSIGNED")

    def unbind(self, rows: DataFrame, batch: int) -> None:
        self._each(rows, "PREEMPT")

    def fail(self, rows: DataFrame, batch: int) -> None:
        self._each(rows, "UNASSIGNED")


@dataclass
class Scheduler:
    """``frames``: the cluster's tables by name. ``history`` has one entry a batch: outcomes and seconds."""

    spark: SparkSession
    frames: dict[str, DataFrame]
    binder: Binder
    initial: tuple[str, ...] = INITIAL
    preemption: tuple[str, ...] = PREEMPTION
    limit: int = 50
    wait: int = 1000
    scoping: bool = False
    options: Options = Options()
    history: list[dict] = field(default_factory=list)
    moves: DataFrame | None = None

    def tasks(self) -> DataFrame:
        """The tasks with all decisions so far."""
        base = self.frames["tasks"]
        if self.moves is None:
            return base
        moved = self.moves.toDF("task", "m_node", "m_requeued").withColumn("m_is", F.lit(True))
        kept = {"node": F.when(F.col("m_is"), F.col("m_node")).otherwise(F.col("node")), "requeued": F.coalesce("m_requeued", "requeued")}
        kept["status"] = F.when(F.col("m_is"), F.when(F.col("m_node").isNull(), "Pending").otherwise("Running")).otherwise(F.col("status"))
        return base.join(moved, "task", "left").withColumns(kept).select(*base.columns)

    def _keep(self, rows: DataFrame) -> None:
        """Later decisions of a task replace earlier ones."""
        rows = rows.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in _MOVES.split(", ")))
        before = rows if self.moves is None else self.moves.join(rows, "task", "left_anti").unionByName(rows)
        self.moves = before.checkpoint()

    def _solve(self, names: tuple[str, ...], chosen: DataFrame, fixed: DataFrame, tasks: DataFrame, scoping: bool = False) -> DataFrame:
        """(task, current, node, outcome) of the chosen tasks."""
        current = F.col("node") if "node" in chosen.columns else F.lit(None)
        placements = chosen.select("task", "priority", F.lit(0).alias("equivalence"), current.cast("long").alias("current"), F.lit(None).cast("long").alias(f"{scope.DECISION}node"))
        frames = policies.tables({**self.frames, "tasks": tasks, "chosen": chosen, "fixed": fixed}) | {"placements": placements}
        texts = [s for p in names for s in policies.POLICIES[p]]
        if scoping:
            frames["spare"] = scope.scoped(parse_all(texts).values(), f"{scope.DECISION}node", "spare", frames, chosen.count())
        solved = Model.build(self.spark, texts, options=self.options).solve("placements", frames.__getitem__)["PLACEMENTS"]
        node = F.nullif(F.col(f"{scope.DECISION}node"), F.lit(policies.NOWHERE))
        return solved.select("task", "current", node.alias("node")).withColumn("outcome", placement.outcome(F.col("current"), F.col("node"))).checkpoint()

    def _hand_over(self, found: DataFrame, outcome: str, give: Callable[[DataFrame, int], None], batch: int) -> DataFrame:
        rows = found.where(F.col("outcome") == outcome).select("task", "current", "node")
        give(rows, batch)
        return rows

    def _batch(self, chosen: DataFrame, now: int) -> None:
        began, batch = time.time(), len(self.history) + 1
        tasks = self.tasks()
        found = self._solve(self.initial, chosen, cluster.placed(tasks), tasks, self.scoping)
        counts = {r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()}
        if counts.get("ASSIGNED"):
            rows = self._hand_over(found, "ASSIGNED", self.binder.bind, batch)
            self._keep(rows.select("task", "node", F.lit(None).alias("requeued")))
        if counts.get("UNASSIGNED"):
            tasks = self.tasks()
            left = chosen.join(found.where("outcome = 'UNASSIGNED'").select("task"), "task", "left_semi")
            fixed = cluster.preemption_fixed(tasks, left)
            again = self._solve(self.preemption, cluster.preemption_free(tasks, left), fixed, fixed)
            counts["UNASSIGNED"] = 0
            for r in again.groupBy("outcome").count().collect():
                counts[r.outcome] = counts.get(r.outcome, 0) + r["count"]
            if counts.get("PREEMPT"):
                self._hand_over(again, "PREEMPT", self.binder.unbind, batch)
            if not (late := again.where("outcome = 'ASSIGNED'").select("task", "current", "node")).isEmpty():
                self.binder.bind(late, batch)
            if counts["UNASSIGNED"]:
                self._hand_over(again, "UNASSIGNED", self.binder.fail, batch)
            changed = again.where("outcome <> 'UNCHANGED'")
            self._keep(changed.select("task", "node", F.when(F.col("node").isNull(), F.lit(now)).alias("requeued")))
        self.history.append({"batch": batch, "seconds": round(time.time() - began, 3)} | {k.lower(): n for k, n in counts.items()})

    def drain(self, now: int) -> list[dict]:
        """Places batches until no task is pending at ``now`` (milliseconds); the history of these batches."""
        ensure_checkpoints(self.spark)
        first = len(self.history)
        while True:
            chosen = cluster.batch(cluster.pending(self.tasks(), now, self.wait), self.limit).checkpoint()
            if chosen.isEmpty():
                return self.history[first:]
            self._batch(chosen, now)


def main(argv: list[str] | None = None) -> None:
    """Drains a cluster whose tables are Parquet files, and prints a line of JSON for each batch."""
    parser = argparse.ArgumentParser(prog="python -m quillon.plans.scheduler", description=main.__doc__)
    parser.add_argument("tables", help="folder with a Parquet table for each of " + ", ".join(TABLES))
    parser.add_argument("out", help="folder for the outcomes and the tasks' final table")
    parser.add_argument("--policies", nargs="*", default=list(INITIAL), choices=INITIAL, metavar="POLICY")
    parser.add_argument("--limit", type=int, default=50, help="tasks of a batch")
    parser.add_argument("--wait", type=int, default=1000, help="milliseconds before a task is tried again")
    parser.add_argument("--retries", type=int, default=0, help="further drains, a wait apart")
    parser.add_argument("--steps", type=int, default=Options().steps, help="limit of a component's search")
    parser.add_argument("--scope", action="store_true", help="solve over the nodes that the policies name and the largest")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    frames = {t: spark.read.parquet(f"{given.tables}/{t}.parquet") for t in TABLES}
    names = tuple(given.policies)
    run = Scheduler(spark, frames, TableBinder(f"{given.out}/outcomes"), names, ("preemption", *names), given.limit, given.wait, given.scope, Options(given.steps))
    for n in range(given.retries + 1):
        if n:
            time.sleep(given.wait / 1000)
        for line in run.drain(int(time.time() * 1000)):
            print(json.dumps(line))
    run.tasks().write.mode("overwrite").parquet(f"{given.out}/tasks")


if __name__ == "__main__":
    main()
