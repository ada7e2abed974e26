import pytest
from pyspark.sql import functions as F

from quillon.plans import policies, scheduler, scope
from quillon.plans.dialect import parse_all

SHORT = ("somewhere", "domain", "capacity")
SCHEMAS = {
    "nodes": "node long, ready boolean",
    "tasks": "task long, node long, status string, priority int, requeued long",
    "node_labels": "subject long, key string, value long",
    "task_labels": "subject long, key string, value long",
    "expressions": "expr long, key string, op string",
    "expression_values": "expr long, value long",
    "terms": "task long, term int, expr long",
    "peer_terms": "task long, term int, expr long",
    "ports": "task long, ip string, port long, protocol string",
    "demands": "task long, resource string, demand int",
    "capacities": "node long, resource string, allocatable int",
    "taints": "node long, key string, value long, effect string",
    "tolerations": "task long, key string, op string, value long, effect string",
    "spreads": "task long, grp long, key string, max_skew int",
}


def frames(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


def waiting(ids, priority=1):
    return [(t, None, "Pending", priority, 0) for t in ids]


def test_bounds_of_decisions():
    texts = [
        "create constraint a as select * from p check controllable__n in (select s.node from spare as s where s.capacity > 0) or p.controllable__n = -1",
        "create constraint b as select * from p where controllable__n in (select node from picked) check p.x = 1",
        "create constraint c as select * from p check controllable__n not in (select node from bad) and controllable__m in (select controllable__n from p) and controllable__n in (1, 2)",
    ]
    assert scope.bounds(parse_all(texts).values()) == {"controllable__n": {"spare": "node", "picked": "node"}}
    all_texts = [s for p in scheduler.INITIAL for s in policies.POLICIES[p]]
    assert scope.bounds(parse_all(all_texts).values()) == {"controllable__node": {"spare": "node", "selected": "node", "tolerating": "node"}}


@pytest.mark.parametrize("scoping", [False, True])
def test_drains_batches_and_queues_again(spark, tmp_path, scoping):
    tables = frames(
        spark, nodes=[(1, True), (2, True), (3, False)], tasks=waiting(range(10, 15)),
        demands=[(t, "cpu", 1) for t in range(10, 15)], capacities=[(1, "cpu", 2), (2, "cpu", 2), (3, "cpu", 9)],
    )
    run = scheduler.Scheduler(spark, tables, scheduler.TableBinder(str(tmp_path)), SHORT, ("preemption", *SHORT), limit=3, scoping=scoping)
    assert len(run.drain(5000)) == 2 and run.drain(5500) == []
    rows = {r.task: r for r in run.tasks().collect()}
    assert sorted(r.node for r in rows.values() if r.node) == [1, 1, 2, 2]
    (left,) = [r for r in rows.values() if r.node is None]
    assert left.status == "Pending" and left.requeued == 5000
    found = spark.read.parquet(str(tmp_path)).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in found} == {"ASSIGNED": 4, "UNASSIGNED": 1}
    assert len(run.drain(6000)) == 1


def test_preempts_lower_priorities(spark, tmp_path):
    tables = frames(
        spark, nodes=[(1, True)], tasks=[(1, 1, "Running", 1, 0), (2, 1, "Running", 9, 0), *waiting([3], 5)],
        demands=[(t, "cpu", 1) for t in (1, 2, 3)], capacities=[(1, "cpu", 2)],
    )
    run = scheduler.Scheduler(spark, tables, scheduler.TableBinder(str(tmp_path)), SHORT, ("preemption", *SHORT))
    (line,) = run.drain(5000)
    assert line["preempt"] == 1 and line["assigned"] == 1 and line["unassigned"] == 0
    assert {r.task: r.node for r in run.tasks().collect()} == {1: None, 2: 1, 3: 1}


def test_taints_and_selectors_hold(spark, tmp_path):
    tables = frames(
        spark, nodes=[(1, True), (2, True), (4, True)], tasks=waiting([5, 6]), demands=[(5, "cpu", 1), (6, "cpu", 1)],
        capacities=[(n, "cpu", 9) for n in (1, 2, 4)], taints=[(1, "k", 1, "NoSchedule"), (2, "k", 1, "NoSchedule")],
        tolerations=[(5, "k", "Exists", None, None)], node_labels=[(2, "zone", 7), (4, "zone", 8)],
        expressions=[(1, "zone", "In")], expression_values=[(1, 7)], terms=[(5, 0, 1)],
    )
    run = scheduler.Scheduler(spark, tables, scheduler.TableBinder(str(tmp_path)), scoping=True)
    run.drain(5000)
    assert {r.task: r.node for r in run.tasks().collect()} == {5: 2, 6: 4}


def test_call_binder_and_command_line(spark, tmp_path, capsys):
    seen = spark.sparkContext.accumulator(0)
    tables = frames(spark, nodes=[(1, True)], tasks=waiting([1]), demands=[(1, "cpu", 1)], capacities=[(1, "cpu", 1)])
    scheduler.Scheduler(spark, tables, scheduler.CallBinder(lambda outcome, row: seen.add(row.task if outcome == "ASSIGNED" else 100)), SHORT).drain(5000)
    assert seen.value == 1
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    scheduler.main([str(tmp_path), str(tmp_path / "out"), "--policies", "somewhere", "domain", "capacity"])
    assert '"assigned": 1' in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out" / "tasks")).where(F.col("node") == 1).count() == 1
