from quillon.sources import logs, tables

LOG = """\
x Fetchcount is 12
t a b c d e updateDataFields for pods took 100 to db and then further time of it 40 ns
no words that count
1 2 3 4 5 6 compiler.updateData() 900ns
1 2 3 Model creation: 55 ns
1 2 3 Model creation: 66 println
#Variables: 10 (3 in objective)
Starting Search at 0.25s
#Variables: 7 (2 in objective)
propagations: 5
integer_propagations: 6
walltime: 0.5
usertime: 0.75
scope fraction: 0.4
1 2 3 4 5 Solver has run successfully in 777ns.
Scheduling decision for pod p1 as part of batch 1 made in time: 1000
Scheduling decision for pod p2 as part of batch 1 made in time: 1000
x Fetchcount is 3
Scope filtering latency: 88ns.
scope fraction: 0.9
1 2 3 4 5 Solver has run successfully in 111ns.
Scheduling decision for pod p3 as part of batch 2 made in time: 2000
"""
PAIRS = """\
2024-01-02T03:04:05.1Z About to try and schedule pod space/a
2024-01-02T03:04:05.5Z About to try and schedule pod space/a
2024-01-02T03:04:05.4Z About to try and schedule pod space/b
2024-01-02T03:04:06Z Attempting to bind b to n1
2024-01-02T03:04:07.25Z Attempting to bind a to n2
"""


def test_logs_become_tables(spark, tmp_path):
    for name in ("41", "42"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata").write_text("workload,solver\nsmall,one\n")
        (tmp_path / name / "trace_log").write_text(LOG)
    (tmp_path / "41" / "paired_log").write_text(PAIRS)
    (tmp_path / "41" / "workload_output").write_text("[x] org.some.WorkloadGeneratorIT - At 120, x for PodName: p1, on n1, is Running, by ADDED \nWorkloadGeneratorIT but no name\n")
    root = str(tmp_path)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(logs.params(spark, root)) == [("41", "small", "one"), ("42", "small", "one")]
    assert rows(logs.decisions(spark, root, "trace_log").where("experiment = '41'")) == [("41", "p1", 1, 1000.0), ("41", "p2", 1, 1000.0), ("41", "p3", 2, 2000.0)]
    assert rows(logs.scope_fractions(spark, root, "trace_log"))[:2] == [("41", 1, 0.4), ("41", 2, 0.9)]
    assert rows(logs.access_latency(spark, root, "trace_log"))[0] == ("41", 1, "pods", 100, 40)
    first, second = [r.asDict() for r in logs.solver_measures(spark, root, "trace_log").where("experiment = '42'").orderBy("batch").collect()]
    assert first == {
        "experiment": "42", "batch": 1, "solve_nanos": 777, "fetch_count": 12, "scope_nanos": 0, "creation_nanos": 55, "variables_before": 10, "objective_variables_before": 3,
        "variables_after": 7, "objective_variables_after": 2, "presolve_seconds": 0.25, "propagations": 5, "integer_propagations": 6, "user_seconds": 0.75, "wall_seconds": 0.5, "database_nanos": 900,
    }
    assert second == first | {"batch": 2, "solve_nanos": 111, "fetch_count": 3, "scope_nanos": 88}
    assert rows(logs.paired_decisions(spark, root, "paired_log")) == [("41", "a", 1, 1750000000.0), ("41", "b", 0, 600000000.0)]
    assert rows(logs.task_events(spark, root)) == [("41", "p1", "Running", "ADDED", 120, "n1")]


def test_replay_samples_affinity_and_ends(spark):
    trace = spark.range(20000).selectExpr("id AS sub", "id AS dep", "id AS start", "id + 9 AS end", "100.0D AS cpu", "200.0D AS mem", "id % 50 AS n")
    got = tables.replay(trace, 100, 100, 200, 9999, affinity=30, nodes=25, lifetime=60)
    assert got.count() == 10000 and got.where("start <> sub div 100 OR ends <> start + 60 OR cpu <> 1 OR mem <> 1").count() == 0
    together = got.where("together")
    assert together.where("n >= 25").count() == 0 and 0.25 < together.count() / got.where("n < 25").count() < 0.35
    again = tables.replay(trace.repartition(7), 100, 100, 200, 9999, affinity=30, nodes=25, lifetime=60)
    assert sorted(r.sub for r in again.where("together").collect()) == sorted(r.sub for r in together.collect())
