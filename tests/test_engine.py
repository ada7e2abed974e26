import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.functions import placement
from quillon.operators import assign, solve
from quillon.plans import catalogue, dialect
from quillon.plans.evaluate import Evaluation
from quillon.sources import tables
from quillon.streaming import events


def test_statement_kinds():
    assert dialect.parse("create constraint c as select * from t check x > 1").kind == dialect.HARD
    assert dialect.parse("create constraint c as select * from t maximize x").kind == dialect.OBJECTIVE
    assert dialect.parse("create constraint c as select a, b from t where a = 'check (' ").kind == dialect.VIEW


@pytest.mark.parametrize("text", ["select * from t", "create constraint c as select * from t check x like 'a'", "create constraint c as select * from t left join u on a = b check a", "create constraint c as select * from t check foo(x) = 1", "create constraint c as select * from t check"])
def test_rejected_statements(text):
    with pytest.raises(dialect.ModelError):
        dialect.parse(text)


def test_duplicate_names():
    with pytest.raises(dialect.ModelError):
        dialect.parse_all(["create constraint c as select * from t check a", "create constraint C as select * from t check a"])


def test_evaluation(spark):
    spark.createDataFrame([(1, 7, "a"), (2, 7, "a"), (3, 3, "b"), (4, None, "b")], "id int, controllable__v int, g string").createOrReplaceTempView("t_eval")
    statements = dialect.parse_all(
        [
            "create constraint spare as select g, sum(controllable__v) as load from t_eval group by g",
            "create constraint low as select * from t_eval where id < 4 check controllable__v <= 6",
            "create constraint same as select * from t_eval group by g check all_equal(controllable__v)",
            "create constraint apart as select * from t_eval group by g check all_different(controllable__v) = true",
            "create constraint some as select * from t_eval check any(controllable__v = 3)",
            "create constraint rising as select * from t_eval group by g check increasing(controllable__v)",
            "create constraint none as select * from t_eval where id > 9 check sum(controllable__v) > 5",
            "create constraint null_row as select * from t_eval check controllable__v > 0",
            "create constraint loaded as select * from spare check load >= 10",
            "create constraint gain as select * from t_eval maximize controllable__v = 7",
        ]
    )
    found = Evaluation(spark, statements, order="id")
    counts = {n: df.count() for n, df in found.violations.items()}
    assert counts == {"low": 2, "same": 0, "apart": 1, "some": 0, "rising": 0, "none": 0, "null_row": 1, "loaded": 1}
    assert found.objectives["gain"].first().objective == 2
    assert {r.name: r.value for r in found.summary().collect()} | {"low": 2, "gain": 2} == {r.name: r.value for r in found.summary().collect()}


def test_search_matches_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        tasks, bins = [f"t{i}" for i in range(4)], ["x", "y", "z"]
        allowed = {t: set(rng.sample(bins, rng.randint(1, 3))) for t in tasks}
        demand = {t: {"cpu": rng.randint(1, 4)} for t in tasks}
        capacity = {b: {"cpu": rng.randint(2, 7)} for b in bins}
        apart = [set(rng.sample(tasks, 2))]
        value = {(t, b): rng.randint(0, 5) for t in tasks for b in bins}
        best = None
        for choice in itertools.product(*(sorted(allowed[t]) for t in tasks)):
            load = {b: sum(demand[t]["cpu"] for t, c in zip(tasks, choice, strict=True) if c == b) for b in bins}
            if all(load[b] <= capacity[b]["cpu"] for b in bins) and all(len({choice[tasks.index(t)] for t in g}) == len(g) for g in apart):
                gain = sum(value[t, c] for t, c in zip(tasks, choice, strict=True))
                best = gain if best is None else max(best, gain)
        status, found = assign.place(allowed, demand, capacity, apart, value)
        assert status == (solve.OPTIMAL if best is not None else solve.INFEASIBLE)
        assert best is None or sum(value[t, b] for t, b in found.items()) == best
        assert bool(assign.core(allowed, demand, capacity, apart)) == (best is None)


def test_assign_by_component(spark):
    pairs = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 5), (1, "b", "y", 4), (2, "c", "z", 1)], "component long, task string, bin string, value long")
    demands = spark.createDataFrame([(1, "a", "cpu", 2), (1, "b", "cpu", 2), (2, "c", "cpu", 9)], "component long, task string, resource string, amount long")
    capacities = spark.createDataFrame([(1, "x", "cpu", 2), (1, "y", "cpu", 3), (2, "z", "cpu", 5)], "component long, bin string, resource string, amount long")
    rows = {(r.component, r.task): (r.status, r.bin) for r in assign.assign(pairs, demands, capacities).collect()}
    assert rows == {(1, "a"): ("OPTIMAL", "x"), (1, "b"): ("OPTIMAL", "y"), (2, None): ("INFEASIBLE", None)}


def test_stream_state_equals_batch(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id")
    source = tmp_path / "in"
    df.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = events.keep_latest(stream, str(tmp_path / "state"), str(tmp_path / "cp"), "user_id", "ts", "event_id")
    query.awaitTermination()
    last = max(int(p.name.split("-")[1]) for p in (tmp_path / "state").glob("state-*"))
    kept = spark.read.parquet(str(tmp_path / "state" / f"state-{last}"))
    assert sorted(kept.collect()) == sorted(events.latest(df, "user_id", "ts", "event_id").collect())


def test_functions(spark):
    df = spark.createDataFrame([("10", "cpu"), ("250m", "cpu"), ("4Ki", "memory"), ("5", "pods"), ("7x", "cpu")], "q string, r string")
    assert [r[0] for r in df.select(placement.quantity(F.col("q"), F.col("r"))).collect()] == [10000, 250, 4096, 5, None]
    pods = spark.createDataFrame([(1, 5, 5), (2, 5, 9), (3, None, None), (4, None, 3)], "pod int, request int, lim int")
    assert {r.pod: r.qos_class for r in placement.service_class(pods, "pod", "request", "lim").collect()} == {1: "Guaranteed", 2: "Burstable", 3: "BestEffort", 4: "Guaranteed"}


def test_trace_and_json(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1040 12378 0 120 8 14 1\n1163 18214 60 300 >1 1.75 1\n\n2709 18693 120 120 4 7 2\n")
    trace = tables.read_trace(spark, str(tmp_path / "t.txt"))
    assert trace.count() == 3 and tables.build_trace(trace).count() == 2
    assert tables.replay(trace, 60, 1, 1, 60).count() == 2 and tables.replay(trace, 60, 1, 1, 1).count() == 1
    df = spark.createDataFrame([(1, [1, 2], None), (2, None, "x")], "a long, b array<long>, c string")
    tables.dump_json(df, str(tmp_path / "j"))
    assert sorted(tables.load_json(spark, df.schema, str(tmp_path / "j")).collect()) == sorted(df.collect())


def test_entry_and_names(spark):
    assert entry.entry(spark).schema.names
    assert set(catalogue.SPARK) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
