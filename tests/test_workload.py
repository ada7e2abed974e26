import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import placement
from quillon.plans import policies, workload
from quillon.plans.model import Model
from quillon.sources import tables
from quillon.streaming import events, shred


def agree(spark, sf, function, text):
    con = duckdb.connect()
    for table in tables.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(text)
    names = [d[0] for d in want.description]
    found = function(spark, sf)
    assert set(found.columns) == set(names)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", workload.QUERIES)
def test_workload_agrees_with_duckdb(spark, sf, name):
    agree(spark, sf, *workload.QUERIES[name])


@pytest.mark.parametrize("name", policies.QUERIES)
def test_policy_agrees_with_duckdb(spark, sf, name):
    agree(spark, sf, policies.query(name), policies.sql(name))


def test_quantities_and_log_values(spark):
    df = spark.createDataFrame([("0.5", "cpu"), ("1.5Gi", "memory"), ("2E", "x"), ("3Pi", "x"), ("12k", "x"), ("1500m", "x"), (None, "cpu")], "q string, r string")
    assert [r[0] for r in df.select(placement.quantity(F.col("q"), F.col("r"))).collect()] == [500, 3 << 29, 2 * 10**18, 3 << 50, 12000, 1, None]
    with pytest.raises(Exception, match="unknown quantity"):
        spark.createDataFrame([("7x",)], "q string").select(placement.quantity(F.col("q"), F.lit("cpu"), strict=True)).collect()
    times = spark.createDataFrame([("3m20s", "2024-01-02T03:04:05.12Z"), ("20s", "2024-01-02T03:04:05Z"), ("4m", "1970-01-01T00:00:01.000000001Z"), ("x", "1970-01-01T00:00:00Z")], "s string, t string")
    got = times.select(placement.running_seconds(F.col("s")), placement.epoch_nanos(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(200, 1704164645120000000), (20, 1704164645000000000), (240, 1000000001), (None, 0)]
    assert spark.range(1).select(placement.megabytes(F.lit(5 << 20).cast("long"))).first()[0] == 5
    with pytest.raises(Exception, match="unknown condition"):
        placement.conditions(spark.createDataFrame([(1, "Odd", "True")], "n int, k string, s string"), "n", "k", "s").collect()


def test_shredded_nodes(spark):
    text = '{"metadata":{"uid":"u","name":"n","labels":{"a":"b"}},"spec":{"taints":[{"key":"k","effect":"NoSchedule"}]},"status":{"conditions":[{"type":"DiskPressure","status":"True"}],"allocatable":{"cpu":"4","memory":"2Ki"},"images":[{"names":["x","y"],"sizeBytes":3145728}]}}'
    objects = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", shred.NODE).alias("o")).select("o.*")
    found = {name: [r.asDict() for r in df.collect()] for name, df in shred.nodes(objects).items()}
    assert found["node_info"][0]["disk_pressure"] and found["node_info"][0]["ready"] and not found["node_info"][0]["unschedulable"]
    assert found["node_taints"] == [{"key": "k", "value": "", "effect": "NoSchedule", "uid": "u"}]
    assert sorted((r["resource"], r["allocatable"]) for r in found["node_resources"]) == [("cpu", 4000), ("memory", 2048)]
    assert sorted(r["name"] for r in found["node_images"]) == ["x", "y"] and found["node_images"][0]["megabytes"] == 3


def test_tombstones_hold_across_batches(spark, tmp_path):
    schema = "k string, t timestamp, n long, kind string"
    rows = [[("a", 0, 1, "add"), ("b", 0, 2, "add")], [("a", 60, 3, "del")], [("a", 120, 4, "add"), ("c", 130, 5, "add")], [("a", 4000, 6, "add"), ("b", 4100, 7, "del")]]
    flat = [(k, t, n, kind) for part in rows for k, t, n, kind in part]
    frame = lambda some: spark.createDataFrame(some, "k string, s long, n long, kind string").select("k", F.timestamp_seconds("s").alias("t"), "n", "kind")
    for upto in range(1, 5):
        place = tmp_path / f"in{upto}"
        for part in rows[:upto]:
            frame(part).coalesce(1).write.mode("append").parquet(str(place))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in4"))
    events.keep_live(stream, str(tmp_path / "state"), str(tmp_path / "cp"), "k", "t", "n", "kind = 'del'", "5 MINUTES").awaitTermination()
    got = events.live(events.state(spark, str(tmp_path / "state")), "k", "t", "n", "kind = 'del'")
    want = events.live(events.after_tombstones(frame(flat), "k", "t", "n", "kind = 'del'", "5 MINUTES"), "k", "t", "n", "kind = 'del'")
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect()) == [5, 6]
    assert len(list((tmp_path / "state").glob("state-*"))) == 2


def test_policies_are_solved_together(spark):
    frame = lambda name, rows, schema: spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
    frame("placements", [(1, 5, 0, None, None), (2, 3, 0, None, None), (3, 1, 1, 11, None)], "task long, priority int, equivalence long, current long, controllable__node long")
    frame("spare", [(10, "cpu", 2), (11, "cpu", 2)], "node long, resource string, capacity long")
    frame("demands", [(1, "cpu", 2), (2, "cpu", 1), (3, "cpu", 1)], "task long, resource string, demand int")
    frame("ports_pending", [(1, 2, None)], "task long, other long, node long")
    texts = [s for p in ("preemption", "somewhere", "domain", "capacity", "ports_pending") for s in policies.POLICIES[p]]
    got = {r.task: r.controllable__node for r in Model.build(spark, texts).solve("placements")["PLACEMENTS"].collect()}
    assert got == {1: 10, 2: 11, 3: 11}
