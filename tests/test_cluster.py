import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.operators import cluster
from quillon.plans import cluster_views
from quillon.sources import tables


def rows(columns, found):
    return sorted((tuple(r[c] for c in columns) for r in found), key=str)


@pytest.mark.parametrize("name", [*cluster_views.VIEWS, *cluster_views.PREEMPTION])
def test_view_agrees_with_duckdb(spark, sf, name):
    con = duckdb.connect()
    for table in tables.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(cluster_views.sql(name))
    names = [d[0] for d in want.description]
    found = cluster_views.query(name)(spark, sf)
    assert set(found.columns) == set(names)
    assert rows(names, found.collect()) == sorted(want.fetchall(), key=str)


def test_effects_and_repeated_rows(spark):
    taints = spark.createDataFrame([(1, "k", "a", "E"), (1, "k", "a", "E"), (2, "k", "a", "F"), (2, "j", "b", "E")], "node int, key string, value string, effect string")
    tolerations = spark.createDataFrame([(7, "k", "Exists", None, None), (7, "k", "Equal", "a", "E"), (8, "k", "Equal", "b", None), (9, "j", "Equal", "b", "E"), (9, "k", "Exists", None, "F")], "task int, key string, op string, value string, effect string")
    chosen = spark.createDataFrame([(7,), (8,), (9,)], "task int")
    assert rows(["task", "node"], cluster.tolerating(chosen, tolerations, taints).collect()) == [(7, 1), (9, 2)]


def test_negated_expressions_meet_every_subject(spark):
    expressions = spark.createDataFrame([(1, "a", "NotIn"), (2, "b", "DoesNotExist"), (3, "a", "In"), (4, "c", "Exists")], "expr int, key string, op string")
    values = spark.createDataFrame([(1, "x"), (3, "x"), (3, "y")], "expr int, value string")
    labels = spark.createDataFrame([(10, "a", "x"), (11, "a", "y"), (11, "b", None), (12, "d", None)], "subject int, key string, value string")
    found = rows(["expr", "subject"], cluster.matches(expressions, values, labels).collect())
    assert found == [(1, 11), (1, 12), (2, 10), (2, 12), (3, 10), (3, 11)]
    assert cluster.matches(expressions, values, labels.limit(0)).count() == 0


def test_largest_breaks_ties_by_node(spark):
    spare = spark.createDataFrame([(n, "cpu", n // 3) for n in range(200)] + [(5, "gpu", 1)], "node int, resource string, capacity long")
    best = cluster.largest(spare, 4)
    assert rows(["node", "resource", "capacity"], best.collect()) == [(195, "cpu", 65), (196, "cpu", 65), (198, "cpu", 66), (199, "cpu", 66), (5, "gpu", 1)]


def shuffled(spark, df):
    """The rows that ``df`` returns, and how many rows its stages wrote for others when nothing is broadcast, as at size."""
    sc = spark.sparkContext
    store, empty = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(empty, False, False, sc._gateway.new_array(sc._jvm.double, 0), empty)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.collect(), written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_port_pairs_are_made_once_and_not_shuffled(spark):
    tasks = spark.createDataFrame([(t, None) for t in range(600)], "task int, node int")
    ports = spark.createDataFrame([(t, ip, port, "TCP") for t in range(600) for ip, port in (("0.0.0.0", 80), ("10.0.0.1", 80), ("10.0.0.1", 443))], "task int, ip string, port int, protocol string")
    found, moved = shuffled(spark, cluster.port_conflicts(tasks, tasks, ports))
    assert rows(["task", "other"], found) == sorted(((a, b) for a in range(600) for b in range(600) if a != b), key=str)
    assert moved < 60_000


def test_ports_of_placed_tasks_are_met_once_and_not_shuffled(spark):
    chosen = spark.createDataFrame([(t, None) for t in range(400)], "task int, node int")
    placed = spark.createDataFrame([(t, t % 7) for t in range(300, 900)] * 2, "task int, node int")
    ports = spark.createDataFrame([(t, "0.0.0.0" if t % 3 == 0 else f"10.0.0.{t % 2}", 80, "TCP") for t in range(900)] + [(1, None, 80, "TCP"), (2, "0.0.0.0", None, "TCP"), (3, "0.0.0.0", 80, None)], "task int, ip string, port int, protocol string")
    found, moved = shuffled(spark, cluster.port_conflicts(chosen, placed, ports))
    want = [(a, b, b % 7) for a in range(400) for b in range(300, 900) if a != b and (a % 3 == 0 or b % 3 == 0 or a % 2 == b % 2)]
    assert rows(["task", "other", "node"], found) == sorted(want, key=str)
    assert moved < len(want) / 5


def test_port_pairs_are_written_small(spark, tmp_path):
    chosen = spark.createDataFrame([(t * 7, None) for t in range(1500)], "task long, node int")
    placed = spark.createDataFrame([(t * 7, t * 11 % 997) for t in range(1000, 4000)] + [(-1, None)], "task long, node int")
    ports = spark.createDataFrame([(t * 7, "0.0.0.0", 80, "TCP") for t in range(4000)] + [(-1, "0.0.0.0", 80, "TCP")], "task long, ip string, port int, protocol string")
    cluster.port_conflicts(chosen, placed, ports).write.parquet(out := f"{tmp_path}/out")
    found, want = spark.read.parquet(out), 1500 * 3001 - 500
    assert (found.count(), found.distinct().count(), found.where("node IS NULL").count()) == (want, want, 1500)
    assert found.where("other >= 0 AND node <> other div 7 * 11 % 997").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < want * 0.6


def test_tolerating_pairs_are_not_shuffled(spark):
    taints = spark.createDataFrame([(n, "k", n % 2, "E") for n in range(300)] + [(n, "j", 1, "F") for n in range(0, 300, 3)], "node int, key string, value int, effect string")
    tolerations = spark.createDataFrame([(t, "k", "Equal", t % 2, None) for t in range(300)] + [(t, "j", "Exists", None, "F") for t in range(0, 300, 2)], "task int, key string, op string, value int, effect string")
    found, moved = shuffled(spark, cluster.tolerating(tolerations.select("task").distinct(), tolerations, taints))
    want = [(t, n) for t in range(300) for n in range(300) if t % 2 == n % 2 and (n % 3 or t % 2 == 0)]
    assert rows(["task", "node"], found) == sorted(want, key=str)
    assert moved < len(want) / 5


def test_channels_are_not_shuffled_and_a_large_key_is_dealt_out(spark, monkeypatch):
    spreads = spark.createDataFrame([(t, g, "zone", 1) for t in range(300) for g in (0, 1)] * 2, "task int, grp int, key string, max_skew int")
    labels = spark.createDataFrame([(n, "zone", n % 5) for n in range(300)] * 2, "subject int, key string, value int")
    found, moved = shuffled(spark, cluster.topology_channels(spreads.select("task").distinct(), spreads, labels))
    assert rows(["grp", "task", "node", "key", "value", "max_skew"], found) == sorted(((g, t, n, "zone", n % 5, 1) for g in (0, 1) for t in range(300) for n in range(300)), key=str)
    assert moved < len(found) / 5
    monkeypatch.setattr(cluster, "BLOCK", 50, raising=False)
    made = cluster.topology_channels(spreads.select("task").distinct(), spreads, labels).groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 1 and sum(r["count"] for r in made) == len(found)


def test_channels_are_written_small(spark, tmp_path):
    spreads = spark.createDataFrame([(t * 7, t % 3, "zone", 1 + t % 3) for t in range(3000)], "task long, grp long, key string, max_skew long")
    labels = spark.createDataFrame([(n * 11, "zone", n * 7919 % 997 % 25) for n in range(3000)], "subject long, key string, value int")
    cluster.topology_channels(spreads.select("task"), spreads, labels).write.parquet(out := f"{tmp_path}/out")
    found = spark.read.parquet(out)
    assert (found.count(), found.distinct().count()) == (9_000_000, 9_000_000)
    assert found.where("key <> 'zone' OR grp <> task div 7 % 3 OR max_skew <> grp + 1 OR value <> node div 11 * 7919 % 997 % 25").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 9_000_000 * 0.3


def test_channels_of_many_strips_come_once(spark, monkeypatch):
    for name, size in (("BLOCK", 20), ("TILE", 8), ("STRIP", 2), ("RUN", 3)):
        monkeypatch.setattr(cluster, name, size, raising=False)
    spreads = [(t, None if t % 4 == 0 else t % 3, (None, "zone", "rack", "none")[t % 4 if t > 9 else 1], t % 2) for t in range(200)]
    labels = [(n, key, None if n % 5 == 0 else n % 7) for n in range(170) for key in ("zone", "rack", None)[: 1 + n % 3]] + [(n, "few", 1) for n in range(3)]
    frame = spark.createDataFrame(spreads * 2, "task int, grp int, key string, max_skew int")
    found = cluster.topology_channels(frame.select("task").distinct(), frame, spark.createDataFrame(labels * 2, "subject int, key string, value int"))
    want = [(g, t, n, k, v, s) for t, g, k, s in spreads for n, at, v in labels if k is not None and k == at]
    assert rows(["grp", "task", "node", "key", "value", "max_skew"], found.collect()) == sorted(want, key=str)
