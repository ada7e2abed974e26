import random

import pytest

from quillon.operators import solve
from quillon.operators.symbolic import FALSE, TRUE, Evaluator, Some, compare
from quillon.plans import dialect, expressions
from quillon.plans.evaluate import Evaluation
from quillon.plans.model import Keys, Model, ModelError, Options, Unsatisfiable


def table(spark, name, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df


def solved(spark, name, constraints, column, key="id", **settings):
    found = Model.build(spark, constraints, **settings).solve(name)[name.upper()]
    return {r[key]: r[column] for r in found.collect()}


def test_expressions_round_trip():
    assert expressions.to_sql(expressions.parse("a + 2 * b / 3 = 1 or not x in (1, 2) and y is not null")) == "(((a + ((2 * b) div 3)) = 1) or ((NOT (x IN (1, 2))) and (y IS NOT NULL)))"
    assert expressions.to_sql(expressions.parse("not a = 'it''s'")) == "(NOT (a = 'it\\'s'))"
    for bad in ("a +", "a in 3", "(a", "a b", "in (select 1"):
        with pytest.raises(expressions.ExpressionError):
            expressions.parse(bad)


def test_values_bound_all_choices():
    rng = random.Random(5)
    tree = lambda n: ("var", rng.choice("xyz")) if n == 0 else ("op", rng.choice("+-*/%"), tree(n - 1), ("lit", rng.randint(-3, 3)) if rng.random() < 0.5 else tree(n - 1))
    for _ in range(300):
        node = ("op", rng.choice(["<", "<=", "=", "<>", ">", ">="]), tree(2), tree(1))
        row = {v: v for v in "xyz"}
        domains = {v: Some(rng.sample(range(-4, 5), 3)) if rng.random() < 0.5 else (-2, 2) for v in "xyz"}
        points = [{v: Some([rng.choice(sorted(d)) if isinstance(d, Some) else rng.randint(*d)]) for v, d in domains.items()} for _ in range(20)]
        whole = Evaluator(domains).value(node, row)
        for p in points:
            assert Evaluator(p).value(node, row) - {None} <= whole
    assert compare("<", (0, 3), Some([4])) == TRUE and compare("=", (0, 3), Some([4])) == FALSE


def test_search_matches_brute_force_on_random_programs():
    rng = random.Random(6)
    for _ in range(60):
        names = ["a", "b", "c", "d"]
        domains = {n: Some(rng.sample(range(6), 4)) for n in names}
        row = {n: n for n in names}
        nodes = []
        for _ in range(3):
            x, y = rng.sample(names, 2)
            nodes.append(("op", rng.choice(["<", "<>", "="]), ("op", rng.choice("+-*"), ("var", x), ("lit", rng.randint(0, 3))), ("var", y)))
        constraints = [solve.Constraint(f"c{i}", tuple(names), lambda d, n=n: Evaluator(d).value(n, row)) for i, n in enumerate(nodes)]
        gain = ("op", "-", ("op", "*", ("lit", 2), ("var", "a")), ("var", "b"))
        objectives = [solve.Objective(("a", "b"), lambda d: __import__("quillon.operators.symbolic", fromlist=["bounds"]).bounds(Evaluator(d).value(gain, row)))]
        best = solve.brute_force(domains, constraints, objectives)
        status, found = solve.search(domains, constraints, objectives, None)
        assert status == (solve.INFEASIBLE if best is None else solve.OPTIMAL)
        assert best is None or 2 * found["a"] - found["b"] == best
        if best is None:
            names_in_core = solve.core(domains, constraints)
            assert names_in_core and solve.brute_force(domains, [c for c in constraints if c.name in names_in_core], []) is None


def test_fixed_and_implied_values(spark):
    table(spark, "hosts", [(i, None, "g" if i < 3 else "h") for i in range(5)], "id long, controllable__v int, g string")
    got = solved(spark, "hosts", ["create constraint a as select * from hosts where g = 'g' check controllable__v = 7", "create constraint b as select * from hosts where controllable__v > 5 check g = 'g'", "create constraint c as select * from hosts where g = 'h' maximize controllable__v"], "controllable__v")
    assert got == {0: 7, 1: 7, 2: 7, 3: 5, 4: 5}


def test_aggregates_and_objectives(spark):
    table(spark, "items", [(i, None, f"k{i % 2}") for i in range(6)], "id long, controllable__n int, k string")
    domain = "create constraint d as select * from items check controllable__n >= 0 and controllable__n <= 9"
    got = solved(spark, "items", [domain, "create constraint s as select * from items group by k check sum(controllable__n) = 12", "create constraint m as select * from items group by k maximize min(controllable__n)"], "controllable__n")
    assert got == dict.fromkeys(range(6), 4)
    got = solved(spark, "items", [domain, "create constraint s as select * from items group by k check all_different(controllable__n) and max(controllable__n) <= 2"], "controllable__n")
    assert all(sorted(got[i] for i in range(p, 6, 2)) == [0, 1, 2] for p in (0, 1))
    got = solved(spark, "items", [domain, "create constraint s as select * from items group by k check all_equal(controllable__n) = true", "create constraint t as select * from items where id = 2 or id = 3 check controllable__n = id"], "controllable__n")
    assert got == {i: 2 + i % 2 for i in range(6)}
    got = solved(spark, "items", [domain, "create constraint c as select * from items where controllable__n = 3 check count(*) = 6"], "controllable__n")
    assert set(got.values()) == {3}


def test_subqueries_joins_and_views(spark):
    table(spark, "pods", [(1, "eu", None), (2, "us", None), (3, "eu", None)], "id long, zone string, controllable__node string")
    table(spark, "nodes", [("n1", "eu", 5), ("n2", "us", 4), ("n3", "eu", 1)], "name string, zone string, size int")
    own = "create constraint near as select * from pods check controllable__node in (select name from nodes where nodes.zone = pods.zone)"
    big = "create constraint big as select * from pods join nodes on pods.controllable__node = nodes.name check nodes.size > 3"
    assert solved(spark, "pods", [own, big], "controllable__node") == {1: "n1", 2: "n2", 3: "n1"}
    view = "create constraint eu as select id as pod, controllable__node as at from pods where zone = 'eu'"
    assert solved(spark, "pods", [own, view, "create constraint v as select * from eu check at = 'n3'"], "controllable__node")[3] == "n3"
    apart = "create constraint apart as select * from pods group by zone check all_different(controllable__node)"
    got = solved(spark, "pods", [own, apart], "controllable__node")
    assert {got[1], got[3]} == {"n1", "n3"}
    fetched = Model.build(spark, [own]).solve("pods", lambda t: spark.table(t).where("id > 1" if t == "pods" else "true"))["PODS"]
    assert sorted(r.id for r in fetched.collect()) == [2, 3]
    with pytest.raises(ModelError):
        Model.build(spark, ["create constraint x as select * from nodes check name in (select controllable__node from pods)"]).solve()


def test_capacity_places_and_spreads(spark):
    table(spark, "tasks", [(i, None, 2 if i < 2 else 1) for i in range(6)], "id long, controllable__bin string, need int")
    table(spark, "bins", [("a", 4), ("b", 4), ("c", 1)], "name string, room int")
    fits = "create constraint fits as select * from tasks join bins check capacity_constraint(tasks.controllable__bin, bins.name, tasks.need, bins.room) = true"
    domain = "create constraint known as select * from tasks check controllable__bin in (select name from bins)"
    got = Model.build(spark, [fits, domain]).solve("tasks")["TASKS"]
    got.createOrReplaceTempView("tasks_done")
    load = {}
    for r in got.collect():
        load[r.controllable__bin] = load.get(r.controllable__bin, 0) + r.need
    assert sum(load.values()) == 8 and max(load.values()) == 4 and load.get("c", 0) <= 1
    check = dialect.parse_all([fits.replace("tasks", "tasks_done")])
    assert Evaluation(spark, check).violations["fits"].count() == 0
    spark.sql("SELECT id, 'c' AS controllable__bin, need FROM tasks_done").createOrReplaceTempView("tasks_done")
    assert [(r.place, r.load) for r in Evaluation(spark, check).violations["fits"].collect()] == [("c", 8)]
    # Not all fit: with presence some lie elsewhere, without it there is no solution.
    table(spark, "bins", [("a", 3), ("b", 3)], "name string, room int")
    elsewhere = "create constraint known as select * from tasks check controllable__bin in (select name from bins) or controllable__bin = 'none'"
    got = solved(spark, "tasks", [fits, elsewhere], "controllable__bin")
    assert list(got.values()).count("none") == 1
    with pytest.raises(Unsatisfiable) as found:
        Model.build(spark, [fits, elsewhere], options=Options(presence=False)).solve()
    assert found.value.names == ["fits"]


def test_cores_name_the_conflict(spark):
    table(spark, "one", [(1, None), (2, None)], "id long, controllable__v int")
    texts = ["create constraint low as select * from one check controllable__v < 3", "create constraint high as select * from one where id = 2 check controllable__v > 5", "create constraint fine as select * from one check controllable__v >= 0"]
    with pytest.raises(Unsatisfiable) as found:
        Model.build(spark, texts).solve()
    assert found.value.names == ["high", "low"]


def test_keys_and_errors(spark):
    table(spark, "child", [(1, None), (2, None)], "id long, controllable__parent long")
    table(spark, "parent", [(10,), (11,)], "pid long")
    keys = {"child": Keys(primary=("controllable__parent",), foreign={"controllable__parent": ("parent", "pid")})}
    got = solved(spark, "child", ["create constraint a as select * from child check id > 0"], "controllable__parent", keys=keys)
    assert sorted(got.values()) == [10, 11]
    assert Model.build(spark, ["create constraint a as select * from child check id in (select pid from parent where pid > 3)"]).tables == ["child", "parent"]
    with pytest.raises(ModelError):
        Model.build(spark, [])


def test_a_long_chain_is_solved_without_recursion(spark):
    table(spark, "chain", [(i, None) for i in range(300)], "id long, controllable__v int")
    texts = ["create constraint d as select * from chain check controllable__v in (1, 2)", "create constraint n as select * from chain a join chain b on a.id + 1 = b.id check a.controllable__v <> b.controllable__v", "create constraint f as select * from chain where id = 0 check controllable__v = 1"]
    assert solved(spark, "chain", texts, "controllable__v") == {i: 1 + i % 2 for i in range(300)}


@pytest.mark.parametrize("check", ["x in (select y from u_ws)", "x\nin\n(select y\nfrom u_ws)", "x  IN  (  SELECT y FROM u_ws )"])
def test_white_space_does_not_change_results(spark, check):
    table(spark, "t_ws", [(1, 5), (2, None), (3, 9)], "id long, x int")
    table(spark, "u_ws", [(5,)], "y int")
    found = Evaluation(spark, dialect.parse_all([f"create constraint c as select id from t_ws check {check}"])).violations["c"]
    assert sorted(r.id for r in found.collect()) == [2, 3]


def test_contains_division_and_total(spark):
    table(spark, "t_in", [(1, 7, [5, 6]), (2, 8, [7])], "id long, x int, xs array<int>")
    texts = [
        "create constraint a as select id from t_in where contains(xs, 7) check x = 0",
        "create constraint b as select t_in.id from t_in join t_in as o on contains(o.xs, t_in.x) check t_in.x in (select x from t_in where x > 7)",
        "create constraint c as select id from t_in check x / 2 = 3",
        "create constraint g as select * from t_in maximize x",
        "create constraint h as select * from t_in maximize id",
    ]
    found = Evaluation(spark, dialect.parse_all(texts))
    assert {n: [r.id for r in df.collect()] for n, df in found.violations.items()} == {"a": [2], "b": [1], "c": [2]}
    assert found.total().first().objective == 18
