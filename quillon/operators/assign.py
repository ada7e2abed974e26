"""Assignment of tasks to bins under hard limits, component by component in parallel.

Tasks and bins that never meet in an allowed pair or a group are independent, so each connected
component is a search of its own (``solve.search``): capacities of several resources, distinctness
within groups, and a value per pair. Components are given by the caller.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import solve
from quillon.operators.symbolic import EITHER, FALSE, TRUE, Capacity, Some, bounds


def _distinct(tasks: tuple[str, ...]):
    def holds(domains: solve.Domains) -> Some:
        taken = [next(iter(domains[t])) for t in tasks if len(domains[t]) == 1]
        if len(taken) != len(set(taken)) or len(tasks) > len(Some().union(*(domains[t] for t in tasks))):
            return FALSE
        return TRUE if len(taken) == len(tasks) else EITHER

    return holds


def problem(allowed: dict, demand: dict, capacity: dict, apart: list[set], value: dict) -> tuple[dict, list[solve.Constraint], list[solve.Objective]]:
    """allowed: task to bins; demand: task to {resource: amount}; capacity: bin to {resource: amount};
    apart: groups whose tasks take different bins; value: (task, bin) to gain."""
    bins = {b for found in allowed.values() for b in found} | set(capacity)
    domains = {t: Some(bins) for t in allowed}
    constraints = [solve.Constraint("DOMAIN", (t,), lambda d, t=t, of=Some(allowed[t]): TRUE if d[t] <= of else EITHER if d[t] & of else FALSE) for t in allowed]
    for r in sorted({r for need in demand.values() for r in need}):
        tasks = {t: need[r] for t, need in demand.items() if t in allowed and need.get(r)}
        if tasks:
            limit = Capacity(tasks, {b: capacity.get(b, {}).get(r, 0) for b in bins})
            constraints.append(solve.Constraint("CAPACITY", tuple(tasks), limit.holds))
    for group in apart:
        constraints.append(solve.Constraint("APART", tuple(sorted(group)), _distinct(tuple(sorted(group)))))
    objectives = [solve.Objective((t,), lambda d, t=t: bounds(Some(value.get((t, b), 0) for b in d[t]))) for t in allowed] if value else []
    return domains, constraints, objectives


def place(allowed: dict, demand: dict, capacity: dict, apart: list[set], value: dict, steps: int | None = solve.STEPS) -> tuple[str, dict]:
    """(status, bin of each task)."""
    return solve.search(*problem(allowed, demand, capacity, apart, value), steps)


def core(allowed: dict, demand: dict, capacity: dict, apart: list[set]) -> set[str]:
    """A least set of limits (DOMAIN, CAPACITY, APART) that conflict; empty if none do."""
    domains, constraints, _ = problem(allowed, demand, capacity, apart, {})
    return set(solve.core(domains, constraints)) if solve.search(domains, constraints, [])[0] == solve.INFEASIBLE else set()


def assign(pairs: DataFrame, demands: DataFrame, capacities: DataFrame, apart: DataFrame | None = None, component: str = "component", steps: int | None = solve.STEPS) -> DataFrame:
    """Solve each component of ``pairs`` (component, task, bin, value).

    ``demands``: component, task, resource, amount. ``capacities``: component, bin, resource,
    amount. ``apart``: component, group, task. Rows (component, status, task, bin); a component
    without an assignment gives one row with its status and nulls.
    """
    rows = pairs.select(component, F.lit("p").alias("what"), F.col("task").alias("a"), F.col("bin").alias("b"), F.col("value").cast("long").alias("n"))
    rows = rows.union(demands.select(component, F.lit("d"), "task", "resource", F.col("amount").cast("long"))).union(capacities.select(component, F.lit("c"), "bin", "resource", F.col("amount").cast("long")))
    if apart is not None:
        rows = rows.union(apart.select(component, F.lit("a"), "group", "task", F.lit(0).cast("long")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        allowed, demand, capacity, groups, value = defaultdict(set), defaultdict(dict), defaultdict(dict), defaultdict(set), {}
        for what, a, b, n in pdf[["what", "a", "b", "n"]].itertuples(index=False):
            if what == "p":
                allowed[a].add(b)
                value[a, b] = int(n)
            elif what == "d":
                demand[a][b] = int(n)
            elif what == "c":
                capacity[a][b] = int(n)
            else:
                groups[a].add(b)
        status, found = place(allowed, demand, capacity, list(groups.values()), value, steps)
        out = [(key[0], status, t, b) for t, b in sorted(found.items())] or [(key[0], status, None, None)]
        return pd.DataFrame(out, columns=[component, "status", "task", "bin"])

    return rows.groupBy(component).applyInPandas(run, f"{component} long, status string, task string, bin string")
