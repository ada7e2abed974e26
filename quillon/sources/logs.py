"""Experiment logs to tables: parameters, task events, scheduling decisions, latencies, solver measures, scope fractions.

An experiment is a folder below a root, and its name is the experiment's id: ``metadata`` (CSV with
a header), ``workload_output``, and a scheduler's log. Lines are found by the words they hold and
taken apart by position; all fields of a line stand in ``LINES``. What a line counts as depends on
those before it in the same log, so the lines that matter of one log meet in one window; logs are
independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import placement

#: Fixed values. kind: (words that a line must hold, a word that it must not hold).
LINES = {
    "fetched": (("Fetchcount is",), None),
    "access": (("updateDataFields for",), None),
    "fraction": (("scope fraction",), None),
    "updated": (("compiler.updateData()",), None),
    "created": (("Model creation:",), "println"),
    "variables": (("#Variables",), None),
    "searching": (("Starting Search",), None),
    "propagations": (("propagations:",), "integer_propagations"),
    "integer_propagations": (("integer_propagations:",), None),
    "wall": (("walltime",), None),
    "user": (("usertime",), None),
    "filtered": (("Scope filtering",), None),
    "solved": (("Solver has run successfully",), None),
    "decided": (("Scheduling decision for pod",), None),
}
_EVENT = "WorkloadGeneratorIT"
_ATTEMPT, _BINDING = "About to try and schedule pod", "Attempting to bind"


def _lines(spark: SparkSession, root: str, file: str) -> DataFrame:
    """(experiment, part, line, value): rows of a split come in order, splits by where they begin."""
    meta = F.col("_metadata")
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file).text(root)
    return read.select(F.element_at(F.split(meta["file_path"], "/"), -2).alias("experiment"), meta["file_block_start"].alias("part"), F.monotonically_increasing_id().alias("line"), "value")


def _order() -> W:
    return W.partitionBy("experiment").orderBy("part", "line")


def _word(i: int) -> Column:
    """The word at ``i`` from the start of the line, or from its end if negative; null where there is none."""
    return F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(i + 1 if i >= 0 else i))


def _number(x: Column) -> Column:
    """The digits at the start of a word, brackets passed over: a latency may end in its unit and a full stop."""
    return F.nullif(F.regexp_extract(x, r"^\(?([0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))


def params(spark: SparkSession, root: str) -> DataFrame:
    """The metadata of each experiment, under the names in its header, as text."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata").option("header", "true").csv(root)
    return read.select(F.element_at(F.split(F.col("_metadata")["file_path"], "/"), -2).alias("experiment"), *read.columns)


def task_events(spark: SparkSession, root: str, file: str = "workload_output") -> DataFrame:
    """What happened to each task: (experiment, task, status, event, time, node)."""
    found = _lines(spark, root, file).where(F.col("value").contains(_EVENT) & F.col("value").contains("PodName"))
    words = F.split(F.substring_index("value", _EVENT, -1), " ")
    word = lambda i: F.try_element_at(words, F.lit(i + 1))
    cut = lambda i: F.expr("substring({0}, 1, length({0}) - 1)".format(f"w{i}"))
    named = found.select("experiment", *(word(i).alias(f"w{i}") for i in (3, 7, 9, 11, 13)))
    return named.select("experiment", cut(7).alias("task"), cut(11).alias("status"), F.trim("w13").alias("event"), cut(3).try_cast("long").alias("time"), cut(9).alias("node"))


def _marked(spark: SparkSession, root: str, file: str) -> DataFrame:
    """The lines that count, with their kind and the batch they belong to: the one after the last decision's, from 1."""
    kind = F.lit(None).cast("string")
    for name, (words, without) in reversed(LINES.items()):
        holds = F.lit(True)
        for w in words:
            holds = holds & F.col("value").contains(w)
        kind = F.when(holds & ~F.col("value").contains(without) if without else holds, name).otherwise(kind)
    found = _lines(spark, root, file).withColumn("kind", kind).where("kind IS NOT NULL")
    # A decision names its own batch; its words follow the marker.
    told = F.split(F.trim(F.substring_index("value", LINES["decided"][0][0], -1)), r"\s+")
    found = found.withColumns({"told": F.when(F.col("kind") == "decided", F.try_element_at(told, F.lit(6)).try_cast("long")), "named": F.when(F.col("kind") == "decided", F.try_element_at(told, F.lit(1)))})
    before = _order().rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("batch", F.coalesce(F.last("told", ignorenulls=True).over(before) + 1, F.lit(1)).cast("long"))


def decisions(spark: SparkSession, root: str, file: str) -> DataFrame:
    """(experiment, task, batch, nanos) of a log whose lines name the decision's batch."""
    return _marked(spark, root, file).where("kind = 'decided'").select("experiment", F.col("named").alias("task"), F.col("told").alias("batch"), _number(_word(-1)).cast("double").alias("nanos"))


def paired_decisions(spark: SparkSession, root: str, file: str) -> DataFrame:
    """The same of a log with a line for each attempt and each binding: from a task's latest attempt to its binding.

    Each binding is a batch, from 0. Lines begin with a time.
    """
    found = _lines(spark, root, file).where(F.col("value").contains(_ATTEMPT) | F.col("value").contains(_BINDING))
    binding = F.col("value").contains(_BINDING)
    task = F.when(binding, _word(-3)).otherwise(F.element_at(F.split(_word(-1), "/"), -1))
    found = found.select("experiment", "part", "line", binding.alias("binding"), task.alias("task"), placement.epoch_nanos(_word(0)).alias("at"))
    own = W.partitionBy("experiment", "task").orderBy("part", "line").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("began", F.last(F.when(~F.col("binding"), F.col("at")), ignorenulls=True).over(own)).where("binding")
    return found.select("experiment", "task", (F.row_number().over(_order()) - 1).cast("long").alias("batch"), (F.col("at") - F.col("began")).cast("double").alias("nanos"))


def access_latency(spark: SparkSession, root: str, file: str) -> DataFrame:
    """(experiment, batch, table, fetched, reflected) in nanoseconds."""
    found = _marked(spark, root, file).where("kind = 'access'")
    return found.select("experiment", "batch", _word(8).alias("table"), _number(_word(10)).cast("long").alias("fetched"), _number(_word(19)).cast("long").alias("reflected"))


def scope_fractions(spark: SparkSession, root: str, file: str) -> DataFrame:
    return _marked(spark, root, file).where("kind = 'fraction'").select("experiment", "batch", _word(-1).try_cast("double").alias("fraction"))


def solver_measures(spark: SparkSession, root: str, file: str) -> DataFrame:
    """A row for each solve: the latest value of each measure up to it; without scoping its latency is 0.

    Counts of variables come in pairs, before presolving and after it.
    """
    marked = _marked(spark, root, file)
    nth = F.count(F.when(F.col("kind") == "variables", 1)).over(_order().rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("nth", nth)
    odd = F.col("nth") % 2 == 1
    of = lambda kind, i, also=F.lit(True): F.when((F.col("kind") == kind) & also, _number(_word(i)))
    values = {
        "fetch_count": (of("fetched", -1), "long"),
        "scope_nanos": (of("filtered", -1), "long"),
        "creation_nanos": (of("created", 5), "long"),
        "variables_before": (of("variables", 1, odd), "long"),
        "objective_variables_before": (of("variables", 2, odd), "long"),
        "variables_after": (of("variables", 1, ~odd), "long"),
        "objective_variables_after": (of("variables", 2, ~odd), "long"),
        "presolve_seconds": (of("searching", 3), "double"),
        "propagations": (of("propagations", 1), "long"),
        "integer_propagations": (of("integer_propagations", 1), "long"),
        "user_seconds": (of("user", 1), "double"),
        "wall_seconds": (of("wall", 1), "double"),
        "database_nanos": (of("updated", 7), "long"),
    }
    upto = _order().rowsBetween(W.unboundedPreceding, 0)
    latest = [F.last(x.cast(kind), ignorenulls=True).over(upto).alias(name) for name, (x, kind) in values.items()]
    found = marked.select("experiment", "batch", "kind", of("solved", 10).cast("long").alias("solve_nanos"), *latest).where("kind = 'solved'")
    return found.drop("kind").fillna(0, ["scope_nanos"])
