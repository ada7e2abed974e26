"""Functions of the placement workload: quantities, conditions, demands, classes, ids, log values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Node conditions and the flags they set (fixed values).
CONDITIONS = {
    "OutOfDisk": "out_of_disk",
    "MemoryPressure": "memory_pressure",
    "DiskPressure": "disk_pressure",
    "PIDPressure": "pid_pressure",
    "NetworkUnavailable": "network_unavailable",
    "Ready": "ready",
}


def quantity(text: Column, resource: Column, strict: bool = False) -> Column:
    """Quantities such as 250m, 0.5, 4Ki, 1.5G: cpu in thousandths, other resources in bytes, cut to whole numbers.

    Unknown units give null, or an error if ``strict``.
    """
    number = F.nullif(F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("decimal(28,6)")
    unit = F.regexp_extract(text, r"^[0-9]+(?:\.[0-9]+)?(.*)$", 1)
    scale = F.when(unit == "", F.lit(1).cast("decimal(20,3)")).when(unit == "m", F.lit("0.001").cast("decimal(20,3)"))
    for i, name in enumerate("KMGTPE", 1):
        scale = scale.when(unit == name, F.lit(1000**i).cast("decimal(20,0)")).when(unit == f"{name}i", F.lit(1024**i).cast("decimal(20,0)"))
        if name == "K":
            scale = scale.when(unit == "k", F.lit(1000).cast("decimal(20,0)"))
    cpu = F.when(unit == "m", number).when(unit == "", number * 1000)
    found = F.floor(F.when(resource == "cpu", cpu.cast("decimal(38,6)")).otherwise((number * scale).cast("decimal(38,6)"))).cast("bigint")
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown quantity "), text)).cast("bigint")) if strict else found


def priority(value: Column) -> Column:
    return F.least(F.coalesce(value, F.lit(10)), F.lit(100))


def service_class(df: DataFrame, pod: str, request: str, limit: str) -> DataFrame:
    """Guaranteed, BestEffort or Burstable for each pod, from its containers' requests and limits."""
    has = F.col(request).isNotNull() | F.col(limit).isNotNull()
    same = F.coalesce(F.coalesce(request, limit) == F.col(limit), F.lit(False))
    return df.groupBy(pod).agg(F.when(~F.bool_or(has), "BestEffort").when(F.bool_and(same), "Guaranteed").otherwise("Burstable").alias("qos_class"))


def conditions(df: DataFrame, node: str, kind: str, status: str) -> DataFrame:
    """The flags of each node from rows (node, kind, status); ready unless told otherwise; unknown kinds are an error."""
    known = F.col(kind).isNull() | F.col(kind).isin(*CONDITIONS)
    checked = df.withColumn(kind, F.when(known, F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown condition "), F.col(kind)))))
    flags = [F.coalesce(F.bool_or(F.when(F.col(kind) == k, F.col(status) == "True")), F.lit(flag == "ready")).alias(flag) for k, flag in CONDITIONS.items()]
    return checked.groupBy(node).agg(*flags)


def rollup(requests: DataFrame, overheads: DataFrame, pods: DataFrame) -> DataFrame:
    """(pod, resource, demand): requests of a pod's containers, one pod unless it asks otherwise, plus the pod's overhead of what it asks for.

    ``requests`` and ``overheads``: pod, resource, amount. ``pods``: pod.
    """
    asked = requests.groupBy("pod", "resource").agg(F.sum("amount").alias("asked"))
    default = pods.select("pod", F.lit("pods").alias("resource")).join(asked, ["pod", "resource"], "left_anti").withColumn("asked", F.lit(1).cast("long"))
    extra = overheads.groupBy("pod", "resource").agg(F.sum("amount").alias("extra"))
    both = asked.unionByName(default).join(extra, ["pod", "resource"], "left")
    return both.select("pod", "resource", (F.col("asked") + F.coalesce("extra", F.lit(0))).cast("long").alias("demand"))


def outcome(before: Column, after: Column) -> Column:
    """What a placement did to a task: its node before and after (null: none)."""
    return F.when(before.eqNullSafe(after), F.when(before.isNull(), "UNASSIGNED").otherwise("UNCHANGED")).when(after.isNull(), "PREEMPT").otherwise("ASSIGNED")


def equivalence_class(*fields: Column) -> Column:
    return F.xxhash64(F.to_json(F.struct(*fields)))


def interned(key: Column, op: Column, values: Column) -> Column:
    """The id of a label expression: equal expressions share it, whatever others there are, without a numbering pass."""
    return F.xxhash64(F.to_json(F.struct(key.alias("key"), op.alias("op"), F.array_sort(values).alias("values"))))


def megabytes(size: Column) -> Column:
    return (size / 1024 / 1024).cast("int")


def running_seconds(text: Column) -> Column:
    """``3m20s``, ``3m`` or ``20s`` in seconds."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"([0-9]+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike("^([0-9]+m)?([0-9]+s)?$") & (text != ""), part("m") * 60 + part("s"))


def epoch_nanos(text: Column) -> Column:
    """An ISO time in UTC, whose fraction may lack trailing zeros, in nanoseconds."""
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9]+)Z?$", 1), 9, "0").cast("bigint")
    return F.unix_seconds(F.to_timestamp(F.regexp_extract(text, r"^([0-9-]+T[0-9:]+)", 1), "yyyy-MM-dd'T'HH:mm:ss")) * 1_000_000_000 + fraction
