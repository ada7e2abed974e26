"""Nested objects to flat tables: pods to ten, nodes to four, one projection each.

Objects are structs (``from_json`` with ``POD`` or ``NODE``); a table is rewritten whole for the
objects at hand, so that an update replaces the rows of its object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import placement

_EXPRESSIONS = "array<struct<key:string,operator:string,values:array<string>>>"
_POD_TERMS = f"array<struct<labelSelector:struct<matchExpressions:{_EXPRESSIONS}>,topologyKey:string>>"
POD = (
    "metadata struct<uid:string,name:string,namespace:string,resourceVersion:long,labels:map<string,string>>, "
    "spec struct<nodeName:string,schedulerName:string,priority:int,nodeSelector:map<string,string>,overhead:map<string,string>,"
    "containers:array<struct<image:string,resources:struct<requests:map<string,string>,limits:map<string,string>>,ports:array<struct<hostIP:string,hostPort:int,protocol:string>>>>,"
    "tolerations:array<struct<key:string,value:string,effect:string,operator:string>>,"
    f"affinity:struct<nodeTerms:array<struct<matchExpressions:{_EXPRESSIONS}>>,podTerms:{_POD_TERMS},antiTerms:{_POD_TERMS}>,"
    f"topologySpreadConstraints:array<struct<maxSkew:int,whenUnsatisfiable:string,topologyKey:string,labelSelector:struct<matchExpressions:{_EXPRESSIONS}>>>>, "
    "status struct<phase:string>"
)
NODE = (
    "metadata struct<uid:string,name:string,labels:map<string,string>>, "
    "spec struct<unschedulable:boolean,taints:array<struct<key:string,value:string,effect:string>>>, "
    "status struct<conditions:array<struct<type:string,status:string>>,allocatable:map<string,string>,images:array<struct<names:array<string>,sizeBytes:long>>>"
)
#: Address of ports that name none, and the operator of tolerations that name none (fixed values).
ANY_ADDRESS, DEFAULT_OPERATOR = "0.0.0.0", "Equal"


def _or(x: str, default: str) -> Column:
    return F.coalesce(F.col(x), F.lit(default))


def _terms(objects: DataFrame, terms: Column, expressions: str) -> DataFrame:
    """(uid, term, expr, key, op, values) of each label expression; ``expr`` is its shared id."""
    rows = objects.select("uid", F.posexplode(terms).alias("term", "t")).select("uid", "term", F.explode(expressions).alias("e"))
    expr = placement.interned(F.col("e.key"), F.col("e.operator"), F.coalesce("e.values", F.array().cast("array<string>")))
    return rows.select("uid", "term", expr.alias("expr"), "e.key", F.col("e.operator").alias("op"), F.col("e.values").alias("values"))


def pods(objects: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``objects`` (columns of POD)."""
    objects = objects.withColumn("uid", F.col("metadata.uid"))
    containers = objects.select("uid", F.explode("spec.containers").alias("c"))
    requests = containers.select(F.col("uid").alias("pod"), F.explode("c.resources.requests").alias("resource", "text"))
    amount = lambda df: df.select("pod", "resource", placement.quantity(F.col("text"), F.col("resource"), strict=True).alias("amount"))
    overheads = objects.select(F.col("uid").alias("pod"), F.explode("spec.overhead").alias("resource", "text"))
    demands = placement.rollup(amount(requests), amount(overheads), objects.select(F.col("uid").alias("pod")))
    ports = containers.select("uid", F.explode("c.ports").alias("p")).where("p.hostPort IS NOT NULL")
    tolerations = objects.select("uid", F.explode("spec.tolerations").alias("t"))
    spreads = objects.select("uid", F.explode("spec.topologySpreadConstraints").alias("s"))
    # A node selector is one more term: every key is in its one value.
    selector = F.transform(F.map_entries("spec.nodeSelector"), lambda e: F.struct(e["key"].alias("key"), F.lit("In").alias("operator"), F.array(e["value"]).alias("values")))
    chosen = F.when(F.size(F.coalesce(F.map_keys("spec.nodeSelector"), F.array().cast("array<string>"))) > 0, F.array(F.struct(selector.alias("matchExpressions"))))
    nodes = F.concat(F.coalesce(chosen, F.array().cast(f"array<struct<matchExpressions:{_EXPRESSIONS}>>")), F.coalesce(F.col("spec.affinity.nodeTerms"), F.array().cast(f"array<struct<matchExpressions:{_EXPRESSIONS}>>")))
    return {
        "pod_info": objects.select("uid", F.col("metadata.name").alias("name"), F.col("metadata.namespace").alias("namespace"), F.col("metadata.resourceVersion").alias("version"), F.col("spec.nodeName").alias("node"), F.col("status.phase").alias("status"), F.col("spec.schedulerName").alias("scheduler"), placement.priority(F.col("spec.priority")).alias("priority")),
        "pod_demands": demands,
        "pod_images": containers.select("uid", F.col("c.image").alias("image")).distinct(),
        "pod_ports": ports.select("uid", _or("p.hostIP", ANY_ADDRESS).alias("ip"), F.col("p.hostPort").alias("port"), F.col("p.protocol").alias("protocol")),
        "pod_labels": objects.select("uid", F.explode("metadata.labels").alias("key", "value")),
        "pod_tolerations": tolerations.select("uid", _or("t.key", "").alias("key"), _or("t.value", "").alias("value"), _or("t.effect", "").alias("effect"), _or("t.operator", DEFAULT_OPERATOR).alias("op")),
        "pod_node_terms": _terms(objects, nodes, "t.matchExpressions"),
        "pod_affinity_terms": _terms(objects, F.col("spec.affinity.podTerms"), "t.labelSelector.matchExpressions"),
        "pod_anti_affinity_terms": _terms(objects, F.col("spec.affinity.antiTerms"), "t.labelSelector.matchExpressions"),
        "pod_spreads": spreads.select("uid", F.col("s.topologyKey").alias("key"), F.col("s.maxSkew").alias("max_skew"), F.col("s.whenUnsatisfiable").alias("otherwise")),
    }


def nodes(objects: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``objects`` (columns of NODE)."""
    objects = objects.withColumn("uid", F.col("metadata.uid"))
    told = objects.select("uid", F.explode_outer("status.conditions").alias("c")).select("uid", F.col("c.type").alias("kind"), F.col("c.status").alias("told"))
    flags = placement.conditions(told, "uid", "kind", "told")
    info = objects.select("uid", F.col("metadata.name").alias("name"), F.coalesce("spec.unschedulable", F.lit(False)).alias("unschedulable"))
    taints = objects.select("uid", F.explode("spec.taints").alias("t"))
    images = objects.select("uid", F.explode("status.images").alias("i"))
    return {
        "node_info": info.join(flags, "uid"),
        "node_labels": objects.select("uid", F.explode("metadata.labels").alias("key", "value")),
        "node_taints": taints.select("uid", "t.key", _or("t.value", "").alias("value"), "t.effect"),
        "node_images": images.select("uid", F.explode("i.names").alias("name"), placement.megabytes(F.col("i.sizeBytes")).alias("megabytes")),
        "node_resources": objects.select("uid", F.explode("status.allocatable").alias("resource", "text")).select("uid", "resource", placement.quantity(F.col("text"), F.col("resource"), strict=True).alias("allocatable")),
    }
