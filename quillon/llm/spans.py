"""Places of regular-expression matches, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


#: Matches whose places are summed up one by one; the sums of such blocks are added afterwards.
BLOCK = 256


def matches(text: Column, pattern: str, rank: int, kind: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as SPAN; places are code points, the end exclusive.

    ``value`` is ``group`` of the match, or all of it. The gaps between matches come from
    splitting at the pattern; running sums of gaps and matches give the places, block by block,
    so that a text with very many matches doesn't copy its array for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["match"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(one))).alias("spans"))

    def summed(steps: Column) -> Column:
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")), step)

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["value"].alias("value")))

    def blocked(steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda i: summed(F.slice(steps, i * BLOCK + 1, F.lit(BLOCK))))
        before = lambda x: F.aggregate(F.transform(x, lambda b: b["at"]), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return _let(blocks, lambda x: _let(before(x), lambda sums: F.flatten(F.transform(x, lambda b, i: moved(b["spans"], F.get(sums, i))))))

    return _let(zipped, lambda steps: F.when(F.size(steps) <= BLOCK, summed(steps)["spans"]).otherwise(blocked(steps)))


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches_if(text: Column, needed: Column, pattern: str, rank: int, kind: str, group: int | None = None) -> Column:
    """``matches`` where ``needed`` holds, which it must wherever the pattern matches; else none."""
    return F.when(needed, matches(text, pattern, rank, kind, group)).otherwise(F.array().cast(SPAN))


def written(spans: Column) -> Column:
    """``kind:start:end`` by start, then rank, comma-joined."""
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(key), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
