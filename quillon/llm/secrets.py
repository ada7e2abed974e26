"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

Two first-order Markov models over printable ASCII, one of random strings and one of ordinary
identifiers, are trained from labelled samples by counting pairs of neighbouring characters.
Candidates are runs of token characters without the spans that patterns have found. The whole
run, its parts between separators, and every window of LEAST characters in a part are scored by
the mean log-likelihood ratio of their pairs; a run is reported as ``random`` where it exceeds
``threshold`` as a whole, else its parts that do, as a whole or in a window.

Only DataFrame functions are used. Null texts count as empty, repeated rows give repeated
results, a null doc_id is kept, further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)(?:word|passwd|secret|token|key)[\x22']?\x20*[:=]"
#: As the fixed pattern with its least length: a run too short has no longer one inside.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SEPARATORS = "/_=-"
#: Characters of a candidate, and of a window that is scored, at least.
LEAST = 20
#: Mean log-likelihood ratio per pair of characters above which a candidate is random.
THRESHOLD = 0.5
CODES = 96

#: Words that ordinary identifiers are made of, for the labelled samples.
WORDS = (
    "account action address amount array async base batch block buffer build byte cache call channel char check child "
    "class clear client close code column command config connect content context control copy count create current data "
    "date default delete depth device dict document domain element empty encode engine entry error event export factory "
    "field file filter final find first flag format frame function get global group handle hash header height helper host "
    "image import index info init input insert item iterator key label last length level library limit line link list "
    "load local lock log manager map mask match max memory merge message method min mode model module name network next "
    "node number object offset open option order output package page parent parse path pattern plugin pool port position "
    "prefix print process project property proxy query queue random range read record reference register remove render "
    "replace report request reset resource response result return root route row run sample save scale schema scope score "
    "search section select send sequence server service session set shape size sort source split stack start state static "
    "status step stop storage stream string style submit table tag target task template test text thread time title "
    "token total trace transform tree type update upload user util valid value variable vector version view weight width window worker write"
).split()


def labelled_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """``text``, ``label``: n random strings (1) in the usual alphabets, n identifiers (0) in the usual styles."""
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    ids = spark.range(n)
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    random = F.when(F.col("id") % 4 == 0, b64).when(F.col("id") % 4 == 1, F.translate(b64, "+/=", "xY7")).when(F.col("id") % 4 == 2, F.substring(digest, 1, 40)).otherwise(F.upper(F.translate(F.substring(b64, 1, 32), "+/=", "QZ2")))
    parts = [pick(k) for k in range(5)]
    number = F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")
    style = F.col("id") % 6
    plain = (
        F.when(style == 0, F.concat_ws("_", *parts[:4]))
        .when(style == 1, F.concat(parts[0], *(F.initcap(p) for p in parts[1:4])))
        .when(style == 2, F.concat_ws("-", *parts[:3], number))
        .when(style == 3, F.concat_ws("/", *parts))
        .when(style == 4, F.upper(F.concat_ws("_", *parts[:4])))
        .otherwise(F.concat(*parts[:4]))
    )
    return ids.select(random.alias("text"), F.lit(1).alias("label")).union(ids.select(plain.alias("text"), F.lit(0).alias("label")))


def _codes(text: Column) -> Column:
    """1 to 95 for each printable ASCII character, 0 for any other."""
    code = lambda c: F.when((F.ascii(c) >= 32) & (F.ascii(c) < 127), F.ascii(c) - 31).otherwise(0)
    return F.transform(F.split(text, ""), code)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of codes; what reaches the driver is CODES squared numbers."""
    codes = samples.where(F.length("text") > 1).select("label", _codes(F.col("text")).alias("codes"))
    pairs = codes.select("label", "codes", F.explode(F.sequence(F.lit(0), F.size("codes") - 2)).alias("at"))
    counts = pairs.groupBy(F.get("codes", F.col("at")).alias("a"), F.get("codes", F.col("at") + 1).alias("b")).agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    from pyspark.sql import Window as W

    w = W.partitionBy("a")
    smooth = lambda n: F.log((F.col(n) + 0.5) / (F.sum(n).over(w) + 0.5 * CODES))
    all_pairs = samples.sparkSession.range(CODES * CODES).select((F.col("id") / CODES).cast("int").alias("a"), (F.col("id") % CODES).cast("int").alias("b"))
    full = all_pairs.join(counts, ["a", "b"], "left").fillna(0, ["n1", "n0"])
    scored = full.select("a", "b", (smooth("n1") - smooth("n0")).alias("ratio"))
    row = scored.agg(F.sort_array(F.collect_list(F.struct("a", "b", "ratio"))).alias("r")).select(F.transform("r", lambda x: F.round(x["ratio"], 5)).alias("r")).first()
    return list(row.r)


def _ratios(text: Column, model: list[float]) -> Column:
    """The ratio of each pair of neighbouring characters; characters are looked up once each."""
    ratios = F.from_json(F.lit(json.dumps(model)), "array<double>")
    pairs = lambda codes: F.transform(F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda c, i: F.get(ratios, F.get(codes, i) * CODES + c))
    return spans._let(_codes(text), pairs)


def mean_ratio(text: Column, model: list[float]) -> Column:
    """The mean ratio over the pairs of characters of ``text``."""
    mean = lambda r: F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x) / F.size(r)
    return F.when(F.length(text) > 1, spans._let(_ratios(text, model), mean)).otherwise(0.0)


def best_window(text: Column, model: list[float]) -> Column:
    """The greatest mean ratio over the windows of LEAST characters of ``text``."""
    n = LEAST - 1

    def best(r: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            now = acc["sum"] + F.get(r, i) - F.when(i >= n, F.get(r, i - n)).otherwise(0.0)
            return F.struct(now.alias("sum"), F.when(i >= n - 1, F.greatest(acc["best"], now)).otherwise(acc["best"]).alias("best"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1e9).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), start, step, lambda acc: acc["best"] / n)

    return F.when(F.length(text) >= LEAST, spans._let(_ratios(text, model), best)).otherwise(-1e9)


def _pieces(span: Column, gaps: Column) -> Column:
    """What is left of ``span`` without the ascending ``gaps`` (start, end), as SPAN."""
    def piece(start: Column, end: Column) -> Column:
        value = F.substring(span["value"], start - span["start"] + 1, end - start)
        return F.struct(start.alias("start"), end.alias("end"), span["rank"].alias("rank"), span["kind"].alias("kind"), value.alias("value"))

    def step(acc: Column, g: Column) -> Column:
        more = F.when(g["start"] - acc["at"] >= LEAST, F.concat(acc["out"], F.array(piece(acc["at"], g["start"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], g["end"]).alias("at"), more.alias("out"))

    last = F.struct(span["end"].alias("start"), span["end"].alias("end"))
    start = F.struct(span["start"].alias("at"), F.array().cast(spans.SPAN).alias("out"))
    return F.aggregate(F.concat(gaps, F.array(last)), start, step, lambda acc: acc["out"])


def _outside(span: Column, base: Column) -> Column:
    """The pieces of ``span`` of LEAST characters that no span of ``base`` meets."""
    near = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return _pieces(span, F.sort_array(F.transform(near, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))))


def _parts(span: Column) -> Column:
    """The parts of ``span`` of LEAST characters between separators."""
    chars = F.split(span["value"], "")
    places = F.filter(F.transform(chars, lambda c, i: F.when(F.instr(F.lit(SEPARATORS), c) > 0, i + 1)), lambda i: i.isNotNull())
    return _pieces(span, F.transform(places, lambda i: F.struct((span["start"] + i - 1).alias("start"), (span["start"] + i).alias("end"))))


def scan(df: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``df`` (doc_id, text): the text, ``base`` (spans of patterns), ``random`` (spans of the models)."""
    text = F.col("text")
    docs = common.texts_of(df.select("doc_id", "text"))
    assign = F.filter(spans.matches_if(text, text.rlike(ASSIGN_HINT), ASSIGN, 0, "assign", 2), lambda s: F.length(s["value"]) >= 12)
    access = spans.matches_if(text, text.contains("AKIA"), ACCESS, 1, "access")
    hexes = spans.matches_if(text, text.rlike("[0-9a-f]{16}"), HEX, 2, "hex")
    docs = docs.withColumns({"assign": assign, "access": access, "hex": hexes})
    docs = docs.withColumn("candidates", spans.matches_if(text, text.rlike("[A-Za-z0-9+/_=-]{20}"), CANDIDATE, 3, "random"))
    base = F.concat("assign", "access", "hex")
    free = F.flatten(F.transform("candidates", lambda c: _outside(c, F.col("base"))))
    docs = docs.withColumn("base", base).withColumn("candidates", free)
    telling = lambda c: F.filter(_parts(c), lambda p: (mean_ratio(p["value"], model) > threshold) | (best_window(p["value"], model) > threshold))
    random = F.flatten(F.transform("candidates", lambda c: F.when(mean_ratio(c["value"], model) > threshold, F.array(c)).otherwise(telling(c))))
    return docs.withColumn("random", F.when(F.size("candidates") > 0, random).otherwise(F.array().cast(spans.SPAN)))
