"""Personal data: fixed patterns, and identifiers found in the contexts that those appear in.

Bootstrapped extraction: entities that the fixed patterns find are seeds. The one to three words
before an entity, and those after it, are lexical patterns. Identifier-shaped strings that no fixed
pattern finds are candidate instances. Each round takes the patterns that stand beside at least
``min_seeds`` different known instances (at first the seeds), counts their words' occurrences in
the corpus, and scores the graph of patterns and instances: a pattern's score is the summed score
of its instances over all those occurrences, and an instance's is the noisy-or of its patterns'
scores, where of the patterns that end in the same word beside it only the best counts. Instances
that reach ``threshold`` are known from then on, so they support patterns of their own in the next
round; they are reported as ``context``. Rounds end when no pattern is new.

Null texts count as empty, repeated rows give repeated results, null ids are kept, further
columns are ignored by ``find`` and kept by ``mask``, whatever their names; an empty table gives no
rows. Very long words, runs of digits and texts take time in proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What follows the at sign of ``EMAIL``; the characters before it are walked over.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: As the fixed patterns; a match starts at a run's first digit, and none is tried inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifier-shaped: account numbers in groups of four, digits and their separators, or letters and digits.
START = re.compile(r"(?<!\w)(?:[(](?=[0-9])|(?=[A-Za-z]*+[0-9]))")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?(?!\w)")
NUMBER = re.compile(r"[(]?[0-9](?:[().\x20-]{0,2}+[0-9])*+")
TOKEN = re.compile(r"[A-Za-z0-9]++(?:[/-][A-Za-z0-9]++)*+")
WORD_AT = re.compile(r"\w")
#: With an at sign.
AT_CANDIDATE = re.compile(r"(?<![\w.%+-])[\w.%+-]+@(?:[\w.-]*\w)(?!@)")
#: Numbers have so many digits; letter-digit identifiers so many characters and digits.
NUMBER_DIGITS, ID_CHARS, ID_DIGITS = 6, 6, 4
DIGITS = "0123456789"
WORD = re.compile(r"\w+")
#: Words of a pattern, at most, and the characters that are searched for them at first.
PATTERN_WORDS = 3
REACH = 120
#: Patterns whose occurrences one pass counts.
PATTERNS_AT_ONCE = 300_000
MIN_SEEDS = 3
THRESHOLD = 0.5
ROUNDS = 3
SPANS = "array<struct<start:int,end:int,kind:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) of what the fixed patterns find, in order."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        left, domain = at, EMAIL_DOMAIN.match(text, at + 1)
        if domain:
            while left > done and text[left - 1] in EMAIL_CHARS:
                left -= 1
            if left < at:
                done = domain.end()
                found.append((left, done, 0))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def _digits(text: str) -> int:
    return sum(map(text.count, DIGITS))


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of numbers and letter-digit identifiers: no character is looked at more than a few times."""
    found = START.search(text)
    while found:
        start = found.start()
        account, number = ACCOUNT.match(text, start), NUMBER.match(text, start)
        end = account.end() if account else number.end() if number else start
        if number and not account and WORD_AT.match(text, end):
            # The last digits belong to a word: the number ends before them.
            end = start + len(text[start:end].rstrip(DIGITS).rstrip("(). -"))
        if account or _digits(text[start:end]) >= NUMBER_DIGITS:
            yield start + (text[start] == "(" and text.find(")", start, end) < 0), end
        else:
            start += text[start] == "("
            end = after = TOKEN.match(text, start).end()
            if WORD_AT.match(text, end):
                end = max(text.rfind("/", start, end), text.rfind("-", start, end), start)
            one = text[start:end]
            count = _digits(one)
            if count >= NUMBER_DIGITS or count >= ID_DIGITS and len(one) >= ID_CHARS:
                yield start, end
            end = end if end > start else after
        found = START.search(text, end)


def candidates_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of identifier-shaped strings between characters that are no part of words."""
    found = list(_numbers(text))
    ats = [m.span() for m in AT_CANDIDATE.finditer(text)] if "@" in text else []
    if ats:
        kept, i = list(ats), 0
        for start, end in found:
            while i < len(ats) and ats[i][1] <= start:
                i += 1
            if i == len(ats) or ats[i][0] >= end:
                kept.append((start, end))
        found = sorted(kept)
    return found


def _near(text: str, start: int, end: int) -> list[str]:
    """The words of text[start:end] in lower case, without one that an end cuts."""
    words = WORD.findall(text[start:end].lower())
    cut_start = start and WORD_AT.match(text, start - 1) and WORD_AT.match(text, start)
    cut_end = end < len(text) and WORD_AT.match(text, end - 1) and WORD_AT.match(text, end)
    return words[1 if cut_start else 0 : -1 if cut_end else None]


def _context(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The last one, two and three words before the place, and the first ones after it, however far they are."""
    reach, before, after = REACH, [], []
    while len(before) < PATTERN_WORDS and reach < 2 * start + REACH:
        before, reach = _near(text, max(0, start - reach), start), 2 * reach
    reach = REACH
    while len(after) < PATTERN_WORDS and reach < 2 * (len(text) - end) + REACH:
        after, reach = _near(text, end, end + reach), 2 * reach
    n = range(1, PATTERN_WORDS + 1)
    return [" ".join(before[-k:]) for k in n if k <= len(before)], [" ".join(after[:k]) for k in n if k <= len(after)]


def pattern_counts(text: str, wanted: list[set[tuple[str, ...]]]) -> Counter[tuple[str, ...]]:
    """How often each of the ``wanted`` patterns, in sets by their number of words, occurs in ``text``."""
    words = WORD.findall(text.lower())
    counts: Counter[tuple[str, ...]] = Counter()
    for k, patterns in enumerate(wanted):
        if patterns:
            counts.update(filter(patterns.__contains__, zip(*(words[i:] for i in range(k + 1)))))
    return counts


ROWS = "doc_id long, text_hash long, spans array<struct<start:int,end:int,kind:int>>, seeds array<struct<instance:string,left:array<string>,right:array<string>>>, candidates array<struct<start:int,end:int,instance:string,left:array<string>,right:array<string>>>"


def scan(df: DataFrame) -> DataFrame:
    """One pass over ``df`` (doc_id, text), kept in the shared folder: a row per document with its
    base spans, seeds and candidates in their contexts."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
    seed = pa.struct([("instance", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
    candidate = pa.struct([("start", pa.int32()), ("end", pa.int32()), *seed])
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("spans", pa.list_(span)), ("seeds", pa.list_(seed)), ("candidates", pa.list_(candidate))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Emitter(schema)
        for doc, text, text_hash in common.arrow_rows(batches, "doc_id", "text", "text_hash"):
            spans, seeds, candidates = [], [], []
            if any(map(text.__contains__, "0123456789@")):
                spans = base_spans(text)
                for start, end, _ in spans:
                    left, right = _context(text, start, end)
                    seeds.append({"instance": text[start:end], "left": left, "right": right})
                at, reach = 0, 0
                for start, end in candidates_of(text):
                    # Spans are in order: those that start before the candidate's end, and how far they reach.
                    while at < len(spans) and spans[at][0] < end:
                        reach = max(reach, spans[at][1])
                        at += 1
                    if reach <= start:
                        left, right = _context(text, start, end)
                        candidates.append({"start": start, "end": end, "instance": text[start:end], "left": left, "right": right})
            out.add(doc, text_hash, [{"start": s, "end": e, "kind": k} for s, e, k in spans], seeds, candidates)
            if out.full():
                yield out.take()
        yield out.take()

    docs = common.texts_of(df.select("doc_id", "text")).withColumn("text_hash", F.xxhash64("text"))
    return common.stage(df.sparkSession, docs.mapInArrow(run, ROWS), "personal-scan")


def occurrences(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, all): how often each of ``patterns`` (pattern, all different) occurs in the texts of ``df``.

    Each pass over the texts counts about PATTERNS_AT_ONCE patterns.
    """
    passes = max(1, -(-patterns.count() // PATTERNS_AT_ONCE))
    texts, found = common.texts_of(df.select("text")), None
    for part in range(passes):
        wanted: list[set[tuple[str, ...]]] = [set() for _ in range(PATTERN_WORDS)]
        for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == part).toLocalIterator():
            words = tuple(r.pattern.split(" "))
            wanted[len(words) - 1].add(words)
        counted = texts.mapInArrow(_counter(df.sparkSession.sparkContext.broadcast(wanted)), "pattern string, n long")
        found = counted if found is None else found.union(counted)
    return found.groupBy("pattern").agg(F.sum("n").alias("all"))


def _counter(shared: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, ...]] = Counter()
        for (text,) in common.arrow_rows(batches, "text"):
            counts.update(pattern_counts(text, shared.value))
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(p) for p in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    return run


def discover(scanned: DataFrame, df: DataFrame, min_seeds: int = MIN_SEEDS, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """The instances (``instance``, ``score``) that high-confidence patterns find; ``scanned`` is the scan of ``df``."""
    spark = scanned.sparkSession

    def edges(column: str, seed: int) -> DataFrame:
        one = scanned.select(F.explode(column).alias("x"))
        sided = lambda side, words: F.transform(words, lambda p: F.struct(F.lit(side).alias("side"), F.get(words, 0).alias("anchor"), p.alias("pattern")))
        one = one.select("x.instance", F.explode(F.concat(sided("L", F.col("x.left")), sided("R", F.col("x.right")))).alias("p"))
        return one.select("instance", "p.side", "p.anchor", F.concat_ws(" ", "p.side", "p.pattern").alias("key"), F.lit(seed).alias("seed"))

    graph = edges("seeds", 1).union(edges("candidates", 0)).groupBy("instance", "side", "anchor", "key").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.min("seed").alias("least"))
    graph = common.stage(spark, graph, "personal-graph")
    beside = graph.where("least = 0").select("key").distinct()
    scores = common.stage(spark, graph.where("seed = 1").select("instance").distinct().withColumn("score", F.lit(1.0)), "personal-seeds")
    words = seeds = None
    for _ in range(rounds):
        # The patterns that known instances support; those that are new are counted.
        known = scores.where(F.col("score") >= threshold).select("instance")
        support = common.join_skewed(graph, known, "instance").groupBy("key").agg(F.count_distinct("instance").alias("seeds")).where(F.col("seeds") >= min_seeds).select("key")
        support = support.join(beside, "key", "left_semi")
        new = common.stage(spark, support if words is None else support.join(words, "key", "left_anti"), "personal-patterns")
        if words is not None and new.isEmpty():
            break
        counted = new.withColumn("pattern", F.expr("substring(key, 3)"))
        more = counted.join(occurrences(df, counted.select("pattern").distinct()), "pattern").select("key", "all")
        words = common.stage(spark, more if words is None else words.union(more), "personal-words")
        live = common.stage(spark, common.join_skewed(graph, words, "key"), "personal-live")
        seeds = scores if seeds is None else seeds
        shares = common.join_skewed(live, scores, "instance").groupBy("key", "all").agg(F.sum(F.col("n") * F.col("score")).alias("s"))
        shares = shares.select("key", F.least(F.lit(0.999), F.col("s") / F.col("all")).alias("p"))
        best = common.join_skewed(live, shares, "key").groupBy("instance", "side", "anchor").agg(F.max("p").alias("p"))
        found = best.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("score"))
        scores = common.stage(spark, found.join(seeds, "instance", "left_anti").union(seeds), "personal-scores")
    return scores.where(F.col("score") >= threshold).join(seeds, "instance", "left_anti") if seeds is not None else scores.limit(0)


def context_spans(scanned: DataFrame, instances: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ``more``): the places of the discovered instances, by distinct document."""
    places = scanned.where(F.size("candidates") > 0).select("doc_id", "text_hash", F.explode("candidates").alias("c")).select("doc_id", "text_hash", "c.start", "c.end", "c.instance")
    one = F.struct("start", "end", F.lit(KINDS.index("context")).alias("kind"))
    return places.join(instances.select("instance"), "instance").groupBy(F.col("doc_id").alias("m_doc"), F.col("text_hash").alias("m_hash")).agg(F.collect_set(one).cast(SPANS).alias("more"))


def find(df: DataFrame, **settings) -> DataFrame:
    """Per row of ``df`` (doc_id, text): ``spans`` of the fixed patterns, ``more`` of the contexts."""
    scanned = scan(df)
    more = context_spans(scanned, discover(scanned, df, **settings))
    same = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("text_hash") == F.col("m_hash"))
    return scanned.join(more, same, "left").select("doc_id", "spans", F.coalesce("more", F.array().cast(SPANS)).alias("more"))


def mask(df: DataFrame, **settings) -> DataFrame:
    """``df`` with every found span of ``text`` replaced by its kind in angle brackets; nulls stay."""
    scanned = scan(df)
    more = context_spans(scanned, discover(scanned, df, **settings))
    key, doc, text_hash, places = common.free_names(df, "key", "doc", "hash", "places")
    keyed = df.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(more.toDF(doc, text_hash, places), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_hash)), "left").select(*df.columns, places)
    columns, place = df.columns, df.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for (text, more) in common.arrow_rows([batch], "text", places):
                if text is not None:
                    spans = base_spans(text) + [(x["start"], x["end"], x["kind"]) for x in more or ()]
                    parts, at = [], 0
                    for start, end, kind in sorted(spans):
                        if start >= at:
                            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
                        at = max(at, end)
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            rest = batch.select(columns)
            yield rest.set_column(place, "text", pa.array(texts, rest.schema.field(place).type))

    return joined.mapInArrow(run, df.schema)
