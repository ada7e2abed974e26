"""The registered query of each operator: production parameters over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import bpe_tables

    coded = bpe_tables.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import token_files

    path = f"{common.shared_dir(spark)}/quillon/token-files-{uuid.uuid4().hex}"
    token_files.write_files(spark, common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import packing

    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import secrets, spans

    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.scan(common.table(spark, sf_dir, "documents"), model)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"), spans.written(F.concat("base", "random")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import quality

    judged = quality.judge(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import personal

    found = personal.find(common.table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, personal.KINDS))

    def written(spans):
        ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(personal.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.concat("spans", "more")).alias("spans"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import neighbours

    return neighbours.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import near_dup

    return near_dup.near_duplicates(common.table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import toxicity

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = toxicity.train(toxicity.labelled_sample(docs, labels.where(~held_out)))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.PREDICT).cast("int").alias("predicted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm import chat

    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    read = chat.read_back(common.stage(spark, chat.format_examples(rows), "chat-examples"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_secrets, op3_token_files, op4_packing, op5_quality, op6_personal, op7_neighbours, op8_near_dup, op9_toxicity, op10_chat)
}
#: What the words and lines of a text are, for DuckDB.
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_LINE = r"lower(trim(regexp_replace(regexp_replace(l, '[1-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' '))"
_TURN = "23 + length(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'))"

#: Exact counterparts: nothing is hashed, sketched or sampled in them.
SQL: dict[str, str] = {
    "op5_quality": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS} AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
named AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three FROM windows),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM named) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM often, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
flat AS (SELECT r, source, text, {_LINE} AS line FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS l FROM d)),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
held AS (SELECT source, line, count(DISTINCT text) AS n FROM flat WHERE line <> '' GROUP BY source, line),
bad AS (SELECT held.source, line FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE held.n > 20 AND (held.n > hosts.n * 0.01 OR held.n > 1000)),
gone AS (SELECT r, sum(length(flat.line) - length(replace(flat.line, ' ', '')) + 1) AS n FROM flat JOIN bad ON flat.source IS NOT DISTINCT FROM bad.source AND flat.line = bad.line GROUP BY r),
counted AS (SELECT w.r, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.r = w.r)
SELECT doc_id, CAST(n_words AS bigint) AS n_words, CAST(word_chars AS bigint) AS word_chars, CAST(n_symbols AS bigint) AS n_symbols, CAST(n_dup_lines AS bigint) AS n_dup_lines, CAST(n_repeat_words AS bigint) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(gone.n, 0) >= 50 AS kept
FROM counted LEFT JOIN gone ON gone.r = counted.r
""",
    "op8_near_dup": f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, {_WORDS} AS words FROM d),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id, coalesce(least.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
""",
    "op10_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, {_TURN.format("role")} + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS chars FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS bigint) AS formatted_chars
FROM p GROUP BY conv_id
""",
}
