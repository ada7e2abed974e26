"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run``
writes each stage's rows to the shared folder and reads them again for the next one.

In every stage a null text counts as empty, a null id or source is a value of its own, rows that
repeat fare alike, columns beside doc_id, text and source are kept as they are, whatever their
names, an empty table gives no rows, and texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, near_dup, packing, personal, quality, toxicity

#: Words that packing remembers: the executor's heap has grown in the stages before,
#: and the workers go on to other stages, so they hold few and only while a task of packing runs.
PACKING_WORDS = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; empty texts have too few words and go."""
    doc, source, text_hash = common.free_names(docs, "q_doc", "q_source", "q_hash")
    gone = quality.judge(docs).where("NOT kept").select("doc_id", "source", "text_hash").distinct().toDF(doc, source, text_hash)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text_hash))
    return docs.join(gone, same, "left_anti")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; trained on all labels of documents here. Without labels all stay."""
    model = toxicity.train(toxicity.labelled_sample(docs, common.table(spark, sf_dir, "labels")))
    (score,) = common.free_names(docs, "toxic_score")
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.PREDICT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8. Those without words or id stay."""
    gone = near_dup.near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return personal.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=PACKING_WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]
#: A string-kernel machine and a tokenizer library are among the stages: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
