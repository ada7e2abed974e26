"""Quality rules: counts over each text, and cross-document line frequency per host.

Lines are normalised (case, digits, white space) and hashed; for each host (``source``) the
distinct documents that hold a line are counted, told apart by their texts: exact copies are one
document here, so that a document isn't depleted because it was copied. Lines are boilerplate if
more than ``min_texts`` documents hold them, and more than ``max_share`` of the host's or more than
``max_texts``. They are taken out, and a document is rejected when fewer than ``min_left`` words,
the least that a document needs, are left.

The text is read once, and what is known of each row is stored: the counts, and the hashes and
sizes of its lines. All lines are dealt out once, as counts of (host, line); those that enough rows
hold are few, and only for them texts are counted and rows looked up.

Only DataFrame functions are used. Repeated 3-word windows are found inside each row, without
a shuffle: window hashes are sorted together with their places. Null texts have no words and
fail; a null source is a host of its own; null ids are kept; repeated rows give repeated results;
further columns are ignored; an empty table gives no rows. A text may be as long as a row can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_TEXTS = 20
MAX_SHARE = 0.01
MAX_TEXTS = 1000
MIN_LEFT = MIN_WORDS
#: Bits of a packed number that hold a window's place.
PLACE_BITS = 28


def words_of(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def _covered(places: Column) -> Column:
    """How many words the 3-word windows at the ascending ``places`` cover."""
    def step(acc: Column, p: Column) -> Column:
        return F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))

    return F.aggregate(places, F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")), step, lambda acc: acc["n"])


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``words``.

    First each window's hash, cut to its high bits, is sorted together with the place; only
    windows with an equal neighbour are then compared by their whole hash.
    """
    low = F.lit((1 << PLACE_BITS) - 1).cast("bigint")
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2))
    packed = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("packed", F.when(F.col("n_words") > 3, F.sort_array(packed)))
    top = lambda i: F.shiftright(F.get("packed", i), PLACE_BITS)
    like = F.filter("packed", lambda x, i: F.coalesce(F.shiftright(x, PLACE_BITS) == top(i + 1), F.lit(False)) | F.coalesce(F.shiftright(x, PLACE_BITS) == F.when(i > 0, top(i - 1)), F.lit(False)))
    df = df.withColumn("like", F.coalesce(like, F.array().cast("array<bigint>")))
    exact = F.sort_array(F.transform("like", lambda x: F.struct(window(x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).alias("p"))))
    df = df.withColumn("exact", F.when(F.size("like") > 0, exact))
    same = lambda x, i: F.coalesce(x["h"] == F.get("exact", i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.when(i > 0, F.get("exact", i - 1))["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("exact", same), lambda x: x["p"]))
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("like") > 0, _covered(places)), F.lit(0).cast("bigint"))).drop("hashes", "packed", "like", "exact")


def _lines(text: Column, host: Column) -> Column:
    """``key`` (hash of the host and the normalised line) and ``words`` of each line with a word."""
    plain = F.lower(F.translate(text, "\t\x0b\x0c\r123456789", " " * 4 + "0" * 9))
    plain = F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)
    bare = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    return F.transform(bare, lambda x: F.struct(F.xxhash64(host, x).alias("key"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))


def measured(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text, source): the counts over its text, ``base_failed``, ``text_hash``, ``host`` and ``lines``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = df.select("doc_id", "source", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    docs = docs.withColumn("host", F.xxhash64(F.col("source").isNull(), "source"))
    docs = docs.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("bigint"))
    docs = docs.withColumn("raw", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    docs = docs.withColumns(
        {
            "word_chars": F.length(F.translate("text", SPACE, "")).cast("bigint"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint"),
            "lines": _lines(F.col("text"), F.col("host")),
        }
    ).drop("text", "raw")
    docs = with_repeats(docs).drop("words")
    return docs.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def counts(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text, source): the counts over its text, and ``base_failed``."""
    return measured(df).drop("lines", "host")


def judge(df: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, max_texts: int = MAX_TEXTS, min_left: int = MIN_LEFT) -> DataFrame:
    """``counts`` with ``n_left`` (words outside boilerplate lines) and ``kept``."""
    spark = df.sparkSession
    own = common.stage(spark, measured(df).withColumn("row", F.monotonically_increasing_id()), "quality-rows")
    keys = own.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    # Rows are at least as many as texts, so no line of too many texts is missing here.
    often = common.stage(spark, keys.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > min_texts).select("key"), "quality-often")
    texts = common.join_sized(keys, often, "key").groupBy("key", "host").agg(F.count_distinct("text_hash").alias("n_texts")).where(F.col("n_texts") > min_texts)
    hosts = own.groupBy("host").agg(F.count_distinct("text_hash").alias("host_texts"))
    texts = texts.join(hosts, "host").where((F.col("n_texts") > F.col("host_texts") * max_share) | (F.col("n_texts") > max_texts))
    boilerplate = common.stage(spark, texts.select("key"), "quality-boilerplate")
    lines = own.select("row", F.inline("lines"))
    gone = common.join_sized(lines, boilerplate, "key").groupBy("row").agg(F.sum("words").alias("n_gone"))
    judged = own.drop("lines", "host").join(gone, "row", "left").withColumn("n_left", F.col("n_words") - F.coalesce("n_gone", F.lit(0)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= min_left)).drop("row", "n_gone")
