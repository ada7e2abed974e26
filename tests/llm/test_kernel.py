import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity


def direct(word):
    """Weights of the word's gapped three-character subsequences, counted one by one, over the norm of a word of its length."""
    text = ["^", *word]
    code = lambda c: toxicity._TABLE[ord(c)] if ord(c) < 256 else toxicity._TABLE[ord("?")]
    found = {}
    for i in range(len(text)):
        for j in range(i + 1, len(text)):
            for k in range(j + 1, len(text)):
                if (j - i, k - j) in toxicity.GAPS:
                    key = (code(text[i]), code(text[j]), code(text[k]))
                    found[key] = found.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
    norm = math.sqrt(max(1e-9, sum(toxicity.DECAY ** (2 * (a + b - 2)) * max(0, len(text) - a - b) for a, b in toxicity.GAPS)))
    return {key: x / norm for key, x in found.items()}


def test_kernel_equals_direct_counts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcd1@é.") for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["漢字かな", "idiot", "id-iot", "i d"]
    got = toxicity.products(words, toxicity.vectors(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = direct(a), direct(b)
            assert got[i, j] == pytest.approx(sum(v * y.get(k, 0.0) for k, v in x.items()))


def test_inserted_characters_stay_close():
    near, far = toxicity.products(["id.iot", "weather"], toxicity.vectors(["idiot"]))[:, 0]
    assert near > 4 * far


def test_long_landmarks_and_texts_count_whole(spark):
    long = "x" * 40 + "idiot"
    assert toxicity.products(["idiot"], toxicity.vectors([long]))[0, 0] > 0
    docs = spark.createDataFrame([(1, "word " * 30_000 + "lastword"), (2, "short text here"), (None, "no id")], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(toxicity.labelled_sample(docs, labels)) == [(("here", "short", "text"), 0), (("lastword", "word"), 1)]


def test_machine_separates_what_can_be_separated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ np.array([1.0, -2, 0, 0, 1]) > 0.3, 1.0, -1.0)
    w, bias = toxicity.fit_machine(x, y)
    assert (np.sign(x @ w + bias) == y).mean() > 0.97


def test_columns_of_the_same_name_are_replaced(spark, docs, empty):
    scored = toxicity.score(docs.withColumn("toxic_score", F.lit("old")), None)
    assert scored.columns == [*docs.columns, "toxic_score"] and {r.toxic_score for r in scored.collect()} == {0.0}
    assert toxicity.score(empty, None).count() == 0
