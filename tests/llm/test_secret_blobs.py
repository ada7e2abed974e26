import random
import re
import time

from pyspark.sql import functions as F

from quillon.llm import secrets, spans


def test_many_matches_and_long_blobs(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    many = " ".join(f"é{'x' * (i % 7)} {rng.getrandbits(80):020x}" for i in range(3000))
    blob = "".join(rng.choice(letters) for _ in range(300_000))
    plain = "load_user_index_table/" * 15_000
    df = spark.createDataFrame([(1, many), (2, blob), (3, plain), (4, "a-" * 100_000), (5, "")], "doc_id long, text string")
    model = secrets.train(secrets.labelled_samples(spark, 300))
    began = time.time()
    rows = {r.doc_id: r for r in secrets.scan(df, model).select("doc_id", spans.written(F.col("hex")).alias("hex"), spans.written(F.col("random")).alias("random")).collect()}
    assert time.time() - began < 90
    assert rows[1].hex == ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{16,}", many))
    assert rows[2].random == "random:0:300000" and rows[3].random == rows[4].random == rows[5].random == ""
