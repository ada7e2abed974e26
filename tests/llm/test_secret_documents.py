from pyspark.sql import functions as F

from quillon.llm import common, secrets


def test_models_alone_tell_the_documents_secrets_from_words(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.scan(common.table(spark, "/root/testdata/sf0.01", "documents"), model)
    ratio = lambda v: F.greatest(secrets.mean_ratio(v, model), secrets.best_window(v, model))
    rows = found.select(F.explode(F.concat(F.transform("base", lambda s: F.struct(F.lit(1).alias("label"), s["value"].alias("value"))), F.transform("candidates", lambda s: F.struct(F.lit(0).alias("label"), s["value"].alias("value"))))).alias("x")).select("x.*")
    scored = rows.where(F.length("value") >= secrets.LEAST).select("label", (ratio(F.col("value")) > secrets.THRESHOLD).alias("random"))
    counts = {(r.label, r.random): r["count"] for r in scored.groupBy("label", "random").count().collect()}
    assert counts.get((1, True), 0) > 10 and not counts.get((1, False)) and not counts.get((0, True))
