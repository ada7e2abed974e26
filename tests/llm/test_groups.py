import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import near_dup, neighbours, personal, queries, toxicity


def word_shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def brute_components(rows, words, percent):
    sets = [(d, word_shingles(t, words)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and (100 * len(x & y) >= percent * len(x | y)):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets}


def chained(n):
    """Copies of one text with more and more words changed, and a passage that others share."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(n):
        own = list(base)
        for j in range(k):
            own[(j * 7) % 200] = f"x{k if j % 3 == 0 else j}"
        rows.append((1000 + k, " ".join(own)))
    rows += [(2000 + k, " ".join(base[:80] + [f"p{k}q{i}" for i in range(60)])) for k in range(40)]
    rows += [(3000 + k, f"Tiny {k % 3}") for k in range(6)] + [(3100, "A  b\tc"), (3101, "a b C"), (3102, None), (3103, " \n")]
    return rows


def test_near_duplicates_match_brute_force(spark, sf, docs):
    rows = chained(25) + [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        expected = brute_components(rows, words, percent)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words, percent).collect()}
        assert found == expected
    assert near_dup.near_duplicates(docs).count() == docs.count()
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1500, rows[40][1]), (1501, None), (1502, [0.0] * 24), (1503, [float("nan")] * 24), (1520, [None] * 24), (None, rows[3][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, shard_cells=8000).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = np.vstack([x, x[40:41]]).astype(np.float64)
    hits = total = 0
    for q in range(0, 1501, 20):
        scores = good @ good[q]
        scores[q] = -np.inf
        best = sorted(range(len(good)), key=lambda i: (-round(scores[i], 9), i))[:20]
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(best))
        total += 20
    assert hits / total >= 0.9
    assert set(found) == set(range(0, 1501, 20))
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_op7_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in queries.op7_neighbours(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[ids[q]] & set(ids[np.argsort(-s)[:20]]))
    assert hits / (20 * len(found)) >= 0.9


def brute_personal(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        check = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and check % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_personal_data_matches_brute_force(spark, sf, docs):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    names = personal.KINDS
    found = {r.doc_id: r for r in queries.op6_personal(spark, sf).collect()}
    assert len(found) == len(rows)
    for r in rows:
        own = brute_personal(r.text or "")
        shown = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in own)
        assert found[r.doc_id].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [found[r.doc_id][f"n_{names[k]}"] for k in range(4)] == [sum(x[1] == k for x in own) for k in range(4)]
    for r in docs.where("text IS NOT NULL").collect():
        assert [(s, k, e) for s, e, k in personal.base_spans(r.text)] == brute_personal(r.text)
    assert personal.base_spans("a@b.c@d.e@f 1.2.3.4.5.6.7.8 " + "9" * 5000) == [(s, e, k) for s, k, e in brute_personal("a@b.c@d.e@f 1.2.3.4.5.6.7.8 " + "9" * 40)]
    assert personal.find(docs.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers_and_mask(spark):
    rows = [(i, f"please dial hotline: +1 (476) 555-5{100 + i} and so on") for i in range(12)]
    rows += [(50, "please dial hotline: 476-555-9123 and then"), (51, "the count was 4765559123 in all"), (52, None), (53, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x"))
    more = {r.doc_id: r.more for r in personal.find(df.select("doc_id", "text")).collect()}
    assert [(m.start, m.end) for m in more[50]] == [(21, 33)]
    assert not more[51]
    texts = {r.doc_id: r.text for r in personal.mask(df).collect()}
    assert texts[0] == "please dial hotline: <PHONE> and so on" and texts[50] == "please dial hotline: <CONTEXT> and then"
    assert texts[51] == rows[13][1] and texts[52] is None and texts[53] == "nothing"


def test_toxicity_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    toxic = [r.predicted for r in held if truth[r.doc_id] == 1]
    clean = [r.predicted for r in held if truth[r.doc_id] == 0]
    # The insults of some languages here are made of common syllables; not all of those are found (see the README).
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.01


def test_toxicity_edges(spark, docs):
    texts = [("you idiot friend of mine", 1), ("idiot says the other", 1), ("what an idiot that one", 1), ("good day to you all", 0), ("the weather stays fine", 0), ("see you soon at home", 0)]
    model = toxicity.train(texts)
    scored = {r.doc_id: r.toxic_score for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == docs.select("doc_id").distinct().count()
    near, far = model.margins(["id-iot", "weather"])
    assert near > far
    assert toxicity.train([]) is None
    assert {r.toxic_score for r in toxicity.score(docs, None).collect()} == {0.0}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels) == []


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, text_of = [docs.count()], None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        counts.append(docs.count())
        text_of = docs
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    assert not any(brute_personal(r.text) for r in text_of.collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {d for d, _ in rows}
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()
