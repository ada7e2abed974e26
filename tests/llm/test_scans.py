import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from quillon.llm import chat, quality, queries, secrets, spans

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def joined(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_secret_patterns_match_brute_force(spark, docs):
    model = secrets.train(secrets.labelled_samples(spark, 300))
    rows = secrets.scan(docs, model).select("doc_id", "text", spans.written(F.col("base")).alias("base"), spans.written(F.col("random")).alias("random")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base == joined(base_secrets(r.text))
    random = next(r for r in rows if r.doc_id == 9)
    at = random.text.index("kq3J8sZp")
    assert random.random == f"random:{at}:{at + 24}"
    assert secrets.scan(docs.limit(0), model).count() == 0


def test_markov_models_tell_held_out_samples_apart(spark):
    samples = secrets.labelled_samples(spark, 1200)
    split = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    model = secrets.train(samples.where(~split))
    held = samples.where(split).select("label", (secrets.mean_ratio(F.col("text"), model) > secrets.THRESHOLD).cast("int").alias("said"))
    right = held.agg(F.avg((F.col("label") == F.col("said")).cast("int")).alias("a")).first().a
    assert right > 0.97


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts_match_brute_force(spark, docs, sf):
    some = docs.select("doc_id", "text", "source").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))
    texts = {(r.doc_id, r.text or "") for r in some.collect()}
    by_id = {}
    for d, t in texts:
        by_id.setdefault(d, set()).add(brute_quality(t))
    rows = quality.counts(some).collect()
    assert len(rows) == some.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in by_id[r.doc_id]


def test_boilerplate_only_documents_are_depleted(spark):
    line = " ".join(f"terms{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(60))
    rows = [(k, f"{own(k)}\n{line}", "h") for k in range(30)] + [(100, line, "h"), (101, line, "other"), (102, None, None)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[k] for k in range(30))
    assert not kept[100] and kept[101] and not kept[102]


def brute_verdicts(rows):
    """(n_left, kept) by row, for rows of doc_id, text, source."""
    def lines(text):
        plain = (re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[1-9]", "0", x)).strip(" ").lower() for x in (text or "").split("\n"))
        return [x for x in plain if x]

    holders, hosts = {}, {}
    for _, text, source in rows:
        hosts.setdefault(source, set()).add(text or "")
        for x in lines(text):
            holders.setdefault((source, x), set()).add(text or "")
    bad = {k for k, v in holders.items() if len(v) > quality.MIN_TEXTS and (len(v) > len(hosts[k[0]]) * quality.MAX_SHARE or len(v) > quality.MAX_TEXTS)}
    for doc, text, source in rows:
        base = brute_quality(text or "")
        left = base[0] - sum(x.count(" ") + 1 for x in lines(text) if (source, x) in bad)
        yield doc, left, not base[5] and left >= quality.MIN_LEFT


def test_verdicts_match_brute_force(spark, docs, sf):
    some = docs.select("doc_id", "text", "source").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))
    own = lambda k, n: " ".join(f"own{k}x{chr(97 + i % 26)}{i // 26}" for i in range(n))
    shared = [(1000 + k, f"{own(chr(97 + k % 26), k)}\nall  RIGHTS reserved 20{k}\n\tall rights reserved 2099\n" + "see the shared notice " * 20, None) for k in range(40, 80)]
    some = some.union(spark.createDataFrame(shared, some.schema))
    got = sorted((r.doc_id or -1, r.n_left, r.kept) for r in quality.judge(some).collect())
    wanted = sorted((d or -1, n, k) for d, n, k in brute_verdicts([tuple(r) for r in some.collect()]))
    assert got == wanted
    assert {k for d, _, k in got if d >= 1000} == {True, False}
    assert quality.judge(some.limit(0)).count() == 0


def test_copies_do_not_deplete_each_other(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(k, text, "h") for k in range(200)], "doc_id long, text string, source string")
    assert quality.judge(df).where("kept").count() == 200


def test_chat_round_trip_and_mask(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b<|end|>c\\<|x", "", None, "<|role|><|text|>\n😀", "\\\\<\\|"]
    rows = [(1, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(odd)]
    rows += [(2, 0, "user", "only asked"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, None, "assistant", "lone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat.format_examples(df)
    assert {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 1, 3: 2, None: 1}
    for r in chat.read_back(examples).collect():
        own = [(t, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == [(a, b) for _, a, b in own]
        assert r.loss == "".join(b for _, a, b in own if a == "assistant")
    assert chat.read_back(chat.format_examples(df.limit(0))).count() == 0


def test_op10_matches_brute_force(spark, sf):
    conv = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        conv.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    rows = queries.op10_chat(spark, sf).collect()
    assert len(rows) == len(conv) + 1
    for r in rows:
        own = sorted(conv.get(r.conv_id, [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
