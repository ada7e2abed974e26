import random
import re
import time

from quillon.llm import personal

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    found = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 12 <= len(digits) <= 19 and personal.luhn(digits):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_fixed_patterns_match_brute_force():
    rng = random.Random(3)
    for alphabet in ("a@.b_", "1.2@-", "+1 (2)3-4.5", "a1@b.c _-4111111111111111", "0123456789 ", "12.3"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert personal.base_spans(text) == brute(text), text


def test_long_runs_take_time_in_proportion():
    n = 1_000_000
    for text in ("7" * n, "1 " * (n // 2) + "x", "a1-" * (n // 3) + "_", "a" * n + "@b", "x@" * (n // 2), "1." * (n // 2), "+" + " " * n, "1 2 3x " * (n // 7), "(" * n, "-" * n + " 123456"):
        began = time.time()
        personal.base_spans(text)
        for start, end in personal.candidates_of(text)[:50]:
            personal._context(text, start, end)
        assert time.time() - began < 10, text[:20]


def test_words_of_a_context_are_found_at_any_distance():
    long = "w" * 500
    text = f"one two {long} " + "-" * 1000 + " 123456 " + "." * 700 + f" {long} three"
    at = text.index("123456")
    left, right = personal._context(text, at, at + 6)
    assert left == [long, f"two {long}", f"one two {long}"] and right == [long, f"{long} three"]


def test_discovered_identifiers_support_patterns_of_their_own(spark):
    rows = [(i, f"number one: +1 (476) 555-5{100 + i}") for i in range(8)]
    rows += [(20 + i, f"number one: Q77{100 + i}") for i in range(5)]
    rows += [(40 + i, f"badge held Q77{100 + i}") for i in range(5)] + [(60, "badge held Z99111"), (61, "lot Z99222")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = {r.doc_id: [(m.start, m.end) for m in r.more] for r in personal.find(df).collect()}
    assert more[20] == [(12, 18)] and more[60] == [(11, 17)] and more[61] == []


def test_clashing_names_and_empty_tables(spark, docs, empty):
    names = ("more", "m_doc", "m_hash", "m_key", "key", "doc", "hash", "places")
    df = docs
    for name in names:
        df = df.withColumn(name, docs["source"])
    masked = personal.mask(df)
    assert masked.columns == df.columns and masked.count() == docs.count()
    assert personal.mask(empty).count() == 0 and personal.find(empty).count() == 0
