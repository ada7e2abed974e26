from quillon.llm import personal


def test_candidates_in_prose_are_whole():
    for text, found in (
        ("hotline: 476-555-9123.", "476-555-9123"),
        ("hotline 476-555-9123, or", "476-555-9123"),
        ("us (476-555-9123) now", "476-555-9123"),
        ("us (476) 555-9123 now", "(476) 555-9123"),
        ("hotline: 476 555 9123.", "476 555 9123"),
        ("ID A1234567", "A1234567"),
        ("account GB29NWBK60161331926819.", "GB29NWBK60161331926819"),
        ("account GB29 NWBK 6016 1331 9268 19.", "GB29 NWBK 6016 1331 9268 19"),
        ("mail me@localhost, please", "me@localhost"),
    ):
        assert [text[s:e] for s, e in personal.candidates_of(text)] == [found]
    assert personal.candidates_of("word2vec and 3 of 1200, " + "-" * 100_000) == []


def test_patterns_of_several_words_find_identifiers(spark):
    rows = [(i, f"and my number is +1 (476) 555-5{100 + i}, so there") for i in range(12)]
    rows += [(20 + i, f"this is what it is {100000 + i} and is that all") for i in range(40)]
    rows += [(90, "Well, my number is 476 555 9123."), (91, "my number is A1234567"), (92, "that is 4765559124")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = {r.doc_id: [(m.start, m.end) for m in r.more] for r in personal.find(df).collect()}
    assert more[90] == [(19, 31)] and more[91] == [(13, 21)]
    assert not any(more[d] for d in more if d not in (90, 91))
    assert personal.mask(df.where("doc_id = 90 OR doc_id < 20")).where("doc_id = 90").first().text == "Well, my number is <CONTEXT>."
