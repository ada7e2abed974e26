from quillon.llm import secrets


def test_secrets_inside_longer_runs_are_found(spark):
    key = "kq3J8sZpW0xTq9RmVb4LcYd2"
    texts = [key, f"com/download/resource/item/{key}", f"com/services/hooks/incoming/{key}/view", f"0123456789abcdef0-{key}", "load_user_index_table/process_request_header_value", "com/download/resource/item/configurationmanagerservice"]
    model = secrets.train(secrets.labelled_samples(spark, 1200))
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    found = {r.doc_id: [r.text[s.start : s.end] for s in r.random] for r in rows}
    assert all(any(key in x for x in found[i]) for i in range(4))
    assert found[4] == found[5] == []
