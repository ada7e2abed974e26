from types import SimpleNamespace

import corpus_pipeline
import public_tokenizers as P
import pyarrow as pa
import pyspark
import pytest

from quillon.llm import common, packing

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture
def task(monkeypatch):
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(common, "_CACHES", {})


def packer_of(stage, monkeypatch):
    """What the stage's workers run."""
    found = []
    frame = SimpleNamespace(select=lambda *_: frame, withColumn=lambda *_: frame, mapInArrow=lambda run, _: found.append(run))
    monkeypatch.setattr(common, "texts_of", lambda df: df)
    stage(frame)
    return found[0]


def batches(rows=1024):
    for at in range(0, rows, 256):
        texts = [" ".join(f"w{(at + i) * 7 + j}x{j}, don't" for j in range(40)) for i in range(256)]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(at, at + 256), pa.int64()), "text": texts})


def test_the_pipelines_packing_leaves_no_words_in_a_worker(task, monkeypatch):
    run = packer_of(lambda df: corpus_pipeline.packed(None, df, ""), monkeypatch)
    most = 0
    for _ in run(batches()):
        most = max(most, *(len(c.known) for c in common._CACHES.values()))
    (cache,) = common._CACHES.values()
    assert most and not cache.known and not cache.encode.words
    stopped = run(batches(8192))
    next(stopped)
    assert cache.known
    stopped.close()
    assert not cache.known and not cache.encode.words


def test_packing_with_few_remembered_words_gives_the_same_pieces(task):
    few, many = (packing._packer(PATH, 0, 1024, 128, 128, keep) for keep in (500, None))
    assert list(few(batches())) == list(many(batches()))


def test_a_remembered_words_limit_holds_and_ends_with_its_caller(task):
    few = common.word_cache(PATH, keep=500)
    for batch in batches():
        for block in common.arrow_blocks([batch], "text", text="text"):
            list(few.spaced([t for (t,) in block]))
            assert len(few.known) <= 500 + 256 * 81 and len(few.encode.words) <= 251
    many = common.word_cache(PATH)
    assert many is few and many.keep == common.KEEP and many.encode.keep == common.KEEP // 2
