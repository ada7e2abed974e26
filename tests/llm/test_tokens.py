import random
import zlib
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillon.llm import bpe_tables, common, packing, token_files


def reference_ids(name, texts):
    tokenizer = Tokenizer.from_file(P.path(name))
    return [array("I", e.ids).tolist() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bpe_matches_tiktoken_and_decodes(docs):
    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tables.read_ranks(path), special_tokens={})
    rows = bpe_tables.round_trip(docs, path, P.PATTERN).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in rows) == sorted((array("I", encoding.encode_ordinary(t)).tobytes(), t.encode()) for t in texts)
    assert bpe_tables.round_trip(docs.limit(0), path, P.PATTERN).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    token_files.write_files(spark, docs, str(tmp_path / "f"), P.path("word_bpe_49k.json"), 2, shard_tokens=500)
    rows = token_files.read_files(spark, str(tmp_path / "f")).collect()
    inputs = docs.collect()
    ids = reference_ids("word_bpe_49k.json", [r.text or "" for r in inputs])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows) == sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(array("I", [*i, 2]).tobytes())) for r, i in zip(inputs, ids, strict=True))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    names = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0))


def test_token_files_of_an_empty_table(spark, empty, tmp_path):
    token_files.write_files(spark, empty, str(tmp_path / "f"), P.path("word_bpe_49k.json"), 2)
    assert token_files.read_files(spark, str(tmp_path / "f")).count() == 0


def test_blocks_decode_from_any_checkpoint_and_checksums_hold():
    import numpy as np

    ids = np.array(random.Random(1).choices(range(300), [1 / (i + 1) for i in range(300)], k=200_000), np.uint32)
    table = token_files.Frequencies(np.bincount(ids))
    data = token_files.write_shard([ids[:5], ids[5:5], ids[5:]], table)
    assert [len(x) for x in token_files.read_shard(data, table)] == [5, 0, len(ids) - 5]
    assert np.array_equal(np.concatenate(list(token_files.read_shard(data, table))), ids)
    spoilt = bytearray(data)
    spoilt[-2000] ^= 1
    with pytest.raises(ValueError):
        list(token_files.read_shard(bytes(spoilt), table))


def test_differencing_is_near_equal_and_fits():
    rng = random.Random(3)
    sizes = [rng.randint(1, 128) for _ in range(900)]
    groups = packing.multiway_difference(sizes, 50)
    assert sorted(i for g in groups for i in g) == list(range(900))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 3
    assert all(sum(sizes[i] for i in g) <= 1024 for g in packing.fill(sizes, 1024))
    assert packing.fill([5], 10) == [[0]]
    assert len(packing.fill([6, 6, 6], 10)) == 3


def test_packing_holds_every_id_once(docs):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    inputs = docs.collect()
    ids = [[*x, 0] for x in reference_ids("byte_bpe_50k.json", [r.text or "" for r in inputs])]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    expected = {r.doc_id: i for r, i in zip(inputs, ids, strict=True)}
    for doc, own in by_doc.items():
        for r in own:
            assert r.doc_tokens == len(expected[doc])
            assert r.ids_crc32 == zlib.crc32(array("I", expected[doc][r.start : r.start + r.length]).tobytes())
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_shared_dir_is_read_from_the_session(spark):
    assert common.shared_dir(spark)


def test_special_strings_are_as_in_the_library():
    texts = ["a <|endoftext|> b", "x<|endoftext|>Y z", "<|startoftext|> Hello <|ENDOFTEXT|>", "<|end of text|>", "plain Words"]
    for name, way in (("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "bare")):
        cache = common.WordCache(common.LibraryEncoder(P.path(name)))
        assert [array("I", x).tolist() for x in getattr(cache, way)(texts)] == reference_ids(name, texts)
