import random
import time

import public_tokenizers
import pytest
import tiktoken

from quillon.llm import bpe_tables


@pytest.fixture(scope="module")
def codec():
    return bpe_tables.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_long_words_equal_the_library(codec, library):
    rng = random.Random(9)
    words = ["a" * n for n in (97, 160, 1000, 1001)] + ["ab" * 333, "abc" * 400, "-" * 777, "=-" * 300, "漢字" * 200, "ha" * 90 + "x" * 200]
    words += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(97, 1500))) for _ in range(15)]
    words += ["".join(rng.choice("aab") for _ in range(rng.randrange(97, 800))) for _ in range(15)]
    words += ["".join(rng.choice("日本語中文字漢") for _ in range(rng.randrange(40, 500))) for _ in range(10)]
    words += ["".join(rng.choice(["the", "ing", "tion", "un"]) for _ in range(200)) for _ in range(5)]
    for word, found in zip(words, codec.encode(words), strict=True):
        assert ids(found) == library.encode_ordinary(word), word[:30]
    # The whole contraction alone, with merges that come out of order.
    for word in words[:10] + words[15:20]:
        for part in codec.split(word):
            data = part.encode()[:600]
            assert codec.contract([data], bpe_tables.CONTRACT_WHOLE) == codec.contract([data])


def test_a_word_of_a_megabyte_is_encoded(codec, library):
    rng = random.Random(10)
    for word in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "a" * 1_000_000, "漢字仮名" * 83_333):
        began = time.time()
        (found,) = codec.encode([word])
        assert len(found) and time.time() - began < 120
        assert codec.decode([found]) == [word.encode()]
    assert ids(codec.encode(["".join(rng.choice("abcdefgh") for _ in range(20_000))])[0])
