"""Byte-level BPE as relational queries: DuckDB inside each partition encodes and decodes.

Encoding. A word's tokens are rows (word, position, id), at first one per byte. Each round of a
recursive query joins every row and its right neighbour with the merge table, takes each
word's pair of least rank, the leftmost among equals, and contracts it: the left row gets the
merged id, the right one goes. Words without a mergeable pair leave the recursion; a word's
last round is its encoding. Only words that the worker hasn't met lately are encoded.

Decoding joins token rows with the vocabulary and concatenates each document's byte strings in
order of position. Bytes travel as the characters of the same numbers, so any token is valid.

A word of n bytes takes up to n rounds, so a long one is encoded in overlapping pieces. Two
encodings of neighbouring pieces are joined at a token that both have at the same place. Any two
neighbours of the joined tokens are then neighbours in one piece's encoding; a merge across them
would have happened there too, so the joined tokens are the word's own encoding. Where pieces have
no such token (repeated characters, out of step), the word is contracted whole, in each round at
all places of its least pair at once: they come next one by one anyway, unless the merged token
could take part in a merge of lower rank, in which case only the leftmost place is contracted.

A pair's rank is that of its concatenation, as in rank files. Null texts count as empty;
repeated rows give repeated results; a null doc_id is kept; further columns are ignored; an empty
table gives no rows. The database works in memory and writes no files.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import common

#: Squared bytes of new words (their rows over all rounds), and tokens to decode, that one query takes.
ENCODE_ROWS = 4_000_000
DECODE_TOKENS = 400_000
#: Words of more bytes are encoded in pieces of PIECE bytes, each of which repeats the last OVERLAP bytes of the one before.
LONG, PIECE, OVERLAP = 96, 48, 16

# One sort of all rows by one number is much cheaper than a window partition for each word.
CONTRACT = """
WITH RECURSIVE state(round, word, place, id) AS (
    SELECT 0, word, place, id FROM parts
  UNION ALL
    (WITH pairs AS (
        SELECT round, word, place, id,
               CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS after,
               CASE WHEN lag(word) OVER w = word THEN lag(place) OVER w END AS before_place
        FROM state WINDOW w AS (ORDER BY word::BIGINT << 32 | place)),
     best AS (
        SELECT word, min(merged::BIGINT << 32 | place) AS pick
        FROM pairs JOIN merges ON pairs.id = merges.first AND pairs.after = merges.second
        GROUP BY word)
     SELECT round + 1, pairs.word, place,
            CASE WHEN place = pick & 4294967295 THEN (pick >> 32)::INTEGER ELSE id END
     FROM pairs JOIN best ON pairs.word = best.word
     WHERE before_place IS DISTINCT FROM pick & 4294967295)
)
SELECT word, id FROM state JOIN (SELECT word, max(round) AS round FROM state GROUP BY word) USING (word, round)
ORDER BY word, place
"""

CONTRACT_WHOLE = """
WITH RECURSIVE state(round, word, place, id) AS (
    SELECT 0, word, place, id FROM parts
  UNION ALL
    (WITH pairs AS (
        SELECT round, word, place, id, lead(id) OVER w AS after, row_number() OVER w AS seq
        FROM state WINDOW w AS (PARTITION BY word ORDER BY place)),
     hits AS (
        SELECT word, seq, merged, safe, min(merged) OVER (PARTITION BY word) AS least
        FROM pairs JOIN merges ON pairs.id = merges.first AND pairs.after = merges.second),
     runs AS (
        SELECT word, seq, merged, safe, row_number() OVER (PARTITION BY word ORDER BY seq) AS nth,
               seq - row_number() OVER (PARTITION BY word ORDER BY seq) AS run
        FROM hits WHERE merged = least),
     picked AS (
        SELECT word, seq, merged FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY seq) AS step FROM runs)
        WHERE step % 2 = 1 AND (safe OR nth = 1))
     SELECT round + 1, pairs.word, place, coalesce(picked.merged, id)
     FROM pairs LEFT JOIN picked ON pairs.word = picked.word AND pairs.seq = picked.seq
     LEFT JOIN picked AS gone ON pairs.word = gone.word AND pairs.seq = gone.seq + 1
     WHERE gone.word IS NULL AND pairs.word IN (SELECT word FROM picked))
)
SELECT word, id FROM (SELECT *, max(round) OVER (PARTITION BY word) AS final FROM state)
WHERE round = final ORDER BY word, place
"""

DECODE = """
SELECT doc, string_agg(chars, '' ORDER BY place) AS text
FROM tokens JOIN vocabulary USING (id) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file at ``path``: base64 of the token, a space, its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, file.read().splitlines()))}


class Codec:
    """An in-memory database with the vocabulary and merge tables of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        # Whether the pattern takes plain letters with the space before them as one match, and a mark behind them as the next.
        self.plain = all(self.split(w) == [w] and self.split(f"{w}{m}") == [w, m] for w in ("word", " Word") for m in common._MARKS)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        first, second, merged = (np.array(c, np.int32) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int32),) * 3
        # Tokens that can take part in a merge of lower rank than their own.
        early = np.unique(np.concatenate([first[first > merged], second[second > merged]]))
        self._load("merges", {"first": pa.array(first), "second": pa.array(second), "merged": pa.array(merged), "safe": pa.array(~np.isin(merged, early))})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self._load("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        self.words: dict[str, bytes] = {}
        self.cache = common.WordCache(self.encode_pieces)

    def _load(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def contract(self, words: list[bytes], query: str = CONTRACT) -> list[bytes]:
        """The ids (little-endian 32-bit) of each of some non-empty words, by one recursive query."""
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self._load("parts", {"word": pa.array(word), "place": pa.array(place.astype(np.int64)), "id": pa.array(self.byte_ids[data])})
        found = self.db.execute(query).fetchnumpy()
        ids, counts = np.asarray(found["id"]).astype("<u4"), np.bincount(np.asarray(found["word"]), minlength=len(words))
        ends = np.cumsum(counts)
        return [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def contract_all(self, words: list[bytes]) -> list[bytes]:
        """``contract`` of any number of words, in queries of bounded size."""
        out, group, rows = [], [], 0
        for i, w in enumerate(words):
            group.append(w)
            rows += len(w) ** 2
            if rows >= ENCODE_ROWS or i == len(words) - 1:
                out += self.contract(group)
                group, rows = [], 0
        return out

    def contract_long(self, word: bytes) -> bytes:
        """The ids of a long word: pieces, joined where neighbours agree."""
        for scale in (1, 4):
            size, step = PIECE * scale, (PIECE - OVERLAP) * scale
            starts = range(0, max(1, len(word) - OVERLAP * scale), step)
            pieces = [word[at : at + size] for at in starts]
            known = dict.fromkeys(pieces)
            known.update(zip(known, self.contract_all(list(known)), strict=True))
            if (found := self._joined(list(starts), [known[p] for p in pieces])) is not None:
                return found
        return self.contract([word], CONTRACT_WHOLE)[0]

    def _joined(self, starts: list[int], encoded: list[bytes]) -> bytes | None:
        """The encodings of overlapping pieces as one; None if two neighbours share no token."""
        out: list[np.ndarray] = []
        ids = np.frombuffer(encoded[0], "<u4")
        ends = np.cumsum(self.sizes[ids])
        for start, data in zip(starts[1:], encoded[1:], strict=True):
            more = np.frombuffer(data, "<u4")
            more_ends = start + np.cumsum(self.sizes[more])
            # A token is told by its place and size; the same bytes have the same id.
            most = int(self.sizes.max()) + 1
            here, there = ends * most + self.sizes[ids], more_ends * most + self.sizes[more]
            _, left, right = np.intersect1d(here, there, assume_unique=True, return_indices=True)
            if not len(left):
                return None
            out.append(ids[: left[0]])
            ids, ends = more[right[0] :], more_ends[right[0] :]
        return np.concatenate([*out, ids]).astype("<u4").tobytes()

    def _cut(self, piece: str) -> list[str]:
        """The matches of the pattern in a piece."""
        if self.plain and piece.isascii():
            body = piece[1:] if piece[:1] == " " else piece
            if body.isalpha():
                return [piece]
            if body[-1:] in common._MARKS and body[:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self.split(piece)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece: each match of the pattern is encoded separately."""
        cut = list(map(self._cut, pieces))
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self.words]
        coded = [w.encode() for w in new]
        short = [i for i, w in enumerate(coded) if len(w) <= LONG]
        self.words.update(zip((new[i] for i in short), self.contract_all([coded[i] for i in short]), strict=True))
        long = {w: self.contract_long(x) for w, x in zip(new, coded, strict=True) if len(x) > LONG}
        look = (lambda w: long[w] if w in long else self.words[w]) if long else self.words.__getitem__
        out = [look(words[0]) if len(words) == 1 else b"".join(map(look, words)) for words in cut]
        if len(self.words) > self.cache.keep:
            self.words.clear()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.cache.spaced(texts))

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each document's ids; long documents go through several queries."""
        out = [b""] * len(encoded)
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(encoded), dtype=np.int32), [len(e) // 4 for e in encoded])
        for at in range(0, len(ids), DECODE_TOKENS):
            part = slice(at, at + DECODE_TOKENS)
            self._load("tokens", {"doc": pa.array(doc[part]), "place": pa.array(np.arange(len(ids[part]), dtype=np.int32)), "id": pa.array(ids[part])})
            for d, text in self.db.execute(DECODE).fetchall():
                out[d] += text.encode("latin-1")
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; it outlives single tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``df`` (doc_id, text): ``ids`` (little-endian 32-bit), ``decoded`` (their bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for block in common.arrow_blocks(batches, "doc_id", "text", text="text"):
            ids = own.encode([r[1] for r in block])
            columns = [pa.array([r[0] for r in block], pa.int64()), pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return common.texts_of(df.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
