"""What the operators of this subpackage share: table access, shared storage, word caches."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, a path in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until ``discard`` or ``clear``, since results are lazy and may still read it.
    """
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._stored_at)


def clear(spark: SparkSession) -> None:
    """Delete all stored tables: for callers whose results are written."""
    _delete(spark, f"{shared_dir(spark)}/quillon")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it from clashing with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def hot_values(left: DataFrame, key: str) -> DataFrame:
    """(key): the values with over a thousandth of the rows of ``left``, so fewer than a thousand of them."""
    least = left.count() // 1000
    return left.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > least).select(key)


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """``left`` joined with ``right``, whose values of ``key`` are unique, where some values may hold much of ``left``.

    The values ``hot`` (by default ``hot_values``, for which ``left`` should be a stored table; at
    most a thousand) are broadcast; their rows are dealt to ``salts`` parts, and the rows of
    ``right`` that they meet are copied to each part.
    """
    hot_key, salt = free_names(left.join(right.limit(0), key, "left"), "hot_key", "salt")
    hot = F.broadcast((hot_values(left, key) if hot is None else hot).select(F.col(key).alias(hot_key)))
    part = F.when(F.col(hot_key).isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    dealt = left.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(salt, part).drop(hot_key)
    parts = F.when(F.col(hot_key).isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(salt, F.explode(parts)).drop(hot_key)
    return dealt.join(copied, [key, salt], how).drop(salt)


#: Rows of a key column that are broadcast at most: some 20 MB.
BROADCAST_ROWS = 250_000


def join_sized(left: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``left`` semi-joined with the stored unique ``keys``: broadcast where their number allows it, else dealt out."""
    if keys.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(keys), key, "left_semi")
    return join_skewed(left, keys, key, "left_semi")


def texts_of(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with null texts as empty ones."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def arrow_blocks(batches: Iterable[pa.RecordBatch], *columns: str, text: str | None = None, chars: int = 2_000_000) -> Iterator[list[tuple]]:
    """Rows of the batches as lists of tuples: at most 256, and about ``chars`` of ``text``, at a time."""
    for batch in batches:
        arrays = [batch.column(c) for c in columns]
        place = columns.index(text) if text else None
        for at in range(0, batch.num_rows, 256):
            block, size = [], 0
            for row in zip(*(a.slice(at, 256).to_pylist() for a in arrays), strict=True):
                block.append(row)
                size += len(row[place] or "") if place is not None else 0
                if size >= chars:
                    yield block
                    block, size = [], 0
            if block:
                yield block


def arrow_rows(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of the batches as tuples, a bounded number of them at a time as Python objects."""
    for block in arrow_blocks(batches, *columns):
        yield from block


class Emitter:
    """Collects rows column by column and hands out record batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 8192):
        self.schema, self.rows = schema, rows
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def full(self) -> bool:
        return len(self.columns[0]) >= self.rows

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns = [[] for _ in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


#: Words that a cache remembers: a worker's memory is bounded by it.
KEEP = 1_000_000
#: Longer words are encoded each time they occur.
WORD_CHARS = 1000

#: A space inside a run of white space that isn't its last character: there no text may be cut.
_UNSAFE_CUT = re.compile(r"\s (?:\s|\Z)")


#: Marks that end a word and are a part of their own in every pattern here.
_MARKS = frozenset(".,;:!?")


class _Known(dict):
    """Encodings of words; a missing one is made on the first look-up, so each word is looked up once.

    Letters alone are one part of the pattern and go to the model at once, in lower case where no
    space leads; one mark behind them is the next part.
    """

    def __init__(self, encode: LibraryEncoder):
        self.one, self.letters, self.whole, self.lead = encode.one, encode.letters, str, ""
        self.marks = {mark: encode.one(mark) for mark in _MARKS}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and not _PLAIN.search(word):
            found = self.letters(self.lead, word if self.lead else word.lower())
        elif word[-1:] in _MARKS and word[:-1].isalpha() and not _PLAIN.search(word):
            found = self[word[:-1]] + self.marks[word[-1]]
        else:
            found = self.one(self.whole(word))
        if len(word) <= WORD_CHARS:
            self[word] = found
        return found


class WordCache:
    """Encodes texts word by word and remembers the words.

    ``encode`` maps a list of strings to a list of encodings (bytes), or has a method ``one``
    for a single string. A text is cut before
    spaces that start a new pre-token of the byte-level pattern, so the joined encodings are
    those of the whole text; where a cut isn't safe, the whole text is encoded at once. At
    most ``keep`` words are remembered, and those of the block at hand.
    """

    def __init__(self, encode, keep: int = KEEP):
        self.encode, self.keep = encode, keep
        self.one, self.special = getattr(encode, "one", None), getattr(encode, "special", None)
        self.known: dict[str, bytes] = _Known(encode) if self.one else {}

    def limit(self, keep: int) -> None:
        """Remember at most ``keep`` words from now on, and half as many parts of words."""
        self.keep = keep
        if isinstance(self.encode, LibraryEncoder):
            self.encode.keep = keep // 2

    def forget(self) -> None:
        """Forget all words: their memory goes back to the system."""
        self.known.clear()
        if isinstance(self.encode, LibraryEncoder):
            self.encode.words.clear()

    def spaced(self, texts: list[str]) -> Iterator[bytes]:
        """The encodings of a few texts where a space belongs to the word after it.

        Words are remembered without that space; a text's first word, which has none, and
        texts that can't be cut are looked up under a key that no word can have.
        """
        cut = []
        for text in texts:
            head, tail = (text, []) if _UNSAFE_CUT.search(text) or self.special and self.special.search(text) else ((parts := text.split(" "))[0], parts[1:])
            cut.append(["\0 " + head, *tail])
        return self._joined(cut, lambda w: w[2:] if w.startswith("\0 ") else " " + w, " ")

    def bare(self, texts: list[str]) -> Iterator[bytes]:
        """The encodings of a few texts where case and white space are dropped."""
        cut = []
        for text in texts:
            if self.special and self.special.search(text):
                cut.append(["\0 " + text])
            else:
                cut.append((text if _PLAIN.search(text) else text.lower()).replace("\n", " ").split(" "))
        return self._joined(cut, lambda w: w[2:] if w.startswith("\0 ") else w if _PLAIN.search(w) else w.lower(), "")

    def _joined(self, cut: list[list[str]], whole: Callable[[str], str], lead: str) -> Iterator[bytes]:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        if self.one:
            known.whole, known.lead = whole, lead
            for words in cut:
                yield b"".join(map(known.__getitem__, words))
            return
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in known]
        known.update(zip(new, self.encode([whole(w) for w in new]), strict=True))
        for words in cut:
            yield b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > WORD_CHARS:
                del known[w]


class _Shown(dict):
    """A character as byte-level vocabularies write its bytes."""

    def __init__(self, chars: dict[int, str]):
        self.chars = chars

    def __missing__(self, char: str) -> str:
        found = self[char] = "".join(self.chars[b] for b in char.encode())
        return found


def _byte_chars() -> dict[int, str]:
    """Byte to character as byte-level vocabularies write them: printable ones stay, others follow from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(moved)}


#: The byte-level pre-tokeniser's own pattern, where a tokenizer names none.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Below these the library's normaliser does no more than str.lower().
_PLAIN = re.compile("[^\0-\u012f]")


class LibraryEncoder:
    """Strings to ids (as bytes) by the tokenizers library as it is, without added special tokens.

    A text that holds one of the vocabulary's special strings goes through the whole library,
    which gives that string its own id. Plain strings are cut by the tokenizer's own pattern here, and its model takes each part;
    words are remembered. All else goes through the whole library. Strings for a lower-casing
    vocabulary come lower-cased. ``kind``: the array type of the ids.
    """

    def __init__(self, path: str, keep: int = KEEP // 2, kind: str = "I"):
        import json
        import os

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.model, self.chars, self.keep, self.kind = self.tokenizer.model, _byte_chars(), keep, kind
        self.words: dict[str, bytes] = {}
        self.shown = _Shown(self.chars)
        before = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        steps = before.get("pretokenizers", [before])
        split = next((x["pattern"]["Regex"] for x in steps if x["type"] == "Split"), BYTE_LEVEL)
        self.cut = regex.compile(split).findall

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > self.keep:
                self.words.clear()
            shown = "".join(map(self.shown.__getitem__, word))
            found = self.words[word] = array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def letters(self, lead: str, word: str) -> bytes:
        """The ids of letters below ``_PLAIN``, after a space or nothing: one part of the pattern."""
        lead = lead and self.chars[32]
        shown = lead + (word if word.isascii() else "".join(map(self.shown.__getitem__, word)))
        return array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def one(self, text: str) -> bytes:
        if (text[1:] if text[:1] == " " else text).isalpha() and not _PLAIN.search(text):
            return self._word(text)
        if not _PLAIN.search(text) and not (self.special and self.special.search(text)):
            return b"".join(map(self._word, self.cut(text)))
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_CACHES: dict[tuple[str, str], WordCache] = {}


def word_cache(path: str, kind: str = "I", keep: int = KEEP) -> WordCache:
    """The worker's cache for the tokenizer file at ``path``, of at most ``keep`` words; it outlives single tasks."""
    if (path, kind) not in _CACHES:
        _CACHES[path, kind] = WordCache(LibraryEncoder(path, kind=kind))
    _CACHES[path, kind].limit(keep)
    return _CACHES[path, kind]


def id_kind(path: str, *more: int) -> str:
    """The array type that holds all ids of the tokenizer file at ``path`` and ``more``: 16 bits if they fit."""
    from tokenizers import Tokenizer

    return "H" if max(*Tokenizer.from_file(path).get_vocab().values(), *more) < 1 << 16 else "I"
