"""Token-id files under static range asymmetric numeral systems (rANS).

File format. A shard is one binary record that can be read alone::

    magic "QRANS1\\0\\0" | n_docs u32 | n_blocks u32 | doc lengths u32[n_docs]
    then per block: n_tokens u32, n_words u32, n_checkpoints u32, crc32 of its ids u32,
                    states u64[LANES] per checkpoint, word position u32 per checkpoint,
                    words u32[n_words]

All numbers are little-endian. Blocks share one frequency table and are otherwise independent.
A block's ids go to its lanes in turn; the lanes share one stream of 32-bit words. Every
CHECKPOINT steps the states and the position in the words are kept, so a block can be decoded
from any checkpoint, and several parts at once. A block's checksum is verified on reading.
The table holds every id's count over all data, scaled to a sum of 2**SCALE, at least 1 for
each id that occurs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

MAGIC = b"QRANS1\0\0"
SCALE = 20
LANES = 512
BLOCK = 1 << 18
CHECKPOINT = 128
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


class Frequencies:
    """The shared table: scaled frequencies, their running sums, and the id of every slot."""

    def __init__(self, counts: np.ndarray):
        """``counts``: by id, over all data."""
        counts = np.asarray(counts, np.int64)
        total, goal = int(counts.sum()), 1 << SCALE
        if np.count_nonzero(counts) > goal:
            raise ValueError("more different ids than slots")
        scaled = np.where(counts > 0, np.maximum(1, counts * (goal / max(total, 1))).astype(np.int64), 0)
        excess = int(scaled.sum()) - goal if total else 0
        while excess:  # taken from or given to the most frequent ids, by id among equals
            order = np.lexsort((np.arange(len(scaled)), -scaled))[: max(1, min(abs(excess), np.count_nonzero(scaled)))]
            if excess < 0:
                scaled[order] += np.int64(1) + (-excess - len(order)) * (np.arange(len(order)) == 0)
            else:
                order = order[scaled[order] > 1]
                scaled[order] -= 1
            excess = int(scaled.sum()) - goal
        self.f = scaled.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64)
        self.ids = np.repeat(np.arange(len(scaled), dtype=np.uint32), scaled)


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    grid = np.full(steps * LANES, ids[0] if n else 0, np.int64)
    grid[:n] = ids
    if n and not table.f[ids].all():
        raise ValueError("an id without a frequency")
    f, c = table.f[grid].reshape(steps, LANES), table.c[grid].reshape(steps, LANES)
    limit = f << np.uint64(63 - SCALE)
    x = np.full(LANES, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        over = x >= limit[step]
        if over.any():
            out = x[over].astype(np.uint32)
            words.append(out)
            written += len(out)
            x[over] >>= _32
        q, r = np.divmod(x, f[step])
        x = (q << np.uint64(SCALE)) + r + c[step]
        if step % CHECKPOINT == 0:
            marks.append((written, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    marks = marks[::-1]
    positions = np.array([written - at for at, _ in marks], "<u4")
    states = np.concatenate([s for _, s in marks]) if marks else np.empty(0, np.uint64)
    head = struct.pack("<4I", n, len(stream), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + states.astype("<u8").tobytes() + positions.tobytes() + stream.astype("<u4").tobytes()


def decode_from(mark: int, n: int, states: np.ndarray, positions: np.ndarray, words: np.ndarray, table: Frequencies) -> np.ndarray:
    """The block's ids from checkpoint ``mark`` to the next one; needs no others."""
    first, last = mark * CHECKPOINT, min((mark + 1) * CHECKPOINT, -(-n // LANES))
    out = np.empty((last - first, LANES), np.uint32)
    x, at = states[mark].copy(), int(positions[mark])
    slots = np.uint64((1 << SCALE) - 1)
    for step in range(last - first):
        slot = x & slots
        ids = table.ids[slot]
        out[step] = ids
        x = table.f[ids] * (x >> np.uint64(SCALE)) + slot - table.c[ids]
        under = x < _LOW
        if k := int(np.count_nonzero(under)):
            x[under] = (x[under] << _32) | words[at : at + k]
            at += k
    final = states[mark + 1] if mark + 1 < len(states) else _LOW
    if not np.all(x == final):
        raise ValueError("a block's words don't lead to its next checkpoint")
    return out.ravel()


def read_block(shard: memoryview, at: int, table: Frequencies) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at``, and where the next one starts."""
    n, n_words, n_marks, crc = struct.unpack_from("<4I", shard, at)
    at += 16
    states = np.frombuffer(shard, "<u8", n_marks * LANES, at).reshape(n_marks, LANES)
    at += 8 * n_marks * LANES
    positions = np.frombuffer(shard, "<u4", n_marks, at)
    at += 4 * n_marks
    words = np.frombuffer(shard, "<u4", n_words, at)
    parts = [decode_from(m, n, states, positions, words.astype(np.uint64), table) for m in range(n_marks)]
    ids = np.concatenate(parts)[:n] if parts else np.empty(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum doesn't hold")
    return ids, at + 4 * n_words


def write_shard(docs: list[np.ndarray], table: Frequencies) -> bytes:
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    blocks = [encode_block(ids[at : at + BLOCK], table) for at in range(0, len(ids), BLOCK)]
    lengths = np.array([len(d) for d in docs], "<u4")
    return MAGIC + struct.pack("<2I", len(docs), len(blocks)) + lengths.tobytes() + b"".join(blocks)


def read_shard(shard: bytes, table: Frequencies) -> Iterator[np.ndarray]:
    """The ids of each document of the shard, in order."""
    if shard[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    view = memoryview(shard)
    n_docs, n_blocks = struct.unpack_from("<2I", view, 8)
    lengths = np.frombuffer(view, "<u4", n_docs, 16)
    at, held = 16 + 4 * n_docs, np.empty(0, np.uint32)
    blocks_left = n_blocks
    for length in lengths.tolist():
        parts, have = [held], len(held)
        while have < length:
            ids, at = read_block(view, at, table)
            blocks_left -= 1
            parts.append(ids)
            have += len(ids)
        whole = np.concatenate(parts) if len(parts) > 1 else held
        yield whole[:length]
        held = whole[length:]
    if blocks_left or len(held):
        raise ValueError("a shard with more ids than its documents")


def tokenise(df: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """``doc_id``, ``ids`` (an array of the type ``kind``, with the end id), null texts counting as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = common.word_cache(tokenizer, kind)
        end = np.array([end_id], kind).tobytes()
        for block in common.arrow_blocks(batches, "doc_id", "text", text="text"):
            ids = [x + end for x in cache.bare([r[1] for r in block])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return common.texts_of(df.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame, kind: str) -> np.ndarray:
    """Counts by id over all documents; what reaches the driver is bounded by the vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for (ids,) in common.arrow_rows(batches, "ids"):
            found = np.bincount(np.frombuffer(ids, kind))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_files(spark: SparkSession, df: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = 4 * BLOCK) -> np.ndarray:
    """Write the ids of ``df`` (doc_id, text) below ``path`` in ascending doc_id order; returns the counts.

    ``path/shards`` has one record per shard: part and shard numbers, which together ascend with
    doc_id, the tokens of the part before it, the documents' ids, and the payload. ``path/table`` has the counts by id.
    """
    kind = common.id_kind(tokenizer, end_id)
    tokens = common.stage(spark, tokenise(df, tokenizer, end_id, kind), "token-ids")
    counts = count_ids(tokens, kind)
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts.tolist()) if n], "id int, n long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = Frequencies(shared.value)
        part, number = TaskContext.get().partitionId(), 0
        docs: list[np.ndarray] = []
        names: list[int] = []
        size = before = 0

        def shard() -> pa.RecordBatch:
            row = [[part], [number], [names], [before], [size], [write_shard(docs, table)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "shard", "doc_ids", "before", "n_tokens", "payload"])

        for doc, ids in common.arrow_rows(batches, "doc_id", "ids"):
            docs.append(np.frombuffer(ids, kind))
            names.append(doc)
            size += len(docs[-1])
            if size >= shard_tokens:
                yield shard()
                before += size
                docs, names, size, number = [], [], 0, number + 1
        if docs:
            yield shard()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "part int, shard int, doc_ids array<long>, before long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/shards")
    return counts


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files below ``path``: doc_id, start, n_tokens, ids_crc32, ids."""
    rows = spark.read.parquet(f"{path}/table").collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    shared = spark.sparkContext.broadcast(counts)
    shards = spark.read.parquet(f"{path}/shards")
    # One sum per range partition reaches the driver, however many shards there are.
    starts, before = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        starts[r.part] = before
        before += r.n
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequencies(shared.value)
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                start = starts[row["part"]] + row["before"]
                out = common.Emitter(kinds, 1024)
                for doc, ids in zip(row["doc_ids"], read_shard(row["payload"], table), strict=True):
                    data = ids.astype("<u4").tobytes()
                    out.add(doc, start, len(ids), zlib.crc32(data), data)
                    start += len(ids)
                    if out.full():
                        yield out.take()
                yield out.take()

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
