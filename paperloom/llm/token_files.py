"""Token-ID output in patched frame-of-reference blocks.

Ids are cut into blocks of ``BLOCK`` values. A block subtracts its least value, packs the rest at the
width that a percentile of them needs, and keeps what is wider in an exception list. An index holds
where each block starts, so one block can be read alone.

Block: ``<u4 least, u1 width, u1 spare (0), u2 values, u2 exceptions``, the packed low bits of all values
(little-endian bit order), the positions of the exceptions (``u2``) and their high bits (``u4``).

A *segment* is a run of whole documents of one task: its ids, document lengths and block index. Segments
are written by Spark's own writer as rows of a table in the shared folder, so any store that Spark
reaches will do; they are in ascending order of the document id, within and across files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, slices
from paperloom.llm.tokens import default_path, encoder

END_ID = 2
BLOCK = 1024
PERCENTILE = 95
#: A segment is closed when it has this many ids; one longer document makes a segment of its own.
SEGMENT_IDS = 1 << 18

_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("spare", "u1"), ("values", "<u2"), ("exceptions", "<u2")])


@lru_cache(128)
def _lanes(width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n values of a width: the 32-bit word where each begins, its place there, and the first value of each word."""
    bit = np.arange(n, dtype=np.int64) * width
    word = bit >> 5
    return word, (bit & 31).astype(np.uint64), np.flatnonzero(np.diff(word, prepend=-1))


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one behind the other from the lowest bit up."""
    if not width:
        return b""
    _, place, firsts = _lanes(width, len(values))
    # A value begins in every word, since none is wider; what goes over a word's end belongs to the next.
    sums = np.add.reduceat((values & np.uint64((1 << width) - 1)) << place, firsts)
    words = np.zeros(len(sums) + 1, np.uint64)
    words[:-1] = sums & np.uint64(0xFFFFFFFF)
    words[1:] |= sums >> np.uint64(32)
    return words.astype("<u4").tobytes()[: (len(values) * width + 7) // 8]


def _unpack_bits(body: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    word, place, firsts = _lanes(width, n)
    words = np.frombuffer(body.ljust(4 * (len(firsts) + 1), b"\0"), "<u4").astype(np.uint64)
    pairs = words[:-1] | words[1:] << np.uint64(32)
    return (pairs[word] >> place & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of 1 to 65,535 values of 32 bits."""
    least = int(values.min())
    rest = (values - np.uint32(least)).astype(np.uint32)
    typical = int(np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))[k])
    width = typical.bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    head = np.array([(least, width, 0, len(values), len(over))], _HEAD)
    high = (rest[over] >> np.uint32(width)).astype("<u4") if width < 32 else np.zeros(0, "<u4")
    return head.tobytes() + _pack_bits(rest.astype(np.uint64), width) + over.astype("<u2").tobytes() + high.tobytes()


def unpack_block(block: bytes) -> np.ndarray:
    head = np.frombuffer(block, _HEAD, 1)[0]
    n, width, extra, at = int(head["values"]), int(head["width"]), int(head["exceptions"]), _HEAD.itemsize
    size = (n * width + 7) // 8
    rest = _unpack_bits(block[at : at + size], width, n)
    over = np.frombuffer(block, "<u2", extra, at + size)
    rest[over] |= np.frombuffer(block, "<u4", extra, at + size + 2 * extra) << np.uint32(width)
    return rest + np.uint32(head["least"])


def pack_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """The blocks of ``ids`` and where each starts."""
    blocks = [pack_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    return b"".join(blocks), [0, *np.cumsum([len(b) for b in blocks]).tolist()][:-1]


def unpack_ids(payload: bytes, starts: list[int]) -> np.ndarray:
    ends = [*starts[1:], len(payload)]
    return np.concatenate([unpack_block(payload[a:b]) for a, b in zip(starts, ends, strict=True)]) if starts else np.zeros(0, np.uint32)


_SEGMENT = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("block_starts", pa.list_(pa.int64())), ("payload", pa.binary())])
_SEGMENT_SQL = "shard int, segment int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, block_starts array<long>, payload binary"


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    shard, number, close = TaskContext.get().partitionId(), 0, end.to_bytes(4, "little")
    docs: list[int | None] = []
    bodies: list[bytes] = []
    held = 0

    def closed() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(bodies), "<u4")
        payload, starts = pack_ids(ids)
        row = {"shard": shard, "segment": number, "doc_ids": list(docs), "doc_tokens": [len(b) // 4 for b in bodies], "n_tokens": len(ids), "block_starts": starts, "payload": payload}
        return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

    for batch in slices(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(ids), 256):
            for doc, body in zip(ids[at : at + 256], encoder(path).encode(texts[at : at + 256]), strict=True):
                docs.append(doc)
                bodies.append(body + close)
                held += len(body) // 4 + 1
                if held >= SEGMENT_IDS:
                    yield closed()
                    docs, bodies, held, number = [], [], 0, number + 1
    if docs:
        yield closed()


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END_ID) -> DataFrame:
    """Write the ids of every text, each with an end id, and return the written segments.

    The documents are dealt out by ranges of their id; files follow in that order. Null texts count as
    empty (the end id alone); null ids come first; rows with the same id stand together.
    """
    path = path or default_path()
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = x.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return materialize(x.mapInArrow(lambda it: _segments(it, path, end), _SEGMENT_SQL), "tokens")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        for row in batch.to_pylist():
            body = unpack_ids(row["payload"], row["block_starts"]).astype("<u4").tobytes()
            lengths = np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths + row["base"]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files.

    Repeated ids are told apart by their order in the files; an empty table gives an empty result.
    """
    # Ids in earlier shards: one row for each shard, that is for each task that wrote.
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = totals.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    heads = segments.select("shard", "segment", "n_tokens").join(earlier, F.col("shard") == F.col("s"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col("shard").alias("h_shard"), F.col("segment").alias("h_segment"), (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("base"))
    placed = segments.join(heads, (F.col("shard") == F.col("h_shard")) & (F.col("segment") == F.col("h_segment")))
    return placed.select("doc_ids", "doc_tokens", "block_starts", "payload", "base").mapInArrow(_decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")
