"""Packing by minimum bin slack.

Every document (its ids and an end id) gives its full windows of ``WINDOW`` tokens, each a sequence of
its own, and a remainder of 0 to ``WINDOW - 1`` tokens. The remainders are packed by length: a bitset
subset-sum dynamic program over the multiset of remaining lengths finds the fill closest to the window,
backtracking gives the counts, and the pattern is laid as often as the counts allow. A gap that no
multiset of the lengths left can close is closed by cutting the longest piece left.

There are at most ``WINDOW - 1`` lengths, so the histogram that the program works on, the patterns and
the table that assigns ranks to places are bounded whatever the corpus holds. Everything that grows with
the corpus stays in tasks: tokens are encoded and cut where the text is read, a remainder's rank among
its length is its place in its task plus the counts of earlier tasks, and the place in a sequence follows
from the rank by a join with the bounded table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, slices
from paperloom.llm.tokens import default_path, encoder

WINDOW = 1024
END_ID = 0


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (length -> how many) whose sum is the largest that is not over ``room``.

    ``counts`` says how many of each length there are. The reachable sums are the bits of an integer;
    each length goes in as 1, 2, 4, ... copies, and the layers are kept for backtracking. Longer lengths
    go in last and are undone first, so that of equal fills one with long pieces is taken.
    """
    layers, bits, mask = [], 1, (1 << (room + 1)) - 1
    for length in sorted(x for x, n in counts.items() if n and x <= room):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            layers.append((bits, length, k))
            bits |= bits << (length * k) & mask
            left -= k
            k *= 2
    at, taken = bits.bit_length() - 1, {}
    for before, length, k in reversed(layers):
        rest = at - length * k
        if rest >= 0 and before >> rest & 1:
            taken[length] = taken.get(length, 0) + k
            at = rest
    return taken


class Stock:
    """Remainders by length; each length is a list of [source length, first rank, end rank, first token] not yet laid."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {k: n for k, n in counts.items() if n}
        self.runs = {k: [[k, 0, n, 0]] for k, n in self.counts.items()}

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of ``n`` pieces of the length, which are then gone."""
        self.counts[length] -= n
        while n:
            run = self.runs[length][0]
            source, lo, hi, first = run
            k = min(n, hi - lo)
            yield source, lo, lo + k, first
            n -= k
            run[1] += k
            if run[1] == hi:
                self.runs[length].pop(0)
        if not self.counts[length]:
            del self.counts[length], self.runs[length]

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        self.counts[length] = self.counts.get(length, 0) + run[2] - run[1]
        self.runs.setdefault(length, []).append(list(run))


def places(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, ...]], int]:
    """The plan for a histogram of remainders, and its number of sequences.

    Rows (length, first rank, end rank, first token, tokens, first sequence, copies in a sequence, number
    of earlier copies, offset): where those tokens of the remainders of that length and those ranks go.
    Each round starts from the longest length left. What the closest fill leaves free is filled with
    tokens cut off the longest pieces left, so only the last sequence can have a gap.
    """
    stock, rows, sequence = Stock(counts), [], 0

    def lay(length: int, n: int, times: int, at: int) -> None:
        done = 0
        for source, lo, hi, first in stock.take(length, n * times):
            rows.append((source, lo, hi, first, length, sequence, n, done, at))
            done += hi - lo

    while stock.counts:
        longest = max(stock.counts)
        taken = closest_fill(stock.counts | {longest: stock.counts[longest] - 1}, window - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(stock.counts[k] // n for k, n in taken.items())
        gap, at = window - sum(k * n for k, n in taken.items()), 0
        spare = stock.counts.copy()
        for k, n in taken.items():
            spare[k] -= n * (times if not gap else 1)
        spare = {k: n for k, n in spare.items() if n and k > gap}
        if gap and spare:
            times = max(1, min(times, spare[max(spare)] // (1 + taken.get(max(spare), 0))))
        for k, n in sorted(taken.items(), reverse=True):
            lay(k, n, times, at)
            at += k * n
        if gap and spare:
            done = 0
            for source, lo, hi, first in list(stock.take(max(spare), times)):
                rows.append((source, lo, hi, first, gap, sequence, 1, done, at))
                stock.put(max(spare) - gap, (source, lo, hi, first + gap))
                done += hi - lo
        sequence += times
    return rows, sequence


_PIECES = "task int, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, local long, ids binary"


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document; ``local`` counts those of the same length in this task."""
    task, seen, close = TaskContext.get().partitionId(), {}, end.to_bytes(4, "little")
    for batch in slices(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(ids), 256):
            rows: list[list] = [[], [], [], [], [], [], []]
            for doc, body in zip(ids[at : at + 256], encoder(path).encode(texts[at : at + 256]), strict=True):
                body += close
                n = len(body) // 4
                for start in range(0, n, window):
                    piece = body[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    local = seen.get(length, 0)
                    seen[length] = local + 1
                    for column, value in zip(rows, (doc, start, length, zlib.crc32(piece), n, local, piece if length < window else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array([task] * len(rows[0]), pa.int32()), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PIECES.split(", ")])


_LAID = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of the pieces that were cut from a remainder; the last columns are its ids and the first token."""
    for batch in slices(batches):
        columns = batch.columns
        cut, first, n = columns[7].to_pylist(), columns[8].to_pylist(), columns[2].to_pylist()
        crc = [c if x is None else zlib.crc32(x[4 * f : 4 * (f + k)]) for c, x, f, k in zip(columns[3].to_pylist(), cut, first, n, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns[:3], pa.array(crc, pa.int64()), *columns[4:7]], names=batch.schema.names[:7])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each token lies in exactly one piece, each piece in one sequence, and only one sequence can be short.
    Null and empty texts are the end id alone. Repeated rows are packed as often as they come, and rows
    with a null id too. An empty table gives no pieces. Sequence ids are gapless from 0: remainders
    first, then the windows that one document fills.
    """
    path = path or default_path()
    spark = docs.sparkSession
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(x.mapInArrow(lambda it: _cut(it, path, window, end), _PIECES), "pieces")
    # One row for each task and length: the rank of a task's first piece of that length.
    tasks = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = materialize(tasks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece_counts")
    # At most ``window`` rows.
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(window, 0)
    rows, sequences = places(counts, window)
    rows.append((window, 0, full, 0, window, sequences, 1, 0, 0))
    cut = sorted({r[0] for r in rows if r[4] < r[0]})
    table = spark.createDataFrame(rows, "p_length int, lo long, hi long, first int, tokens int, sequence long, copies int, done long, at int")
    held = pieces.withColumn("ids", F.when(F.col("length").isin(cut), F.col("ids")))
    held = held.join(tasks.select(F.col("task").alias("t"), F.col("length").alias("l"), "base"), (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
    held = held.withColumn("rank", F.col("base") + F.col("local"))
    # The table has a few rows for each length; its size is bounded by the window, not by the corpus.
    laid = held.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo") + F.col("done")
    laid = laid.select(
        "doc_id",
        (F.col("start") + F.col("first")).alias("start"),
        F.col("tokens").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.floor(step / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + (step % F.col("copies")) * F.col("tokens")).cast("long").alias("offset"),
        F.when(F.col("tokens") < F.col("length"), F.col("ids")).alias("ids"),
        "first",
    )
    return laid.mapInArrow(_sum_up, _LAID)
