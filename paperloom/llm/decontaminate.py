"""Benchmark decontamination by one Aho-Corasick automaton over words.

Texts and items are normalised alike (A-Z lower-cased, words are runs of digits, letters and characters
above U+007F). The windows of all items go into one automaton whose alphabet is the items' own words, so a
text is scanned once, word by word, and every window that ends at a word is found there; a word that no item
has leads back to the root. Hits are places in the sequence of words and are mapped back to code points of the original text.

The automaton is the stated query set, the benchmark; its size is checked before it is sent: windows are counted,
and beyond ``MAX_WINDOWS`` they are dealt by their hash into several automata of that size. A task then
reads its texts once and passes each batch through one automaton after the other, so neither the driver
nor a worker ever holds more than ``HELD`` of them, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, materialize, slices

#: Consecutive words of an item in a window; an item of fewer is one window.
WINDOW = 10
#: Windows to an automaton: some 100 MB in a worker.
MAX_WINDOWS = 250_000
#: Automata that a worker keeps built.
HELD = 2

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: Byte for byte: A-Z to a-z, what is no part of a word to a space. Bytes over 0x7F are parts of characters over U+007F.
_NORMAL = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_NORMAL).split()


def windows_of(text: bytes, window: int = WINDOW) -> set[bytes]:
    """The windows of an item, each as its words with spaces between."""
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


class Windows:
    """An automaton over windows; each leads to the number of its words and the places of its items."""

    def __init__(self, windows: list[bytes], items: list[list[str]]) -> None:
        self.place: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, of in zip(windows, items, strict=True):
            key = tuple(self.place.setdefault(w, len(self.place) + 1) for w in window.split(b" "))
            self.automaton.add_word(key, (len(key), of))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes], hit: bytearray, items: set[str]) -> None:
        """Mark the words inside any occurrence of a window and add the items of what occurs."""
        get = self.place.get
        ones, seen = b"\1" * 64, set()
        for end, value in self.automaton.iter(tuple([get(w, 0) for w in words])):
            n = value[0]
            hit[end + 1 - n : end + 1] = ones[:n] if n <= 64 else b"\1" * n
            if id(value) not in seen:
                seen.add(id(value))
                items.update(value[1])


@lru_cache(HELD)
def _built(at: int, held: Broadcast) -> Windows | None:
    windows, items = held.value
    del held._value  # it would stay as long as the worker does
    return Windows(windows, items) if windows else None


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in the original text, in code points, end exclusive."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[edge[::2]], points[edge[1::2]]


def spans_of(text: bytes, hit: bytearray) -> list[dict[str, int]]:
    """The runs of hit words as spans of the original text."""
    starts, ends = word_bounds(text)
    edge = np.flatnonzero(np.diff(np.frombuffer(hit, np.int8), prepend=0, append=0))
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def _scan(batches: Iterator[pa.RecordBatch], automata: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small = list(slices([batch]))
        hits: list[bytearray | None] = [None] * batch.num_rows
        items: list[set[str]] = [set() for _ in hits]
        counts = [0] * batch.num_rows
        for at, held in enumerate(automata):
            windows, row = _built(at, held), -1
            for part in small:
                for text in part.column(1).cast(pa.binary()):
                    row += 1
                    words = words_of(text.as_py() or b"")
                    counts[row] = len(words)
                    if not words or windows is None:
                        continue
                    hit = hits[row] or bytearray(len(words))
                    windows.scan(words, hit, items[row])
                    if items[row] or hits[row] or any(hit):
                        hits[row] = hit
        spans = [spans_of(batch.column(1)[i].as_py().encode(), hit) if hit else [] for i, hit in enumerate(hits)]
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array([sum(h) if h else 0 for h in hits], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, _SPANS)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ("doc_id", "n_words", "n_hit", "items", "spans")])


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, items): every distinct window of the benchmark and the ids, as strings, of the items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = sorted(windows_of((batch.column(1)[i].as_py() or "").encode(), window))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([batch.column(0)[i].as_py()] * len(found), pa.string())], names=["win", "item"])

    x = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(cut, "win binary, item string").groupBy("win").agg(F.collect_set("item").alias("items"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (sorted as strings), spans (start, end in code points).

    ``n_hit`` counts the words inside any occurrence of a window, a span is a run of such words in the
    original text. Null and empty texts have no words; items without words have no window. Repeated rows
    and rows with a null id each come back; rows of one item id are one item; the windows of an item
    without an id are found, but it is not listed. An empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    windows = materialize(item_windows(benchmark, item_col, item_text_col, window), "windows")
    # An item listed under a window counts like a window of its own.
    size = windows.agg(F.coalesce(F.sum(F.size("items") + 1), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // (2 * max_windows)))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("win"), F.lit(blocks)))
    automata = []
    for block in range(blocks):  # each is bounded by max_windows, however many there are
        rows = dealt.where(F.col("block") == block).select("win", "items").collect()
        automata.append(spark.sparkContext.broadcast(([bytes(r.win) for r in rows], [r["items"] for r in rows])))
    discard(windows)
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(lambda it: _scan(it, automata), _FOUND)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``decontaminate``'s rows: n_items, items_sha256, contaminated."""
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
#: The same by joins on the text of every run of as many words as some window has.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
p AS (SELECT item_id, ws, least(len(ws), {WINDOW}) AS n, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM p),
g AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n),
h AS (SELECT g.r, g.n, g.i, w.item_id FROM g JOIN w ON g.n = w.n AND array_to_string(g.ws[g.i:g.i + g.n - 1], ' ') = w.win),
k AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN t ON d.r = t.r
"""
