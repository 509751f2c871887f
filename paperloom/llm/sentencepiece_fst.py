"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file, each into flat arrays (``Machine``: one index of arcs by state and
label, and the output and weight of every state):

* the normaliser: the model's character map (longest rule first), white space and the ``▁`` before the text;
* the pieces: reading a piece writes its id, at its cost;
* the byte fallback: a character without a piece of its own reads as its UTF-8 bytes, at a cost that no piece has.

The normaliser is deterministic and runs first. The other two are composed with its output as they are walked,
a state being a position and a state of the pieces, and the shortest path in the tropical semiring (least sum
of costs) is taken.

* Unigram models: a piece costs its negative log probability.
* BPE models: a path is the model's output exactly if every two neighbouring pieces are what the merges
  make of their joint text. So pieces cost nothing, and going from one piece to the next costs nothing or
  infinity by that rule. Every prefix of a text has one such path, so a position remembers only its last piece.

Whether two pieces can be neighbours is worked out when first asked and kept. A path never crosses two
characters that stand side by side in no piece. So a text is composed part by part, and parts seen before keep
their path.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices

_SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A worker remembers between one and two times so many chunks (some 200 bytes each), and eight times so many neighbours.
CACHE_CHUNKS = 600_000
_INF = float("inf")


def default_path() -> str:
    """The 32k piece model among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, message[at : at + size]
            at += size


class Model:
    """What a model file says: pieces, scores, kinds and settings."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.character_map = bytes(normaliser.get(2, b""))
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.remove_extra_spaces = bool(normaliser.get(4, 1))
        self.space = _SPACE if normaliser.get(5, 1) else " "
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with white space before words are supported")
        if USER_DEFINED in self.kinds and self.kind == UNIGRAM:
            raise ValueError("user-defined pieces are supported in BPE models only")
        self.unknown = self.kinds.index(UNKNOWN)


def character_rules(blob: bytes) -> dict[str, str]:
    """What a model's character map replaces by what.

    The blob is the byte length of a double-array trie, its 32-bit units, and the replacements, each ended by a
    zero byte. In a unit, bits 0 to 7 and 31 are the label, bit 8 says that a value hangs below, and bits 10 to 30
    are the offset to the children, times 256 if bit 9 is set.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    rules, open_nodes = {}, [(0, b"")]
    while open_nodes:
        at, key = open_nodes.pop()
        unit = units[at]
        base = at ^ ((unit >> 10) << ((unit & 512) >> 6))
        if unit >> 8 & 1:
            start = units[base] & 0x7FFFFFFF
            rules[key.decode()] = texts[start : texts.index(b"\0", start)].decode()
        open_nodes += [(base ^ c, key + bytes([c])) for c in range(1, 256) if base ^ c < len(units) and units[base ^ c] & 0x800000FF == c]
    return rules


class Machine:
    """A transducer compiled from (text that it reads, what it writes, cost), in flat arrays.

    States are numbers from 0, the start. ``arcs`` finds the state that a state and a label lead to;
    ``writes`` and ``costs`` hold, for each state, what ends there (-1: nothing does).
    """

    LABELS = 0x110000

    def __init__(self, paths: Iterable[tuple[str, int, float]]) -> None:
        self.arcs: dict[int, int] = {}
        self.writes, self.costs = array("i", [-1]), array("d", [0.0])
        for text, out, cost in paths:
            state = 0
            for c in text:
                key = state * self.LABELS + ord(c)
                state = self.arcs.setdefault(key, len(self.writes))
                if state == len(self.writes):
                    self.writes.append(-1)
                    self.costs.append(0.0)
            self.writes[state], self.costs[state] = out, cost

    def longest(self, text: str, at: int) -> tuple[int, int]:
        """Where the longest path that reads ``text`` from ``at`` ends, and what it writes; -1 if there is none."""
        state, best = 0, (at, -1)
        for end in range(at, len(text)):
            state = self.arcs.get(state * self.LABELS + ord(text[end]))
            if state is None:
                break
            if self.writes[state] >= 0:
                best = end + 1, self.writes[state]
        return best


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.bpe = model.kind == BPE
        kinds = list(zip(range(len(model.pieces)), model.pieces, model.kinds, strict=True))
        self.id_of = {piece: i for i, piece, kind in kinds if kind == NORMAL}
        self.pieces = Machine((piece, i, 0.0 if self.bpe else -model.scores[i]) for piece, i in self.id_of.items())
        self.own_id = {piece: i for i, piece, kind in kinds if kind == USER_DEFINED}
        # Pieces of the user stand for themselves: nothing rewrites them and nothing merges with them.
        rules = character_rules(model.character_map) | {piece: piece for piece in self.own_id}
        self.written_by_rule = list(rules.values())
        self.normaliser = Machine((key, i, 0.0) for i, key in enumerate(rules)) if rules else None
        self.starts = re.compile("[" + "".join(re.escape(c) for c in sorted({key[0] for key in rules})) + "]") if rules else None
        self.own = re.compile("(" + "|".join(re.escape(p) for p in sorted(self.own_id, key=len, reverse=True)) + ")") if self.own_id else None
        self.bytes_of = {int(p[3:5], 16): i for i, p, kind in kinds if kind == BYTE}
        self.fallback_cost = 10.0 - min((model.scores[i] for i in self.id_of.values()), default=0.0)
        #: Characters that stand side by side in some piece.
        self.pairs = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.cut_at_spaces = not any(p[1] == model.space and p[0] != model.space for p in self.pairs)
        #: Whether every character that a piece has is a piece too; then no path of costs 0 needs the fallback.
        self.closed = all(c in self.id_of for p in self.id_of for c in p)
        self.written = [p.replace(model.space, " ").encode() if k in (NORMAL, USER_DEFINED) else b"" for _, p, k in kinds]
        for value, i in self.bytes_of.items():
            self.written[i] = bytes([value])
        self.written[model.unknown] = " ⁇ ".encode()
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.neighbours: dict[int, bool] = {}

    def normalise(self, text: str) -> str:
        """The text as the pieces read it."""
        if self.normaliser is not None:
            out, at = [], 0
            for m in iter(lambda: self.starts.search(text, at), None):
                out.append(text[at : m.start()])
                at, rule = self.normaliser.longest(text, m.start())
                if rule < 0:
                    out.append(m[0])
                    at = m.end()
                else:
                    out.append(self.written_by_rule[rule])
            text = "".join([*out, text[at:]])
        if self.model.remove_extra_spaces:
            text = re.sub(" {2,}", " ", text).strip(" ")
        prefix = " " if self.model.dummy_prefix and text else ""
        text = (prefix + text).replace(" ", self.model.space)
        return text.rstrip(self.model.space) if self.model.remove_extra_spaces else text

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored pair first, the leftmost of equals."""
        parts, scores = list(text), self.model.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether two pieces can be neighbours (``left`` may be -1: a fallback or the start, which no merge crosses)."""
        a, b = (self.model.pieces[i] if i >= 0 else "" for i in (left, right))
        return self._merged(a + b) == [x for x in (a, b) if x]

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes_of[b] for b in char.encode("utf-8", "surrogatepass")] if self.model.byte_fallback else [self.model.unknown]

    def _free_path(self, text: str) -> list[int]:
        """The path of cost 0, depth first with long pieces first: where arcs cost 0 or infinity, the first to reach the end is the shortest."""
        n, labels = len(text), [ord(c) for c in text]
        arcs, writes, width, known = self.pieces.arcs, self.pieces.writes, Machine.LABELS, self.neighbours
        seen, out, ways = [False] * (n + 1), [-1], []
        at = 0
        while at < n:
            if len(ways) < len(out):  # what can be read from here
                state, here = 0, []
                for end in range(at, n):
                    state = arcs.get(state * width + labels[end])
                    if state is None:
                        break
                    if writes[state] >= 0:
                        here.append((end + 1, writes[state]))
                ways.append((at, here))
            here, left = ways[-1][1], out[-1]
            while here:
                end, piece = here.pop()
                if seen[end]:
                    continue
                key = (left + 1) << 32 | piece
                fits = known.get(key)
                if fits is None:
                    fits = known[key] = self._fits(left, piece)
                if fits:
                    seen[end] = True
                    out.append(piece)
                    at = end
                    break
            else:  # a dead end: back to the state before
                ways.pop()
                out.pop()
                at = ways[-1][0]
        return out[1:]

    def shortest_path(self, text: str) -> list[int]:
        """Ids on the least-cost path through the composition of the normalised ``text`` and the pieces."""
        if self.bpe and self.closed and all(c in self.id_of for c in text):
            return self._free_path(text)
        n, labels = len(text), [ord(c) for c in text]
        arcs, writes, costs, width, known = self.pieces.arcs, self.pieces.writes, self.pieces.costs, Machine.LABELS, self.neighbours
        # By position: the least cost, and the last piece on the way there (-1: a fallback) and its start.
        best, last, start = [_INF] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            cost = best[at]
            if cost == _INF:
                continue
            state, alone, left = 0, False, last[at]
            for end in range(at, n):
                state = arcs.get(state * width + labels[end])
                if state is None:
                    break
                piece = writes[state]
                if piece >= 0:
                    alone |= end == at
                    total = cost + costs[state]
                    if total >= best[end + 1]:
                        continue
                    if self.bpe:
                        key = (left + 1) << 32 | piece
                        fits = known.get(key)
                        if fits is None:
                            fits = known[key] = self._fits(left, piece)
                        if not fits:
                            continue
                    best[end + 1], last[end + 1], start[end + 1] = total, piece, at
            if not alone and cost + self.fallback_cost < best[at + 1]:
                best[at + 1], last[at + 1], start[at + 1] = cost + self.fallback_cost, -1, at
        out, at = [], n
        while at:
            out.append([last[at]] if last[at] >= 0 else self._fallback(text[start[at]]))
            at = start[at]
        return [i for part in reversed(out) for i in part]

    def _parts(self, chunk: str) -> list[str]:
        """A chunk cut between characters that stand side by side in no piece."""
        cuts = [0, *(i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.pairs), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _path(self, chunk: str) -> bytes:
        """The path of a chunk that is not known, and so of its parts."""
        out = self.older.get(chunk)
        if out is None:
            found = []
            for part in self._parts(chunk):
                path = self.paths.get(part) or self.older.get(part)
                if path is None:
                    path = array("I", self.shortest_path(part)).tobytes()
                    if len(part) < 100:
                        self.paths[part] = path
                found.append(path)
            out = b"".join(found)
        if len(chunk) < 100:
            self.paths[chunk] = out
        return out

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut where no piece can cross."""
        return _cut(self.model.space).findall(text) if self.cut_at_spaces else [text]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return np.zeros(0, "<u4")
        if len(self.paths) > CACHE_CHUNKS:
            self.older, self.paths = self.paths, {}
        if len(self.neighbours) > 8 * CACHE_CHUNKS:
            self.neighbours = {}
        text = self.normalise(text)
        if self.own is not None:
            spans = self.own.split(text)
            found = [self._ids(x) if k % 2 == 0 else array("I", [self.own_id[x]]).tobytes() for k, x in enumerate(spans)]
        else:
            found = [self._ids(text)]
        ids = np.frombuffer(b"".join(found), "<u4")
        if not self.model.byte_fallback and len(ids):  # a run of unknown characters is one unknown piece
            again = (ids == self.model.unknown) & np.r_[False, ids[:-1] == self.model.unknown]
            ids = ids[~again]
        return ids

    def _ids(self, text: str) -> bytes:
        chunks = self.chunks(text)
        found = list(map(self.paths.get, chunks))
        if None in found:
            for k, path in enumerate(found):
                if path is None:
                    found[k] = self.paths.get(chunks[k]) or self._path(chunks[k])
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join([self.written[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@cache
def _cut(space: str) -> re.Pattern:
    return re.compile(f"{space}+[^{space}]*|[^{space}]+")


@cache
def transducer(path: str) -> Transducer:
    """One compiled model for each worker and file."""
    with open(path, "rb") as f:
        return Transducer(Model(f.read()))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for batch in slices(batches):
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(docs), 256):
            ids = [t.encode(x) for x in texts[at : at + 256]]
            flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + 256], pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array) of every row, in no order.

    Null and empty texts have no ids; repeated rows each come back; an empty table gives an empty result.
    """
    path = path or default_path()
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(lambda it: _encoded(it, path), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for batch in slices(batches):
        texts = [None if x is None else t.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text, no ids an empty one."""
    path = path or default_path()
    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lambda it: _decoded(it, path), "doc_id long, text string")


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for batch in slices(batches):
        rows: list[list] = [[], [], [], []]
        for text in batch.column(1).to_pylist():
            ids = t.encode(text)
            back = t.decode(ids)
            values = (len(ids), zlib.crc32(ids.tobytes()), len(back), back == (text or "").replace(_SPACE, " "))
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_crc32", "n_chars_decoded", "round_trip"])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), n_chars_decoded and round_trip of every row.

    Encodes and decodes each whole text in one task without keeping the ids. ``▁`` itself decodes as a
    space, as in the model's own library; everything else must come back as it was.
    """
    path = path or default_path()
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(lambda it: _digest(it, path), "doc_id long, n_tokens long, ids_crc32 long, n_chars_decoded long, round_trip boolean")
