"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers (A: byte-level BPE, B: SentencePiece) cut the same bytes. Every token points to the token of the
other side that overlaps it and reaches farthest to the right; where both end at one byte, B's token points to itself.
Following the pointers leads to the terminal token of a component, and doubling the successors
(``s = s[s]``) gets there in as many vectorised steps as the longest chain has binary digits. The terminals
label the groups, and the two tokens that end at one byte are a link.

No token of either side reaches over a single space or a line end between two visible characters (which is checked for
B's pieces), so a text is cut there, and a chunk always has the same tokens, groups and links. Workers keep those
of the chunks they have seen lately; texts with other white space beside a cut, or with very long
chunks, are aligned whole. The results are the same either way (there is a test).

Corpus-wide counts of linked id pairs are summed in the tasks first. The pairs are sent to the tasks when they are
at most ``MAX_PAIRS``, which is checked; beyond that each document's distinct pairs are joined with
them by salted keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import discard, materialize, slices
from paperloom.llm.tokens import default_path, encoder

#: A worker remembers between one and two times so many chunks, some 400 bytes each.
CACHE_CHUNKS = 250_000
#: Texts with longer chunks are aligned whole.
MAX_CHUNK = 200
#: Characters aligned whole at a time (one longer text is aligned alone).
WHOLE_CHARS = 1 << 20
#: Pairs whose counts go to every task (17 bytes each); more are joined.
MAX_PAIRS = 2_000_000
#: A task sums up so many pairs before it passes them on.
HELD_PAIRS = 1_000_000
_SALTS = 16


def default_piece_path() -> str:
    """The 32k SentencePiece model among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level(entry: str) -> bytes:
    """The bytes that an entry of a byte-level vocabulary stands for: visible Latin-1 characters are their own byte, the rest are numbered from U+0100."""
    return bytes(_bytes_of()[c] for c in entry)


@cache
def _bytes_of() -> dict[str, int]:
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of every A token and every B token, and for each group its A token that ends it, from ascending byte ends.

    The last ends are equal. A group ends where an A and a B token end together.
    """
    n = len(a_ends)
    reach_b, reach_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    terminal = a_ends[reach_a] == b_ends
    s = np.concatenate([n + reach_b, np.where(terminal, n + np.arange(len(b_ends)), reach_a)])
    while not np.array_equal(s, jumped := s[s]):
        s = jumped
    group = np.cumsum(terminal) - 1
    return group[s[:n] - n], group[s[n:] - n], reach_a[terminal]


class Aligner:
    """Groups and links of texts under two tokenizers."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        entries = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        special = {t.content for t in self.a.tokenizer.get_added_tokens_decoder().values()}
        for entry, i in entries.items():
            self.a_bytes[i] = entry.encode() if entry in special else byte_level(entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.a_signs, self.b_signs = ([[f"{i}{end}" for end in ends] for i in range(len(t))] for t, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        self.line_end = self.b.encode("\n")
        reach_over = any("\n" in p or " " in p.lstrip("▁").replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_control(i))
        self.cuts = not reach_over and b"".join(self.b_bytes[i] for i in self.line_end) == b" \n"
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _joined(self, whole: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[tuple | None]:
        """(A tokens, B tokens, groups, the groups as text with a ``;`` behind each, links as pairs of 32-bit ids) for each; None where the bytes differ."""
        get_a, get_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        fit = [bool(w) and b"".join(map(get_a, x)) == w and b"".join(map(get_b, y)) == w for w, x, y in zip(whole, a, b, strict=True)]
        a_ids, b_ids = (np.array([i for x, ok in zip(s, fit, strict=True) if ok for i in x], np.int64) for s in (a, b))
        out: list[tuple | None] = [None] * len(whole)
        if not len(a_ids):
            return out
        in_a, in_b, last_a = components(np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids]))
        groups = len(last_a)
        per_a, per_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
        last_b = np.cumsum(per_b) - 1
        # The place of each token where a group's A tokens stand before its B tokens.
        at_a = np.arange(len(a_ids)) + (np.cumsum(per_b) - per_b)[in_a]
        at_b = np.arange(len(b_ids)) + np.cumsum(per_a)[in_b]
        ends_a, ends_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        ends_a[last_a], ends_b[last_b] = 1, 1
        signs = np.empty(len(a_ids) + len(b_ids), object)
        signs[at_a] = [self.a_signs[i][e] for i, e in zip(a_ids.tolist(), ends_a.tolist(), strict=True)]
        signs[at_b] = [self.b_signs[i][e] for i, e in zip(b_ids.tolist(), ends_b.tolist(), strict=True)]
        signs = signs.tolist()
        links = np.stack([a_ids[last_a], b_ids[last_b]], 1).astype("<u4").tobytes()
        groups_before = np.concatenate([[0], np.cumsum(ends_a)]).tolist()
        i = j = 0
        for k, ok in enumerate(fit):
            if ok:
                n_a, n_b = len(a[k]), len(b[k])
                g, h = groups_before[i], groups_before[i + n_a]
                out[k] = (n_a, n_b, h - g, "".join(signs[i + j : i + j + n_a + n_b]).encode(), links[8 * g : 8 * h])
                i, j = i + n_a, j + n_b
        return out

    def whole(self, texts: list[str]) -> list[tuple | None]:
        """The texts without cutting them."""
        a = [np.frombuffer(x, np.uint32).tolist() for x in self.a.plain([" " + t for t in texts])]
        return self._joined([(" " + t).encode() for t in texts], a, self.b.encode(texts, num_threads=1))

    def _learn(self, missing: set[str]) -> None:
        new = []
        for chunk in missing:
            if chunk in self.older:
                self.known[chunk] = self.older[chunk]
            elif len(chunk) > MAX_CHUNK or not chunk or chunk != "\n" and ((chunk[1:2] if chunk[0] == " " else chunk[0]).isspace() or chunk[-1].isspace()):
                pass  # it can't stand alone
            else:
                new.append(chunk)
        lines = [c for c in new if c != "\n"]
        ids_a = dict(zip(lines, self.a._parts(lines), strict=True)) | {"\n": self.a.plain(["\n"])[0]}
        # B puts a space before what it encodes; a chunk without one goes behind a line end.
        ids_b = self.b.encode([c[1:] if c[0] == " " else "\n" + c if c != "\n" else c for c in new], num_threads=1)
        skip = len(self.line_end)
        ids_b = [x if c[0] == " " else x[skip:] if c != "\n" else x[1:] for c, x in zip(new, ids_b, strict=True)]
        found = self._joined([c.encode() for c in new], [np.frombuffer(ids_a[c], np.uint32).tolist() for c in new], ids_b)
        self.known.update((c, x) for c, x in zip(new, found, strict=True) if x is not None)

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """As ``_joined``, for whole texts; None for those without tokens."""
        if len(self.known) > CACHE_CHUNKS:
            self.older, self.known = self.known, {}
        cut = [(" " + t).replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")[1:] if t and self.cuts and "\0" not in t else [] for t in texts]
        get = self.known.get
        self._learn({c for chunks in cut for c in chunks if c not in self.known})
        out: list[tuple | None] = [None] * len(texts)
        whole, held = [], 0
        for i, (t, chunks) in enumerate(zip(texts, cut, strict=True)):
            found = [get(c) for c in chunks]
            if found and None not in found:
                n_a, n_b, groups, text, links = zip(*found, strict=True)
                out[i] = (sum(n_a), sum(n_b), sum(groups), b"".join(text), b"".join(links))
            elif t:
                whole.append(i)
                held += len(t)
                if held > WHOLE_CHARS:
                    self._whole_into(out, whole, texts)
                    whole, held = [], 0
        self._whole_into(out, whole, texts)
        return out

    def _whole_into(self, out: list, places: list[int], texts: list) -> None:
        for i, x in zip(places, self.whole([texts[i] for i in places]) if places else [], strict=True):
            out[i] = x


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each worker and pair of tokenizers."""
    return Aligner(path_a, path_b)


_COLUMNS = {"row": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "links": pa.binary()}
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"


def _align(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 100):
        rows = []
        for x in aligner(path_a, path_b).align(batch.column(2).to_pylist()):
            if x is None:
                rows.append((0, 0, 0, 0, "", b""))
            else:
                text = x[3][:-1]
                rows.append((*x[:3], len(x[4]) // 8, hashlib.sha256(text).hexdigest() if digest else text.decode(), x[4]))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), list(_COLUMNS.values())[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=list(_COLUMNS))


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """One row for each document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups, links.

    ``groups`` is the alignment as text, ``a1,a2|b1;a3|b2`` (ids of A and B, in order); with ``digest`` it is the
    lower-case hex SHA-256 of that, for tables whose groups are not to be kept. ``links`` are the
    pairs of tokens that end together, 32-bit little-endian ids of A and B in turn. Texts that are null or
    empty, or that a tokenizer doesn't give back byte for byte, have no tokens: zeros and empty columns.
    Repeated rows and rows with a null id each come back.
    """
    path_a, path_b = path_a or default_path(), path_b or default_piece_path()
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(lambda it: _align(it, path_a, path_b, digest), _ALIGNED)


def _keys(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all rows as one array of A id * 2**32 + B id, and how many each row has."""
    held = links.to_pylist()
    ids = np.frombuffer(b"".join(held), "<u4").reshape(-1, 2).astype(np.int64)
    return ids[:, 0] << 32 | ids[:, 1], np.array([len(x) // 8 for x in held], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n), summed up in the task."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    for batch in slices(batches, 500):
        new, n = np.unique(_keys(batch.column(0))[0], return_counts=True)
        keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) > HELD_PAIRS:
            yield rows()
            keys, counts = keys[:0], counts[:0]
    yield rows()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus join the ids of a pair, and whether that is the most of its B id (ties are all best)."""
    n = aligned.select("links").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))))


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _sums(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``sizes`` values."""
    total = np.concatenate([[0], np.cumsum(at)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def link_scores(aligned: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """The rows of ``align_tokens`` (a written table) with n_best and count_sum: links whose pair is the best of its B id, and the sum of all links' counts."""
    spark = aligned.sparkSession
    pairs = materialize(pair_counts(aligned), "pairs")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if pairs.count() <= max_pairs:
        t = pairs.toPandas().sort_values("pair")
        sent = spark.sparkContext.broadcast((t["pair"].to_numpy(), t["n"].to_numpy(), t["best"].to_numpy().astype(np.int64)))
        discard(pairs)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for batch in slices(batches, 500):
                keys, sizes = _keys(batch.column(6))
                at = np.searchsorted(known, keys)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(_sums(best[at], sizes)), pa.array(_sums(n[at], sizes)), batch.column(5)], names=[*kept, "n_best", "count_sum", "groups"])

        return aligned.select(*kept, "groups", "links").mapInArrow(score, _SCORED)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            for row, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, times = np.unique(_keys(pa.array([links], pa.binary()))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(keys), pa.int64()), pa.array(keys), pa.array(times)], names=["of_row", "key", "times"])

    # A frequent pair meets its count in _SALTS tasks; each row has a pair once.
    held = aligned.select("row", "links").mapInArrow(spread, "of_row long, key long, times long").withColumn("salt", F.pmod("of_row", F.lit(_SALTS)).cast("int"))
    salted = pairs.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = held.join(salted, (F.col("key") == F.col("pair")) & (F.col("salt") == F.col("p_salt")))
    sums = met.groupBy("of_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = aligned.join(sums, F.col("row") == F.col("of_row"), "left")
    return out.select(*kept, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups")


def aligned_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``align_tokens`` with the corpus-wide scores of its links. An empty table gives no rows."""
    return link_scores(materialize(align_tokens(docs, id_col, text_col, path_a, path_b, digest), "aligned"), max_pairs)
