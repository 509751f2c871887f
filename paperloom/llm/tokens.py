"""Token ids by the tokenizers library, with a cache of chunks.

A byte-level vocabulary never merges across the pieces that its pre-tokenizer cuts, and a single space
between two visible characters always begins a piece. So a text can be cut at its single spaces and line
ends, and a chunk (with its space) always gets the same ids; so do, within a chunk, its word and the
punctuation behind it. Each worker keeps the ids of the chunks it has seen lately; only new ones go to the
tokenizer. Texts with other white space beside a cut go to the tokenizer whole. The ids are the same
either way (there is a test).
"""

from __future__ import annotations

from array import array
from functools import cache

import numpy as np

#: A worker remembers between one and two times so many chunks; it bounds its memory (some 200 bytes each).
CACHE_CHUNKS = 800_000
#: Marks that end a word wherever they stand.
_MARKS = ".,#$%&*!?;:"


def default_path() -> str:
    """The 50k byte-level BPE vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str) -> "Encoder":
    """One encoder for each worker and vocabulary."""
    return Encoder(path)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """The ids of short parts without line ends: they go to the tokenizer as the lines of one text."""
        if not parts:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.line_end) if self.line_end is not None else []
        if len(ends) != len(parts) - 1:  # a vocabulary that joins line ends with what is beside them
            return self.plain(parts)
        body, stops = ids.tobytes(), (4 * ends).tolist()
        return [body[a:b] for a, b in zip([0, *(x + 4 for x in stops)], [*stops, len(body)], strict=True)]

    def _learn(self, missing: set[str]) -> None:
        """Add the ids of chunks; one that can't stand alone is left out."""
        known, older = self.known, self.older.get
        marked, parts = [], set()
        for chunk in missing:
            before = older(chunk)
            if before is not None:
                known[chunk] = before
            elif chunk == "\n":
                known[chunk] = self.plain([chunk])[0]
            elif chunk and not (chunk[1:2] if chunk[0] == " " else chunk[0]).isspace() and not chunk[-1].isspace():
                word = chunk.rstrip(_MARKS)
                if word and word[-1].isalpha() and len(word) < len(chunk):
                    marked.append((chunk, word, chunk[len(word) :]))
                    parts.update(marked[-1][1:])
                else:
                    parts.add(chunk)
        parts = [p for p in parts if p not in known]
        known.update(zip(parts, self._parts(parts), strict=True))
        known.update((chunk, known[word] + known[marks]) for chunk, word, marks in marked)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty."""
        if len(self.known) > CACHE_CHUNKS:
            self.older, self.known = self.known, {}
        cut = [t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if t and "\0" not in t else [] for t in texts]
        # Most chunks are known: each is looked up once, and only the gaps of a text are looked at again.
        get = self.known.get
        found = [list(map(get, chunks)) for chunks in cut]
        out, gaps, missing = [], {}, set()
        for i, (chunks, ids) in enumerate(zip(cut, found, strict=True)):
            try:
                out.append(b"".join(ids))
            except TypeError:  # not all of them are known
                gaps[i] = [at for at, x in enumerate(ids) if x is None]
                missing.update([chunks[at] for at in gaps[i]])
                out.append(b"")
        self._learn(missing)
        whole = [i for i, t in enumerate(texts) if t and not cut[i]]
        for i, places in gaps.items():
            chunks, ids = cut[i], found[i]
            for at in places:
                ids[at] = get(chunks[at])
            try:
                out[i] = b"".join(ids)
            except TypeError:  # a chunk without ids of its own
                whole.append(i)
        for i, ids in zip(whole, self.plain([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out
