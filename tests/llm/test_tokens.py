import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm.packing import WINDOW, closest_fill, pack, places
from paperloom.llm.token_files import pack_ids, read_tokens, unpack_block, unpack_ids, write_tokens
from paperloom.llm.tokens import Encoder, default_path
from tests.llm.helpers import crowded, docs, empty, odd

ODD = ["", " a", "a  b", "don't it's 's x's\n'll\n b", "a \n b\nc", "x\n\ny", "é ü b c  d", "1 2 3.4 a1", "tab\tx y", "<|endoftext|> a <|endoftext|>", "a\x00b c", "日本 語 x", "a\r\nb c", "​ a b́ c", "a\x1cb \x1c c", "a  b"]


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(tok, text, end):
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_ids_equal_plain_ids(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    e = Encoder(default_path())
    assert e.encode(texts) == e.plain(texts)
    for known in (dict.fromkeys(range(1_000_000)), e.known):
        e.known, e.older = known, {}
        assert e.encode(ODD) == e.plain(ODD)
        assert e.encode(texts) == e.plain(texts)
    e.known, e.older = {}, e.known
    assert e.encode(texts) == e.plain(texts)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    cases = [np.zeros(1, np.uint32), np.full(1000, 7, np.uint32), np.array([0, 2**32 - 1], np.uint32), rng.integers(0, 50257, 5000, dtype=np.uint32), np.where(rng.random(3000) < 0.02, 2**31, rng.integers(0, 9, 3000)).astype(np.uint32), rng.integers(0, 2**32, 2049, dtype=np.uint32)]
    for x in cases:
        payload, starts = pack_ids(x)
        assert (unpack_ids(payload, starts) == x).all()
        assert (unpack_block(payload[starts[-1] :]) == x[len(x) - len(x) % 1024 if len(x) % 1024 else -1024 :]).all()
    small, _ = pack_ids(cases[4])
    assert len(small) < 3000  # outliers do not widen the rest
    assert unpack_ids(*pack_ids(np.zeros(0, np.uint32))).size == 0


def check_files(spark, tok, df):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, tuple(ids_of(tok, r.text, 2))) for r in df.collect()), key=lambda x: x[:2])
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(write_tokens(df)).collect()), key=lambda x: x[2])
    assert [x[:2] for x in got] == [x[:2] for x in rows]
    assert sorted((*x[:2], x[3], x[4]) for x in got) == sorted((*x[:2], len(x[2]), crc(x[2])) for x in rows)
    at = 0
    for x in got:
        assert x[2] == at
        at += x[3]


def test_token_files(spark, sf_dir, tok):
    check_files(spark, tok, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check_files(spark, tok, odd(spark))
    check_files(spark, tok, crowded(odd(spark)))
    assert read_tokens(write_tokens(empty(spark))).count() == 0


def test_closest_fill_against_all_sums():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(1, 60))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        taken = closest_fill(counts, room)
        assert all(n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)


def test_places_hold_every_token_once():
    rng = np.random.default_rng(3)
    cases = [({}, 10), ({3: 7}, 10), ({7: 5, 9: 3}, 10), ({1023: 300}, 1024)]
    cases += [(dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 64, n), return_counts=True)))), 64) for n in (1, 5, 300)]
    for counts, window in cases:
        rows, sequences = places(counts, window)
        fill, cover = {}, {}
        for length, lo, hi, first, tokens, sequence, copies, done, at in rows:
            for rank in range(lo, hi):
                step = rank - lo + done
                fill.setdefault(sequence + step // copies, []).append((at + step % copies * tokens, tokens))
                cover.setdefault((length, rank), []).append((first, tokens))
        assert len(cover) == sum(counts.values()) and sorted(fill) == list(range(sequences))
        ends = []
        for parts, whole in [*((x, None) for x in fill.values()), *((x, k[0]) for k, x in cover.items())]:
            at = 0
            for first, n in sorted(parts):
                assert first == at
                at += n
            assert at == whole if whole else at <= window
            if not whole:
                ends.append(at)
        assert sum(e < window for e in ends) <= 1


def check_pack(tok, df):
    want = sorted(tuple(ids_of(tok, r.text, 0)) for r in df.collect())
    rows = pack(df).collect()
    by_seq, total = {}, 0
    known = {}
    for r in df.collect():
        known.setdefault(r.doc_id, []).append(ids_of(tok, r.text, 0))
    for r in rows:
        assert any(len(x) == r.doc_tokens and crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in known[r.doc_id])
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(map(len, want))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= WINDOW
    assert len(by_seq) == -(-total // WINDOW)


def test_packing(spark, sf_dir, tok):
    check_pack(tok, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check_pack(tok, odd(spark))
    check_pack(tok, crowded(docs(spark, [(1, "a b c"), (2, None)])))
    assert pack(empty(spark)).count() == 0
