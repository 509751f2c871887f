import random

import numpy as np
import pytest
import sentencepiece

from paperloom.llm.sentencepiece_fst import Model, Transducer, _fields, decode, default_path, encode, round_trip, transducer
from tests.llm.helpers import crowded, empty, odd

ODD = ["", " ", "   ", " " * 7 + "a", "a" + " " * 40, "\t x", "a\x00b", "<s> a</s>", "<0x41>", "▁ ▁a", "ﬁ▁", "日本語　テスト", "\U0001f600 é ñ\r\n\n x", "don't", "aaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 3.14159", "́a", "x" * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_path())


def unigram(raw):
    """The same pieces as a unigram model (scores scaled so that sums are comparable)."""
    import struct

    out, at = b"", 0
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")
    out = raw[:at] + b"\x18\x01 \x80\xfa\x01" + raw[at + 6 :]
    return out


def test_corpus_equals_the_library(spark, sf_dir, library):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    t = transducer(default_path())
    for text in texts:
        ids = t.encode(text).tolist()
        assert ids == library.encode(text)
        assert t.decode(np.array(ids)) == text


def test_odd_and_random_texts_equal_the_library(library):
    rng = random.Random(8)
    chars = "aeinrst  .,'\n\tABé漢▁\U0001f600-0<>"
    t = transducer(default_path())
    for text in ODD + ["".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(1500)]:
        assert t.encode(text).tolist() == library.encode(text), text
        assert t.decode(t.encode(text)) == library.decode(library.encode(text)) == text.replace("▁", " ")


def field(number, body):
    size, out = len(body), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + out + bytes([size]) + body


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("extra_spaces", [False, True])
def test_models_with_a_character_map_and_pieces_of_the_user(rule, extra_spaces):
    raw = open(default_path(), "rb").read()
    maps = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=extra_spaces, escape_whitespaces=True).serialized_model_proto()
    spec = dict(_fields(maps))[3]
    # Of repeated fields the last one holds.
    made = raw + field(1, field(1, b"<mark>") + b"\x15\0\0\0\0\x18\x04") + field(1, field(1, b"zqz") + b"\x15\0\0\0\0\x18\x04") + field(3, spec)
    library, t = sentencepiece.SentencePieceProcessor(model_proto=made), Transducer(Model(made))
    assert t.normaliser is not None
    rng = random.Random(4)
    chars = "aeinqzrst  .,'\n\tABé漢▁\U0001f600-0<>ﬁ①Ａ　ｶﾞ가각ǅ\u0301\u200b"
    for text in [x for x in ODD if "\0" not in x] + ["a <mark>b zqzqzzqz<mark", "ＡＢＣ ﬁne ①②"] + ["".join(rng.choices(chars, k=rng.randint(1, 40))) for _ in range(300)]:
        assert t.encode(text).tolist() == library.encode(text), text


def test_both_searches_find_the_same_path():
    t, rng = transducer(default_path()), random.Random(2)
    for _ in range(300):
        text = "▁" + "".join(rng.choices("theringaoslpqu", k=rng.randint(1, 14)))
        free = t.shortest_path(text)
        t.closed = False
        try:
            assert t.shortest_path(text) == free
        finally:
            t.closed = True


def test_unigram_path_is_the_least_cost_of_all_paths():
    t = Transducer(Model(unigram(open(default_path(), "rb").read())))
    assert not t.bpe
    cost = lambda i: -t.model.scores[i]

    def least(text):
        if not text:
            return 0.0
        ways = [cost(t.id_of[text[:k]]) + least(text[k:]) for k in range(1, len(text) + 1) if text[:k] in t.id_of]
        return min(ways, default=float("inf")) if text[0] in t.id_of else min([*ways, t.fallback_cost + least(text[1:])])

    rng = random.Random(9)
    for text in ["the", "thinking", "\U0001f600a"] + ["".join(rng.choices("theringaos", k=9)) for _ in range(60)]:
        chunk = "▁" + text
        ids = t.shortest_path(chunk)
        assert t.decode(np.array(ids)) == text
        got = sum(cost(i) for i in ids if t.model.kinds[i] == 1) + t.fallback_cost * sum(c not in t.id_of for c in chunk)
        assert abs(got - least(chunk)) < 1e-6


def test_tables(spark, library):
    for df in (odd(spark), crowded(odd(spark))):
        want = sorted((r.doc_id is not None, r.doc_id or 0, library.encode(r.text or "")) for r in df.collect())
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in encode(df).collect()) == want
        assert sorted((r.doc_id or 0, r.text) for r in decode(encode(df)).collect()) == sorted((r.doc_id or 0, r.text or "") for r in df.collect())
        assert all(r.round_trip for r in round_trip(df).collect())
    assert round_trip(empty(spark)).count() == 0
    assert decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, None), (2, "")]
