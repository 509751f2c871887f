import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paperloom.llm.alignment import Aligner, align_tokens, aligned_links, components, default_piece_path
from paperloom.llm.tokens import default_path
from tests.llm.helpers import crowded, docs, empty, odd

ODD = ["", " a", "a  b", "don't it's 's x's\n'll\n b", "a \n b\nc", "x\n\ny", "é ü b c  d", "1 2 3.4 a1", "tab\tx y", "<|endoftext|> a <|endoftext|>", "a\x00b c", "日本 語 x", "a\r\nb c", "​ a b́ c", "a\x1cb \x1c c", "a  b", "\n", " ", "▁a ▁", "<s> <0x41> </s>", "２ ﬁ", "z" * 5000 + " end", "\U0001f600 \U0001f600\n\U0001f469‍\U0001f680"]


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def entry_bytes(entry):
    """Written apart from the library: the usual table of byte-level vocabularies, one byte at a time."""
    table, extra = {}, 0
    for b in range(256):
        if b < 33 or 126 < b < 161 or b == 173:
            table[chr(256 + extra)] = b
            extra += 1
        else:
            table[chr(b)] = b
    return bytes(table[c] for c in entry)


def brute(both, text):
    """Groups as lists of ids, by walking along the bytes."""
    tok, sp = both
    if not text:
        return []
    a = [(i, entry_bytes(tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    out, i, j, at_a, at_b, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a += len(a[i][1])
            ga.append(a[i][0])
            i += 1
        else:
            at_b += len(b[j][1])
            gb.append(b[j][0])
            j += 1
        if at_a == at_b and ga and gb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def expected(both, rows):
    groups = [brute(both, t) for _, t in rows]
    counts = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc, _), g in zip(rows, groups, strict=True):
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((doc is not None, doc or 0, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out)


def check(both, df, **options):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in aligned_links(df, digest=True, **options).collect())
    assert got == expected(both, rows)


def test_whole_table_against_brute_force(spark, sf_dir, both):
    check(both, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_joined_counts_are_the_same(spark, sf_dir, both):
    check(both, spark.read.parquet(f"{sf_dir}/documents.parquet").unionAll(odd(spark)), max_pairs=0)


def test_odd_rows(spark, both):
    check(both, odd(spark))
    check(both, crowded(odd(spark)))
    check(both, docs(spark, list(enumerate(ODD))))
    assert aligned_links(empty(spark)).count() == 0
    assert aligned_links(empty(spark), max_pairs=-1).count() == 0


def test_groups_as_text(spark, both):
    (row,) = align_tokens(docs(spark, [(1, "some wordings\nhere")])).collect()
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in brute(both, "some wordings\nhere"))
    assert len(row.links) == 8 * row.n_links


def test_cut_texts_equal_whole_texts(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    x = Aligner(default_path(), default_piece_path())
    assert x.cuts
    for _ in range(2):
        assert x.align(texts) == [x.whole([t])[0] if t else None for t in texts]
        x.older, x.known = x.known, {}


def test_components_of_random_cuts():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, 30)), n)) for _ in "ab")
        shared = sorted(set(a.tolist()) & set(b.tolist()))
        in_a, in_b, last = components(a, b)
        assert in_a.tolist() == [sum(s < e for s in shared) for e in a] and in_b.tolist() == [sum(s < e for s in shared) for e in b]
        assert a[last].tolist() == shared


def test_one_long_chain():
    n = 100_000
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n - 1, 2), 2 * n)
    in_a, in_b, last = components(a, b)
    assert in_a.max() == in_b.max() == 0 and last.tolist() == [len(a) - 1]
