import random
import re

import numpy as np

from paperloom.llm.components import components
from paperloom.llm.ngram_join import _parts, drop_near_copies, ngram_components
from tests.llm.helpers import crowded, docs, empty, odd


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words, percent):
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted((x for x in sets if x[0] is not None and x[1]), key=lambda x: len(x[1]))
    for j, (b, t) in enumerate(order):
        for a, s in order[:j][::-1]:
            if 100 * len(s) < percent * len(t):
                break
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i is not None, i or 0, len(s), -1 if i is None else root(i)) for i, s in sets)


def check(df, words=4, percent=85):
    want = brute([(r.doc_id, r.text) for r in df.collect()], words, percent)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_components(df, words=words, percent=percent).collect())
    assert got == want
    return want


def family(seed, n, length, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    first = [word() for _ in range(length)]
    out = [" ".join(first)]
    for _ in range(n):
        copy = (rng.choice(out)).split()
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out


def test_corpus_against_brute_force(spark, sf_dir):
    want = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sum(x[1] != x[3] for x in want) > 5


def test_families_with_chains_and_short_texts(spark):
    texts = family(1, 40, 60, 2) + family(2, 30, 200, 8) + family(3, 20, 12, 1) + family(4, 10, 3, 1) + ["a b c", "A B C", "a b", "a b c d", "a  b\nc d"]
    d = docs(spark, list(enumerate(texts)))
    want = check(d)
    assert len({x[3] for x in want}) < len(want)
    check(d, 5, 80)


def test_odd_rows(spark):
    check(odd(spark))
    assert ngram_components(crowded(odd(spark))).count() == odd(spark).count()
    assert ngram_components(empty(spark)).count() == 0
    kept = drop_near_copies(crowded(odd(spark)))
    assert kept.columns == crowded(odd(spark)).columns


def test_ids_that_come_again(spark):
    rng = random.Random(8)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(0, 240, 6):
        a = w(23)
        # 20 shingles of which 18 are found in the copy without the last two words: 90 per cent.
        rows += [(i + 1, " ".join(a)), (i + 1, " ".join(a)), (i, " ".join(a[:-2]))]
        # Two texts under one id, each a near copy of another id's; an equal text under a third; a blank one.
        b, c = w(63), w(30)
        rows += [(i + 4, " ".join(b)), (i + 4, " ".join(c)), (i + 2, " ".join(b[:-8])), (i + 3, " ".join([*c[:-1], "x"])), (i + 5, "  ".join(c)), (i + 4, " ")]
    want = check(docs(spark, rows))
    assert all(x[3] in (x[1], x[1] // 6 * 6, x[1] // 6 * 6 + 2) for x in want) and sum(x[1] != x[3] for x in want) == 280
    check(docs(spark, rows), 5, 80)


def test_linked_sets_share_a_signature():
    rng = random.Random(5)
    for _ in range(1500):
        n, percent = rng.choice([8, 13, 14, 20, 26, 30, 60, 120, 500]), rng.choice([80, 85])
        a = {rng.getrandbits(63) for _ in range(n)}
        d = rng.randint(0, max(1, n // 5))
        b = (a - set(rng.sample(sorted(a), min(d, n - 1)))) | {rng.getrandbits(63) for _ in range(rng.randint(0, d))}
        if a != b and 100 * len(a & b) >= percent * len(a | b):
            (x, need_x), (y, need_y) = (_parts(np.array(sorted(s), np.uint64), percent) for s in (a, b))
            assert len(set(x.tolist()) & set(y.tolist())) >= max(need_x, need_y)


def test_components_of_random_links(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}
