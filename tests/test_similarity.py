"""The similarity join against brute force: recall at two sizes, exact mode, repeated vectors, late arrivals."""

import numpy as np
import pytest

from paperloom.operators import similarity as S

COLUMNS = "id long, vec array<double>, doc long, confidence double"


def made(n, seed=3, dim=32):
    """Unit vectors: loose clusters, near copies at 0.86 and more, and one vector that a tenth of all rows have."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    near = rng.permutation(n)[: n // 2].reshape(-1, 2)
    v[near[:, 1]] = v[near[:, 0]] + rng.normal(size=(len(near), dim)) * rng.uniform(0.05, 0.55, (len(near), 1))
    v[rng.permutation(n)[: n // 10]] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, rng.integers(0, max(2, n // 20), n)


def frame(spark, v, doc):
    return spark.createDataFrame([(i, x.tolist(), int(d), 0.9) for i, (x, d) in enumerate(zip(v, doc, strict=True))], COLUMNS)


def links_of(v, threshold):
    """All pairs between the first rows of equal vectors."""
    _, first = np.unique(v, axis=0, return_index=True)
    first = np.sort(first)
    s = np.round(v[first] @ v[first].T, 6)
    p, q = np.nonzero(np.triu(s >= threshold, 1))
    return {(int(first[a]), int(first[b])) for a, b in zip(p, q, strict=True)}


def parents_of(v, doc, threshold):
    s = np.round(v @ v.T, 6)
    out = {}
    for i in range(len(v)):
        near = [j for j in range(i) if s[i, j] >= threshold]
        same = [j for j in near if doc[j] == doc[i]]
        out[i] = same[0] if same else min(near, key=lambda j: (-s[i, j], j), default=None)
    return out


@pytest.mark.parametrize("n", [3000, 9000])
@pytest.mark.parametrize("threshold", [0.86, 0.7])
def test_recall_at_two_sizes(spark, n, threshold):
    v, doc = made(n)
    want = links_of(v, threshold)
    got = {(r.a, r.b) for r in S.similar_pairs(frame(spark, v, doc), threshold, bucket=200).collect()}
    planes, tables = S.hash_plan(n, threshold, bucket=200)
    assert planes >= 4 and tables > 1 and len(want) > 400
    assert got <= want and len(got & want) >= 0.9 * len(want)


def test_plan_grows_slowly():
    (_, t1), (_, t2) = S.hash_plan(10**6, 0.9), S.hash_plan(10**9, 0.9)
    assert 1 < t1 < t2 < 12 * t1 < 1000  # rows shuffled: vectors x tables, where all pairs would be 1,000 times more
    assert S.hash_plan(500, 0.3) == S.hash_plan(50_000, 0.3) == (0, 1)
    assert S.hash_plan(10**7, 0.3)[0] > 4


def test_parents_with_repeats(spark):
    v, doc = made(1200)
    x = frame(spark, v, doc)
    want = parents_of(v, doc, 0.6)
    assert {r.id: r.parent for r in S.duplicate_parents(x, 0.6, exact=True).collect()} == want
    got = {r.id: r.parent for r in S.duplicate_parents(x, 0.6, bucket=100).collect()}
    has = [i for i in want if want[i] is not None]
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in has) >= 0.9 * len(has)
    assert all(got[i] is None for i in want if want[i] is None)


def test_large_buckets_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 150)
    v, doc = made(1000)
    assert {(r.a, r.b) for r in S.similar_pairs(frame(spark, v, doc), 0.8, exact=True).collect()} == links_of(v, 0.8)


def test_best_pairs_with_repeats(spark):
    v, doc = made(600)
    s = np.round(v @ v.T, 6)
    for n in (5, 40, 3000):
        want = sorted(((-s[a, b], a, b) for a in range(600) for b in range(a + 1, 600) if doc[a] != doc[b] and s[a, b] > 0.8))[:n]
        got = [(-r.score, r.a, r.b) for r in S.near_duplicates(frame(spark, v, doc), 0.8, 0.5, n, exact=True).collect()]
        assert got == [(float(x), a, b) for x, a, b in want]


def test_odd_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert S.similar_pairs(none, 0.9).count() == S.near_duplicates(none, 0.9).count() == S.duplicate_parents(none, 0.9).count() == 0
    some = spark.createDataFrame([(1, None, 1, 0.9), (2, [1.0, 0.0], 1, 0.9), (3, [1.0, 0.0], 1, 0.9), (4, [0.0, 1.0], None, 0.9)], COLUMNS)
    assert {(r.id, r.parent) for r in S.duplicate_parents(some, 0.9).collect()} == {(1, None), (2, None), (3, 2), (4, None)}
    assert S.near_duplicates(some, 0.9).count() == 0


@pytest.mark.parametrize("cuts", [[0, 300, 310, 700], [0, 1, 2, 699, 700]])
def test_groups_batch_by_batch_equal_all_at_once(spark, cuts):
    v, doc = made(700)
    x = frame(spark, v, doc).select("id", "vec", "doc")
    parents, root = parents_of(v, doc, 0.6), {}
    for i in range(700):
        root[i] = i if parents[i] is None else root[parents[i]]
    stored = None
    for lo, hi in zip(cuts, cuts[1:]):
        new = S.settled(S.arrive(stored, x.where(f"id >= {lo} AND id < {hi}"), 0.6, exact=True))
        assert {r.id: r.group_id for r in new.collect()} == {i: root[i] for i in range(lo, hi)}
        stored = new if stored is None else S.settled(stored.unionByName(new))
    assert S.arrive(stored, x.limit(0), 0.6).count() == 0
    assert len(set(root.values())) < 650


def test_chains_within_a_batch(spark):
    old = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, group_id long")
    new = spark.createDataFrame([(4, 2), (5, 4), (6, 5), (7, None), (8, 7), (9, 3)], "id long, parent long")
    assert {(r.id, r.group_id) for r in S.extend_groups(old, new).collect()} == {(4, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 3)}


def test_pairs_of_a_bucket_are_never_held_together(spark):
    import pandas as pd

    from paperloom.operators import similarity as S

    n = 3000
    rows = spark.range(n).selectExpr("id", "array(1D, id * 1e-9D) AS vec", "array(0L) AS keys")
    counted = S.in_buckets(rows, 0.5, [], lambda left, right, p, q, s: pd.DataFrame({"n": [len(p)]}), "n long").collect()
    assert sum(r.n for r in counted) == n * (n - 1) // 2
    assert max(r.n for r in counted) < 2_000_000


def test_no_plan_copies_half_a_million_vectors_by_the_hundred():
    planes, tables = S.hash_plan(492_307, 0.3)
    assert tables * max(1, 492_307 / 2**planes / S.BLOCK) < 64


def test_rounds_lose_and_repeat_nothing(spark, monkeypatch):
    v, doc = made(700)
    x = frame(spark, v, doc)
    monkeypatch.setattr(S, "BLOCK", 97)
    once = [sorted(S.similar_pairs(x, 0.7, bucket=300).collect()), S.near_duplicates(x, 0.8, 0.5, 50, exact=True).collect(), sorted(S.duplicate_parents(x, 0.6, exact=True).collect())]
    monkeypatch.setattr(S, "ROUND_ROWS", 10)
    dealt = []
    rounds = S._rounds
    monkeypatch.setattr(S, "_rounds", lambda *a: dealt.append(rounds(*a)) or dealt[-1])
    pairs = [(r.a, r.b) for r in S.similar_pairs(x, 0.8, exact=True).collect()]
    assert len(dealt[0]) > 2 and len(pairs) == len(set(pairs)) and set(pairs) == links_of(v, 0.8)
    again = [sorted(S.similar_pairs(x, 0.7, bucket=300).collect()), S.near_duplicates(x, 0.8, 0.5, 50, exact=True).collect(), sorted(S.duplicate_parents(x, 0.6, exact=True).collect())]
    assert again == once and len(once[0]) > 100
    assert len(dealt) > 3 and sum(len(d) > 2 for d in dealt) > 3


def test_a_round_has_few_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "ROUND_ROWS", 10)
    for blocks in (30, 31):
        big = spark.createDataFrame([(0, 3000, blocks)], "table int, size long, blocks long")
        dealt = S._rounds(3000, 1, big)
        # Each distance once; two copies of each vector a round, but one for its own block and for the opposite one.
        assert [d for (_, lo), (_, hi) in dealt for d in range(lo, hi + 1)] == list(range(blocks // 2 + 1))
        assert all(sum(1 if d == 0 or 2 * d == blocks else 2 for d in range(lo, hi + 1)) <= 2 for (_, lo), (_, hi) in dealt)
    dealt = S._rounds(1000, 9, spark.createDataFrame([], "table int, size long, blocks long"))
    assert [t for (lo, _), (hi, _) in dealt for t in range(lo, hi + 1)] == list(range(9)) and len(dealt) == 5


def test_rows_without_a_document_take_no_place(spark):
    v, _ = made(300)
    rows = [(i, x.tolist(), None if i % 2 else i, 0.9) for i, x in enumerate(v)]
    s = np.round(v @ v.T, 6)
    want = sorted((-s[a, b], a, b) for a in range(0, 300, 2) for b in range(a + 2, 300, 2) if s[a, b] > 0.2)[:40]
    got = [(-r.score, r.a, r.b) for r in S.near_duplicates(spark.createDataFrame(rows, COLUMNS), 0.2, 0.5, 40, exact=True).collect()]
    assert got == [(float(x), a, b) for x, a, b in want] and len(got) == 40
