import numpy as np

from paperloom.llm.ann import Hnsw, nearest

SCHEMA = "vec_id long, embedding array<double>, label int"


def exact(rows, k=20, every=20):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for i, v in ok:
        if i % every == 0:
            for j, w in ok:
                if j != i and len(w) == len(v):
                    best = out.setdefault(i, {})
                    best[j] = max(best.get(j, -np.inf), float(np.dot(np.array(v), np.array(w))))
    return {i: [(j, -x) for x, j in sorted((-x, j) for j, x in best.items())[:k]] for i, best in out.items()}


def found(df, **kw):
    out = {}
    for r in sorted(nearest(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got, want = found(df), exact([(r.vec_id, r.embedding) for r in df.collect()])
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.95
    for q, rows in got.items():
        v = {i: s for i, s in want[q]}
        assert all(abs(s - v[i]) < 1e-12 for i, s in rows if i in v)


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_over_many_cells_with_and_without_structure(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert recall(found(df, cell_vectors=60), exact([(r.vec_id, r.embedding) for r in df.collect()])) >= 0.9
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).tolist(), 0) for i in range(1500)]  # no structure, any length
    rows += [(i, (3 * np.eye(24)[5] + rng.normal(size=24) / 9).tolist(), 0) for i in range(1500, 2300)]  # one crowded place
    df = spark.createDataFrame(rows, SCHEMA)
    assert recall(found(df, cell_vectors=150), exact([r[:2] for r in rows])) >= 0.9


def test_recall_of_one_larger_graph():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:100]
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    got = Hnsw(x).nearest(q, 160)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(true.tolist(), got.tolist())]) >= 0.95


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(100)] + [(i, rng.normal(size=3).tolist(), 0) for i in range(100, 160)]
    rows += [(200, None, 0), (220, [0.0, 0.0, 0.0], 0), (240, [1.0, None, 2.0], 0), (260, [1.0, float("nan"), 0.0], 0), (280, [float("inf"), 0.0, 0.0], 0), (None, same, 0), (300, [1.0, 1.0], 0), (320, [], None), (20, same, 0)]
    rows += [(100, [3.0, -2.0, 0.5], 0), (17, [9.0, 9.0, 9.0], 0), (140, same, 0)]  # ids with two vectors
    df = spark.createDataFrame(rows, SCHEMA)
    want = exact([r[:2] for r in rows])
    got = found(df)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert [i for i, _ in got[20]] == [17, *[i for i in range(20) if i != 17]]


def test_empty_table_and_clashing_columns(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    from tests.llm.helpers import crowded

    df = crowded(spark.createDataFrame([(20, [1.0, 0.0], 0), (21, [0.5, 0.5], 0)], SCHEMA))
    assert [tuple(r) for r in nearest(df).collect()] == [(20, 1, 21, 0.5)]
