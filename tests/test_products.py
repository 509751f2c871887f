"""Products of blocks of vectors against plain loops: repeated and odd vectors, ties, blocks of any size, no join by nested loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import products as P
from paperloom.operators import retrieval as R
from paperloom.operators import similarity as S

SCHEMA = "id long, vec array<double>, doc long"


def rows_of(n=400, dim=6, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[rng.permutation(n)[: n // 4]] = v[0]
    v[rng.permutation(n)[: n // 4]] += 3e-7  # told apart only by what rounding takes away
    vec = [x.tolist() for x in v]
    vec[7], vec[20], vec[41], vec[60], vec[61] = None, None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [0.0] * dim, [1.0] * (dim - 1)
    return [(i, x, None if i % 50 == 3 else i % 3) for i, x in enumerate(vec)]


@pytest.mark.parametrize("apart", [None, ("q_doc", "doc")])
@pytest.mark.parametrize("blocks", [(10_000, 20_000), (9, 37)])
def test_nearest_are_those_of_scoring_all_pairs(spark, monkeypatch, apart, blocks):
    monkeypatch.setattr(R, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(P, "BLOCK", blocks[1])
    v = spark.createDataFrame(rows_of(), SCHEMA)
    q = v.where("id % 20 IN (0, 1)").selectExpr("id AS query_id", "vec AS q_vec", "doc AS q_doc")
    got = R.nearest_vectors(q, v, 15, apart)
    pairs = v.crossJoin(q).where(F.lit(True) if apart is None else F.col("doc") != F.col("q_doc"))
    want = R.ranked(pairs.select("query_id", "id", F.round(R.dot("q_vec", "vec"), 6).alias("score")), 15)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 400


def test_no_pair_is_made_by_a_nested_loop(spark):
    v = spark.createDataFrame([r for r in rows_of() if r[1] and len(r[1]) == 6 and None not in r[1]], SCHEMA)
    for x in (R.nearest_vectors(v.selectExpr("id AS query_id", "vec AS q_vec"), v, 5), S.link_titles(v.selectExpr("id AS code", "'ring bolt' AS title", "vec"), v.selectExpr("id AS p_code", "'bolt' AS p_title", "vec AS p_vec"), 0.5)):
        plan = x._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "LINK_BLOCK", 30)
    monkeypatch.setattr(P, "BLOCK", 50)
    titles = ["Data Structures", "structures of data", "Advanced Theory", None, "", "Graph-Theory", "the graphs", "Signals & data"]
    rows = [(i, titles[i % 8], x) for i, x, _ in rows_of(240)]
    rows[30] = (30, "Data", [float("nan")] * 6)
    o = spark.createDataFrame([r for r in rows if r[0] % 3 == 0], "code long, title string, vec array<double>")
    t = spark.createDataFrame(rows, "p_code long, p_title string, p_vec array<double>")
    got = {(r.code, r.p_code): str(r.score) for r in S.link_titles(o, t, 0.8).collect()}
    x = o.crossJoin(t).where("code <> p_code").withColumn("score", F.round(R.dot("vec", "p_vec"), 2)).where("score >= 0.8")
    want = {(r.code, r.p_code): str(r.score) for r in x.where(S.share_keyword(F.col("title"), F.col("p_title"))).collect()}
    assert got == want and len(want) > 500


def test_empty_sides(spark):
    v = spark.createDataFrame(rows_of(100), SCHEMA).where("id < 40")
    q = v.selectExpr("id AS query_id", "vec AS q_vec")
    assert R.nearest_vectors(q.limit(0), v).count() == R.nearest_vectors(q, v.limit(0)).count() == 0


def test_sums_are_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 64)), rng.normal(size=(7, 64))
    p, q = np.nonzero(np.ones((5, 7)))
    want = []
    for i, j in zip(p, q, strict=True):
        s = 0.0
        for x, y in zip(a[i], b[j], strict=True):
            s += x * y
        want.append(s)
    assert P.in_order(a, b, p, q).tolist() == want and math.isfinite(P.slack(a, b))
