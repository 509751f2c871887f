"""Fuzzy scores from the index against a plain walk over every name for every query."""

import random

from pyspark.sql import functions as F

from paperloom.operators import retrieval as R


def walk(query, name):
    q, t = query.strip().lower(), name.lower()
    if not q:
        return None
    starts = lambda i: i == 0 or t[i - 1] in " \t\n-/("
    at = t.find(q)
    if at >= 0:
        return 1000 - at + 200 * starts(at) - 0.5 * len(t)
    score, place, streak = 0.0, 0, 0
    for c in q.replace(" ", ""):
        found = t.find(c, place)
        if found < 0:
            return None
        streak = streak + 1 if found == place else 0
        score += 1 + 3 * streak + 6 * starts(found) - 0.3 * min(found - place, 10)
        place = found + 1
    return score


def test_whole_catalogue_against_a_walk(spark):
    rng = random.Random(2)
    stock = "data structures graph-theory (lab) maths/2 signals of and design CS21 x ünï".split()
    name = lambda: " ".join(rng.choices(stock, k=rng.randrange(1, 5)))
    rows = [(rng.choice("ab"), str(i), [name(), rng.choice([None, "", name()])]) for i in range(200)]
    queries = [(i, "".join(rng.choices("dastgrphl cx2(-ü", k=rng.randrange(0, 7)))) for i in range(150)]
    queries += [(200 + i, name()[: rng.randrange(1, 9)].upper()) for i in range(50)] + [(300, "d"), (301, "zz"), (302, " data "), (303, "dd"), (304, "d d"), (305, None)]
    got = {(r.query_id, r.kind, r.id): r.score for r in R.fuzzy(spark.createDataFrame(queries, "query_id long, q string"), spark.createDataFrame(rows, "kind string, id string, names array<string>")).collect()}
    want = {}
    for k, q in queries:
        for kind, i, names in rows:
            scores = [s for s in (walk(q or "", n) for n in names if n is not None) if s is not None]
            if scores:
                want[k, kind, i] = max(scores)
    assert got.keys() == want.keys() and len(want) > 2000
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_no_product_in_the_plan(spark):
    q, c = spark.createDataFrame([(1, "ab")], "query_id long, q string"), spark.createDataFrame([("k", "1", ["a b"])], "kind string, id string, names array<string>")
    plan = R.fuzzy(q, c)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert R.fuzzy(q, c.limit(0)).count() == R.fuzzy(q.limit(0), c).count() == 0


def test_a_palette_without_all_rows_is_the_palette_of_all_rows(spark, monkeypatch):
    rng = random.Random(5)
    stock = ["ring bolt", "ring", "a ring", "Brand#1", "Brand#11", "bolt (old)", "rolling"]
    rows = [(rng.choice(["course", "branch", "subject"]), str(i % 180), rng.sample(stock, 2) + [None]) for i in range(200)]
    queries = [(i, rng.choice(["ring", "rng", "BRAND#1", "bolt", "ro", "zz", " ring", "", None])) for i in range(60)]
    q, c = spark.createDataFrame(queries, "query_id long, q string"), spark.createDataFrame(rows, "kind string, id string, names array<string>")
    want = sorted(R.palette(R.fuzzy(q, c)).select("query_id", "kind", "id", "score", "place").collect())
    assert sorted(R.fuzzy_palette(q, c).collect()) == want and len(want) > 200
    # No more rows of a name go on than a palette shows.
    first = R.fuzzy_palette(q, c)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in first
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 3)
    assert sorted(R.fuzzy_palette(q, c).collect()) == want


def test_odd_catalogues_in_small_tiles(spark, monkeypatch):
    rng = random.Random(9)
    names = ["Ring Bolt", "ring bolt", "a ring", "Brand#1", "bolt (old)", "", None]
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(str, range(40))]), rng.choice([None, [], [None], rng.sample(names, 2)])) for _ in range(400)]
    queries = [(i if i % 9 else None, rng.choice(["ring", "rng", " RING", "b#", "zz", "", None])) for i in range(40)]
    want = sorted({(k or -1, kind or "", i or "", max(s)) for k, q in queries for kind, i in {r[:2] for r in rows} if (s := [s for r in rows if r[:2] == (kind, i) for n in r[2] or [] if n is not None and (s := walk(q or "", n)) is not None])})
    q, c = spark.createDataFrame(queries, "query_id long, q string"), spark.createDataFrame(rows, "kind string, id string, names array<string>")
    found = lambda: sorted({(r.query_id or -1, r.kind or "", r.id or "", round(r.score, 3)) for r in R.fuzzy(q, c).collect()})
    want = [(*x[:3], round(x[3], 3)) for x in want]
    assert found() == want and len(want) > 300
    monkeypatch.setattr(R, "TILE", 3)
    monkeypatch.setattr(R, "LEAST_PAIRS", 50)
    assert found() == want
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 3)
    assert found() == want


def test_rows_of_equal_texts_and_names_take_few_bytes(spark, tmp_path):
    n, m = 20_000, 400
    q = spark.range(n).selectExpr("id AS query_id", "'ring' AS q")
    c = spark.range(m).selectExpr("'k' AS kind", "CAST(id AS string) AS id", "array('ring bolt') AS names")
    found = R.fuzzy(q, c)
    found.write.parquet(str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet"))
    assert size < 0.3 * n * m
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("id").agg(F.count("*").alias("rows"), F.sum("query_id").alias("sum"))
    assert [tuple(r) for r in out.groupBy("rows", "sum").count().collect()] == [(n, n * (n - 1) // 2, m)]
