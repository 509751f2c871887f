"""Registered queries against their SQL twins on the smallest tables (the whole set is compared by the driver)."""

import datetime
import decimal

import pytest

from paperloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each family, so that the suite stays short.
CHOSEN = [
    "agg1_topic_frequency", "agg3_recurring_questions", "agg5_facets", "agg5_grouping_sets", "agg11_courses_from_papers", "agg19_takeaways", "agg21_library_shelves",
    "flt2_lenient_parameters", "flt3_known_courses", "flt7_all_words", "jn5_scheme_papers", "jn6_code_reuse", "jn1_hydration", "ret2_bm25", "ret5_rank_fusion",
    "ret8_duplicate_parents", "ret9_group_assignment", "jn7_title_linkage", "doc1_lines", "doc8_confidence", "doc13_weak_regions", "act2_streaks", "ast6_daily_allowance",
    "src3_duplicate_rejection", "snk2_upsert", "cur1_vocabulary_merge", "syl1_version_diff", "srt2_page_with_total", "str2_rate_audit",
    "src1_folder_scan", "src2_type_gate", "src4_manifest_join", "src6_scheme_files", "src8_external_catalogue", "cls2_evidence", "doc6_leaves",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    cur = duck.execute(plans.SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


def test_names_and_twins_belong_together():
    assert set(plans.SQL) <= set(plans.QUERIES)
    assert len(plans.QUERIES) > 120


def test_a_listing_counts_papers_for_its_hits_alone(spark):
    from paperloom.operators import retrieval as R
    from paperloom.operators.filters import FILTER_FIELDS

    fields = ", ".join(f"{n} {t}" for n, t in FILTER_FIELDS.items())
    q = spark.sql(f"SELECT 1L AS query_id, from_json('{{}}', '{fields}') AS f")
    rows = [(f"q{i}", i, 2000 - i % 3, 1, None if i == 9 else i % 4, "x") for i in range(12)]
    c = spark.createDataFrame(rows, "question_id string, document_id long, year long, unit long, group_id long, text string")
    others = {"course_code": "string", "branch": "string", "semester": "long", "exam_type": "string", "kind": "string", "marks": "long"}
    c = c.selectExpr("*", *[f"CAST(NULL AS {t}) AS {n}" for n, t in others.items()])
    got = R.filter_listing(q, c, 6, ("recurrence", "text")).orderBy("rank").collect()
    # The latest six: documents 0, 3, 6, 9 of 2000, then 1 and 4 of 1999; each group is in three papers, but group 1 lost one; no group is 1.
    assert [(r.question_id, r.recurrence) for r in got] == [("q0", 3), ("q3", 3), ("q6", 3), ("q4", 3), ("q1", 2), ("q9", 1)]


def test_replies_meet_their_candidates_in_one_shuffle(spark):
    from paperloom.operators.curation import reconcile_replies

    choices = spark.createDataFrame([("a", ["TREES", " a  new one ", "x", None, "graphs"]), ("b", ["Heaps"]), ("b", ["third", "heaps", "fourth"]), ("c", []), ("d", [None]), (None, ["trees"])], "question_id string, labels array<string>")
    candidates = spark.createDataFrame([("a", "trees"), ("a", "Trees"), ("a", "graphs"), ("b", "heaps"), ("c", "x"), ("e", "y"), (None, "trees"), ("a", None)], "question_id string, name string")
    r = reconcile_replies(choices, candidates)
    got = {x.question_id: (x.tags, x.proposals) for x in r.collect()}
    assert got == {"a": (["Trees", "trees", "graphs"], ["a new one"]), "b": (["heaps"], ["third", "fourth"]), "d": ([], []), None: ([], ["trees"])}
    assert "Join" not in r._jdf.queryExecution().optimizedPlan().toString()
