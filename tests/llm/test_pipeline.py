import os

from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm.common import scratch_dir
from paperloom.llm.ngram_join import drop_near_copies
from tests.llm.helpers import crowded, docs as made, empty, odd
from tests.llm.test_line_dedup import brute as lines_left
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_secrets import base as secrets
from paperloom.llm.line_dedup import MAX_RATIO, MIN_PAGES


def test_each_stage_on_all_that_its_predecessor_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen[name] = (before, rows)
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in rows)
    before, rows = seen["quality_rules"]
    assert all(before[r.doc_id] == r for r in rows) and 100 < len(rows) < len(before)
    before, rows = seen["line_dedup"]
    want = {x[1]: x[2] for x in lines_left([(r.doc_id, r.text, r.source) for r in before.values()], MAX_RATIO, MIN_PAGES)}
    assert {r.doc_id: r.text for r in rows} == want
    before, rows = seen["ngram_jaccard_join"]
    want = {x[1] for x in groups([(r.doc_id, r.text) for r in before.values()], 5, 80) if x[1] == x[3] or not x[2]}
    assert {r.doc_id for r in rows} == want and len(rows) < len(before)
    before, rows = seen["secret_scans"]
    assert len(rows) == len(before)
    for r in rows:
        assert sum(secrets(r.text)[:3]) == 0
        assert r.text == before[r.doc_id].text or "[SECRET]" in r.text or "[EXAMPLE]" in r.text
    before, rows = seen["packing"]
    assert {r.doc_id for r in rows} == set(before)


def test_run_leaves_its_result_only(spark, sf_dir):
    before = set(os.listdir(scratch_dir(spark)))
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    (left,) = set(os.listdir(scratch_dir(spark))) - before
    assert os.listdir(f"{scratch_dir(spark)}/{left}") == ["4-packing"]


def test_odd_rows_and_empty_tables_run_through(spark, tmp_path):
    # Each on a host of its own: on one host their common line would be on most pages, hence boilerplate.
    prose = " ".join(f"alpha{i} beta{i}" for i in range(60))
    rows = odd(spark).unionByName(made(spark, [(20, prose, "en", "h1"), (20, prose, "en", "h2"), (21, prose + " end", "en", "h3"), (None, prose, "en", "h4")]))
    crowded(rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == {20, None}
    empty(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_of_a_repeated_id_one_row_stays(spark):
    rows = made(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (2, "other words"), (None, "x y"), (None, "x y"), (3, "A b c d e f")])
    out = drop_near_copies(crowded(rows))
    assert out.columns == crowded(rows).columns
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert [i for i, _ in got] == [0, 0, 1, 2]
    assert got == sorted((r.doc_id or 0, r.text) for r in drop_near_copies(crowded(rows).orderBy(F.desc("text"))).collect())
