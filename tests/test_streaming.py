import os

from pyspark.sql import functions as F

from paperloom import views as V
from paperloom.document_table import DocumentTable
from paperloom.operators.activity import rate_audit
from paperloom.operators.curation import retag
from paperloom.operators.documents import lines
from paperloom.streaming import intake as I


def files_of(path):
    return sum(f.startswith("part-") for _, _, names in os.walk(path) for f in names)


def test_ingest_replaces_documents_that_come_again(spark, tmp_path):
    src = str(tmp_path / "src")
    target = DocumentTable(spark, str(tmp_path / "out"))
    schema = "document_id long, page long, text string, ts timestamp"
    ts = F.lit("2024-01-01 10:00:00").cast("timestamp")
    one = spark.createDataFrame([(1, 1, "a\nb"), (2, 1, "c"), (3, 1, "c")], "document_id long, page long, text string").withColumn("ts", ts)
    one.coalesce(1).write.parquet(src)
    pages = I.first_copies(I.pages_stream(spark, src, schema))
    process = lambda b: lines(b).select("document_id", "line")
    I.ingest(pages, process, target, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.line for r in target.read().collect()) == ["a", "b", "c"]
    spark.createDataFrame([(1, 1, "z"), (2, 1, " ")], "document_id long, page long, text string").withColumn("ts", ts).write.mode("append").parquet(src)
    I.ingest(pages, process, target, str(tmp_path / "cp")).awaitTermination(120)
    left = {(r.document_id, r.line) for r in target.read().collect()}
    assert (1, "z") in left and not {(1, "a"), (1, "b"), (2, "c")} & left


def batch(spark, ids, word):
    return spark.createDataFrame([(i, f"{word}{k}") for i in ids for k in range(i % 3)], "document_id long, line string")


def held(table):
    return sorted(map(tuple, table.read().collect()))


def test_document_table_against_a_dict(spark, tmp_path):
    """Batches with documents that come again, that lose all rows, and batches that are repeated, late ones too."""
    table, want = DocumentTable(spark, str(tmp_path / "t"), buckets=2, compact_after=3), {}
    assert table.read() is None
    plan = [(range(10), "a"), (range(5, 15), "b"), (range(0, 20, 4), "c"), (range(3), "d"), (range(19, 22), "e"), ([7, 8], "f"), ([1], "g"), ([2], "h")]
    for epoch, (ids, word) in enumerate(plan):
        rows, docs = batch(spark, ids, word), spark.createDataFrame([(i,) for i in ids], "document_id long")
        table.merge(rows, epoch, docs)
        want |= {i: [f"{word}{k}" for k in range(i % 3)] for i in ids}
        now = sorted((i, l) for i, ls in want.items() for l in ls)
        assert held(table) == now
        table.merge(rows, epoch, docs)  # the same batch again
        if epoch:  # and one that was merged long ago
            ids0, word0 = plan[max(0, epoch - 3)]
            if table._marked("base") and table._marked("base")[-1] >= epoch - 3 >= 0:
                table.merge(batch(spark, ids0, word0), epoch - 3)
        assert held(table) == now
    # Two bases and the batches after the older one, in two files each, with their keys.
    assert files_of(tmp_path / "t") <= 2 * 2 + 2 * 2 * 2 * 3


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    table.merge(batch(spark, [1, 2], "a"), 0)
    before = held(table)
    table._write(batch(spark, [1, 2], "b"), "rows", 1)  # the driver was lost here
    assert held(table) == before
    table.merge(batch(spark, [1], "c"), 1)
    assert held(table) == [(1, "c0"), (2, "a0"), (2, "a1")]


def test_many_documents_few_files(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"), buckets=4, compact_after=4)
    for epoch in range(6):
        table.merge(spark.range(epoch * 15_000, epoch * 15_000 + 25_000).select(F.col("id").alias("document_id"), F.lit(epoch).alias("v")), epoch)
    assert table.read().count() == 100_000
    assert table.read().groupBy("v").count().orderBy("v").collect()[-1]["count"] == 25_000
    assert files_of(tmp_path / "t") <= 4 * (2 + 2 * 2 * 4)


def test_retag_twice_is_once(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"))
    rows = [("q1", 1, ["x"]), ("q2", 1, []), ("q3", 2, []), ("q4", 3, ["y"]), ("q5", 4, []), ("q6", 5, None)]
    table.merge(spark.createDataFrame(rows, "question_id string, document_id long, topics array<string>"), 0)
    papers = spark.createDataFrame([(1, "ready", "A"), (2, "needs_review", "B"), (3, "ready", "A"), (4, "failed", "A"), (5, "ready", "A"), (6, "ready", "A")], "document_id long, status string, course_code string")
    tag = lambda q: q.where("question_id <> 'q6'").select("question_id", F.array(F.lit("new")).alias("topics"))
    state = lambda: {r.question_id: r.topics for r in table.read().collect()}
    report = retag(table, papers, tag, 1, ["A"], only_untagged=True)
    assert {tuple(r) for r in report.collect()} == {(1, 2, 2), (5, 1, 1)}
    first = state()
    assert first == {"q1": ["new"], "q2": ["new"], "q3": [], "q4": ["y"], "q5": [], "q6": []}
    assert spark.read.parquet(f"{tmp_path}/t/rows/epoch=1").select("document_id").distinct().count() == 2
    retag(table, papers, tag, 1, ["A"], only_untagged=True)
    assert state() == first
    retag(table, papers, tag, 2, ["A"], only_untagged=True)
    assert state() == first
    retag(table, papers, tag, 3)
    assert state() == {"q1": ["new"], "q2": ["new"], "q3": ["new"], "q4": ["new"], "q5": [], "q6": []}


def test_retag_in_place_reads_its_rows_once(spark, tmp_path, monkeypatch):
    rows = [(f"q{i}", None if i % 11 == 0 else i % 7, [] if i % 3 == 0 else ["x"] if i % 5 else None) for i in range(60)]
    papers = spark.createDataFrame([(i, "failed" if i == 2 else "ready", "AB"[i % 2]) for i in range(8)] + [(None, "ready", "A")], "document_id long, status string, course_code string")
    new = F.when(F.col("question_id") != "q6", F.array(F.col("question_id")))
    taggers = {False: lambda q: q.where("question_id <> 'q6'").select("question_id", new.alias("topics")), True: lambda q: q.withColumn("topics", new)}
    states, plans, merge = {}, [], DocumentTable.merge
    monkeypatch.setattr(DocumentTable, "merge", lambda self, rows, *a, **k: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or merge(self, rows, *a, **k))
    for whole, tag in taggers.items():
        table = DocumentTable(spark, str(tmp_path / str(whole)), buckets=2)
        table.merge(spark.createDataFrame(rows, "question_id string, document_id long, topics array<string>"), 0)
        reports = [sorted(map(tuple, retag(table, papers, tag, e, ["A"], only_untagged=e < 2, in_place=whole).collect())) for e in (1, 2)]
        states[whole] = reports, sorted((tuple(r) for r in table.read().collect()), key=str)
    assert states[True] == states[False]
    # The questions are tagged where they are read, for the first batch and for a later one: no join by question.
    by_question = [any("Join" in line and "question_id" in line for line in p.splitlines()) for p in plans]
    assert by_question == [False, True, True, False, False, False]


def test_stream_of_rates_equals_its_batch(spark, sf_dir, tmp_path):
    e = V.events(spark, sf_dir)
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e")).withWatermark("ts", "60 days")
    q = rate_audit(s, "user_id", "15 minutes", 1).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, rate_audit(e, "user_id", "15 minutes", 1).collect()))


def test_rate_stream_query_reads_what_the_stream_wrote(spark, sf_dir, monkeypatch):
    from pyspark.sql.streaming import StreamingQuery

    from paperloom import plans

    waits, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, *limit: waits.append(limit) or wait(self, *limit))
    got = plans.QUERIES["str2_rate_stream"](spark, sf_dir)
    assert waits and set(waits) == {()} and got.inputFiles()
    want = plans.QUERIES["str2_rate_audit"](spark, sf_dir)
    assert got.count() == want.count() and got.agg(F.sum("n")).first() == V.events(spark, sf_dir).agg(F.count(F.lit(1))).first()


def test_live_allowance(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = V.events(spark, sf_dir).select("user_id", F.col("event_id").alias("request_id"), "ts")
    e.repartition(2).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = I.live_allowance(s, 2).writeStream.format("memory").queryName("allow").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.table("allow")
    assert got.count() == e.count()
    from paperloom.functions.scalars import india_day

    n = e.groupBy("user_id", india_day(F.col("ts")).alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.least("n", F.lit(2)))).first()[0]
    assert got.where("ok").count() == n


def requests(spark, tmp_path, name, rows):
    df = spark.createDataFrame([(t, u) for t, u in rows], "t string, user_id long").select(F.col("t").cast("timestamp").alias("ts"), "user_id")
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return df


def counts(df):
    return {(r.key, r.start.strftime("%H:%M")): r.n for r in df.collect()}


def test_rates_in_append_mode(spark, tmp_path):
    """State is bounded by the watermark, a window's row is written once, late requests are counted apart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    first = [(f"2024-01-01 {h:02}:{m:02}:00", u) for h in range(10) for m in (1, 2, 40) for u in (1, 2)]
    df = requests(spark, tmp_path, "r", first)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    log = I.RateLog(spark, str(tmp_path / "log"), "user_id", "15 minutes", "30 minutes")
    log.run(s)
    batch = counts(rate_audit(df, "user_id", "15 minutes", 1))
    assert counts(log.closed()) | counts(log.open()) == batch and log.late().count() == 0
    # The watermark is at 09:10; of 40 windows only those that end after it have state.
    assert counts(log.open()) == {(1, "09:00"): 2, (2, "09:00"): 2, (1, "09:30"): 1, (2, "09:30"): 1}
    second = [("2024-01-01 03:03:00", 1), ("2024-01-01 03:04:00", 1), ("2024-01-01 09:05:00", 2), ("2024-01-01 20:00:00", 7)]
    requests(spark, tmp_path, "r", second)
    log.run(s)
    assert counts(log.late()) == {(1, "03:00"): 2}
    assert counts(log.open()) == {(7, "20:00"): 1}
    done = counts(log.closed())
    assert done[1, "03:00"] == 2 and done[2, "09:00"] == 3 and log.closed().count() == len(done) == len(batch)
