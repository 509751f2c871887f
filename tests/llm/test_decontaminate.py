import re

import pytest

from paperloom.llm.decontaminate import decontaminate, report
from tests.llm.helpers import crowded, docs, empty, odd

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, window=10):
    """(n_words, n_hit, items, spans) by comparing every run of words with every window."""
    where = list(WORD.finditer((text or "").translate(LOWER)))
    words, hit, found = [m[0] for m in where], set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(LOWER))
        windows = {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} if own else set()
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= {str(item)} - {"None"}
    spans = []
    for i in sorted(hit):
        if i - 1 in hit:
            spans[-1][1] = where[i].end()
        else:
            spans.append([where[i].start(), where[i].end()])
    return len(words), len(hit), sorted(found), spans


def check(spark, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r["items"], [[s.start, s.end] for s in r.spans]) for r in decontaminate(rows, bench, **options).collect()), key=repr)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, *brute(r.text, items)) for r in rows.collect()), key=repr)
    assert got == want
    return got


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "two THREE four, five; six seven eight nine ten eleven"),
    (3, "Short answer"),
    (3, "ünï-CODE 日本 42"),
    (4, "answer"),
    (5, ""),
    (6, None),
    (7, "..."),
    (None, "nameless item"),
    (10, "a a a a a a a a a a a a"),
    (8, "Short answer"),
]
TEXTS = [
    "x one two three four five six seven eight nine ten eleven twelve y",
    "ONE  two\nthree\tfour -- five/six seven eight nine ten",
    "one two three four five six seven eight nine",
    "😀é short, answer! the short\x00answer",
    "ÜNÏ code 日本 42; ünï code 日本 42",
    "a " * 40,
    "a " * 9,
    "nameless item",
    "shortanswer answers",
    "İK two three",
]


def test_spans_items_and_counts(spark):
    x = docs(spark, list(enumerate(TEXTS))).unionAll(odd(spark))
    one = check(spark, x, ITEMS)
    assert check(spark, x, ITEMS, max_windows=1) == one  # many small automata, one after the other
    assert any(r[3] for r in one)


def test_awkward_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(empty(spark), bench).count() == 0
    assert {(r.n_hit, tuple(r["items"])) for r in decontaminate(odd(spark), bench.limit(0)).collect()} == {(0, ())}
    plain = sorted(map(repr, decontaminate(odd(spark), bench).collect()))
    assert sorted(map(repr, decontaminate(crowded(odd(spark)), crowded(bench)).collect())) == plain


def test_a_passage_in_a_long_text_is_found_where_it_stands(spark):
    body = " ".join(f"w{i % 977}" for i in range(200_000))
    passage = "One two three, four five six seven eight nine ten ELEVEN"
    text = body + " " + passage + " " + body
    (row,) = decontaminate(docs(spark, [(1, text)]), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    (span,) = row.spans
    assert text[span.start : span.end] == passage and row.n_hit == 11 and row["items"] == ["1", "2"]


def test_digest_of_no_items(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r.doc_id: r for r in report(decontaminate(docs(spark, [(1, "clean"), (2, "the answer")]), bench)).collect()}
    assert not rows[1].contaminated and rows[1].items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert rows[2].contaminated and rows[2].n_items == 1


@pytest.mark.parametrize("name", ["op12_decontaminate", "op13_filter_audit"])
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    from paperloom.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries()[name](spark, sf_dir)
    cur = con.execute(oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)
