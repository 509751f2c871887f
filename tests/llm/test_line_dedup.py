from collections import Counter

from paperloom.llm.line_dedup import drop_boilerplate, line_dedup
from tests.llm.helpers import crowded, docs, empty, odd


def brute(rows, ratio, least):
    hosts, held = Counter(), Counter()
    for _, text, host in rows:
        hosts[host] += 1
        held.update((host, x) for x in {x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")})
    over = {k for k, n in held.items() if n >= least and n > ratio * hosts[k[0]]}
    out = []
    for i, text, host in rows:
        a = (text or "").split("\n")
        k = [x for x in a if (host, x) not in over]
        out.append((i is None, i, "\n".join(k), len(a), len(a) - len(k)))
    return sorted(out)


def check(df, ratio=0.3, least=2):
    want = brute([(r.doc_id, r.text, r.source) for r in df.collect()], ratio, least)
    got = line_dedup(df, max_ratio=ratio, min_pages=least).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want
    return want


def test_against_brute_force(spark, sf_dir):
    assert any(x[4] for x in check(spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.05, 3))


def test_odd_rows(spark):
    check(odd(spark))
    check(crowded(odd(spark)))
    assert line_dedup(empty(spark)).count() == 0


def test_null_host_and_ties(spark):
    d = docs(spark, [(1, "menu\nbody one", "en", None), (2, "menu\nbody two\nmenu", "en", None), (3, "menu", "en", None), (4, "menu\nx", "en", "t")])
    want = check(d, 0.5, 2)
    assert [x[2] for x in want] == ["body one", "body two", "", "menu\nx"]


def test_documents_keep_their_columns(spark):
    d = crowded(docs(spark, [(i, f"menu\nbody {i}", "en", "t") for i in range(4)] + [(9, None)]))
    out = drop_boilerplate(d, max_ratio=0.5, min_pages=2)
    assert out.columns == d.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: "body 0", 1: "body 1", 2: "body 2", 3: "body 3", 9: None}
