from collections import defaultdict
from itertools import permutations
import re

from paperloom.llm.filter_audit import filter_audit
from tests.llm.helpers import crowded, docs, empty, odd

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every document through every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, shapley = defaultdict(lambda: [0] * 6), defaultdict(int)
    texts = [(d, t or "") for d, t, _ in rows]
    for d, t, lang in rows:
        t, part = t or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": any(c in t for c in "#$%&*|"),
            "E": d is not None and any(e is not None and e < d and u == t for e, u in texts),
        }
        for order in permutations("ABCDE"):
            alive = True
            for step, f in enumerate(order, 1):
                x = out[part, "".join(order), step]
                removed = alive and fails[f]
                x[2] += fails[f] and not alive
                alive = alive and not fails[f]
                x[0] += alive
                x[1] += removed
                x[3] += fails[f] and sum(fails.values()) == 1
                x[4] += removed and d in good
                x[5] += removed and d in toxic
                shapley[part, f] += removed
    return sorted((p, o, s, *x, shapley[p, o[s - 1]]) for (p, o, s), x in out.items())


def check(spark, df, labels, crowd=False):
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    marks = spark.createDataFrame(labels, LABELS)
    got = filter_audit(crowded(df) if crowd else df, crowded(marks) if crowd else marks)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(*names).collect())) == brute(rows, labels)


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (10, LONG, "en"), (11, LONG, "en"), (12, LONG, "de"), (13, LONG, None), (9, LONG, ""), (9, LONG, ""), (14, LONG + " #", "en"), (15, LONG.upper(), "en"),
    (16, "same " * 300, "en"), (17, "same " * 300, "fr"), (18, "a b", "fr"), (None, LONG, "en"), (None, "a b", "fr"), (18, "a b", "fr"), (19, "\x0b\x0c \x1c", "fr"), (18, LONG, "xx"),
]


def test_against_every_order_by_rows(spark):
    labels = [(10, 1, 0), (11, 0, 1), (12, 1, 1), (9, 1, 0), (9, 0, 1), (14, None, None), (16, 0, 1), (None, 1, 1), (18, 1, None), (99, 1, 1), (15, 0, 1)]
    check(spark, docs(spark, ROWS), labels)
    check(spark, docs(spark, ROWS).unionAll(odd(spark)), labels, crowd=True)
    check(spark, odd(spark), [])


def test_empty_tables(spark):
    assert filter_audit(empty(spark), spark.createDataFrame([], LABELS)).count() == 0
    assert filter_audit(docs(spark, [(1, None, None)]), spark.createDataFrame([], LABELS)).count() == 600


def test_shares_add_up(spark):
    x = filter_audit(docs(spark, ROWS), spark.createDataFrame([], LABELS))
    for r in x.groupBy("part", "filter_order").agg({"removed": "sum", "kept": "min", "shapley": "sum"}).collect():
        n = sum((lang or "") == r.part for _, _, lang in ROWS)
        assert r["sum(removed)"] + r["min(kept)"] == n and r["sum(shapley)"] == 120 * r["sum(removed)"]
