import random
import re
from collections import Counter

from paperloom.llm.quality import quality_filter, quality_rules
from tests.llm.helpers import crowded, docs, empty, odd


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = {j for i, t in enumerate(tri) if n[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def check(df):
    want = sorted((r.doc_id is None, r.doc_id, *base(r.text)) for r in df.collect())
    got = quality_rules(df).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_base_counts_on_the_corpus(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_base_counts_on_odd_rows(spark):
    check(odd(spark))
    check(crowded(odd(spark)))
    assert quality_rules(empty(spark)).count() == 0


def test_divergence_rejects_junk_and_keeps_prose(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    r = quality_rules(d).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [x.kept for x in r if x.quality == 1]
    assert sum(good) == len(good)
    junk = docs(spark, [(-1, " ".join(f"W{i}###" for i in range(200)))])
    kept = {x.doc_id for x in quality_filter(d.unionByName(junk)).collect()}
    assert -1 not in kept and len(kept) > 100


def test_words_alone_reject_junk_of_usual_characters(spark):
    """Prose and junk have the same words but for the common ones, so the character classes can't tell them apart."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8)))
    common = "the of and to in a is that for it with on was by this from".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.25 else word() for _ in range(n))
    junk = lambda n: " ".join(word() for _ in range(n))
    german = " ".join(rng.choice(["der", "die", "und", "den"]) if rng.random() < 0.25 else word() for _ in range(300))
    rows = [(i, prose(300)) for i in range(60)] + [(100 + i, prose(55)) for i in range(40)]
    bad = [(200, junk(300)), (201, junk(60)), (202, german)]
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows + bad)).collect()}
    assert not any(r.base_failed or r.char_distance > 0.28 for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {200, 201, 202}


def test_filter_returns_the_columns_it_got(spark):
    assert quality_filter(crowded(odd(spark))).columns == crowded(odd(spark)).columns
