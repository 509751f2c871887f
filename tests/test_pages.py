"""Pages of an ordered table against slices of a sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import catalogue as C


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.choice([None, *range(40)]), i) for i in range(2000)]


@pytest.mark.parametrize("page", [1, 2, 7, 33, 66, 67, 10**6, 0, -3])
def test_page(spark, rows, page):
    df = spark.createDataFrame(rows, "k int, id long").repartition(5)
    order = [F.desc_nulls_last("k"), F.asc("id")]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    at = min(max(1, page), 67)
    got = C.page_of(df, order, page, 30, first_rows=90, part_rows=150).collect()
    assert [(r.k, r.id) for r in got] == want[30 * (at - 1) : 30 * at]
    assert {(r.total, r.n_pages) for r in got} == {(2000, 67)}


def test_only_the_ranges_of_the_page_are_sorted(spark):
    ranged = spark.range(5000).withColumn("__part", (F.col("id") / 100).cast("int"))
    part, skip = C._ranges_with(ranged, 4210, 30)
    assert skip == 10 and sorted(r.id for r in part.collect()) == list(range(4200, 4300))
    part, skip = C._ranges_with(ranged, 4290, 30)
    assert skip == 90 and part.count() == 200


def test_page_of_nothing(spark):
    df = spark.range(0)
    assert C.page_of(df, [F.asc("id")], 5, 10).collect() == []
    assert C.page_of(df, [F.asc("id")], 5, 10, first_rows=0).collect() == []
