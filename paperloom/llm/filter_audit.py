"""Filter interaction audit by higher-order SQL folds.

What a filter removes depends on the filters before it. Every document gets a mask of the filters that it
fails; documents of one part and one mask (at most 32 a part) are one weighted cell. A cell folds across the array of
all 120 filter orders: ``transform`` over the orders, ``aggregate`` along the steps of one, which gives 600
structs weighted by the cell's documents. The audit is their elementwise sum over the cells of a part.

The array of orders is a constant of the plan (120 words), so nothing that grows is broadcast. A text
travels as its digest; copies of one text are summed by (digest, part, labels) in the map tasks, so a text that a
third of all rows hold meets itself again as a few partial sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import bind, let

FILTERS = "ABCDE"
#: A: fewer words than this.
MIN_WORDS = 200
#: B: distinct words are less than this percentage of the words.
MIN_DISTINCT = 50
#: C: capitals A-Z are more than this percentage of the code points.
MAX_CAPITALS = 3
#: D: any of these characters.
MARKS = "#$%&*|"

ORDERS = ["".join(p) for p in permutations(FILTERS)]

_STEP = "STRUCT<filter_order: STRING, step: INT, kept: BIGINT, removed: BIGINT, redundant: BIGINT, unique_fails: BIGINT, good_lost: BIGINT, toxic_lost: BIGINT>"


def text_mask(text: str) -> str:
    """SQL for the bits of filters A to D that a text fails."""
    words = f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    bits = f"""CAST(IF(size(ws) < {MIN_WORDS}, 1, 0)
        + IF(100L * size(array_distinct(ws)) < {MIN_DISTINCT}L * size(ws), 2, 0)
        + IF(100L * length(regexp_replace({text}, '[^A-Z]+', '')) > {MAX_CAPITALS}L * length({text}), 4, 0)
        + IF({text} RLIKE '[{MARKS}]', 8, 0) AS INT)"""
    return let(words, "ws", bits)


def orders_fold(mask: str, n: str, good: str, toxic: str) -> str:
    """SQL for the 600 structs of a cell: ``aggregate`` walks an order with whether its documents are still there."""
    orders = "array(" + ", ".join(f"'{o}'" for o in ORDERS) + ")"
    bit = f"shiftleft(1, ascii(substr(o, i, 1)) - {ord(FILTERS[0])})"
    fails = f"({mask} & {bit}) <> 0"
    weighed = f"""named_struct('filter_order', o, 'step', i,
        'kept', IF(a.alive AND NOT {fails}, {n}, 0L), 'removed', IF(a.alive AND {fails}, {n}, 0L),
        'redundant', IF(NOT a.alive AND {fails}, {n}, 0L), 'unique_fails', IF({mask} = {bit}, {n}, 0L),
        'good_lost', IF(a.alive AND {fails}, {good}, 0L), 'toxic_lost', IF(a.alive AND {fails}, {toxic}, 0L))"""
    start = f"named_struct('alive', true, 'steps', CAST(array() AS ARRAY<{_STEP}>))"
    walk = f"(a, i) -> named_struct('alive', a.alive AND NOT {fails}, 'steps', concat(a.steps, array(CAST({weighed} AS {_STEP}))))"
    return f"flatten(transform({orders}, o -> aggregate(sequence(1, {len(FILTERS)}), {start}, {walk}, a -> a.steps)))"


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail exactly the filters of a mask, and how many of them have each label."""
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    x = bind(x, "mask", text_mask("text")).select("doc_id", "part", "mask", F.unhex(F.sha2("text", 256)).alias("digest"))
    x = x.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("good OR toxic").groupBy("l_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    x = x.join(marks, F.col("doc_id") == F.col("l_id"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # A row here is one id with one text and part, so the least struct holds how many rows have the first id.
    x = x.groupBy("digest", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", F.col("n").alias("m"))).alias("first"))
    of_text = Window.partitionBy("digest")
    x = x.withColumn("first_id", F.min(F.when(~F.col("nameless"), F.col("first.doc_id"))).over(of_text))
    originals = F.when(F.col("nameless"), F.col("n")).when(F.col("first.doc_id") == F.col("first_id"), F.col("first.m")).otherwise(F.lit(0))
    x = x.withColumn("originals", originals)
    copy_bit = 1 << FILTERS.index("E")
    both = F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    x = x.select("part", "good", "toxic", F.inline(both))
    sums = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]]
    return x.groupBy("part", "mask").agg(*sums).where("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts count as empty (no words: filter A only), a null part is the empty string. Repeated rows each
    count, and rows of one id are no copies of each other (E asks for a smaller id). A null id is no copy of anything
    and makes nothing a copy; it has no label. A document is good or toxic if any of its label rows says so; null
    labels say nothing. Every part has all 600 rows; an empty table has no part, so no rows.
    """
    cells = mask_cells(docs, labels, id_col, text_col, part_col)
    steps = cells.select("part", F.inline(F.expr(orders_fold("mask", "n", "good", "toxic"))))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    summed = steps.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in names])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    # 120 rows for each part and filter.
    return summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


#: The same by rows: every document meets every order's step, without masks or folds.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
s AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
w AS (SELECT doc_id, text, part, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
f AS (SELECT w.doc_id, w.part, len(ws) < {MIN_WORDS} AS A, 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws) AS B,
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(w.text) AS C, regexp_matches(w.text, '[{MARKS}]') AS D,
    coalesce(first_id < w.doc_id, false) AS E
  FROM w JOIN s ON w.text = s.text),
g AS (SELECT part, A, B, C, D, E, count(*) AS n, count(*) FILTER (WHERE q) AS good, count(*) FILTER (WHERE t) AS toxic
  FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id) l ON f.doc_id = l.doc_id
  GROUP BY ALL),
u AS (SELECT part, n, good, toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([A, B, C, D, E]) AS fails, A::INT + B::INT + C::INT + D::INT + E::INT AS failed,
    hash(part, A, B, C, D, E) AS cell FROM g),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT u.*, filter_order, strpos(filter_order, letter) AS step,
    coalesce(bool_or(fails) OVER (PARTITION BY cell, part, filter_order ORDER BY strpos(filter_order, letter) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone
  FROM u, o),
t AS (SELECT part, filter_order, step, any_value(letter) AS letter,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM t
"""
