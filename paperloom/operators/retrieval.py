"""Batch retrieval: many queries at once against a corpus.

A set of queries is a table of its own; where it meets the corpus it is broadcast in blocks of at most
``QUERY_BLOCK`` rows, never the corpus. Every ranking has a total order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.filters import passes
from paperloom.operators.products import in_products, nearest, regular
from paperloom.tables import discard, settled, written

QUERY_BLOCK = 10_000
K1, B = 1.2, 0.75
#: Words that no field indexes.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
WORD_SPLIT = "[^a-z0-9à-öø-ÿ]+"
#: The same characters named one by one: Java matches a class that isn't negated several times as fast.
_BETWEEN_WORDS = r"[\x00-/:-`{-ß÷Ā-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Index terms of a text: lower case, without possessive endings and stop words."""
    t = F.regexp_replace(F.lower(text), "['’]s\\b", "")
    return F.filter(F.split(t, _BETWEEN_WORDS), lambda w: (w != "") & ~w.isin(STOP_WORDS))


#: Postings, for each query, of the rarest terms that the first bound is worked out from.
FIRST_POSTINGS = 2000
#: Scores are rounded to six places, so rows this near to a bound are kept.
_SLACK = 2e-6


def postings(queries: DataFrame, corpus: DataFrame, fields: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(query_id, term) wanted, and (id, term, s): what a term of the queries adds to a row's score. Both are written tables.

    The corpus is read once: each field gives its terms and, under the empty term, one row with its length, from which
    the statistics of the whole corpus are worked out. Terms of no query go before the first shuffle, and the others travel
    as numbers. The postings lie together by row, so that scores are summed where they are read.
    """
    wanted = written(queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")), "wanted")
    numbered = wanted.select("word").distinct().withColumn("term", F.monotonically_increasing_id() + 1)
    numbered = written(numbered.unionByName(queries.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).cast("long").alias("term"))), "terms")
    # The terms are worked out once a row, in the explode of the fields.
    named = [F.struct(F.lit(i).alias("field"), F.col(f).alias("terms")) for i, f in enumerate(fields)]
    rows = corpus.select("id", F.explode(F.array(*named)).alias("f")).where("f.terms IS NOT NULL")
    rows = rows.select("id", "f.field", F.size("f.terms").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.col("f.terms"))).alias("word"))
    tf = written(rows.join(numbered, "word").groupBy("id", "field", "term", "len").agg(F.count(F.lit(1)).cast("int").alias("tf")), "frequencies")
    # One row for each field.
    stats = tf.where("term = 0").groupBy(F.col("field").alias("s_field")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    df = tf.where("term > 0").groupBy(F.col("field").alias("d_field"), F.col("term").alias("d_term")).agg(F.count(F.lit(1)).alias("df"))
    boost = F.element_at(F.array(*[F.lit(float(b)) for b in fields.values()]), F.col("d_field") + 1)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = written(df.join(F.broadcast(stats), F.col("d_field") == F.col("s_field")).select("d_field", "d_term", "avg_len", (boost * idf * (K1 + 1)).alias("weight")), "weights")
    x = tf.join(df, (F.col("field") == F.col("d_field")) & (F.col("term") == F.col("d_term")))
    s = F.col("weight") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    posted = written(x.select("id", "term", s.alias("s")).repartition("id").groupBy("id", "term").agg(F.sum("s").alias("s")), "postings")
    asked = written(wanted.join(numbered, "word").select("query_id", "term"), "asked")
    discard(tf, df, wanted, numbered)
    return asked, posted


def bm25(queries: DataFrame, corpus: DataFrame, fields: dict[str, float], k: int = 50, first_postings: int = FIRST_POSTINGS) -> DataFrame:
    """query_id, id, score (6 places), rank of the ``k`` best rows of each query.

    ``queries``: query_id, text; ``corpus``: id and one array of terms for each field. A row matches when a field
    holds a query term. Statistics are those of the whole corpus.

    Common words have the most postings and add the least. The rarest terms of a query (``first_postings``
    postings, one term at least) give a first score of some rows; the ``k``-th best of these is a bound that the result can't stay under.
    Terms whose highest contributions together can't reach it are *weak*: a row with weak terms only is not in the result, so the postings
    of weak terms are read for the rows that are in reach of the bound alone. Every other row is left out
    for sure, so the result is that of scoring all.
    """
    wanted, posted = postings(queries, corpus, fields)
    # One row for each term of the queries.
    terms = posted.groupBy(F.col("term").alias("t_term")).agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("most"))
    of_query = Window.partitionBy("query_id")
    by_rarity = of_query.orderBy("n", "term")
    asked = wanted.join(terms, F.col("term") == F.col("t_term")).withColumn("before", F.coalesce(F.sum("n").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    asked = written(asked.withColumn("rare", (F.col("before") < first_postings) & ((F.col("before") == 0) | (F.col("before") + F.col("n") <= first_postings))).select("query_id", "term", "n", "most", "rare"), "asked")

    def scores(of: DataFrame) -> DataFrame:
        return posted.join(of.select("query_id", F.col("term").alias("q_term")), F.col("term") == F.col("q_term")).groupBy("query_id", "id").agg(F.sum("s").alias("s"))

    first = scores(asked.where("rare")).withColumn("r", F.row_number().over(of_query.orderBy(F.desc("s"), "id"))).where(F.col("r") == k)
    bound = first.select(F.col("query_id").alias("b_id"), F.col("s").alias("bound"))
    x = asked.join(bound, F.col("query_id") == F.col("b_id"), "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    # The commonest terms, as long as all they can add stays under the bound.
    x = x.withColumn("reach", F.sum("most").over(of_query.orderBy(F.desc("n"), "term")))
    x = written(x.withColumn("weak", ~F.col("rare") & (F.col("reach") + _SLACK < F.col("bound"))).select("query_id", "term", "most", "weak", "bound"), "weak")
    strong = written(scores(x.where("NOT weak")), "strong")
    # The scores so far give a closer bound: all but the weak terms are in them.
    by_score = of_query.orderBy(F.desc("s"), "id")
    closer = strong.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select(F.col("query_id").alias("c_id"), F.col("s").alias("closer"))
    spare = x.groupBy(F.col("query_id").alias("w_id")).agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))), F.lit(0.0)).alias("spare"))
    spare = written(spare.join(closer, F.col("w_id") == F.col("c_id"), "left").select("w_id", (F.greatest("bound", F.coalesce("closer", F.lit(0.0))) - F.col("spare") - _SLACK).alias("least")), "least")
    near = strong.join(spare, F.col("query_id") == F.col("w_id")).where(F.col("s") >= F.col("least")).select("query_id", "id", "s")
    weak = x.where("weak").select(F.col("query_id").alias("k_id"), F.col("term").alias("k_term"))
    rest = near.join(weak, F.col("query_id") == F.col("k_id")).select("query_id", F.col("id").alias("n_id"), "k_term")
    rest = posted.join(rest, (F.col("id") == F.col("n_id")) & (F.col("term") == F.col("k_term"))).select("query_id", "id", "s")
    scored = near.unionByName(rest).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    best = written(ranked(scored, k), "best")  # k rows for each query
    discard(asked, x, strong, spare, posted)
    return best


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """Adds the rank by score, ties by id, and keeps the ``k`` best of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays; of unit vectors, their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest_vectors(queries: DataFrame, corpus: DataFrame, k: int = 50, apart: tuple[str, str] | None = None) -> DataFrame:
    """query_id, id, score (6 places), rank of the ``k`` corpus rows nearest to each query vector; ``apart`` names columns of whole numbers, of queries and corpus, that have to differ.

    Every query (query_id, q_vec, ...) meets every row, as matrix products of blocks; a pair of blocks passes on its own ``k`` best
    of each query. Vectors that are NULL, of another length or not finite have no place in a matrix: their pairs are scored one by one.
    """
    dim = corpus.agg(F.mode(F.size("vec")).alias("dim")).first().dim
    dim = dim if (dim or 0) > 0 else 1
    q_fits, fits = regular("q_vec", dim), regular("vec", dim)
    condition = F.lit(True) if apart is None else F.col(apart[0]) != F.col(apart[1])

    def search(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        return lambda q: ranked(rows.join(F.broadcast(q), condition).select("query_id", "id", F.round(dot("q_vec", "vec"), 6).alias("score")), k)

    q_columns, columns = (["query_id", "q_vec"], ["id", "vec"]) if apart is None else (["query_id", "q_vec", apart[0]], ["id", "vec", apart[1]])
    queries, corpus = queries.select(*q_columns), corpus.select(*columns)
    x = in_products(queries.where(q_fits), corpus.where(fits), "query_id", "id", "q_vec", "vec", QUERY_BLOCK, nearest(k, apart), "query_id long, id long, score double")
    x = x.withColumn("score", F.round("score", 6))
    for q, rows in ((queries.where(~q_fits), corpus), (queries.where(q_fits), corpus.where(~fits))):
        if not q.isEmpty() and not rows.isEmpty():
            x = x.unionByName(in_blocks(q, search(rows)).select("query_id", "id", "score"))
    return ranked(x, k)


def in_blocks(queries: DataFrame, join: Callable[[DataFrame], DataFrame], key: str = "query_id") -> DataFrame:
    """The union of ``join`` over blocks of a stated set of queries, each small enough to be broadcast: ``QUERY_BLOCK`` rows at most.

    Blocks are dealt by hash of the key and dealt anew, into twice as many, until the largest fits. With more than one, each
    block's result is a job of its own and written, so no plan holds more than one of the joins.
    """
    blocks, whole = -(-queries.count() // QUERY_BLOCK), queries
    while blocks > 1:
        of = F.pmod(F.xxhash64(key), F.lit(blocks))
        if queries.groupBy(of.alias("block")).count().agg(F.max("count")).first()[0] <= QUERY_BLOCK:
            return reduce(DataFrame.unionByName, [settled(join(whole.where(of == i))) for i in range(blocks)])
        blocks *= 2
    return join(whole)


def by_mode(queries: DataFrame, vector: DataFrame, keyword: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two lists with only the queries whose ``mode`` wants them (hybrid wants both)."""
    v = queries.where("mode IN ('hybrid', 'vector')").select("query_id")
    w = queries.where("mode IN ('hybrid', 'keyword')").select("query_id")
    return vector.join(v, "query_id", "left_semi"), keyword.join(w, "query_id", "left_semi")


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: query_id, id, score, vector_rank, keyword_rank, rank.

    Ties go to the order of the vector list, then of the keyword list.
    """
    null = F.lit(None).cast("long")
    both = vector.select("query_id", "id", F.col("rank").alias("vr"), null.alias("kr")).unionByName(keyword.select("query_id", "id", null.alias("vr"), F.col("rank").alias("kr")))
    g = both.groupBy("query_id", "id").agg(F.max("vr").alias("vector_rank"), F.max("kr").alias("keyword_rank"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    g = g.withColumn("score", F.round(part("vector_rank") + part("keyword_rank"), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), "keyword_rank")
    return g.withColumn("rank", F.row_number().over(w).cast("long"))


def filter_listing(queries: DataFrame, corpus: DataFrame, first: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Queries without text: the first rows by year (latest first), document and order; then by recurrence and year, stably.

    The score is one over the place. Only the first rows of each query are ranked by recurrence, so papers are counted for their
    groups alone (no group: 1). ``keep`` names more columns of the corpus, or ``recurrence``, to go with the hits, which are written.
    """
    x = in_blocks(queries, lambda q: corpus.join(F.broadcast(q), passes("f")))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("year"), "document_id", "unit", "question_id")
    columns = dict.fromkeys(["query_id", "question_id", "year", "group_id", *[c for c in keep if c != "recurrence"]])
    x = written(x.withColumn("first", F.row_number().over(w)).where(F.col("first") <= first).select(*columns, "first"), "first")
    groups = x.select("group_id").distinct()
    of_groups = corpus.select("group_id", "document_id").join(_few(groups), "group_id", "left_semi").groupBy("group_id").agg(F.countDistinct("document_id").alias("recurrence"))
    x = x.join(of_groups, "group_id", "left").withColumn("recurrence", F.coalesce("recurrence", F.lit(1)))
    again = Window.partitionBy("query_id").orderBy(F.desc("recurrence"), F.desc_nulls_last("year"), "first")
    x = x.withColumn("rank", F.row_number().over(again).cast("long"))
    return written(x.select("query_id", "question_id", "rank", F.round(1 / F.col("rank"), 6).alias("score"), *keep), "listing")


def _few(keys: DataFrame) -> DataFrame:
    """Keys to be joined; broadcast if they are few, so that the rows need no shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else keys


def shape(hits: DataFrame, limits: DataFrame) -> DataFrame:
    """Hits cut at each query's limit (1 to 100, 20 where silent), with the total before the cut and the score to four places."""
    x = hits.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).join(limits.select("query_id", F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce("limit", F.lit(20)))).alias("most")), "query_id")
    return x.where(F.col("rank") <= F.col("most")).withColumn("score", F.round("score", 4)).drop("most")


def hydrate(hits: DataFrame, questions: DataFrame, papers: DataFrame, vocabulary: DataFrame, recurrence: DataFrame) -> DataFrame:
    """Hits with their question, paper, topic labels and recurrence; ids without a question are dropped.

    The hits are few and the tables large: each join is on a key, and labels come by exploding the hits' topics.
    """
    q = questions.select("question_id", "document_id", "text", "topics")
    x = written(hits.join(q, F.col("id") == F.col("question_id")), "hits")
    p = papers.select(F.col("document_id").alias("p_id"), "title", "month").join(_few(x.select(F.col("document_id").alias("p_id")).distinct()), "p_id", "left_semi")
    x = x.join(p, F.col("document_id") == F.col("p_id"), "left").drop("p_id")
    t = x.select("query_id", "question_id", F.posexplode("topics").alias("at", "topic"))
    v = vocabulary.select(F.col("name"), F.col("label").alias("v_label"))
    t = t.join(v, F.col("topic") == F.col("name"), "left").groupBy(F.col("query_id").alias("tq"), F.col("question_id").alias("ti")).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("v_label", "topic").alias("label")))).alias("ls"))
    x = x.join(t, (F.col("query_id") == F.col("tq")) & (F.col("question_id") == F.col("ti")), "left")
    r = recurrence.select(F.col("question_id").alias("r_id"), "recurrence")
    x = x.join(r, F.col("question_id") == F.col("r_id"), "left")
    return x.select("query_id", "rank", "question_id", "text", "title", "month", F.coalesce(F.array_join(F.col("ls.label"), ","), F.lit("")).alias("labels"), F.coalesce("recurrence", F.lit(1)).alias("recurrence"))


def evaluate(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """mode, recall, mrr, over all judged queries.

    ``hits``: mode, query_id, rank, key; ``relevant``: query_id and the array ``keys``. Two hits with one
    key both count as found, as the published figures count them; ``recall_distinct`` counts keys once.
    """
    r = relevant.select("query_id", "keys", F.size("keys").alias("size"))
    modes = hits.select("mode").distinct()
    each = r.select("query_id", "size").join(F.broadcast(modes), F.lit(True))  # two or three modes
    found = hits.where(F.col("rank") <= k).join(r, "query_id").where(F.array_contains("keys", F.col("key")))
    g = found.groupBy("mode", "query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("d"), F.min("rank").alias("first"))
    x = each.join(g, ["mode", "query_id"], "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return x.groupBy("mode").agg(mean(F.col("n") / F.col("size")).alias("recall"), mean(F.col("d") / F.col("size")).alias("recall_distinct"), mean(1 / F.col("first")).alias("mrr"))


#: Fixed values of the fuzzy scores: what stands before a word's start, and what a match gains and loses.
BEFORE_WORD = r"[\s\-/(]"
CONTIGUOUS, AT_START, BY_LENGTH = 1000, 200, 0.5
EACH, STREAK, START, GAP, MOST_GAP = 1.0, 3.0, 6.0, 0.3, 10


def contiguous_score(name: Column, query: Column) -> Column:
    """Score of a name that holds the query as one piece: earlier and at a word's start is better; NULL if it does not."""
    n, q = F.lower(name), F.lower(query)
    at = F.instr(n, q)
    starts = (at == 1) | F.substring(n, at - 1, F.lit(1)).rlike(BEFORE_WORD)
    return F.when((F.length(q) > 0) & (at > 0), CONTIGUOUS - (at - 1) + F.when(starts, AT_START).otherwise(0) - BY_LENGTH * F.length(n))


def scattered_score(name: Column, query: Column) -> Column:
    """Score of a name that holds the query's characters in order: streaks and word starts count for it, gaps against it; NULL if it does not.

    One fold over the query's characters, each taken at its first place after the last one.
    """
    n = F.lower(name)
    state = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.lit(0).alias("streak"), F.lit(True).alias("ok"))
    place = lambda s, c: F.call_function("locate", c, n, s["at"] + 1)

    def fold(s: Column, c: Column) -> Column:
        at = place(s, c)
        streak = F.when(at == s["at"] + 1, s["streak"] + 1).otherwise(0)
        start = (at == 1) | F.substring(n, at - 1, F.lit(1)).rlike(BEFORE_WORD)
        gain = EACH + STREAK * streak + F.when(start, START).otherwise(0.0) - GAP * F.least(at - s["at"] - 1, F.lit(MOST_GAP))
        return F.struct(at.alias("at"), (s["score"] + gain).alias("score"), streak.alias("streak"), (s["ok"] & (at > 0)).alias("ok"))

    chars = _characters(F.lower(query))
    done = F.aggregate(chars, state, fold)
    return F.when((F.size(chars) > 0) & done["ok"], done["score"])


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: (c != "") & (c != " "))


def _in_order(chars: Column) -> Column:
    """All pairs of a first and a later character, and all characters, each once."""
    later = F.transform(chars, lambda c, i: F.transform(F.array_distinct(F.slice(chars, i + 2, F.size(chars))), lambda d: F.concat(c, d)))
    return F.array_distinct(F.concat(chars, F.flatten(later)))


#: So many queries may be broadcast to the rows that their texts have found; more are joined as Spark sees fit.
BROADCAST_QUERIES = 500_000
#: So many ids of a group lie in one array; a multiple of 8, as files pack numbers of a column by eights.
TILE = 256
#: Pairs of a catalogue row and a query, found or not, that a task has where rows come out; small tables have tasks of fewer.
TASK_PAIRS, LEAST_PAIRS = 200_000_000, 1_000_000


def _text_scores(queries: DataFrame, named: DataFrame) -> DataFrame:
    """(q_text, s_n, score): every text of the queries with every name (``n``, lower case) that it matches, each once."""
    asked = queries.select("q_text").distinct().withColumn("c", _characters(F.col("q_text"))).where(F.size("c") > 0)
    pairs = F.transform(F.slice("c", 1, F.size("c") - 1), lambda x, i: F.concat(x, F.get("c", i + 1)))
    asked = written(asked.select("q_text", F.explode(F.when(F.size("c") > 1, F.array_distinct(pairs)).otherwise(F.col("c"))).alias("pair")), "pairs")
    index = named.select("n").distinct().select("n", F.explode(_in_order(_characters(F.col("n")))).alias("key"))
    index = written(index.join(asked.select(F.col("pair").alias("key")).distinct(), "key", "left_semi"), "index")
    counts = index.groupBy(F.col("key").alias("c_key")).agg(F.count(F.lit(1)).alias("names"))
    # A query with a pair that no name has finds nothing by that pair.
    rarest = asked.join(counts, F.col("pair") == F.col("c_key"), "left").groupBy("q_text").agg(F.min_by("pair", F.struct(F.coalesce("names", F.lit(0)), "pair")).alias("pair"))
    x = rarest.join(index, F.col("pair") == F.col("key")).select("q_text", "n")
    x = x.withColumn("score", F.coalesce(contiguous_score(F.col("n"), F.col("q_text")), scattered_score(F.col("n"), F.col("q_text")))).where("score IS NOT NULL")
    x = written(x.select("q_text", F.col("n").alias("s_n"), "score"), "scores")
    discard(asked, index)
    return x


def _with_text(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lower(F.trim("q")).alias("q_text"))


def _asked_by(q: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (s_text, kind, id and more) for every query of the text."""
    few = q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    return found.join(F.broadcast(q) if few else q, F.col("q_text") == F.col("s_text")).drop("q_text", "s_text")


def _tiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(``key``, tile, ``value``): the values of each key, NULL ones too, in arrays of ``TILE``, but for a few shorter ones."""
    many = 16 * TILE
    # At most one row for each 16 tiles; a hot key's rows meet it as Spark sees fit (broadcast or skew join).
    large = rows.groupBy(F.col(key).alias("l_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many)
    x = rows.join(large, F.col(key) == F.col("l_key"), "left")
    x = x.withColumn("dealt", F.pmod(F.xxhash64(value), F.ceil(F.coalesce("n", F.lit(1)) / many)))
    x = x.groupBy(key, "dealt").agg(F.array_sort(F.collect_list(F.struct(value))).alias("values"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("values") - 1) / TILE).cast("int")), lambda i: F.slice("values", i * TILE + 1, F.lit(TILE)))
    x = x.select(key, "dealt", F.posexplode(cut).alias("at", "values"))
    return x.select(key, F.struct("dealt", "at").alias("tile"), F.col(f"values.{value}").alias(value))


def fuzzy(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """query_id, kind, id, score: the best score over a catalogue row's fields (``names``); rows without one are left out.

    Either way to match has the query's characters in their order, so every two neighbours of them are a pair *in order* in
    the name. A query is looked up by its rarest such pair in an index of names; only what it finds there is scored.
    Equal names and equal queries are scored once; queries without characters match nothing.

    Every row that every query finds comes out, which grows with queries times rows, so nothing else does: rows of the same names and queries
    of the same text lie in arrays (*tiles*) until the last step, which shuffles nothing. There each query of a tile meets the same ids
    in turn, and the queries of a task are those of a few names: columns of runs and short repetitions, which take a file a tenth of a byte a row.
    """
    q, lower = _with_text(queries), F.transform(F.filter("names", lambda n: n.isNotNull()), lambda n: F.lower(n))
    rows = catalogue.select("kind", "id", lower.alias("names")).groupBy("kind", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    rows = written(_tiles(rows.where(F.size("names") > 0).select(F.struct("kind", "names").alias("of"), "id"), "of", "id"), "rows")
    named = rows.select("of.names").distinct().select("names", F.explode("names").alias("n"))
    scored = named.join(_text_scores(q, named), F.col("s_n") == F.col("n")).groupBy(F.col("names").alias("s_names"), F.col("q_text").alias("s_text")).agg(F.round(F.max("score"), 3).alias("score"))
    scored = written(scored, "scored")
    asked = _tiles(q.where("q_text IS NOT NULL"), "q_text", "query_id")
    n = q.count()
    pairs = n * (rows.agg(F.sum(F.size("id"))).first()[0] or 0)
    tasks = max(-(-pairs // TASK_PAIRS), min(-(-pairs // LEAST_PAIRS), int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    x = rows.repartitionByRange(tasks, "of", "tile").join(_few(scored), F.col("of.names") == F.col("s_names"))
    x = x.join(F.broadcast(asked) if n <= BROADCAST_QUERIES else asked, F.col("s_text") == F.col("q_text"))
    # The pairs of tiles go on one by one: without a step between, Spark would hold all rows that one tile of the catalogue leads to.
    x = x.select(F.col("of.kind").alias("kind"), "id", "score", "query_id").coalesce(tasks)
    return x.withColumn("query_id", F.explode("query_id")).select("query_id", "kind", F.explode("id").alias("id"), "score")


def fuzzy_palette(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``palette`` of ``fuzzy``, without every row that a text finds: query_id, kind, id, score, place.

    Of the rows of one kind that have one name, all but the first ids are behind as many others that score at least as much, so a name
    passes on no more ids than a palette shows. A palette belongs to a text and goes to its queries at the end.
    """
    q, most = _with_text(queries), max(PALETTE.values())
    named = catalogue.select("kind", "id", F.explode("names").alias("n")).where("n IS NOT NULL").select("kind", "id", F.lower("n").alias("n")).distinct()
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("n", "kind").orderBy("id"))).where(F.col("r") <= most).drop("r")
    x = _text_scores(q, named).join(first, F.col("s_n") == F.col("n")).groupBy(F.col("q_text").alias("query_id"), "kind", "id").agg(F.round(F.max("score"), 3).alias("score"))
    x = palette(x).withColumnRenamed("query_id", "s_text")
    return _asked_by(q, x).select("query_id", "kind", "id", "score", "place")


#: How many of each kind a palette shows.
PALETTE = {"course": 5, "branch": 3, "subject": 3}


def palette(scored: DataFrame) -> DataFrame:
    """The best of each kind; where any score reaches 500, scattered matches go."""
    x = scored.withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).where((F.col("top") < 500) | (F.col("score") >= 500))
    w = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id")
    x = x.withColumn("place", F.row_number().over(w).cast("long"))
    most = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(n)) for kind, n in PALETTE.items()])
    return x.where(F.col("place") <= most).drop("top")
