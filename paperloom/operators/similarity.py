"""Similarity joins over unit vectors, duplicate parents and groups, without all pairs.

Vectors are hashed by random hyperplanes. A pair at an angle ``w`` agrees on one plane with probability 1 - w/pi, so the
number of tables follows from the planes to a table and the recall asked for at the threshold; closer pairs are found more often.
The number of planes is what costs least for the number of vectors (``hash_plan``). Within
a bucket every pair is compared exactly. Equal vectors are one class before anything is hashed. A bucket
that is larger than ``BLOCK`` all the same is compared block by block, in as many tasks as it has pairs of
blocks, and what leaves a task is already reduced (a row's best, the best of all), never the pairs of a group.
With ``exact`` there is one table without planes: all pairs, block by block.

A vector is copied for each table and for each other block of a bucket, so all copies at once would take disk by the square of the vectors.
Tables and pairs of blocks are therefore dealt into rounds of a bounded number of copies; the shuffle files of a round go with it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.catalogue import keywords, share_keyword, squashed
from paperloom.operators.products import in_products, linked, regular
from paperloom.operators.retrieval import dot, in_blocks
from paperloom.tables import discard, settled, written

#: The most vectors that one side of a comparison has, and how many scores are worked out at a time, which is also how many pairs are held.
BLOCK = 16_000
SLICE_SCORES = 1_000_000
#: The most official titles that one side of a comparison has.
LINK_BLOCK = 2000
#: What a copy of a vector costs in a shuffle, in comparisons of two vectors.
COPY_COST = 2500
#: So many copies of each vector are shuffled in one round, or so many in all if that is more.
ROUND_COPIES, ROUND_ROWS = 2, 500_000
#: The share of pairs at the threshold that the tables are to find.
RECALL = 0.95
_SALTS = 16
#: In place of an id where there is none.
_NONE = (1 << 63) - 1


def hash_plan(n: int, threshold: float, recall: float = RECALL, bucket: int | None = None) -> tuple[int, int]:
    """(planes to a table, tables) for ``n`` vectors: a pair at the threshold shares a bucket of some table with probability ``recall``.

    More planes make smaller buckets, so fewer comparisons and blocks, but need more tables, so more copies of each vector. The
    cheapest plan is taken; no planes (all pairs, block by block) is one of them. ``bucket`` asks for buckets of a size instead.
    """
    alike = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi

    def tables(planes: int) -> int:
        shared = alike**planes
        return 1 if shared >= recall else math.ceil(math.log(1 - recall) / math.log(1 - shared))

    def cost(planes: int) -> float:
        size = n / 2**planes
        return tables(planes) * (COPY_COST * max(1, size / BLOCK) + size)

    most = math.ceil(math.log2(max(1, n)))
    planes = max(0, round(math.log2(max(1, n) / bucket))) if bucket else min(range(most + 1), key=cost)
    return planes, tables(planes)


def with_keys(classes: DataFrame, planes: int, tables: int, dim: int, seed: int = 5) -> DataFrame:
    """``classes`` with ``keys``: the bucket of ``vec`` in each table."""
    normals = np.random.default_rng(seed).normal(size=(dim, tables * planes))
    weights = 1 << np.arange(planes, dtype=np.int64)
    kind, spark_kind = (pa.int16(), "smallint") if planes < 16 else (pa.int64(), "bigint")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec"))
            x = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            keys = ((x @ normals > 0).reshape(len(x), tables, planes) * weights).sum(2)
            offsets = pa.array(np.arange(0, keys.size + 1, tables), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()).cast(kind))], names=[*batch.schema.names, "keys"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema) + f", keys array<{spark_kind}>"
    return classes.mapInArrow(keyed, schema)


#: From a task's left and right rows and the pairs found (places in both, scores) to the rows that leave it.
Reduce = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


#: Rows of the rounds so far, or of one, to fewer rows that are enough.
Again = Callable[[DataFrame], DataFrame]


def in_buckets(keyed: DataFrame, threshold: float, within: list[str], reduce: Reduce, schema: str, only: Column | None = None, again: Again | None = None, most: int | None = None) -> DataFrame:
    """``reduce`` over the pairs of every bucket (and equal ``within``) whose score, to six places, reaches the threshold.

    It is applied to some of a bucket's pairs at a time, so callers reduce what comes out once more. Where there are several rounds, their
    rows are written, and reduced by ``again`` from round to round. With ``most``, what comes out are pairs with their score of which only
    the ``most`` best are wanted, so the threshold rises to the last of so many.

    ``keyed``: id, vec, keys. A pair that shares buckets of several tables counts in the first only. With
    ``only``, buckets without any such row are left out.
    """
    of = ["table", "key", *within]
    found = keyed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("keys")).alias("tables")).first()
    tables, blocked = found.tables or 1, found.n > BLOCK

    def rows_of(first: int, last: int) -> DataFrame:
        """Every vector in each of its buckets of tables ``first`` to ``last``, with the keys it has in the tables before."""
        x = keyed.select("*", F.posexplode(F.slice("keys", first + 1, last - first + 1)).alias("at", "key"))
        return x.withColumn("table", F.col("at") + first).drop("at").withColumn("keys", F.slice("keys", F.lit(1), F.col("table")))

    blocks = F.ceil(F.col("size") / BLOCK)
    rounds, big = [((0, 0), (tables - 1, found.n))], None
    if blocked:
        # At most one row for each BLOCK rows; a hot bucket's rows meet it as Spark sees fit (broadcast or skew join).
        sizes = rows_of(0, tables - 1).groupBy(*of).agg(F.count(F.lit(1)).alias("size"))
        big = written(sizes.where(F.col("size") > BLOCK).select(*[F.col(c).alias(f"b_{c}") for c in of], "size"), "sizes")
        if found.n * tables * -(-found.n // BLOCK) > max(ROUND_ROWS, ROUND_COPIES * found.n):
            rounds = _rounds(found.n, tables, big.select(F.col("b_table").alias("table"), "size", blocks.alias("blocks")))

    def copies(first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
        rows = rows_of(first[0], last[0])
        if only is not None:
            touched = rows.where(only).select(*[F.col(c).alias(f"t_{c}") for c in of]).distinct()
            rows = rows.join(touched, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in of], "left_semi")
        if big is None:
            return rows.withColumns({"block": F.lit(0).cast("long"), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
        rows = rows.join(big, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in of], "left").drop(*[f"b_{c}" for c in of])
        rows = rows.withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        # Blocks stand in a circle; the pairs of a round are so far apart in it.
        start = F.when(F.col("table") == first[0], first[1]).otherwise(0).cast("long")
        end = F.least(F.floor(F.col("blocks") / 2), F.when(F.col("table") == last[0], last[1]).otherwise(found.n).cast("long"))
        rows = rows.withColumn("apart", F.explode(F.when(start <= end, F.sequence(start, end))))
        others = F.array_distinct(F.array(F.pmod(F.col("block") + F.col("apart"), "blocks"), F.pmod(F.col("block") - F.col("apart"), "blocks")))
        rows = rows.withColumn("other", F.explode(others))
        return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("size", "blocks", "apart", "other")

    out = pa.schema([(name, {"long": pa.int64(), "double": pa.float64()}[kind]) for name, kind in map(str.split, schema.split(", "))])

    def compared(rows: DataFrame, least: float) -> DataFrame:
        def compare(x: pa.Table) -> pa.Table:
            i, j, table, low = x["i"][0].as_py(), x["j"][0].as_py(), x["table"][0].as_py(), least
            left = x.filter(pc.equal(x["block"], i))
            right = left if i == j else x.filter(pc.equal(x["block"], j))
            del x
            # Vectors stay in Arrow's flat form; only the plain columns become a frame.
            plain = [t.drop_columns(["vec", "keys"]).to_pandas() for t in (left, right)]
            if not left.num_rows or not right.num_rows:
                return out.empty_table()
            a, b = (_rows_of(t, "vec") for t in (left, right))
            ka, kb = (_rows_of(t, "keys") for t in (left, right)) if table else (None, None)
            # Pairs are reduced before they are many, so that those of a block are never held together.
            found, held, step = [out.empty_table()], [], max(1, min(len(a), SLICE_SCORES // len(b)))
            full = SLICE_SCORES if most is None else min(SLICE_SCORES, 10 * most)
            products, near = np.empty((step, len(b))), np.empty((step, len(b)), bool)
            for k in range(0, len(a), step):
                slice_of = a[k : k + step]
                scores = np.matmul(slice_of, b.T, out=products[: len(slice_of)]).ravel()
                # Rounding moves a score by half of a millionth at most.
                at = np.flatnonzero(np.greater_equal(scores, low - 1e-6, out=near[: len(slice_of)].ravel()))
                p, q = np.divmod(at, len(b))
                s, p = scores[at].round(6), p + k
                keep = (s >= low) & (p < q) if i == j else s >= low
                p, q, s = p[keep], q[keep], s[keep]
                if table and len(p):
                    new = np.concatenate([~(ka[p[m : m + 100_000]] == kb[q[m : m + 100_000]]).any(1) for m in range(0, len(p), 100_000)])
                    p, q, s = p[new], q[new], s[new]
                held.append((p, q, s))
                if sum(len(h[0]) for h in held) >= full or k + step >= len(a):
                    best = reduce(*plain, *map(np.concatenate, zip(*held, strict=True)))
                    found.append(pa.Table.from_pandas(best, out, preserve_index=False))
                    held = []
                    if most is not None and len(best) >= most:
                        low = max(low, best["score"].min())
            return pa.concat_tables(found)

        return rows.groupBy(*of, "i", "j").applyInArrow(compare, schema)

    if len(rounds) == 1:
        return compared(copies(*rounds[0]), threshold)
    tables_of: list[DataFrame] = []
    for k, of_round in enumerate(rounds):
        x = compared(copies(*of_round), threshold)
        if again is None:
            tables_of.append(written(x, "pairs"))
            continue
        x = written(again(functools.reduce(DataFrame.unionByName, [*tables_of, x])), "pairs")
        discard(*tables_of)
        tables_of = [x]
        if most is not None and k + 1 < len(rounds):
            so_far = x.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
            threshold = max(threshold, so_far.least) if so_far.n >= most else threshold
    discard(big)
    return functools.reduce(DataFrame.unionByName, tables_of)


def _rounds(n: int, tables: int, big: DataFrame) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The first and last (table, distance of blocks) of each round, which has about ``ROUND_COPIES`` copies of each of ``n`` vectors.

    ``big``: table, size and blocks of the buckets of several blocks; what comes to the driver is a number for each table and distance.
    """
    apart = F.col("apart")
    once = (apart == 0) | (apart * 2 == F.col("blocks"))
    x = big.select("table", "size", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("blocks") / 2))).alias("apart"))
    of_big = {(r.table, r.apart): r.n for r in x.groupBy("table", "apart").agg(F.sum(F.col("size") * F.when(once, 1).otherwise(2)).alias("n")).collect()}
    # All rows are in some bucket at distance 0.
    steps = sorted({**of_big, **{(t, 0): n for t in range(tables)}}.items())
    most, rounds, held = max(ROUND_ROWS, ROUND_COPIES * n), [], 0
    for at, k in steps:
        if not rounds or held + k > most:
            rounds.append((at, at))
            held = 0
        rounds[-1], held = (rounds[-1][0], at), held + k
    return rounds


def _rows_of(table: pa.Table, column: str) -> np.ndarray:
    """The lists of a column, all of one length, as the rows of a matrix."""
    flat = pc.list_flatten(table.column(column).combine_chunks()).to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _hashed(x: DataFrame, threshold: float, recall: float, exact: bool, bucket: int) -> DataFrame:
    """A written table of ``x`` with the keys of its vectors."""
    x = written(x, "vectors")
    found = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    planes, tables = (0, 1) if exact else hash_plan(found.n, threshold, recall, bucket)
    if not planes:
        return x.withColumn("keys", F.array(F.lit(0)))
    keyed = written(with_keys(x, planes, tables, found.dim or 1), "keyed")
    discard(x)
    return keyed


def _all_pairs_of(left: pd.DataFrame, right: pd.DataFrame, p: np.ndarray, q: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    a, b = left["id"].to_numpy()[p], right["id"].to_numpy()[q]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": s})


def similar_pairs(vectors: DataFrame, threshold: float, recall: float = RECALL, exact: bool = False, bucket: int | None = None) -> DataFrame:
    """(a, b, score) of the a < b whose inner product, to six places, reaches the threshold; of equal vectors the least id stands for all.

    ``vectors``: id, vec (unit vectors of one length; null ones are left out). ``equal_vectors`` has who stands for whom.
    """
    x = vectors.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")
    return in_buckets(_hashed(x, threshold, recall, exact, bucket), threshold, [], _all_pairs_of, "a long, b long, score double")


def equal_vectors(vectors: DataFrame) -> DataFrame:
    """(id, first) of the rows whose vector an earlier row has: the least id of that vector."""
    first = vectors.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = first.select(F.md5(F.to_json(F.struct("vec"))).alias("of"), "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("f_salt"))
    x = vectors.where("vec IS NOT NULL").select("id", F.md5(F.to_json(F.struct("vec"))).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int").alias("salt"))
    return x.join(salted, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("f_salt"))).where("id > first").select("id", "first")


def near_duplicates(vectors: DataFrame, threshold: float = 0.86, min_confidence: float = 0.6, n: int = 100, recall: float = RECALL, exact: bool = False, bucket: int | None = None) -> DataFrame:
    """The ``n`` most similar pairs (over the threshold) of different documents among rows that are sure enough: a, b, score.

    ``vectors``: id, vec, doc, confidence. Classes of equal vectors are compared; a task passes on its ``n`` best
    pairs of classes, by score and by the least pair of rows of different documents in them, and only those
    that are best of all are expanded to rows.
    """
    sure = vectors.where((F.col("confidence") >= min_confidence) & F.col("vec").isNotNull() & F.col("doc").isNotNull()).select("id", "vec", "doc")
    # The first row of a class, and the first of another document: Spark keeps two rows of a class before the shuffle.
    units = sure.groupBy("vec", "doc").agg(F.min("id").alias("id"))
    two = units.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where("r <= 2")
    classes = two.groupBy("vec").agg(F.max(F.when(F.col("r") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("r") == 1, F.col("doc"))).alias("doc"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("id"))), F.lit(_NONE)).alias("second"))

    def best(left: pd.DataFrame, right: pd.DataFrame, p: np.ndarray, q: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        c1, d1 = left["id"].to_numpy()[p], right["id"].to_numpy()[q]
        c2, d2 = left["second"].to_numpy()[p], right["second"].to_numpy()[q]
        apart = left["doc"].to_numpy()[p] != right["doc"].to_numpy()[q]
        lo, hi = np.minimum(c1, d1), np.maximum(c1, d1)
        # Where both first rows are of one document, one of them meets the other's first row of another document.
        lo1, hi1, lo2, hi2 = np.minimum(c1, d2), np.maximum(c1, d2), np.minimum(c2, d1), np.maximum(c2, d1)
        sooner = (lo1 < lo2) | (lo1 == lo2) & (hi1 <= hi2)
        lo, hi = np.where(apart, lo, np.where(sooner, lo1, lo2)), np.where(apart, hi, np.where(sooner, hi1, hi2))
        out = pd.DataFrame({"a_class": c1, "b_class": d1, "score": s, "lo": lo, "hi": hi})
        return out[out["hi"] < _NONE].sort_values(["score", "lo", "hi"], ascending=[False, True, True]).head(n)

    schema = "a_class long, b_class long, score double, lo long, hi long"
    keyed = _hashed(classes, threshold, recall, exact, bucket)
    first = lambda x: x.orderBy(F.desc("score"), "lo", "hi").limit(n)
    own = keyed.where(F.col("second") < _NONE).select(F.col("id").alias("a_class"), F.col("id").alias("b_class"), F.round(dot("vec", "vec"), 6).alias("score"), F.col("id").alias("lo"), F.col("second").alias("hi"))
    own = settled(first(own.where(F.col("score") > threshold)))
    so_far = own.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    links = in_buckets(keyed, so_far.least if so_far.n >= n else threshold, [], best, schema, again=first, most=n)
    links = settled(first(links.unionByName(own).where(F.col("score") > threshold)))
    # At most 2n classes; of each class and document no more than its n + 1 first rows can be in the n best pairs.
    wanted = links.select(F.explode(F.array("a_class", "b_class")).alias("w")).distinct()
    of = keyed.join(F.broadcast(wanted), F.col("id") == F.col("w")).select(F.col("vec").alias("c_vec"), F.col("id").alias("class"))
    rows = sure.join(F.broadcast(of), F.col("vec") == F.col("c_vec")).select("class", "id", "doc")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("class", "doc").orderBy("id"))).where(F.col("r") <= n + 1).drop("r")
    a, b = rows.toDF("ca", "a", "doc_a"), rows.toDF("cb", "b", "doc_b")
    x = links.join(a, F.col("a_class") == F.col("ca")).join(b, F.col("b_class") == F.col("cb"))
    x = x.where("doc_a <> doc_b AND (a_class <> b_class OR a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    return x.orderBy(F.desc("score"), "a", "b").limit(n)


def duplicate_parents(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL, exact: bool = False, bucket: int | None = None, since: int | None = None) -> DataFrame:
    """(id, parent): the first earlier question of the same paper over the threshold, else the most similar earlier one (ties to the smaller id).

    Order of arrival is the id, which is unique. ``vectors``: id, vec (unit), doc. Rows without a vector have no parent. Every task
    reduces to one row for each row of a bucket: the least id of its paper, or the best earlier one. Rows
    that repeat a vector take what its first row has found, as that is as near to all of them. With ``since``, only
    the rows from that id on are answered, and only buckets that they are in are compared.
    """
    # A class of vectors is as old as its first row, but its later rows need what that row finds, so the last one counts.
    late = None if since is None else F.col("last") >= since
    x = vectors.where("vec IS NOT NULL").select("id", "vec", "doc")

    def first(left: pd.DataFrame, right: pd.DataFrame, p: np.ndarray, q: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        a, b = left["id"].to_numpy()[p], right["id"].to_numpy()[q]
        out = pd.DataFrame({"id": np.maximum(a, b), "found": np.minimum(a, b)})
        return out.groupby("id", as_index=False)["found"].min()

    def best(left: pd.DataFrame, right: pd.DataFrame, p: np.ndarray, q: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        a, b = left["id"].to_numpy()[p], right["id"].to_numpy()[q]
        out = pd.DataFrame({"id": np.maximum(a, b), "found": np.minimum(a, b), "score": s})
        return out.sort_values(["score", "found"], ascending=[False, True]).drop_duplicates("id")

    # Within a paper: one row for each vector of a paper.
    units = _hashed(x.groupBy("vec", "doc").agg(F.min("id").alias("id"), F.max("id").alias("last")), threshold, recall, exact, bucket)
    least = lambda x: x.groupBy("id").agg(F.min("found").alias("found"))
    in_paper = least(in_buckets(units, threshold, ["doc"], first, "id long, found long", late, again=least))
    # Over all papers: one row for each vector.
    classes = units.groupBy("vec", "keys").agg(F.min("id").alias("id"), F.max("last").alias("last"))
    one = lambda x: x.groupBy("id").agg(F.min_by("found", F.struct(-F.col("score"), F.col("found"))).alias("found"), F.max("score").alias("score"))
    nearest = one(in_buckets(classes, threshold, [], best, "id long, found long, score double", late, again=one))
    # A later row of a vector: its first row is an earlier one with the highest score there is, but others may be as near.
    again = equal_vectors(x.select(F.struct("vec", "doc").alias("vec"), "id")).select("id", F.col("first").alias("of"))
    of_unit = again.join(in_paper.toDF("u", "before"), F.col("of") == F.col("u"), "left").select("id", F.coalesce("before", "of").alias("found"))
    in_paper = in_paper.unionByName(of_unit)
    self_score = classes.select(F.col("id").alias("c"), F.round(dot("vec", "vec"), 6).alias("own"))
    repeated = equal_vectors(x.select("vec", "id")).select("id", F.col("first").alias("of"))
    near = nearest.join(self_score, F.col("id") == F.col("c")).where("score >= own").select(F.col("id").alias("n_id"), F.col("found").alias("n_found"))
    of_class = repeated.join(near, F.col("of") == F.col("n_id"), "left").select("id", F.coalesce("n_found", "of").alias("found"))
    nearest = nearest.select("id", "found").unionByName(of_class)
    out = vectors.select("id") if since is None else vectors.select("id").where(F.col("id") >= since)
    out = out.join(in_paper.toDF("p_id", "in_paper"), F.col("id") == F.col("p_id"), "left")
    return out.join(nearest.toDF("b_id", "best"), F.col("id") == F.col("b_id"), "left").select("id", F.coalesce("in_paper", "best").alias("parent"))


def groups(parents: DataFrame) -> DataFrame:
    """(id, group_id): the root of each row in the forest of (id, parent), by pointer doubling.

    The rounds grow with the logarithm of the longest chain. Each ends in a checkpoint in the shared folder.
    """
    x = settled(parents.select("id", F.coalesce("parent", "id").alias("up")))
    while True:
        y = x.select(F.col("id").alias("u"), F.col("up").alias("v"))
        x = settled(x.join(y, F.col("up") == F.col("u"), "left").select("id", F.coalesce("v", "up").alias("next"), (F.coalesce("v", "up") != F.col("up")).alias("moved")))
        done = x.where("moved").isEmpty()
        x = x.select("id", F.col("next").alias("up"))
        if done:
            return x.select("id", F.col("up").alias("group_id"))


def extend_groups(old: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, group_id) of newly arrived rows: a parent that has a group passes it on, the others are resolved among themselves.

    ``old``: id, group_id of all rows before; ``parents``: id, parent of the new ones. Old rows never change, as
    parents come before their children; chains within the batch are doubled, then take their root's group.
    """
    known = old.select(F.col("id").alias("o_id"), F.col("group_id").alias("o_group"))
    x = settled(parents.join(known, F.col("parent") == F.col("o_id"), "left").select("id", "parent", "o_group"))
    roots = groups(x.select("id", F.when(F.col("o_group").isNull(), F.col("parent")).alias("parent")))
    given = x.where("o_group IS NOT NULL").select(F.col("id").alias("g_id"), "o_group")
    return roots.join(given, F.col("group_id") == F.col("g_id"), "left").select("id", F.coalesce("o_group", "group_id").alias("group_id"))


def arrive(stored: DataFrame | None, batch: DataFrame, threshold: float = 0.9, recall: float = RECALL, exact: bool = False, bucket: int | None = None) -> DataFrame:
    """The batch (id, vec, doc; ids above all stored ones) with its ``group_id``, from the ``stored`` rows (the same, with theirs).

    Only buckets with new vectors are compared, and only new rows get groups, so batch after batch
    ends as all at once.
    """
    columns = ["id", "vec", "doc"]
    if stored is None:
        return batch.join(groups(duplicate_parents(batch, threshold, recall, exact, bucket)), "id").select(*columns, "group_id")
    since = batch.agg(F.min("id")).first()[0]
    if since is None:
        return stored.limit(0)
    both = stored.select(*columns).unionByName(batch.select(*columns))
    found = extend_groups(stored, duplicate_parents(both, threshold, recall, exact, bucket, since))
    return batch.join(found, "id").select(*columns, "group_id")


def nearest_topics(questions: DataFrame, vocabulary: DataFrame, k: int = 8, floor: float = 0.65, known_bonus: float = 0.03, most_topics: int = 5000) -> DataFrame:
    """(id, topic, score, place): the ``k`` topics nearest to each question, a little nearer if used in its course before.

    ``questions``: id, vec, course; ``vocabulary``: topic, t_vec, courses. The vocabulary is a controlled
    list, checked to be at most ``most_topics`` long, and is what is broadcast.
    """
    if vocabulary.limit(most_topics + 1).count() > most_topics:
        raise ValueError("the vocabulary is too long to be broadcast")
    x = questions.join(F.broadcast(vocabulary), F.lit(True))  # checked above
    x = x.select("id", "topic", F.round(dot("vec", "t_vec") + F.when(F.array_contains("courses", F.col("course")), known_bonus).otherwise(0.0), 6).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "topic")
    return x.where(F.col("score") >= floor).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def tags(candidates: DataFrame, least: float = 0.78, most: int = 3) -> DataFrame:
    """(id, tags): at most three sure topics of each question, nearest first."""
    x = candidates.where((F.col("score") >= least) & (F.col("place") <= most))
    return x.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "topic"))), lambda s: s["topic"].cast("string")), ",").alias("tags"))


def resolve_proposals(proposals: DataFrame, vocabulary: DataFrame, threshold: float = 0.9, most_topics: int = 5000) -> DataFrame:
    """(slug, topic, how): the topic of the same slug; else the nearest one over the threshold; else a new one.

    ``proposals``: slug, p_vec; ``vocabulary``: topic, t_vec (checked to be short, as above).
    """
    if vocabulary.limit(most_topics + 1).count() > most_topics:
        raise ValueError("the vocabulary is too long to be broadcast")
    same = vocabulary.select(F.col("topic").alias("same"))
    x = proposals.join(same, F.col("slug") == F.col("same"), "left")
    near = x.where("same IS NULL").join(F.broadcast(vocabulary), F.lit(True)).select("slug", "topic", F.round(dot("p_vec", "t_vec"), 6).alias("s")).where(F.col("s") >= threshold)
    near = near.groupBy(F.col("slug").alias("n_slug")).agg(F.max_by("topic", F.struct("s", "topic")).alias("near"))
    x = x.join(near, F.col("slug") == F.col("n_slug"), "left")
    return x.select("slug", F.coalesce("same", "near", "slug").alias("topic"), F.when(F.col("same").isNotNull(), "same").when(F.col("near").isNotNull(), "near").otherwise("new").alias("how"))


def link_titles(official: DataFrame, titles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(code, p_code, score): titles whose cosine, rounded to two places first, reaches the threshold and which share a distinctive word.

    ``official``: code, title, vec; ``titles``: p_code, p_title, p_vec. Every title meets every official one, as matrix products of blocks;
    the titles are compared in the task, so that only links leave it. Vectors that have no place in a matrix are taken one by one.
    """
    dim = titles.agg(F.mode(F.size("p_vec")).alias("dim")).first().dim
    dim = dim if (dim or 0) > 0 else 1
    o_fits, fits = regular("vec", dim), regular("p_vec", dim)
    o = official.where(o_fits).select("code", keywords(F.col("title")).alias("words"), "vec")
    t = titles.where(fits).select("p_code", squashed(F.col("p_title")).alias("squashed"), "p_vec")
    # Half a hundredth under the threshold is rounded up to it.
    x = in_products(o, t, "code", "p_code", "vec", "p_vec", LINK_BLOCK, linked(threshold - 0.005), "code long, p_code long, score double")
    x = x.withColumn("score", F.round("score", 2)).where(F.col("score") >= threshold)

    def one_by_one(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        shared = (F.col("code") != F.col("p_code")) & share_keyword(F.col("title"), F.col("p_title"))
        scored = lambda q: rows.join(F.broadcast(q), F.lit(True)).where(shared).select("code", "p_code", F.round(dot("vec", "p_vec"), 2).alias("score"))
        return lambda q: scored(q).where(F.col("score") >= threshold)

    for q, rows in ((official.where(~o_fits), titles), (official.where(o_fits), titles.where(~fits))):
        if not q.isEmpty() and not rows.isEmpty():
            x = x.unionByName(in_blocks(q, one_by_one(rows), "code"))
    return x
