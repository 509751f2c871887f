"""Products of two tables of vectors, block by block.

Where every vector of one table has to meet every one of another, both are dealt into blocks and each pair of blocks is one group
of a task: memory is bounded by the blocks, and scores come from matrix products. These only choose candidates; what leaves a
task was summed component by component, as ``retrieval.dot`` sums it, so results don't depend on the order of a matrix product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most rows that a block of the larger table has, the most components of a block, and how many rows of the other one are multiplied with it at a time.
BLOCK = 20_000
COMPONENTS = 8_000_000
SLICE = 256
#: Small tables are dealt into more blocks than they need, of so many rows at least, so that there are tasks enough.
TASKS, LEAST = 48, 1000
#: How far a matrix product may be from the sum in order, as a share of the product of the lengths.
_ERROR = 1e-12

#: From both sides of a pair of blocks (rows, vectors) to the rows that leave it.
Kernel = Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.Table]


def regular(vec: str, dim: int) -> Column:
    """Whether a vector has ``dim`` components, all of them finite. Not NULL."""
    whole = (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return pc.list_flatten(values).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def in_order(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows ``p`` of ``a`` with rows ``q`` of ``b``, summed from the first component on."""
    s = np.zeros(len(p))
    for x, y in zip(a.T, b.T, strict=True):
        s += x[p] * y[q]
    return s


def slack(a: np.ndarray, b: np.ndarray) -> float:
    return _ERROR * float(np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max()) if len(a) and len(b) else 0.0


def in_products(few: DataFrame, many: DataFrame, few_key: str, many_key: str, few_vec: str, many_vec: str, few_block: int, kernel: Kernel, schema: str) -> DataFrame:
    """``kernel`` over all pairs of a block of ``few`` (``few_block`` rows or about that) and one of ``many``. All vectors are ``regular``.

    A row of ``many`` is copied once for each block of ``few``, and the other way round, so the shuffle grows with rows times blocks.
    """
    n, m = few.count(), many.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(many_vec)).alias("dim")).first()
    dim = m.dim or 1
    few_blocks = max(1, -(-n // min(few_block, max(1, COMPONENTS // dim))))
    many_blocks = max(1, -(-m.n // min(BLOCK, max(1, COMPONENTS // dim))), min(-(-TASKS // few_blocks), m.n // LEAST))
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block_of = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    left = few.withColumn("few_block", block_of(few_key, few_blocks)).withColumn("many_block", all_of(many_blocks))
    right = many.withColumn("many_block", block_of(many_key, many_blocks)).withColumn("few_block", all_of(few_blocks))
    by = ["few_block", "many_block"]

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        return kernel(a, matrix(a, few_vec, dim), b, matrix(b, many_vec, dim))

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(multiply, schema)


def _numbers(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column as dense numbers (equal values, equal numbers; over both sides only if they are whole numbers) and where it is NULL."""
    x = table.column(column).combine_chunks()
    return pc.fill_null(x, 0).to_numpy(zero_copy_only=False), pc.is_null(x).to_numpy(zero_copy_only=False)


def nearest(k: int, apart: tuple[str, str] | None) -> Kernel:
    """Each query's ``k`` best rows of a block by score, ties to the smaller id, and whatever is so near to the ``k``-th that rounding to six places may put it first.

    Query columns: query_id, q_vec; row columns: id, vec; ``apart``: columns of whole numbers of both that have to differ.
    """

    def kernel(queries: pa.Table, a: np.ndarray, rows: pa.Table, b: np.ndarray) -> pa.Table:
        query_id, ids = queries.column("query_id").to_numpy(), rows.column("id").to_numpy()
        q_of, of = (_numbers(queries, apart[0]), _numbers(rows, apart[1])) if apart else (None, None)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(a) and len(b):
            # Of equal vectors (with one value of ``apart``) the k least ids are enough.
            key = np.column_stack([b, of[0], of[1]]) if apart else b
            key = np.ascontiguousarray(key).view(np.dtype((np.void, key.dtype.itemsize * key.shape[1]))).ravel()
            same = np.unique(key, return_inverse=True)[1]
            order = np.lexsort((ids, same))
            keep = np.sort(order[_place(same[order]) < k])
            b, ids = b[keep], ids[keep]
            of = (of[0][keep], of[1][keep]) if apart else None
            most, near = min(k, len(b)), 2e-6 + 2 * slack(a, b)
            for at in range(0, len(a), SLICE):
                s = a[at : at + SLICE] @ b.T
                if apart:
                    s[(q_of[0][at : at + SLICE, None] == of[0]) | q_of[1][at : at + SLICE, None] | of[1]] = -np.inf
                least = np.partition(s, len(b) - most, axis=1)[:, len(b) - most]
                p, q = np.nonzero((s >= least[:, None] - near) & (s > -np.inf))
                exact = in_order(a[at : at + SLICE], b, p, q)
                order = np.lexsort((ids[q], -exact, p))
                p, q, exact = p[order], q[order], exact[order]
                # Rows of one and the same score are in the order of their ids whatever it is rounded to.
                run = np.cumsum(np.concatenate([[0], (p[1:] != p[:-1]) | (exact[1:] != exact[:-1])])[: len(p)])
                keep = _place(run) < k
                found.append((query_id[p[keep] + at], ids[q[keep]], exact[keep]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return kernel


def _place(run: np.ndarray) -> np.ndarray:
    """The place, from 0, of each element in its run of equal ones."""
    first = np.concatenate([[True], run[1:] != run[:-1]])[: len(run)]
    at = np.arange(len(run))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(run) else at


def linked(threshold: float) -> Kernel:
    """(code, p_code, score) of the pairs of different codes whose score reaches the threshold and of which the second title holds a word of the first.

    Scores are not rounded, and those a little under the threshold stay in. Columns: code, words, vec; p_code, squashed, p_vec.
    """

    def kernel(official: pa.Table, a: np.ndarray, titles: pa.Table, b: np.ndarray) -> pa.Table:
        code, p_code = official.column("code").to_numpy(), titles.column("p_code").to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(a) and len(b):
            w_of, w = _dictionary([tuple(x or ()) for x in official.column("words").to_pylist()])
            t_of, t = _dictionary(titles.column("squashed").to_pylist())
            near = 1e-6 + slack(a, b)
            for at in range(0, len(a), SLICE):
                p, q = np.nonzero(a[at : at + SLICE] @ b.T >= threshold - near)
                p, q = (x[code[p + at] != p_code[q]] for x in (p, q))
                # Each pair of different titles is looked at once.
                pair, of = np.unique(w_of[p + at] * len(t) + t_of[q], return_inverse=True)
                share = np.fromiter((t[j] is not None and any(x in t[j] for x in w[i]) for i, j in zip(*divmod(pair, len(t)), strict=True)), bool, len(pair))
                p, q = p[share[of]], q[share[of]]
                found.append((code[p + at], p_code[q], in_order(a[at : at + SLICE], b, p, q)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table({"code": pa.array(columns[0], pa.int64()), "p_code": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return kernel


def _dictionary(values: list) -> tuple[np.ndarray, list]:
    """The number of each value, and the different values by number."""
    numbers: dict = {}
    return np.fromiter((numbers.setdefault(v, len(numbers)) for v in values), np.int64, len(values)), list(numbers)
