"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles. Documents link when the Jaccard similarity of their
sets is at least ``percent`` per cent.

1. Equal sets form classes (one aggregation by a 128-bit hash), and a class is one node from there on.
2. A linked set has at least ``percent`` per cent of its shingles in common with another class. So a class
   goes on only if at most the rest of its shingles are its alone; it is enough to count them in a fixed
   part of the shingle domain (``_part_of_domain``). Most documents of a mixed corpus end here, with their class.
3. Sizes are cut into bands so wide that a linked pair is in one band or in two neighbouring ones. For
   each pair of neighbouring bands the similarity bounds the number of differing shingles by some ``k``.
   The shingle domain is dealt by hash into ``n1`` first-level and each of these into ``n2`` second-level
   parts. At most ``k // (k2 + 1)`` first-level parts can hold more than ``k2`` differences, so any other
   one agrees on some ``n2 - k2`` of its second-level parts: a signature is the hash of what a set has in
   such a subset, and linked sets share one. ``spare`` additional first-level parts make so many agree
   that a set can leave out its smallest signatures (``_parts`` says how).
4. Documents that share a signature are candidates. In a few rounds every document is compared with a
   few hubs, those of the hubs of its signatures with which it shares most of them; what links is one
   component, and the hub of a signature is from the largest component there. So a group of near copies
   costs a comparison for each member, not for each pair.
5. Then every pair that shares a signature and lies in different components is a candidate still, so no
   link between components is missed. Of these go documents that share fewer signatures than any linked
   pair must, and pairs that two exact bounds rule out: with all
   shingles ordered by rarity, linked sets share one of their first few, and its places bound what they
   can have in common (prefix and position filter).
6. Candidates are checked exactly on the shingles of their whole texts.

Signatures only propose; false ones are thrown out by the check. Shingles are told apart by 64-bit hashes.
Nothing is grouped into one task: what is worked out for a signature or a shingle is a sum, least or
greatest value, taken in the map tasks first, and goes back to the rows by a join that AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import discard, materialize, slices
from paperloom.llm.components import components

WORDS = 4
PERCENT = 85
#: Words whose hash a worker remembers.
_CACHE_WORDS = 200_000
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _ODD[7]
    x = (x ^ (x >> _U(27))) * _ODD[6]
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are lower-cased, words are cut at ASCII white space."""
    if len(_words) > _CACHE_WORDS:
        _words.clear()
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    if len(w) < words:
        # The whole sequence is one shingle; its length keeps it apart from true ones.
        return np.unique(_mix((w * _ODD[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _U(len(w))))
    total = np.zeros(len(w) - words + 1, np.uint64)
    for i in range(words):
        total = _mix(total + w[i : len(w) - words + 1 + i] * _ODD[i % 8])
    return np.unique(total)


@lru_cache(None)
def bands(percent: int) -> list[int]:
    """Least sizes of the bands: a set is at least ``percent`` per cent as large as one it links with."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return out


def shape(largest: int, percent: int) -> tuple[int, int, int, int, int]:
    """(k, n1, n2, k2, spare) for sets of up to ``largest`` shingles."""
    k = (100 - percent) * 2 * largest // (100 + percent)
    if k <= 3:
        return k, 1, k + 3, k, 0
    least = k // 2 + 1
    spare = max(1, -(-least // 4))
    return k, least + spare, 3, 1, spare


def _parts(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The PartEnum signatures of a set for its own and the next pair of bands, and how many of them it must share with a set it links with.

    Linked sets agree on a subset in at least ``spare + 1`` first-level parts. A set leaves out the subsets
    smaller than the largest size for which at most ``spare // 2`` of its parts hold one that small. Take
    the one of two linked sets with the larger such size: in ``spare + 1 - spare // 2`` parts that agree all
    its subsets are of that size or more, and the same subset of the other set has the same shingles, so
    both give it.
    """
    edges, out, need = bands(percent), [], 1 << 30
    at = int(np.searchsorted(edges, len(s), "right")) - 1
    for pair in (at, at + 1):  # bands pair - 1 and pair
        k, n1, n2, k2, spare = shape(edges[pair + 1] - 1, percent)
        if k == 0:  # only equal sets link, and those are one class
            continue
        seed = _mix(np.array([pair + 1], np.uint64))[0]
        mixed = _mix(s ^ seed)
        part = (mixed % _U(n1 * n2)).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, part, _mix(mixed + seed))
        held = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        sums = sums.reshape(n1, n2)
        if k2 == 1:
            subset = sums.sum(axis=1, dtype=np.uint64, keepdims=True) - sums
            size = held.sum(axis=1, keepdims=True) - held
        else:
            left_out = [list(c) for c in combinations(range(n2), k2)]
            subset = np.stack([sums.sum(axis=1, dtype=np.uint64) - sums[:, c].sum(axis=1, dtype=np.uint64) for c in left_out], axis=1)
            size = np.stack([held.sum(axis=1) - held[:, c].sum(axis=1) for c in left_out], axis=1)
        name = _mix(np.arange(subset.size, dtype=np.uint64).reshape(subset.shape) + _mix(np.array([pair + 1], np.uint64) * _U(3)))
        sigs = _mix(subset + name)
        least = np.sort(size.min(axis=1))[spare // 2]
        out.append(sigs[size >= least])
        need = min(need, spare + 1 - spare // 2)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), need


def _part_of_domain(percent: int) -> int:
    """Shingles below this hash are counted: somewhat more of them than a linked set can have alone."""
    return min((1 << 64) - 1, int(1.6 * (100 - percent) / 100 * (1 << 64)))


def _hash(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


_SETS = "doc_id long, n_shingles long, hi long, lo long, counted array<long>"


def _sets(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Size and hash of each text's set, and its shingles in the part of the domain that is counted."""
    below = _U(_part_of_domain(percent))
    for batch in slices(batches):
        n, hi, lo, counted = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, words)
            h = _hash(s)
            n.append(len(s))
            hi.append(h[0])
            lo.append(h[1])
            counted.append(s[: np.searchsorted(s, below)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), _lists(counted)], names=["doc_id", "n_shingles", "hi", "lo", "counted"])


_SIGNED = "node long, n long, need int, shingles array<long>, sigs array<long>"


def _signed(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Shingles and signatures of the rows (node, hi, lo, text) whose text is that class's; one id can have texts of several classes."""
    for batch in slices(batches):
        nodes, need, sets, sigs = [], [], [], []
        for node, hi, lo, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = shingles(text, words)
            if _hash(s) == (hi, lo):
                signatures, least = _parts(s, percent)
                nodes.append(node)
                need.append(min(least, 1 << 30))
                sets.append(s)
                sigs.append(signatures)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(need, pa.int32()), _lists(sets), _lists(sigs)], names=["node", "n", "need", "shingles", "sigs"])


def _check(pairs: DataFrame, sets: DataFrame, percent: int, signatures_too: bool = False) -> DataFrame:
    """The pairs (a, b) that link, as a written table; ``signatures_too``: that they share one is still to be seen."""
    more = ["sigs"] if signatures_too else []
    ta = sets.select(F.col("node").alias("ia"), F.col("n").alias("na"), F.col("shingles").alias("sa"), *[F.col(c).alias("ga") for c in more])
    tb = sets.select(F.col("node").alias("ib"), F.col("n").alias("nb"), F.col("shingles").alias("sb"), *[F.col(c).alias("gb") for c in more])
    # Rows are still small where a hub meets its set, and the second join deals by the other document.
    x = pairs.join(ta, F.col("a") == F.col("ia")).join(tb, F.col("b") == F.col("ib"))
    if signatures_too:
        x = x.where(F.arrays_overlap("ga", "gb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return materialize(x.where((common > 0) & (100 * common >= percent * (F.col("na") + F.col("nb") - common))).select("a", "b"), "checked")


#: Hubs that a document is compared with in each round, and into how many kinds signatures are dealt, each of
#: which takes other hubs. The first round gathers most of a group; the later ones try further members for those
#: that are close to some of the group only.
HUB_ROUNDS = (1, 8, 8, 8)
#: Signatures that a document must share with a hub to be compared with it; fewer are most often chance.
HUB_SHARED = 2


def _mixed(shared: DataFrame, found: DataFrame | None, turn: int = 0) -> DataFrame:
    """(sig, node, n, comp, hub) of the signatures that nodes of several components share, as a written table.

    ``hub`` (node, n, comp) of a signature is a node of the largest component there: of the nodes that have the
    signature, the first in an order that changes with ``turn`` and the kind of signature.
    """
    if found is None:
        x = shared.select("sig", "node", "n", F.col("node").alias("comp"), F.lit(1).cast("long").alias("members"))
    else:
        sizes = found.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("members"))
        c = found.select(F.col("node").alias("found_node"), "component").join(sizes, F.col("component") == F.col("c"))
        x = shared.join(c, F.col("node") == F.col("found_node"), "left").select("sig", "node", "n", F.coalesce("component", "node").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"))
    order = F.xxhash64("node", F.pmod("sig", F.lit(HUB_ROUNDS[turn])), F.lit(turn))
    ends = x.groupBy(F.col("sig").alias("s")).agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.max(F.struct("members", "comp", order.alias("order"), "node", "n")).alias("h"))
    ends = ends.where("first <> last").select("s", F.struct("h.node", "h.n", "h.comp").alias("hub"))
    return materialize(x.join(ends, F.col("sig") == F.col("s")).select("sig", "node", "n", "comp", "hub"), "mixed")


def _hub_pairs(mixed: DataFrame, tested: DataFrame | None, percent: int, hubs: int) -> DataFrame:
    """(a, b): for each node b the ``hubs`` hubs a, not of its component and not met before, with which it shares most signatures."""
    alike = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    x = mixed.where((F.col("hub.comp") != F.col("comp")) & alike).groupBy(F.col("node").alias("b"), F.col("hub.node").alias("a")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HUB_SHARED)
    if tested is not None:
        x = x.join(tested.select(F.col("a").alias("ta"), F.col("b").alias("tb")), (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
    # A node has no more hubs than signatures.
    best = x.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.col("n").desc(), "a"))).where(F.col("place") <= hubs)
    return materialize(best.select("a", "b"), "hubs")


def _close_pairs(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) across components that pass the prefix and position filters."""
    shared = mixed.groupBy(F.col("node").alias("m"), "comp").agg(F.count(F.lit(1)).alias("shared"))
    held = sets.join(shared, (F.col("node") == F.col("m")) & (F.col("shared") >= F.col("need"))).select("node", "comp", "n", "shingles")
    held = materialize(held, "unsettled")
    tokens = held.select("node", "comp", "n", F.explode("shingles").alias("token"))
    counts = tokens.groupBy(F.col("token").alias("t")).agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last").select("t", "df")
    # Tokens of one component only stand first in the order and match nothing: a number says how many.
    # A document's list is no longer than the document.
    common = tokens.join(counts, F.col("token") == F.col("t")).groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ordered"))
    x = common.withColumn("alone", F.col("n") - F.size("ordered"))
    # Of n tokens a linked set has at least percent per cent: it has one of the first n - that + 1.
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - F.col("alone")).cast("int")
    x = x.where(prefix > 0).select("node", "comp", "n", "alone", F.posexplode(F.slice("ordered", F.lit(1), prefix)).alias("at", "o"))
    x = materialize(x.select("node", "comp", "n", (F.col("at") + F.col("alone")).alias("pos"), F.col("o.token").alias("token")), "prefixes")
    a, b = (x.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("pos").alias(f"p{k}"), F.col("comp").alias(f"c{k}"), F.col("token").alias(f"tok_{k}")) for k in "ab")
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    near = ((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = materialize(a.join(b, (F.col("tok_a") == F.col("tok_b")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near).select("a", "b").distinct(), "pairs")
    discard(held, x)
    return pairs


def _nodes(named: DataFrame, percent: int) -> DataFrame:
    """(node, hi, lo, first, may_link) of each class, as a written table: its smallest id, and whether so few of its shingles are its alone that it can link.

    A shingle is of one class alone if the least and the greatest of its classes' hashes are the same.
    """
    classes = named.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"))
    counted = named.select("hi", F.explode("counted").alias("token")).groupBy("token").agg(F.min("hi").alias("h"), F.max("hi").alias("other"))
    alone = counted.where("h = other").groupBy("h").agg(F.count(F.lit(1)).alias("alone"))
    x = classes.join(alone, F.col("hi") == F.col("h"), "left")
    may = 100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")
    return materialize(x.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "first", may.alias("may_link")), "nodes")


def _id_links(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between the nodes of each id that comes with texts of several classes."""
    again = named.groupBy(F.col("doc_id").alias("r")).agg(*[f(F.struct("hi", "lo")).alias(k) for f, k in ((F.min, "low"), (F.max, "high"))]).where("low <> high")
    mine = named.select("doc_id", "hi", "lo").join(again, F.col("doc_id") == F.col("r"), "left_semi").distinct()
    mine = materialize(mine.join(nodes.select(F.col("hi").alias("h"), F.col("lo").alias("l"), "node"), (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l"))).select("doc_id", "node"), "nodes_of_ids")
    least = mine.groupBy(F.col("doc_id").alias("d")).agg(F.min("node").alias("a"))
    return mine.join(least, F.col("doc_id") == F.col("d")).where("a <> node").select("a", F.col("node").alias("b"))


def _links(x: DataFrame, nodes: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): enough of the links between nodes that their components are right, ``known`` among them."""
    texts = x.join(nodes.where("may_link").select("node", "hi", "lo", "first"), F.col("doc_id") == F.col("first")).select("node", "hi", "lo", "text")
    # Rows that repeat an id and its text are one.
    signed = texts.mapInArrow(lambda it: _signed(it, words, percent), _SIGNED)
    sets = materialize(signed.dropDuplicates(["node"]), "signed")
    rows = sets.select("node", "n", F.explode("sigs").alias("sig"))
    several = rows.groupBy(F.col("sig").alias("s")).agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("s")
    shared = materialize(rows.join(several, F.col("sig") == F.col("s"), "left_semi"), "shared")
    links, found, tested = known, None if known.isEmpty() else components(known), None
    for turn, hubs in enumerate(HUB_ROUNDS):
        mixed = _mixed(shared, found, turn)
        pairs = _hub_pairs(mixed, tested, percent, hubs)
        discard(mixed)
        if pairs.isEmpty():
            break
        new = _check(pairs, sets, percent)
        tested = pairs if tested is None else tested.union(pairs)
        links = links.union(new)
        if not new.isEmpty():
            found = components(links)
    mixed = _mixed(shared, found)
    discard(shared)
    pairs = _close_pairs(mixed, sets, percent)
    links = links.union(_check(pairs, sets, percent, signatures_too=True))
    discard(mixed, pairs, sets)
    return links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links, its own included) of every row.

    Null, empty and blank texts have no shingles and link with nothing. A text of fewer words than a
    shingle is one shingle. Rows that share an id are one document, whose texts are all compared; rows
    with a null id link with nothing and have a null component. An empty table gives an empty result.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(x.mapInArrow(lambda it: _sets(it, words, percent), _SETS), "sets")
    named = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = _nodes(named, percent)
    rows = materialize(sets.drop("counted"), "rows")
    discard(sets)
    named = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    found = components(_links(x, nodes, _id_links(named, nodes), words, percent))
    # Back from nodes to rows; a component is named by the smallest id of its classes.
    at = nodes.join(found.select(F.col("node").alias("f"), "component"), F.col("node") == F.col("f"), "left").select("hi", "lo", "first", F.coalesce("component", "node").alias("comp"))
    least = at.groupBy(F.col("comp").alias("c")).agg(F.min("first").alias("named"))
    top = materialize(at.join(least, F.col("comp") == F.col("c")).select(F.col("hi").alias("h"), F.col("lo").alias("l"), "named"), "tops")
    discard(nodes)
    of_class = (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l"))
    # A blank text is of the component of the id's other texts.
    blank = rows.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    of_id = named.join(blank, "doc_id", "left_semi").join(top, of_class).groupBy(F.col("doc_id").alias("o")).agg(F.min("named").alias("of_id"))
    out = rows.join(top, of_class & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left").join(of_id, (F.col("doc_id") == F.col("o")) & (F.col("n_shingles") == 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("named", "of_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays, columns as they came.

    Of rows that share an id one stays, the one whose JSON has the smallest hash; rows without an id all stay.
    """
    c = ngram_components(docs, id_col, text_col, words, percent)
    gone = materialize(c.where("component_id <> doc_id").select(F.col("doc_id").alias("__pl_gone")).distinct(), "gone")
    left = docs.join(gone, F.col(id_col) == F.col("__pl_gone"), "left_anti")
    again = docs.groupBy(F.col(id_col).alias("__pl_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND __pl_again IS NOT NULL")
    again = materialize(again.select("__pl_again"), "again")
    if again.isEmpty():
        return left
    same = F.col(id_col) == F.col("__pl_again")
    row = F.struct(*[F.col(f"`{k}`") for k in docs.columns])
    # Summed in the map tasks, so an id on very many rows is one row of each of them.
    one = left.join(again, same, "left_semi").groupBy(id_col).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("__pl_row"))
    return left.join(again, same, "left_anti").unionByName(one.select("__pl_row.*"))
