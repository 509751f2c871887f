"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring at ``VNODES`` points. A key belongs to the first point clockwise from its
hash; if that shard is full, the key goes on clockwise to the next shard with room. Capacities sum to the
number of keys (one more for the first ``n % shards`` shards), so the counts are at most one apart, and a
key leaves its home only when the home is full.

Keys are placed in the order of their ring position. So what one arc of the ring (between two points)
sends on is known from the arcs' counts alone: at most ``shards * VNODES`` numbers, whatever the corpus
holds. The walk over them is done on those numbers; keys are ranked within their arc in tasks, and rank
and arc say the shard and the slot.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import materialize

SHARDS = 8
VNODES = 256
#: Positions are the first 40 bits of an MD5 hash.
_HEX = 10


def _position(name: str) -> int:
    import hashlib

    return int(hashlib.md5(name.encode()).hexdigest()[:_HEX], 16)


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of all points in clockwise order."""
    return sorted((_position(f"shard-{s}-{v}"), s) for s in range(shards) for v in range(vnodes))


def capacities(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Rows (arc, first rank, end rank, shard, first slot): where the keys of each arc go, arcs in ring order."""
    rows, used, room = [], [0] * len(room), list(room)
    for arc in sorted(counts):
        rank, at = 0, arc
        while rank < counts[arc]:
            shard = points[at % len(points)][1]
            k = min(counts[arc] - rank, room[shard])
            if k:
                rows.append((arc, rank, rank + k, shard, used[shard]))
                used[shard] += k
                room[shard] -= k
                rank += k
            at += 1
    return rows


def arc_of(points: list[tuple[int, int]], position: int) -> int:
    """The first point at or after a position; beyond the last it is the first one."""
    return bisect_left(points, (position, -1)) % len(points)


def shard_keys(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null), home_shard.

    Size is the UTF-8 bytes of the text (null: none) plus one. The key is the document id; a null id is
    a key of its own. Rows that share an id share a position and are told apart by their rank. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    x = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.conv(F.substring(F.md5(key), 1, _HEX), 16, 10).cast("long").alias("position"),
    )
    # The position's top bits point at the few arcs that it can be in; the table holds at most one row for each arc and bucket.
    bits = 28
    table = [(b, lo, hi, arc) for arc, lo, hi in _arcs(points) for b in range(lo >> bits, (hi >> bits) + 1)]
    arcs = spark.createDataFrame(table, "bucket long, lo long, hi long, arc int")
    x = x.join(F.broadcast(arcs), (F.shiftright("position", bits) == F.col("bucket")) & (F.col("position") >= F.col("lo")) & (F.col("position") <= F.col("hi")))
    x = materialize(x.select("doc_id", "size", "text_crc32", "position", "arc"), "keys")
    counts = {r.arc: r.n for r in x.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each arc at most
    rows = walk(points, counts, capacities(sum(counts.values()), shards))
    homes = [(arc, points[arc][1]) for arc in counts]
    placed = spark.createDataFrame(rows, "p_arc int, lo long, hi long, shard int, base long").join(spark.createDataFrame(homes, "h_arc int, home_shard int"), F.col("p_arc") == F.col("h_arc"))
    order = Window.partitionBy("arc").orderBy("position", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = x.withColumn("rank", F.row_number().over(order) - F.lit(1))
    out = ranked.join(F.broadcast(placed), (F.col("arc") == F.col("p_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


def _arcs(points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(arc, first position, last position); the first arc also has what lies beyond the last point."""
    out, before = [], -1
    for arc, (p, _) in enumerate(points):
        if p > before:
            out.append((arc, before + 1, p))
            before = p
    return [*out, *([(0, before + 1, 16**_HEX - 1)] if before < 16**_HEX - 1 else [])]
