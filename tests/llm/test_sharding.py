import hashlib
import zlib

from paperloom.llm.sharding import arc_of, capacities, ring, shard_keys, walk
from tests.llm.helpers import crowded, docs, empty, odd


def brute(rows, shards, vnodes):
    """One key after the other, in ring order, each to the first shard clockwise with room."""
    points = ring(shards, vnodes)
    pos = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:10], 16)
    full = [(arc_of(points, pos(i)), pos(i), i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows]
    room, out, slots = capacities(len(rows), shards), [], [0] * shards
    for arc, _, real, i, crc, size in sorted(full):
        at = arc
        while not room[points[at % len(points)][1]]:
            at += 1
        s = points[at % len(points)][1]
        room[s] -= 1
        out.append((real, i, size, crc, s, slots[s]))
        slots[s] += 1
    return sorted(out)


def check(df, shards=8, vnodes=256):
    got = shard_keys(df, shards, vnodes).collect()
    want = brute([(r.doc_id, r.text) for r in df.collect()], shards, vnodes)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.slot) for r in got) == want
    n = [sum(x[4] == s for x in want) for s in range(shards)]
    assert max(n) - min(n) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    return got


def test_corpus(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sum(r.shard == r.home_shard for r in got) > 0.7 * len(got)  # only overflow moves


def test_odd_rows(spark):
    check(odd(spark), 3, 4)
    check(crowded(odd(spark)))
    assert shard_keys(empty(spark)).count() == 0
    check(docs(spark, [(1, "a")] * 5), 2, 3)


def test_walk_fills_every_shard():
    points = ring(4, 8)
    rows = walk(points, {0: 100, 5: 1, 31: 19}, capacities(120, 4))
    assert sum(hi - lo for _, lo, hi, _, _ in rows) == 120
    assert {s: sum(hi - lo for _, lo, hi, t, _ in rows if t == s) for s in range(4)} == dict.fromkeys(range(4), 30)
