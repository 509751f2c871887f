"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, materialize


def _jump(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent a root. Parents are never larger than their nodes, so the paths end."""
    held = parents
    while True:
        up = parents.select(F.col("node").alias("u"), F.col("parent").alias("v"))
        moved = parents.join(up, F.col("parent") == F.col("u"), "left").select("node", F.coalesce("v", "parent").alias("next"), (F.coalesce("v", "parent") != F.col("parent")).alias("moved"))
        moved = materialize(moved, "jump")
        discard(held)
        held, parents = moved, moved.select("node", F.col("next").alias("parent"))
        if moved.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Each round hooks every root to its smallest neighbour, shortens the paths by doubling and contracts
    the links to the roots, until no link is left. Every round is a written table; nothing is collected.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("parent")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("parent")))
        roots = _jump(materialize(both.groupBy("node").agg(F.min("parent").alias("parent")), "hook"))
        if found is None:
            found = roots
        else:
            r = roots.select(F.col("node").alias("r"), F.col("parent").alias("p"))
            found = materialize(found.join(r, F.col("parent") == F.col("r"), "left").select("node", F.coalesce("p", "parent").alias("parent")), "found")
        ra = roots.select(F.col("node").alias("na"), F.col("parent").alias("pa"))
        rb = roots.select(F.col("node").alias("nb"), F.col("parent").alias("pb"))
        e = edges.join(ra, F.col("a") == F.col("na")).join(rb, F.col("b") == F.col("nb")).where("pa <> pb")
        last, edges = edges, materialize(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(last)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("parent").alias("component"))
