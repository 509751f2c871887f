"""Line dedup by site-relative frequency.

For each host (the ``source`` of a document), the share of its pages that hold a line is worked out, and
lines above a boilerplate ratio are dropped from that host's pages. A line is what stands between two
``\\n``; lines without a word are left alone.

Only keys travel for the counts: (host, 128-bit hash of the line), each at most once a page, summed in
the map tasks before the shuffle, so a line that a third of all pages hold is a handful of partial sums.
The few lines over the ratio go back to the pages that hold them through a salted join, and a page's text
meets its own list of dropped hashes by document id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import bind, let, materialize

#: A line is boilerplate when more than this share of its host's pages hold it ...
MAX_RATIO = 0.05
#: ... and pages share it at all: a line of one page is never boilerplate, however few pages its host has.
MIN_PAGES = 2
_SALTS = 32

_WORDS_IN = r"length(btrim({l}, ' \t\n\u000b\f\r')) > 0"


def boilerplate_lines(lines: DataFrame, pages_of_host: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, pages, host_pages) of the lines over the ratio, from one row for each page and line."""
    counts = lines.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    # Salted, so that the lines of a hot host don't meet in one task.
    totals = pages_of_host.withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    counts = counts.withColumn("c_salt", F.pmod(F.xxhash64("line_hash"), F.lit(_SALTS)).cast("int"))
    both = counts.join(totals, counts.host.eqNullSafe(totals.of_host) & (F.col("c_salt") == F.col("h_salt")), "inner")
    return both.where(F.col("pages") > max_ratio * F.col("host_pages")).select("host", "line_hash", "pages", "host_pages")


def _deduped(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """The input with ``__pl_r``: the text that is left, the number of lines and of dropped lines."""
    x = docs.withColumns({"__pl_id": F.col(id_col), "__pl_text": F.coalesce(F.col(text_col).cast("string"), F.lit("")), "__pl_host": F.col(host_col).cast("string")})
    keys = x.select(F.col("__pl_id").alias("doc_id"), F.col("__pl_text").alias("text"), F.col("__pl_host").alias("host"))
    hashes = "transform(array_distinct(filter(split(text, '\\n'), l -> " + _WORDS_IN.format(l="l") + ")), l -> unhex(md5(l)))"
    lines = keys.select("doc_id", "host", F.explode(F.expr(hashes)).alias("line_hash"))
    hosts = keys.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).select(F.col("host").alias("of_host"), "host_pages")
    over = materialize(boilerplate_lines(lines, hosts, max_ratio, min_pages), "boilerplate")
    salted = over.select(F.col("host").alias("o_host"), F.col("line_hash").alias("o_hash"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("o_salt"))
    held = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
    hits = held.join(salted, F.col("host").eqNullSafe(F.col("o_host")) & (F.col("line_hash") == F.col("o_hash")) & (F.col("salt") == F.col("o_salt")), "inner")
    # A page can have no more distinct boilerplate lines than its host has: the mean lines of a page over the ratio.
    drop = hits.groupBy("doc_id", "host").agg(F.collect_set("line_hash").alias("__pl_gone")).select(F.col("doc_id").alias("__pl_hit"), F.col("host").alias("__pl_hit_host"), "__pl_gone")
    out = x.join(drop, F.col("__pl_id").eqNullSafe(F.col("__pl_hit")) & F.col("__pl_host").eqNullSafe(F.col("__pl_hit_host")), "left")
    kept = let("split(__pl_text, '\\n')", "a", let("filter(a, l -> NOT array_contains(__pl_gone, unhex(md5(l))))", "k", "struct(array_join(k, '\\n') AS text, CAST(size(a) AS BIGINT) AS n_lines, CAST(size(a) - size(k) AS BIGINT) AS n_dropped)"))
    same = "struct(__pl_text AS text, CAST(size(split(__pl_text, '\\n')) AS BIGINT) AS n_lines, 0L AS n_dropped)"
    return bind(out, "__pl_r", f"CASE WHEN __pl_gone IS NULL THEN {same} ELSE {kept} END")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each input row: doc_id, text (without dropped lines), n_lines, n_dropped.

    Null text counts as empty and comes back as an empty text; the rows of a null host are a host of
    their own; a page that repeats a line counts once for it, and all its copies are dropped together;
    repeated rows each count as a page and each come back; an empty table gives an empty result. A page
    of which nothing is left has an empty text.
    """
    x = docs.select(*{id_col: 0, text_col: 0, host_col: 0})
    return _deduped(x, id_col, text_col, host_col, max_ratio, min_pages).select(F.col("__pl_id").alias("doc_id"), "__pl_r.*")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents with their boilerplate lines gone; rows and other columns stay as they came."""
    x = _deduped(docs, id_col, text_col, host_col, max_ratio, min_pages)
    changed = F.when(F.col("__pl_r.n_dropped") > 0, F.col("__pl_r.text")).otherwise(F.col(f"`{text_col}`"))
    return x.select(*[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source AS host FROM documents),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
c AS (SELECT host, line, count(DISTINCT doc_id) AS pages FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY host, line),
h AS (SELECT host, count(*) AS host_pages FROM d GROUP BY host),
b AS (SELECT c.host, c.line FROM c JOIN h ON c.host IS NOT DISTINCT FROM h.host WHERE pages >= {MIN_PAGES} AND pages > {MAX_RATIO} * host_pages)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS text,
  count(*) AS n_lines, count(b.line) AS n_dropped
FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND l.line = b.line GROUP BY l.doc_id
"""
