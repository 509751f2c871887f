"""Secret scans by corpus-wide ownership frequency (native).

Candidates are found in each text by pattern. The hash of every candidate value is then aggregated over
the corpus by distinct repositories and distinct owners: a value that several owners hold, or two owners
in many repositories, is a widely copied example, a value that one owner holds and that looks random is a live-looking credential. Bare
tokens that no pattern of a named kind matches are reported (kind ``owned``) only where the frequency
says that they are owner-specific and they look live.

Only DataFrame functions are used. Texts are scanned once; what travels is the candidates. Counts are
summed in the map tasks, and the verdicts go back through a salted join, so that a value on a third of
all rows stays spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import let, materialize

#: The patterns of the named kinds, in order, with the group that is the value and its least length.
KINDS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]
#: Bare tokens: runs of 16 characters or more; ownership and looks decide on long ones too.
BARE = ("owned", r"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-]))", 1, 16)
#: A value with this many distinct owners or more is a widely copied example.
COPIED_OWNERS = 3
#: So is one of two owners that this many repositories hold.
COPIED_REPOSITORIES = 6
MIN_DISTINCT_CHARS = 8
PLACEHOLDER = r"(?i)example|sample|dummy|test|changeme|placeholder|your|x{4}|1234|abcd|0{6}"
_SALTS = 32
#: Code points to a block when spans are replaced.
_BLOCK = 4096


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str, join: str) -> str:
    """SQL: running totals of an array by doubling, so n elements cost n log n; ``join`` puts ``x`` and an earlier ``y`` together."""
    step = "transform(a, (x, i) -> CASE WHEN i >= shiftleft(1, k) THEN " + let("get(a, i - shiftleft(1, k))", "y", join) + " ELSE x END)"
    return f"aggregate(sequence(0, 30), {values}, (a, k) -> CASE WHEN shiftleft(1, k) < size(a) THEN {step} ELSE a END)"


def _below(values: str, limit: str) -> str:
    """SQL: how many elements of a sorted array are below ``limit``, by halving."""
    return f"aggregate(sequence(30, 0), 0, (lo, k) -> CASE WHEN lo + CAST(shiftleft(1, k) AS BIGINT) <= size({values}) AND get({values}, CAST(lo + shiftleft(1, k) - 1 AS INT)) < {limit} THEN CAST(lo + shiftleft(1, k) AS INT) ELSE lo END)"


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """SQL: the array of (start, end, rank, kind, value) of one kind; start and end count code points."""
    p = _sql(pattern)
    lengths = "transform(m, (x, i) -> CAST(length(get(pieces, i)) + length(x) AS BIGINT))"
    spans = f"transform(m, (x, i) -> struct(get(ends, i) - length(x) AS start, get(ends, i) AS end, {rank} AS rank, '{kind}' AS kind, get(v, i) AS value))"
    none = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, rank: INT, kind: STRING, value: STRING>>)"
    body = let(_running(lengths, "x + y"), "ends", f"filter({spans}, s -> length(s.value) >= {least})")
    bound = let(f"split(text, {p}, -1)", "pieces", let(f"regexp_extract_all(text, {p}, 0)", "m", let(f"regexp_extract_all(text, {p}, {group})", "v", body)))
    return f"CASE WHEN text RLIKE {p} THEN {bound} ELSE {none} END"


def _looks_live(value: str) -> str:
    return f"({value} RLIKE '[0-9]' AND {value} RLIKE '[A-Za-z]' AND size(array_distinct(split({value}, ''))) >= {MIN_DISTINCT_CHARS} AND NOT {value} RLIKE {_sql(PLACEHOLDER)})"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, owner, repo and the array ``found`` of candidate spans for each row, from one scan of the texts."""
    x = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(owner_col).cast("string").alias("owner"),
        F.to_json(F.struct(*[F.col(c) for c in repo_cols])).alias("repo"),
    )
    for i, (kind, pattern, group, least) in enumerate([*KINDS, BARE]):
        x = x.withColumn(kind, F.expr(_spans(kind, i, pattern, group, least)))
    named = "concat(" + ", ".join(k[0] for k in KINDS) + ")"
    # A bare token counts only where it looks live and no named span covers part of it: as many spans end before it as begin before its end.
    apart = f"{_below('starts', 'b.end')} = {_below('ends', 'b.start + 1')}"
    alone = let("sort_array(transform(n, s -> s.start))", "starts", let("sort_array(transform(n, s -> s.end))", "ends", f"filter(owned, b -> {_looks_live('b.value')} AND {apart})"))
    bare = let(named, "n", alone)
    return x.select("doc_id", "owner", "repo", F.expr(f"concat({named}, {bare})").alias("found"))


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, owners, repositories: over how many distinct owners and repositories each value is spread."""
    v = candidates.select("owner", "repo", F.explode("found").alias("c")).select("owner", "repo", F.unhex(F.sha2("c.value", 256)).alias("value_hash")).distinct()
    return v.groupBy("value_hash").agg(F.count_distinct(F.coalesce("owner", F.lit("\u0000"))).alias("owners"), F.count_distinct("repo").alias("repositories"))


def judge(candidates: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """row_id and ``spans`` (start, end, rank, kind, live, copied) of the rows of ``candidates`` that hold any.

    ``candidates`` must be a written table with a unique ``row_id``.
    """
    # Values that are not among the copied ones need no row here. The salt is part of the written table, so that its size is what Spark sees.
    widely = ownership(candidates).where((F.col("owners") >= copied_owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= COPIED_REPOSITORIES))).select(F.col("value_hash").alias("o_hash"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("o_salt"))
    spread = materialize(widely, "copied")
    each = candidates.select("row_id", F.explode("found").alias("c"))
    each = each.select("row_id", "c", F.unhex(F.sha2("c.value", 256)).alias("value_hash"), F.pmod(F.xxhash64("row_id"), F.lit(_SALTS)).cast("int").alias("salt"))
    known = each.join(spread, (F.col("value_hash") == F.col("o_hash")) & (F.col("salt") == F.col("o_salt")), "left")
    copied = F.col("o_hash").isNotNull()
    live = ~copied & F.expr(_looks_live("c.value"))
    known = known.where((F.col("c.kind") != BARE[0]) | ~copied)
    span = F.struct("c.start", "c.rank", "c.end", "c.kind", live.alias("live"), copied.alias("copied"))
    return known.groupBy("row_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan_secrets(docs: DataFrame, copied_owners: int = COPIED_OWNERS, **columns) -> DataFrame:
    """One row for each input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Null text counts as empty. A text of n matches costs n log n steps. A null owner counts as one owner of its own. Repeated rows each come back;
    copies by one owner are one owner. Base spans stay whatever the frequency says (``n_live`` and
    ``n_copied`` tell the verdicts); the method adds spans of kind ``owned``. An empty table gives an
    empty result.
    """
    # The ids are kept because the table is written before it is read twice.
    c = materialize(find_candidates(docs, **columns).withColumn("row_id", F.monotonically_increasing_id()), "secrets")
    some = c.where(F.size("found") > 0)
    judged = judge(some, copied_owners).withColumnRenamed("row_id", "j_id")
    out = c.select("row_id", "doc_id").join(judged, F.col("row_id") == F.col("j_id"), "left")
    spans = "coalesce(spans, CAST(array() AS ARRAY<STRUCT<start: BIGINT, rank: INT, end: BIGINT, kind: STRING, live: BOOLEAN, copied: BOOLEAN>>))"
    listed = "array_join(transform({a}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    n = lambda cond: F.expr(f"CAST(size(filter({spans}, s -> {cond})) AS BIGINT)")
    return out.select(
        "doc_id",
        *[n(f"s.kind = '{k[0]}'").alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(F.expr(listed.format(a=f"filter({spans}, s -> s.kind <> '{BARE[0]}')")), 256).alias("base_sha256"),
        F.expr(listed.format(a=spans)).alias("spans"),
        n("s.live").alias("n_live"),
        n("s.copied").alias("n_copied"),
    )


def _redacted(text: str) -> str:
    """SQL: ``text`` with marks in place of the spans ``__pl_s`` (sorted by start).

    Spans overlap as long as one begins before the farthest end so far. The text is cut into blocks, so that
    a stretch costs its own length, not the way to it from the start of the text.
    """
    first = "filter(sequence(0, size(__pl_s) - 1), i -> i = 0 OR get(__pl_s, i).start >= get(far, i - 1))"
    last = "(coalesce(get(f, g + 1), size(__pl_s)) - 1)"
    groups = f"transform(f, (i, g) -> struct(get(__pl_s, i).start AS start, get(far, {last}) AS end, get(open, {last}) > CASE WHEN i = 0 THEN 0 ELSE get(open, i - 1) END AS secret))"
    stretch = lambda a, b: f"substring(array_join(slice(blocks, CAST({a} DIV {_BLOCK} AS INT) + 1, CAST({b} DIV {_BLOCK} - {a} DIV {_BLOCK} AS INT) + 1), ''), CAST({a} % {_BLOCK} AS INT) + 1, CAST({b} - {a} AS INT))"
    before = let("CASE WHEN g = 0 THEN 0L ELSE get(groups, g - 1).end END", "p", stretch("p", "s.start"))
    marked = f"transform(groups, (s, g) -> concat({before}, CASE WHEN s.secret THEN '[SECRET]' ELSE '[EXAMPLE]' END))"
    tail = let("element_at(groups, -1).end", "p", stretch("p", f"CAST(length({text}) AS BIGINT)"))
    out = let(f"regexp_extract_all({text}, '(?s).{{1,{_BLOCK}}}', 0)", "blocks", f"concat(array_join({marked}, ''), {tail})")
    open_ = _running("transform(__pl_s, s -> CASE WHEN s.copied THEN 0 ELSE 1 END)", "x + y")
    return let(_running("transform(__pl_s, s -> s.end)", "greatest(x, y)"), "far", let(open_, "open", let(first, "f", let(groups, "groups", out))))


def redact_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """The documents with every reported span replaced: ``[SECRET]``, or ``[EXAMPLE]`` for a widely copied value.

    Columns and rows stay as they came; overlapping spans become one mark, the more serious one. Rows
    without a span keep their text, null included.
    """
    own = "__pl_row"
    held = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "texts")
    c = find_candidates(held.withColumnRenamed(own, "__pl_id"), id_col="__pl_id", text_col=text_col, owner_col=owner_col, repo_cols=repo_cols)
    some = materialize(c.where(F.size("found") > 0).withColumnRenamed("doc_id", "row_id"), "secrets")
    judged = judge(some, copied_owners).select(F.col("row_id").alias("__pl_j"), F.col("spans").alias("__pl_s"))
    x = held.join(judged, F.col(own) == F.col("__pl_j"), "left")
    t = f"`{text_col}`"
    x = x.withColumn(text_col, F.expr(f"CASE WHEN __pl_s IS NULL THEN {t} ELSE {_redacted(t)} END"))
    return x.select(*[F.col(f"`{k}`") for k in docs.columns])
