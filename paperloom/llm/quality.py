"""Quality rules by distribution divergence (native).

A document is compared with the reference of its language in two ways: the histogram of its character
classes and the histogram of its common words. The measure is the Jensen-Shannon distance (base 2, so 0
to 1). References are the mean histograms of all documents of the language that are long enough; each
document weighs the same, so one huge text can't bend them. Languages without a word list share the
reference ``other``, which has character classes only.

Length guards: divergence is judged only from ``MIN_WORDS`` words on, and only against a reference that
at least ``MIN_REFERENCE_DOCS`` documents made.

Common words are a small part of any text, so the word limit comes from the reference: it is
``WORD_SHARE`` of the distance of a text without any common word of the language. On the labels of
sf0.1 no good document of ``STEADY_WORDS`` words or more has over 0.73 of that distance, and none shorter
has over 0.92; a shorter text is therefore held to ``WORD_SHARE_SHORT``, which hardly more than a text
without common words exceeds. A reference with next to no common words (``MIN_COMMON_SHARE``) gives no
limit of its own.

Only DataFrame functions are used. The text is scanned twice (once for the references, once for the
verdict), nothing but five reference rows is shuffled, and those five rows are what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import bind, let

MIN_WORDS = 50
MIN_REFERENCE_DOCS = 20
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.70
WORD_SHARE = 0.80
WORD_SHARE_SHORT = 0.99
STEADY_WORDS = 100
MIN_COMMON_SHARE = 0.05

#: Sixteen frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "on", "was", "by", "this", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para"],
}
N_COMMON = 16
#: Character classes in the order of the histogram.
CLASSES = ["lower_or_other_letter", "upper", "digit", "space", "stop", "symbol"]
_SYMBOLS = r"#*$%&|<>"


def _quote(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_ALL_WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
_LANG = f"CASE WHEN __pl.lang IN ({_quote(sorted(COMMON_WORDS))}) THEN __pl.lang ELSE 'other' END"
_LIST = "CASE __q0.lang " + " ".join(f"WHEN '{k}' THEN array({_quote(v)})" for k, v in COMMON_WORDS.items()) + f" ELSE array_repeat('', {N_COMMON}) END"


def _kept_chars(pattern: str) -> str:
    return f"CAST(length(regexp_replace(__q0.text, '{pattern}', '')) AS BIGINT)"


def _with_histograms(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Adds ``__q0`` (text, language, words) and ``__q1`` (counts of classes and of common words)."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("__pl", F.struct(t.alias("text"), F.col(lang_col).cast("string").alias("lang")))
    bare = r"btrim(__pl.text, ' \t\n\u000b\f\r')"
    words = f"CASE WHEN length({bare}) = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE split({bare}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+') END"
    out = bind(out, "__q0", f"struct(__pl.text AS text, {_LANG} AS lang, {words} AS words)").drop("__pl")
    spaces = r"[^ \\t\\n\\x0B\\f\\r]+"
    common = f"concat(' ', lower(array_join(filter(__q0.words, w -> lower(w) IN ({_quote(_ALL_WORDS)})), '  ')), ' ')"
    counts = "transform({lst}, k -> CASE WHEN k = '' THEN 0L ELSE CAST((length(s) - length(replace(s, concat(' ', k, ' '), ''))) DIV (length(k) + 2) AS BIGINT) END)".format(lst=_LIST)
    return bind(
        out,
        "__q1",
        (
            "struct(CAST(length(__q0.text) AS BIGINT) AS n_chars, CAST(size(__q0.words) AS BIGINT) AS n_words, "
            f"{_kept_chars(spaces)} AS n_space, {_kept_chars('[^#*$%&|<>]+')} AS n_symbols, "
            + _kept_chars(r"\\P{Lu}+") + " AS n_upper, " + _kept_chars(r"[^0-9]+") + " AS n_digit, " + _kept_chars(r"[^.,;:!?]+") + " AS n_stop, "
            + let(common, "s", counts) + " AS common)"
        ),
    )


def _shares() -> tuple[str, str]:
    """SQL of the two histograms as shares that sum to one."""
    q = "__q1"
    rest = f"({q}.n_chars - {q}.n_upper - {q}.n_digit - {q}.n_space - {q}.n_stop - {q}.n_symbols)"
    n = f"CAST(greatest({q}.n_chars, 1) AS DOUBLE)"
    chars = f"transform(array({rest}, {q}.n_upper, {q}.n_digit, {q}.n_space, {q}.n_stop, {q}.n_symbols), c -> c / {n})"
    w = f"CAST(greatest({q}.n_words, aggregate({q}.common, 0L, (a, c) -> a + c), 1) AS DOUBLE)"
    words = let(f"transform({q}.common, c -> c / {w})", "h", "concat(h, array(1D - aggregate(h, 0D, (a, c) -> a + c)))")
    return chars, words


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each language: mean class and common-word histograms and the number of documents behind them.

    At most five rows come out (four word lists and ``other``), whatever the input holds.
    """
    chars, words = _shares()
    x = _with_histograms(docs, text_col, lang_col).where(F.col("__q1.n_words") >= min_words)
    x = x.select(F.col("__q0.lang").alias("ref_lang"), F.expr(chars).alias("c"), F.expr(words).alias("w"))
    # Rounded, so that the order of summing can't show in a verdict.
    mean = lambda col, i: F.round(F.avg(F.col(col)[i]), 9)
    return x.groupBy("ref_lang").agg(
        F.count(F.lit(1)).alias("ref_docs"),
        F.array(*[mean("c", i) for i in range(len(CLASSES))]).alias("ref_chars"),
        F.array(*[mean("w", i) for i in range(N_COMMON + 1)]).alias("ref_words"),
    )


def _js(p: str, q: str) -> str:
    """SQL of the Jensen-Shannon distance of two share arrays; null if either is null."""
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (x.p + x.q)) ELSE 0D END"
    return f"sqrt(greatest(0D, 0.5D * aggregate(zip_with({p}, {q}, (a, b) -> struct(a AS p, b AS q)), 0D, (s, x) -> s + {half('x.p')} + {half('x.q')})))"


def _own_limit() -> str:
    """SQL of the word distance from ``ref_words`` to a text without common words; null if the reference has next to none itself."""
    none = f"concat(array_repeat(0D, {N_COMMON}), array(1D))"
    return f"CASE WHEN 1D - element_at(ref_words, -1) >= {MIN_COMMON_SHARE}D THEN {_js(none, 'ref_words')} END"


def _repeat_words() -> str:
    """SQL: words inside 3-word windows that are found twice or more in the text."""
    hashes = "CASE WHEN size(__q0.words) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(__q0.words) - 3), i -> xxhash64(__q0.words[i], __q0.words[i + 1], __q0.words[i + 2])) END"
    again = "filter(s, (e, i) -> (i > 0 AND get(s, i - 1).h = e.h) OR coalesce(get(s, i + 1).h = e.h, false))"
    covered = "aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0L, (a, x) -> a + x)"
    ordered = let("sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))", "s", let(f"sort_array(transform({again}, e -> e.i))", "p", covered))
    return let(hashes, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {ordered} END")


def with_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", references: DataFrame | None = None, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, out_col: str = "__quality") -> DataFrame:
    """Every input row and column, with a struct ``out_col`` of the counts, distances and verdict.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept. Null text counts as empty (no words, so ``base_failed``); a null or unknown
    language is judged by the classes of ``other``; repeated rows each get their own verdict; an empty
    table gives an empty result. A distance is null where a length guard holds it back.
    """
    refs = language_references(docs, text_col, lang_col) if references is None else references
    chars, words = _shares()
    x = _with_histograms(docs, text_col, lang_col)
    refs = refs.select(*[F.col(c).alias(f"__{c}") for c in ("ref_lang", "ref_docs", "ref_chars", "ref_words")], F.expr(_own_limit()).alias("__ref_none"))
    x = x.join(F.broadcast(refs), F.col("__q0.lang") == F.col("__ref_lang"), "left")  # five rows at most
    lines = let("filter(split(__q0.text, '\\n'), l -> length(btrim(l, ' \\t\\n\\u000b\\f\\r')) > 0)", "l", "CAST(size(l) - size(array_distinct(l)) AS BIGINT)")
    x = bind(x, "__q2", f"struct({lines} AS n_dup_lines, {_repeat_words()} AS n_repeat_words)")
    judged = f"__q1.n_words >= {MIN_WORDS} AND __ref_docs >= {MIN_REFERENCE_DOCS}"
    x = bind(x, "__q3", f"struct(CASE WHEN {judged} THEN {_js(chars, '__ref_chars')} END AS c, CASE WHEN {judged} AND __q0.lang <> 'other' THEN {_js(words, '__ref_words')} END AS w)")
    # least() passes over a null.
    word_limit = f"least({max_word_distance}D, __ref_none * CASE WHEN __q1.n_words >= {STEADY_WORDS} THEN {WORD_SHARE}D ELSE {WORD_SHARE_SHORT}D END)"
    failed = f"(__q1.n_words < {MIN_WORDS} OR 100 * __q2.n_repeat_words > 50 * __q1.n_words)"
    x = bind(
        x,
        out_col,
        (
            "struct(__q1.n_words AS n_words, __q1.n_chars - __q1.n_space AS word_chars, __q1.n_symbols AS n_symbols, __q2.n_dup_lines AS n_dup_lines, __q2.n_repeat_words AS n_repeat_words, "
            f"{failed} AS base_failed, __q3.c AS char_distance, __q3.w AS word_distance, "
            f"NOT {failed} AND coalesce(__q3.c <= {max_char_distance}D, true) AND coalesce(__q3.w <= {word_limit}, true) AS kept)"
        ),
    )
    return x.drop("__q0", "__q1", "__q2", "__q3", "__ref_lang", "__ref_docs", "__ref_chars", "__ref_words", "__ref_none")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Counts, distances and verdict of each document, by id."""
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return with_quality(cols, **options).select("doc_id", "__quality.*")


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their columns as they came."""
    return with_quality(docs, **options).where("__quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
