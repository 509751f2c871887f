"""Documents with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd(spark):
    """Null, empty, blank, long, repeated and non-ASCII rows, nulls in every column."""
    return docs(
        spark,
        [
            (1, None),
            (2, ""),
            (3, " \t\n\x0b "),
            (4, "word"),
            (5, "alpha beta gamma delta " * 3000, None, None),
            (6, "\U0001f600 é token = 'abcdef123456' \U0001f600", "xx", "a"),
            (6, "\U0001f600 é token = 'abcdef123456' \U0001f600", "xx", "a"),
            (None, "one two three four five six", "de", "b"),
            (7, "line\nline\n\nline\r\nother \x1c word joined", "fr", "a"),
        ],
    )


def empty(spark):
    return spark.createDataFrame([], DOCS)


def crowded(df):
    """Extra columns whose names an operator could be using itself."""
    from pyspark.sql import functions as F

    names = "id row_id spans kept size shard pages host line_hash found owners n_words salt start length sequence_id component_id hub rank value".split()
    return df.select("*", *[F.lit("x").alias(n) for n in names])
