"""Writes, merges and corrections, as new snapshots of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.document_table import DocumentTable


def new_documents(batch: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """The batch with ``hash`` and ``duplicate``: known hashes, and all but the first of equal ones in the batch (ties by id)."""
    x = batch.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))
    known = stored.select(F.col("hash").alias("s_hash")).distinct()
    first = x.groupBy(F.col("hash").alias("f_hash")).agg(F.min("id").alias("first"))
    x = x.join(known, F.col("hash") == F.col("s_hash"), "left").join(first, F.col("hash") == F.col("f_hash"))
    return x.withColumn("duplicate", F.col("s_hash").isNotNull() | (F.col("id") != F.col("first"))).drop("s_hash", "f_hash", "first")


def replace_by_key(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table without any row of the keys in ``new``, and the new rows: writing twice changes nothing."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: the one with the highest version, new rows before old ones of the same version."""
    both = table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__new", "__r")


def insert_missing(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table and those new rows whose keys it does not have."""
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti"))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Each table without the rows of the documents in ``gone``."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def prunable(papers: DataFrame) -> DataFrame:
    """One row: how many stored files of ready papers could be fetched again, their bytes, and how many stay."""
    can = (F.col("status") == "ready") & F.col("stored") & F.coalesce(F.col("source_url").rlike("(?i)^https?://"), F.lit(False))
    return papers.agg(F.count_if(can).alias("n_files"), F.coalesce(F.sum(F.when(can, F.col("file_size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("stored") & ~can).alias("n_left"))


def find_or_create(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(parents, rows with their parent's id): one parent for each key, numbered by its values' hash, so that a retry gives the same ids."""
    pid = F.sha2(F.to_json(F.struct(*key)), 256)  # the names stand in it, so nulls do not shift
    parents = rows.select(*key).distinct().withColumn("paper_id", pid)
    return parents, rows.withColumn("paper_id", pid).drop(*key)


def merge_topic(questions: DataFrame, source: str, target: str) -> DataFrame:
    """Questions with one topic put in another's place: added if absent, the old one removed."""
    t = F.array_remove(F.array_union("topics", F.array(F.lit(target))), source)
    return questions.withColumn("topics", F.when(F.array_contains("topics", source), t).otherwise(F.col("topics")))


def merge_vocabulary(vocabulary: DataFrame, source: str, target: str) -> DataFrame:
    """The vocabulary after a merge: the source points to the target, which takes over its name and courses."""
    s = vocabulary.where(F.col("name") == source).select(F.col("course_codes").alias("s_codes")).withColumn("k", F.lit(target))
    x = vocabulary.join(s, F.col("name") == F.col("k"), "left")
    return x.select("name", F.when(F.col("name") == source, target).otherwise(F.col("merged_into")).alias("merged_into"), F.when(F.col("k").isNotNull(), F.array_sort(F.array_union("course_codes", F.coalesce("s_codes", F.array().cast("array<string>"))))).otherwise(F.col("course_codes")).alias("course_codes"), F.when(F.col("k").isNotNull(), F.array(F.lit(source))).otherwise(F.array().cast("array<string>")).alias("aliases"))


def approve(vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """Proposed, unmerged topics of the list become approved."""
    x = vocabulary.join(names.select(F.col("name").alias("n_name")).distinct(), F.col("name") == F.col("n_name"), "left")
    hit = F.col("n_name").isNotNull() & (F.col("status") == "proposed") & F.col("merged_into").isNull()
    return x.withColumn("status", F.when(hit, "approved").otherwise(F.col("status"))).drop("n_name")


def remember_courses(vocabulary: DataFrame, questions: DataFrame) -> DataFrame:
    """Topics with the codes of the courses that use them added."""
    used = questions.select(F.explode("topics").alias("t"), "course_code").where("course_code IS NOT NULL").groupBy("t").agg(F.collect_set("course_code").alias("u"))
    x = vocabulary.join(used, F.col("name") == F.col("t"), "left")
    return x.withColumn("course_codes", F.array_sort(F.array_union("course_codes", F.coalesce("u", F.array().cast("array<string>"))))).drop("t", "u")


def cascade_update(questions: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Questions with their papers' corrected metadata; only fields that a patch sets change. Keyed by document_id."""
    p = patches.select(F.col("document_id").alias("__d"), *[F.col(f).alias(f"__{f}") for f in fields])
    x = questions.join(p, F.col("document_id") == F.col("__d"), "left")
    return x.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop("__d", *[f"__{f}" for f in fields])


def reconcile_replies(choices: DataFrame, candidates: DataFrame, most: int = 3, most_new: int = 2) -> DataFrame:
    """question_id, tags, proposals: of the proposed labels of each question, those that are candidates (whatever their case), and a few new ones.

    ``choices``: question_id, labels (array, in order); ``candidates``: question_id, name.
    """
    squeezed = F.transform("labels", lambda raw, at: F.struct(at.alias("at"), F.trim(F.regexp_replace(raw, r"\s+", " ")).alias("label")))
    # A question's labels and candidates meet in one group: they are shuffled once, a row for all labels of a question.
    x = choices.select("question_id", squeezed.alias("labels"), F.lit(None).cast("string").alias("name"))
    c = candidates.where("question_id IS NOT NULL").select("question_id", F.lit(None).cast(x.schema["labels"].dataType).alias("labels"), "name")
    x = x.unionByName(c).groupBy("question_id").agg(F.flatten(F.collect_list("labels")).alias("labels"), F.collect_list("name").alias("names")).where(F.size("labels") > 0)
    same = lambda l: lambda name: F.lower(l["label"]) == F.lower(name)
    named = F.flatten(F.transform("labels", lambda l: F.transform(F.filter("names", same(l)), lambda name: F.struct(l["at"].alias("at"), name.alias("v")))))
    new = F.filter("labels", lambda l: F.length(l["label"]).between(3, 60) & ~F.exists("names", same(l)))
    pick = lambda found, value, n: F.slice(F.array_distinct(F.transform(F.array_sort(found), lambda s: s[value])), 1, n)
    return x.select("question_id", pick(named, "v", most).alias("tags"), pick(new, "label", most_new).alias("proposals"))


def unanswered(questions: DataFrame, choices: DataFrame) -> DataFrame:
    return questions.select("question_id").join(choices.select("question_id"), "question_id", "left_anti")


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, unit, topic) between two syllabus versions, each with unit and topic: added, removed, kept, new-unit."""
    o, n = old.select("unit", "topic").distinct(), new.select("unit", "topic").distinct()
    what = lambda df, name: df.select(F.lit(name).alias("change"), "unit", "topic")
    added = n.join(o.select("topic").distinct(), "topic", "left_anti")
    removed = o.join(n.select("topic").distinct(), "topic", "left_anti")
    kept = n.join(o.select("topic").distinct(), "topic", "left_semi")
    units = n.select("unit").distinct().join(o.select("unit").distinct(), "unit", "left_anti").withColumn("topic", F.lit(None).cast("string"))
    return what(added, "added").unionByName(what(removed, "removed")).unionByName(what(kept, "kept")).unionByName(what(units, "new-unit"))


def question_key(question: Column, *filters: Column) -> Column:
    """One key for a question and its slice: case, spacing and closing marks don't count."""
    q = F.trim(F.regexp_replace(F.lower(F.regexp_replace(question, r"\s+", " ")), r"[?.!\s]+$", ""))
    return F.sha2(F.to_json(F.struct(q.alias("q"), *filters)), 256)


def retag(table: DocumentTable, papers: DataFrame, tag: Callable[[DataFrame], DataFrame], epoch: int, codes: list[str] | None = None, only_untagged: bool = False, in_place: bool = False) -> DataFrame:
    """Tag the questions of ingested papers anew, without repeating anything else; document_id, n_questions, n_changed of each paper done.

    ``table`` holds question_id, document_id, topics and more; ``papers``: document_id, status, course_code. The papers are
    those that are ready or in review, of the chosen ``codes`` (all, if none are named), with any question without
    topics where ``only_untagged``. ``tag`` takes their questions and returns question_id and topics; a question
    that it leaves out has no topics then. With ``in_place`` it returns their whole rows, each once, with new or NULL topics, and
    they are not joined with themselves. Only the rows of these papers are written, as batch ``epoch``; the state
    before that batch is what is read, so a job that is run again, whole or after a failure, ends the same.
    """
    before = table.read(before=epoch)
    chosen = papers.where(F.col("status").isin("ready", "needs_review")).select("document_id", "course_code")
    if codes:
        chosen = chosen.where(F.col("course_code").isin(codes))
    chosen = chosen.select("document_id").distinct()
    if only_untagged:
        untagged = before.where(F.coalesce(F.size("topics"), F.lit(0)) < 1).select("document_id")
        chosen = chosen.join(untagged, "document_id", "left_semi")
    mine = table.read(before=epoch, of=chosen.where("document_id IS NOT NULL"))
    if in_place:
        done = tag(mine).withColumn("__t", F.col("topics"))
    else:
        fresh = tag(mine).select(F.col("question_id").alias("__q"), F.col("topics").alias("__t"))
        done = mine.join(fresh, F.col("question_id") == F.col("__q"), "left")
    now = F.coalesce("__t", F.array().cast("array<string>"))
    table.merge(done.withColumn("topics", now).select(*before.columns), epoch, dealt=False)
    was = mine.select(F.col("question_id").alias("__q"), F.col("topics").alias("__t"))
    written = table.read().join(chosen, "document_id", "left_semi").join(was, F.col("question_id") == F.col("__q"))
    return written.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(~F.col("topics").eqNullSafe(F.col("__t"))).alias("n_changed"))
