"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every operator here: space and U+0009 to U+000D.
WS = r"\x20\x09-\x0D"

BATCH_ROWS = 1000

_own_scratch: dict[str, str] = {}
#: Where the scratch tables of this driver are that it still holds.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: The folder that ``scratch_folder`` opened, if any.
_open: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset (a local test session)
    a temporary folder is made, once for each application.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="spark-paperloom-")
    return _own_scratch[app]


#: Settings that hold while a scratch table is written: shuffle files go once the table is there.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it ran, and what a task numbered
    or drew stays as it was written. ``discard`` removes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{_open.get() or scratch_dir(spark)}/paperloom-{name}-{uuid.uuid4().hex}"
    # Texts can be long: few of them to a batch bound what a Python worker holds.
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(rows))
    wanted = _WRITING | {rows: str(min(held, BATCH_ROWS) if held > 0 else BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that ``materialize`` returned and that no result is still to be read from."""
    for df in tables:
        path = _written.pop(df, None) if df is not None else None
        if path is not None:
            remove(df.sparkSession, path)


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` writes inside lies in one folder, which goes at the end: results must be written by then."""
    path = f"{scratch_dir(spark)}/paperloom-scratch-{uuid.uuid4().hex}"
    held = _open.set(path)
    try:
        yield
    finally:
        _open.reset(held)
        remove(spark, path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text of a document; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is then worked out once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def bind(df: DataFrame, name: str, value: str) -> DataFrame:
    """``df`` with the column ``name``, worked out exactly once a row.

    The value goes through a one-element explode: unlike a projection, the optimizer neither merges that
    into later expressions nor copies it into filters above, where a costly value would be worked out
    anew at each mention (inside a lambda, for each element).
    """
    return df.withColumn(name, F.explode(F.array(F.expr(value))))
