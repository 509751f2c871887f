"""Intermediate tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables are that ``written`` made and this driver still holds.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where none is set (a local session) a temporary one, set for the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = tempfile.mkdtemp(prefix="spark-paperloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the shared checkpoint folder, so later steps neither repeat it nor lose it with an executor.

    The cluster's ``spark.checkpoint.dir`` is used; only where none is set (a local session) a temporary folder is.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back: smaller than a checkpoint, and the planner knows its size.

    ``discard`` removes it when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/paperloom-{name}-{uuid.uuid4().hex}"
    # Shuffle files go once the table is there.
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` returned."""
    for df in tables:
        path = _paths.pop(df, None)
        if path is not None:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
