"""A table whose rows are replaced by document, batch by batch, for streams and re-runs.

    rows/epoch=E    rows of the documents of batch E, dealt by document into ``buckets`` files at most (or a file for each task that had them)
    keys/epoch=E    ids of all documents of batch E, those without rows too
    base/epoch=E    all rows that were alive after batch E
    done/*          empty folders: which of these are whole (``batch-E``, ``base-E``)

Only what is marked in ``done`` is read. Of a document, the rows of its latest batch count. A batch that comes again
overwrites its own folders, so writing it twice changes nothing. Every ``compact_after`` batches
the rows alive become a new base, and the batches before the last base but one go, so the number of
files is bounded by ``buckets`` and ``compact_after``, whatever the number of documents. A batch that is not ``dealt`` is
spared a shuffle and has as many files as tasks. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are sent to all tasks, some 50 bytes each; more are joined.
BROADCAST_KEYS = 200_000


class DocumentTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", buckets: int = 8, compact_after: int = 8) -> None:
        self.spark, self.path, self.key, self.buckets, self.compact_after = spark, path.rstrip("/"), key, buckets, compact_after
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda *parts: jvm.Path("/".join([self.path, *parts]))
        self._fs = self._at().getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _marked(self, kind: str) -> list[int]:
        return sorted(int(n.split("-")[1]) for n in self._names("done") if n.startswith(f"{kind}-"))

    def _state(self, before: int | None) -> tuple[int | None, list[int]]:
        """The base to read and the batches after it."""
        bases = [e for e in self._marked("base") if before is None or e < before]
        base = bases[-1] if bases else None
        return base, [e for e in self._marked("batch") if (base is None or e > base) and (before is None or e < before)]

    def _write(self, df: DataFrame, folder: str, epoch: int, dealt: bool = True) -> None:
        (df.repartition(self.buckets, self.key) if dealt else df).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{folder}/epoch={epoch}")

    def merge(self, rows: DataFrame, epoch: int, documents: DataFrame | None = None, dealt: bool = True) -> None:
        """Put ``rows`` in the place of all rows of their documents, and of those in ``documents`` that have no rows any more.

        Epochs ascend. One that is in a base already has been merged before, and is left alone. Large batches need not be ``dealt``.
        """
        bases = self._marked("base")
        if bases and epoch <= bases[-1]:
            return
        self._fs.delete(self._at("done", f"batch-{epoch}"), True)
        self._write(rows, "rows", epoch, dealt)
        mine = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/epoch={epoch}").select(self.key)
        if documents is not None:
            mine = mine.unionByName(documents.select(self.key))
        self._write(mine.distinct(), "keys", epoch)
        self._fs.mkdirs(self._at("done", f"batch-{epoch}"))
        if len(self._state(None)[1]) >= self.compact_after:
            self.compact()

    def _parts(self, folder: str, epochs: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{folder}").parquet(*[f"{self.path}/{folder}/epoch={e}" for e in epochs])

    def read(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame | None:
        """The rows alive (before a batch, if one is named; of the documents in ``of`` alone, if given), or None while nothing has been merged."""
        base, batches = self._state(before)
        k = F.col(self.key)
        # Joins by the same keys in the same form: the rows are shuffled once for all of them.
        wanted = (lambda x: x) if of is None else lambda x: x.join(of.select(k.alias("__of")), k.eqNullSafe(F.col("__of")), "left_semi")
        old = wanted(self.spark.read.parquet(f"{self.path}/base/epoch={base}")) if base is not None else None
        if not batches:
            return old
        latest = self._parts("keys", batches).groupBy(k.alias("__k")).agg(F.max("epoch").alias("__e"), F.count(F.lit(1)).alias("__n"))
        again = self._small(latest.where("__n > 1"))
        new = wanted(self._parts("rows", batches))
        # Of a document that came more than once, the rows of earlier batches go; most came once.
        new = new.join(again, k.eqNullSafe(F.col("__k")) & (F.col("epoch") < F.col("__e")), "left_anti").drop("epoch")
        return new if old is None else old.join(self._small(latest), k.eqNullSafe(F.col("__k")), "left_anti").unionByName(new)

    def _small(self, keys: DataFrame) -> DataFrame:
        """Keys to be joined; broadcast if they are few, so that the rows need no shuffle."""
        return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys

    def compact(self) -> None:
        """Write the rows alive as a new base; what only older bases need goes."""
        base, batches = self._state(None)
        if not batches:
            return
        alive, epoch = self.read(), batches[-1]
        self._write(alive, "base", epoch)
        self._fs.mkdirs(self._at("done", f"base-{epoch}"))
        if base is None:
            return
        # Readers may still be at the last base and the batches after it.
        for e in [e for e in self._marked("batch") if e <= base]:
            for gone in (("done", f"batch-{e}"), ("rows", f"epoch={e}"), ("keys", f"epoch={e}")):
                self._fs.delete(self._at(*gone), True)
        for e in [e for e in self._marked("base") if e < base]:
            self._fs.delete(self._at("done", f"base-{e}"), True)
            self._fs.delete(self._at("base", f"epoch={e}"), True)
