"""Streams: documents as they arrive, request rates, and a running daily allowance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from paperloom.document_table import DocumentTable
from paperloom.functions.scalars import india_day


def pages_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Pages from Parquet files as they are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_copies(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """The stream without documents whose content came before within the watermark. ``pages`` has ts (timestamp) and text."""
    return pages.withColumn("hash", F.sha2("text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash"])


def ingest(pages: DataFrame, process: Callable[[DataFrame], DataFrame], target: DocumentTable, checkpoint: str) -> StreamingQuery:
    """Each batch is processed and merged into the target; a document that comes again replaces its earlier rows.

    ``process`` keeps the target's key. A batch that is repeated after a failure has the same number and
    replaces itself. A target belongs to one checkpoint, which numbers its batches.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        target.merge(process(batch), epoch, batch.select(target.key))

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _by_epoch(rows: DataFrame, target: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Each batch's rows under its number; a batch that is repeated overwrites its own."""
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RateLog:
    """The request-rate audit as a stream: key, start, n of each window.

    A window's row is written once, when the watermark has passed its end, and its state goes with it; so the state is the
    windows of the last ``delay``. Requests that come after that are *late*: they are in no window's row. What arrives is
    counted by window and batch beside it, without state, and what no row accounts for is the late count.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, window: str, delay: str) -> None:
        self.spark, self.path, self.key, self.window, self.delay = spark, path, key, window, delay
        self._schema = None

    def _counted(self, requests: DataFrame) -> DataFrame:
        g = requests.groupBy(F.window("ts", self.window).alias("w"), F.col(self.key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        return g.select("key", F.col("w.start").alias("start"), "n")

    def run(self, requests: DataFrame) -> None:
        """Take in all files that are there. ``requests``: a stream with ts (timestamp) and the key."""
        closed = self._counted(requests.withWatermark("ts", self.delay))
        self._schema = closed.schema
        for part in ("closed", "arrived"):  # so that a stream without any file can be read
            self.spark.createDataFrame([], self._schema).write.mode("overwrite").parquet(f"{self.path}/{part}/epoch=-1")
        _by_epoch(closed, f"{self.path}/closed", f"{self.path}/checkpoint", "append").awaitTermination()

        def arrived(batch: DataFrame, epoch: int) -> None:
            self._counted(batch).write.mode("overwrite").parquet(f"{self.path}/arrived/epoch={epoch}")

        requests.writeStream.foreachBatch(arrived).option("checkpointLocation", f"{self.path}/checkpoint-arrived").trigger(availableNow=True).start().awaitTermination()

    def closed(self) -> DataFrame:
        """The windows that are over."""
        return self._written("closed")

    def _written(self, part: str) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(f"{self.path}/{part}").drop("epoch")

    def open(self) -> DataFrame:
        """The windows that still have state."""
        if self._written("arrived").isEmpty():
            return self.spark.createDataFrame([], self._schema)
        state = self.spark.read.format("statestore").load(f"{self.path}/checkpoint")
        return state.select(F.col(f"key.{self.key}").alias("key"), F.col("key.window.start").alias("start"), F.col("value.count").alias("n"))

    def late(self) -> DataFrame:
        """key, start, n of the requests that came when their window was over."""
        arrived = self._written("arrived")
        known = self.closed().unionByName(self.open()).withColumn("n", -F.col("n"))
        return arrived.unionByName(known).groupBy("key", "start").agg(F.sum("n").alias("n")).where("n > 0")


class _Allowance(StatefulProcessor):
    """Counts the requests of one (user, day) and says which are within the cap."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.used.get()[0] if self.used.exists() else 0
        for batch in rows:
            batch = batch.sort_values(["ts", "request_id"])
            places = range(n + 1, n + 1 + len(batch))
            n += len(batch)
            yield pd.DataFrame({"user_id": [key[0]] * len(batch), "request_id": batch["request_id"].tolist(), "place": list(places), "ok": [p <= self.cap for p in places]})
        self.used.update((n,))

    def close(self) -> None:
        pass


def live_allowance(requests: DataFrame, cap: int = 20) -> DataFrame:
    """user_id, request_id, place, ok of each request as it comes; the state is one count for each (user, Indian day)."""
    x = requests.select("user_id", india_day(F.col("ts")).cast("string").alias("day"), "request_id", "ts")
    return x.groupBy("user_id", "day").transformWithStateInPandas(_Allowance(cap), outputStructType="user_id long, request_id long, place long, ok boolean", outputMode="Append", timeMode="None")
