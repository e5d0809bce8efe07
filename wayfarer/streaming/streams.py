"""Streams over append-only tables: latest status, rating roll-up, upserts and the search log.

Each function takes a streaming DataFrame and a folder shared by all executors, runs the micro-batches that are
available, and returns the result as a batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a table."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    single = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 64)
    return single.parquet(folder)


def _last(spark: SparkSession, folder: str, name: str) -> int | None:
    """Number of the newest finished table ``name-<number>`` below ``folder``; it outlives the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    numbers = [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found]
    return max(numbers, default=None)


def _drop(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


#: After so many batches the changes are folded into one table.
FOLD = 16


class ChangeLog:
    """A keyed table below a folder, written as the rows that each batch changes.

    A batch writes its changed rows and nothing else; of the rows of a key the one of the latest batch counts. Every
    ``FOLD`` batches the log is folded into one table. A batch that runs again writes the same table again, a folded
    table takes the place of what it holds only once it is whole, and all of it outlives the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str | T.StructType, fold: int = FOLD) -> None:
        self.spark, self.folder, self.keys, self.fold = spark, folder, keys, fold
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _numbers(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found)

    def write(self, batch: DataFrame, number: int) -> None:
        """The rows that batch ``number`` changes, one for each key."""
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/changes-{number}")
        if (number + 1) % self.fold == 0:
            self.read(number).write.mode("overwrite").parquet(f"{self.folder}/folded-{number}")
            for kind, last in (("changes", number), ("folded", number - 1)):
                for n in self._numbers(kind):
                    if n <= last - (self.fold if kind == "changes" else 0):  # readers of the table before may still hold the last ones
                        _drop(self.spark, f"{self.folder}/{kind}-{n}")

    def read(self, up_to: int | None = None) -> DataFrame:
        """The table after all finished batches."""
        known = lambda kind: [n for n in self._numbers(kind) if up_to is None or n <= up_to]
        start = max(known("folded"), default=None)
        parts = [("folded", start)] if start is not None else []
        parts += [("changes", n) for n in known("changes") if start is None or n > start]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        tables = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/{kind}-{n}").withColumn("_n", F.lit(n)) for kind, n in parts]
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = reduce(DataFrame.unionByName, tables).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_n").alias("_row"))
        return newest.select(*[c if c in self.keys else F.col("_row")[c].alias(c) for c in self.schema.names])


def _run(stream: DataFrame, log: ChangeLog, mode: str) -> DataFrame:
    """Run the batches that are available into a change log; the table is returned."""
    started = stream.writeStream.outputMode(mode).foreachBatch(log.write).option("checkpointLocation", f"{log.folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return log.read()


_HELD = "at long, status_id long, status string, expires long"
_STATUS = "place_id long, status_id long, status string, checked_at timestamp, expires_at timestamp, is_fresh boolean"


class NewestStatus(StatefulProcessor):
    """The newest event of a place, and a timer at its expiry.

    An event that isn't newer than the one held changes nothing. When the event time passes the expiry the place is
    reported once more, as stale, without any new event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("newest", _HELD)

    @staticmethod
    def _row(key: tuple, held: tuple, fresh: bool) -> pd.DataFrame:
        at, status_id, status, expires = held
        when = lambda us: pd.Series([pd.NaT if us is None else pd.Timestamp(us, unit="us")], dtype="datetime64[us]")
        return pd.DataFrame({"place_id": pd.Series(list(key), dtype="Int64"), "status_id": [status_id], "status": [status], "checked_at": when(at), "expires_at": when(expires), "is_fresh": [fresh]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        rank = lambda e: (e[0] is not None, e[0] or 0, e[1] is not None, e[1] or 0)
        old = self.held.get() if self.held.exists() else None
        best = tuple(old) if old else None
        for batch in rows:
            for at, status_id, status, expires in zip(batch["at"], batch["status_id"], batch["status"], batch["expires"], strict=True):
                event = (whole(at), whole(status_id), None if pd.isna(status) else str(status), whole(expires))
                if best is None or rank(event) > rank(best):
                    best = event
        if best is None or old is not None and best == tuple(old):
            return
        if old and old[3] is not None:
            self.handle.deleteTimer(_millis(old[3]))
        self.held.update(best)
        fresh = best[3] is not None and _millis(best[3]) > timerValues.getCurrentWatermarkInMs()
        if fresh:
            self.handle.registerTimer(_millis(best[3]))
        yield self._row(key, best, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, tuple(self.held.get()), False)

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def latest_status(events: DataFrame, folder: str, delay: str = "1 hour") -> DataFrame:
    """``place_id, status_id, status, checked_at, expires_at, is_fresh``: the newest status of each place.

    ``events`` has ``place_id, status_id, status, checked_at, expires_at``. Older events that arrive late change nothing,
    equal times go by ``status_id``, and a status is stale once the stream's time (its latest event less ``delay``) reaches
    its expiry, or if it has none. Events that come later than ``delay`` behind the stream are dropped. Only places that
    change are written. State lies in a store on disk, so it may outgrow memory.
    """
    spark = events.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        narrow = events.select("place_id", "status_id", "status", F.unix_micros(F.col("checked_at").cast("timestamp")).alias("at"), F.unix_micros(F.col("expires_at").cast("timestamp")).alias("expires"), F.col("checked_at").cast("timestamp").alias("event_time"))
        newest = narrow.withWatermark("event_time", delay).groupBy("place_id").transformWithStateInPandas(NewestStatus(), _STATUS, outputMode="Update", timeMode="EventTime")
        # A timer and a new event may both report a place in a batch: what was checked later counts, and of one event the expiry.
        rank = F.struct(F.col("checked_at").isNotNull().alias("t"), F.col("checked_at").alias("a"), F.col("status_id").alias("b"), (~F.col("is_fresh")).alias("c"))
        rest = ["status_id", "status", "checked_at", "expires_at", "is_fresh"]
        log = ChangeLog(spark, folder, ["place_id"], _STATUS)
        once = lambda batch: batch.groupBy("place_id").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("place_id", "r.*")
        started = newest.writeStream.outputMode("update").foreachBatch(lambda batch, n: log.write(once(batch), n)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        started.awaitTermination()
        return log.read()
    finally:
        spark.conf.set(provider, before)


#: Longer reviews are cut.
REVIEW_CHARS = 500


def accepted_ratings(ratings: DataFrame) -> DataFrame:
    """Whole ratings of one to five stars; reviews are trimmed and cut, blank ones become null. For tables and streams."""
    text = F.substring(F.trim("review"), 1, REVIEW_CHARS)
    return ratings.withColumns({"rating": F.col("rating").cast("int"), "review": F.when(text != "", text)}).where("rating BETWEEN 1 AND 5")


def rating_rollup(ratings: DataFrame, folder: str, delay: str = "7 days") -> DataFrame:
    """``place_id, n, rating, last_review``: number and mean of the accepted ratings of each place, and its latest review.

    ``ratings`` has ``rating_id, place_id, rating, review, rating_date``. A rating that is delivered again within ``delay``
    counts once, and what is remembered of deliveries goes with the watermark; ratings later than that are dropped. A
    batch writes only the places that it changes.
    """
    once = accepted_ratings(ratings).withWatermark("rating_date", delay).dropDuplicatesWithinWatermark(["rating_id"])
    said = F.when(F.col("review").isNotNull(), F.struct(F.col("rating_date").alias("a"), F.col("rating_id").alias("b")))
    summed = once.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("rating"), F.max_by("review", said).alias("last_review"))
    return _run(summed, ChangeLog(ratings.sparkSession, folder, ["place_id"], summed.schema), "update")


def upsert_last_seen(observed: DataFrame, keys: list[str], time: str, folder: str) -> DataFrame:
    """A snapshot of keys with the latest time they were seen; each micro-batch makes the next snapshot.

    Snapshots lie below ``folder`` by the number of their batch, so a restart goes on from the last one and a batch that
    runs twice writes the same snapshot; the one before is kept until the next is there.
    """
    spark = observed.sparkSession
    schema = observed.select(*keys, time).schema

    def merge(batch: DataFrame, number: int) -> None:
        both = batch.select(*keys, time)
        if number > 0:
            both = both.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{folder}/snapshot-{number - 1}"))
        both.groupBy(*keys).agg(F.max(time).alias(time)).write.mode("overwrite").parquet(f"{folder}/snapshot-{number}")
        _drop(batch.sparkSession, f"{folder}/snapshot-{number - 2}")

    query = observed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = _last(spark, folder, "snapshot")
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{folder}/snapshot-{last}")


def search_log(searches: DataFrame, folder: str) -> DataFrame:
    """Append search facts to a table."""
    query = searches.writeStream.format("parquet").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return searches.sparkSession.read.schema(searches.schema).parquet(f"{folder}/log")
