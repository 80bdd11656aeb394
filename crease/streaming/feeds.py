"""Counters and marks of feeds, kept in the state store of a stream: what one run has counted, the next goes on from."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: One patch: marks that are null keep what is known, counts are added.
PATCHES = "feed string, etag string, last_modified string, imported long, failed long, at timestamp"
#: What the state and its rows hold; times are microseconds since 1970.
STATE = "etag string, etag_at long, last_modified string, modified_at long, imported long, failed long, last_us long"
ROWS = "feed string, etag string, last_modified string, imported long, failed long, last_us long, stale boolean"
#: The state store that this kind of state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FeedMarks(StatefulProcessor):
    """Per feed: summed counts, the newest non-null marks, and a timer that tells of a feed without patches for too long.

    A patch without a time is older than any with one; of marks of one time the one that sorts last counts, so the
    order in which patches come does not matter.
    """

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def _row(self, feed: str, known: tuple, stale: bool) -> Row:
        etag, _, modified, _, imported, failed, last = known
        return Row(feed=feed, etag=etag, last_modified=modified, imported=imported, failed=failed, last_us=last, stale=stale)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        etag, etag_at, modified, modified_at, imported, failed, last = self.known.get() or (None, None, None, None, 0, 0, None)
        now = 0
        for r in rows:
            at, now = r.us or 0, max(now, r.now_ms)
            if r.etag is not None and (etag is None or (at, r.etag) > (etag_at, etag)):
                etag, etag_at = r.etag, at
            if r.last_modified is not None and (modified is None or (at, r.last_modified) > (modified_at, modified)):
                modified, modified_at = r.last_modified, at
            imported, failed = imported + (r.imported or 0), failed + (r.failed or 0)
            last = max(last or at, at)
        known = (etag, etag_at, modified, modified_at, imported, failed, last)
        self.known.update(known)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.stale_ms)
        yield self._row(key[0], known, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield self._row(key[0], self.known.get(), True)

    def close(self) -> None:
        pass


def feed_marks(patches: DataFrame, stale_after: timedelta = timedelta(days=2), slack: str = "1 hour") -> DataFrame:
    """The rows of feeds that a stream of patches changes, and of those that have had none for stale_after (and slack), once.

    The stream's time is that at which a batch takes patches up. Patches may so come in any order and be of any age: none
    is too late, unless the clock is set back by more than slack. Patches without a feed are left out.
    """
    spark = patches.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    now = F.current_timestamp()
    rows = patches.filter("feed is not null").withColumns({"us": F.unix_micros("at"), "taken_up": now, "now_ms": F.unix_millis(now)}).withWatermark("taken_up", slack)
    marks = FeedMarks(round(stale_after.total_seconds() * 1000))
    found = rows.groupBy("feed").transformWithState(marks, outputStructType=ROWS, outputMode="Update", timeMode="EventTime")
    return found.withColumn("last_at", F.timestamp_micros("last_us")).drop("last_us")


def keep_feeds(spark: SparkSession, landing: str, path: str, checkpoint: str, stale_after: timedelta = timedelta(days=2), slack: str = "1 hour") -> StreamingQuery:
    """Take up the patches (JSON lines) that have landed; the feeds of a batch go to a folder of its number, so that a repeated batch overwrites itself."""
    patches = spark.readStream.schema(PATCHES).json(landing)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return feed_marks(patches, stale_after, slack).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_feeds(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each feed; one that was told stale and has a patch in the same batch is not stale."""
    rows = spark.read.schema(ROWS.replace("last_us long", "last_at timestamp") + ", batch int").parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    newest = F.max_by(F.struct(*columns), F.struct("batch", "imported", "failed", "last_at", ~F.col("stale")))
    return rows.groupBy(F.col("feed").alias("key")).agg(newest.alias("row")).select("row.*")
