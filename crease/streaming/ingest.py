"""Incremental ingestion of match documents, and event-time windows over a stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crease.operators.identity import pending
from crease.sources import matchdocs


def document_stream(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """Documents as they land in a folder."""
    rows = (
        spark.readStream.schema(matchdocs.SCHEMA)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "broken")
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
    )
    name = F.col("_metadata.file_name")
    return rows.filter(F.lower(name) != "readme.json").withColumn("match_id", matchdocs.stem(name))


def new_documents(docs: DataFrame, known: DataFrame, sweep: bool = True) -> DataFrame:
    """Of each match the highest revision, if the match is unknown or, in a sweep, the revision is new.

    known: (match_id, revision).
    """
    revision = F.greatest(F.lit(1), F.coalesce(F.col("meta.revision"), F.lit(1)))
    marked = docs.withColumn("revision", revision)
    best = marked.groupBy("match_id").agg(F.max("revision").alias("revision"))
    newest = marked.join(best, ["match_id", "revision"], "left_semi").dropDuplicates(["match_id"])
    return pending(newest, known, "match_id", sweep)


def ingest(
    spark: SparkSession, landing: str, silver: str, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None, sweep: bool = True
) -> StreamingQuery:
    """Take up landed documents in micro-batches: unknown matches, and in a sweep higher revisions of known ones.

    A batch's rows go to a folder of its own number, so that a batch that is run again overwrites itself; what earlier
    batches hold is known from a small table of (match_id, revision), not from the documents.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = matchdocs.split_valid(batch)
        known = known_matches(spark, silver).filter(F.col("batch") < number).select("match_id", "revision")
        new = new_documents(good, known, sweep).withColumn("rev", F.col("revision")).drop("revision")
        new.write.mode("overwrite").parquet(f"{silver}/documents/batch={number}")
        bad.write.mode("overwrite").parquet(f"{silver}/rejected/batch={number}")
        written = spark.read.parquet(f"{silver}/documents/batch={number}")
        written.select("match_id", F.col("rev").alias("revision")).write.mode("overwrite").parquet(f"{silver}/known/batch={number}")
        if handle:
            handle(written, number)

    query = document_stream(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def known_matches(spark: SparkSession, silver: str) -> DataFrame:
    """match_id, revision and batch of everything ingested; empty before the first batch."""
    schema = "match_id string, revision int, batch int"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{silver}/known")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{silver}/known")


def current_documents(spark: SparkSession, silver: str) -> DataFrame:
    """The latest revision of each ingested match."""
    rows = spark.read.parquet(f"{silver}/documents")
    best = rows.groupBy("match_id").agg(F.max(F.struct("rev", "batch")).alias("best"))
    best = best.select("match_id", F.col("best.rev").alias("rev"), F.col("best.batch").alias("batch"))
    return rows.join(best, ["match_id", "rev", "batch"], "left_semi").dropDuplicates(["match_id"])


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and users of each type in tumbling windows; works on a stream or a table."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
