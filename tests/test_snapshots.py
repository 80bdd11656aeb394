"""Snapshots of one moment, and ages to parts of a second, against the SQL."""

import duckdb
from helpers import same
from pyspark.sql import functions as F

from crease import oracles, registry
from crease.operators import identity


def test_snapshots_of_one_moment(spark, sf_dir, tmp_path):
    """Every event comes sixty times with a number of its own: the first of them counts, whatever its payload's text."""
    out = str(tmp_path / "events.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + k * 1000 AS event_id) FROM '{sf_dir}/events.parquet', range(60) r(k)) TO '{out}'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{out}'")
    got = registry.queries()["snapshot_latest"](spark, str(tmp_path)).toPandas()
    assert len(got)
    same(got, con.sql(oracles.SQL["snapshot_latest"]).df())


def test_age_to_parts_of_a_second(spark):
    rows = spark.createDataFrame(
        [("p", "a", "2024-01-01 00:00:00.4", "old"), ("p", "b", "2024-01-01 00:00:00.6", "young"), ("p", "c", "2024-01-01 00:00:00.5", "just")],
        "page_type string, url string, fetched_at string, payload string",
    ).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = identity.fresh_snapshots(rows, F.lit("2024-01-01 06:00:00.5"), 6 * 3600)
    assert got.columns == ["page_type", "key", "fetched_at", "payload"] and {r.payload for r in got.collect()} == {"young", "just"}
