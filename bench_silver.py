"""The headline queries over silver tables written once, in Spark and in DuckDB on the same files; warm, the best of three runs.

BENCH_SF_DIR: the tables, BENCH_COPIES: how often silver holds them (with matches of their own), BENCH_CPUS. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease import registry
from crease.plans import layout
from crease.sources import adapter

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
COPIES, CPUS, RUNS = int(os.environ.get("BENCH_COPIES", "1")), os.environ.get("BENCH_CPUS", "8"), 3
NAMES = [
    *["over_rollup", "over_cumulative", "innings_totals", "batting_card", "bowling_card", "match_summary", "career_stats", "career_players"],
    *["standings_nrr", "edition_most_runs", "team_record", "batting_performances", "career_by_class", "chase_features"],
]


def copied(rows: DataFrame) -> DataFrame:
    """rows COPIES times, with match ids of their own."""
    copy = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    return copy.withColumn("match_id", F.concat(F.col("match_id"), F.lit("-"), F.col("copy").cast("string"))).drop("copy")


def best(run) -> float:
    took = []
    for _ in range(RUNS + 1):
        began = time.time()
        run()
        took.append(time.time() - began)
    return round(min(took[1:]), 3)


def main() -> None:
    work = tempfile.mkdtemp(prefix="bench-silver-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{work}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = copied(adapter.deliveries(spark, SF_DIR)), copied(adapter.matches(spark, SF_DIR)), adapter.players(spark, SF_DIR)
    layout.write_silver(*tables, f"{work}/silver")
    silver = layout.read_silver(spark, f"{work}/silver")
    for name in ("deliveries", "matches", "players"):  # the queries read these in place of the views
        setattr(adapter, name, lambda *_, t=silver[name]: t)
    queries, oracles = registry.queries(), registry.oracle_sql()
    con = duckdb.connect()
    con.sql(f"SET threads = {CPUS}")
    for name in ("deliveries", "matches", "players"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{work}/silver/{name}/**/*.parquet', hive_partitioning = true, hive_types_autocast = false)")
    out = {}
    for name in NAMES:
        sql = oracles[name].replace(adapter.SQL, "WITH unused AS (SELECT 1)\n")
        ours = best(lambda n=name: queries[n](spark, "").write.format("noop").mode("overwrite").save())
        out[name] = {"spark": ours, "duckdb": best(lambda q=sql: con.sql(q).to_arrow_table())}
    rows = silver["deliveries"].count()
    totals = {k: round(sum(x[k] for x in out.values()), 2) for k in ("spark", "duckdb")}
    print(json.dumps({"rows": rows, "cpus": int(CPUS), "runs": RUNS, **totals, "queries": out}))
    spark.stop()


if __name__ == "__main__":
    main()
