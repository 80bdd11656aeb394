"""Sinks and sources that are no queries over the tables: caches, JSON lines, stores, snapshots, crawls, page sources."""

import os
import time

import pytest
from pyspark.sql import functions as F

from crease.operators import identity, scorecards
from crease.plans import layout
from crease.sources import adapter, made, matchdocs, pages, teams


def test_register_cache(spark, tmp_path):
    cache, calls = str(tmp_path / "people.csv"), []

    def download(path):
        calls.append(path)
        with open(path, "w") as f:
            f.write("identifier,key_external\na,1\n")

    read = lambda **k: matchdocs.cached_register(spark, cache, download, **k).collect()
    assert [tuple(r) for r in read()] == [("a", "1")] and len(calls) == 1
    read()
    assert len(calls) == 1
    old = time.time() - 8 * 86400
    os.utime(cache, (old, old))
    read()
    assert len(calls) == 2
    read(force=True)
    assert len(calls) == 3


def test_json_lines_and_their_types(spark, sf_dir, tmp_path):
    rows = scorecards.innings_totals(adapter.deliveries(spark, sf_dir)).withColumn("none", F.lit(None).cast("string"))
    layout.write_ndjson(rows, str(tmp_path / "lines"))
    schema = "match_id string, innings_no int, batting_team string, runs long, wickets long, balls long, none string"
    back = matchdocs.read_ndjson(spark, str(tmp_path / "lines"), schema)
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0


def test_relational_store(spark, sf_dir, tmp_path):
    """Derby, which comes with Spark: tables are replaced, not added to, and can be read in ranges."""
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    for _ in range(2):
        counts = layout.replace_in_store({"innings": orders}, url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, batch=100)
        assert counts == {"innings": orders.count()}
    parts = layout.read_store(spark, url, "innings", key="o_orderkey", bounds=(0, 1500), parts=3)
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == orders.count()


def test_snapshots_are_added(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    for i in (1, 2):
        row = spark.sql(f"select 'scorecard' page_type, '/a' url, timestamp'2024-01-01 0{i}:00:00' fetched_at, 'v{i}' payload")
        layout.append_snapshots(row, path)
    kept = spark.read.parquet(path)
    assert kept.count() == 2
    now = F.lit("2024-01-01 02:30:00").cast("timestamp")
    assert [r.payload for r in identity.fresh_snapshots(kept, now, 3600).collect()] == ["v2"]
    assert identity.fresh_snapshots(kept, now, 60).count() == 0


def test_crawl_finds_each_page_once(spark):
    """A web with a cycle, a chain of 50 pages, links to oneself and to known pages, and no seed."""
    links = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "d"), ("d", "n0"), *[(f"n{i}", f"n{i + 1}") for i in range(49)], ("n49", "a"), ("lost", "b")]
    table = spark.createDataFrame(links, "params string, to string")
    seed = spark.createDataFrame([("p", "a", 0), ("p", "a", 3)], "page_type string, params string, depth int")
    expand = lambda f: f.join(table, "params").select("page_type", F.col("to").alias("params"), (F.col("depth") + 1).alias("depth"))
    found = sorted((r.params, r.depth) for r in identity.crawl(seed, expand).collect())
    assert found == sorted([("a", 0), ("b", 1), ("c", 1), ("d", 2), *[(f"n{i}", 3 + i) for i in range(50)]])
    assert identity.crawl(seed.limit(0), expand).count() == 0


def test_page_sources(spark):
    assert set(pages.SOURCES) >= {"series-fixtures", "scorecard", "player-profile"}
    with pytest.raises(KeyError, match="weather"):
        pages.source_of("weather")
    pages.register_source("weather", pages.PageSource(lambda rows, base: rows, ()))
    assert pages.source_of("weather").leads_to == ()
    del pages.SOURCES["weather"]
    rows = spark.createDataFrame([(1, '{"isOut": "true", "n": 1}'), (2, '{"isOut": true}'), (3, "{}")], "page_id int, line string")
    assert [r.b for r in rows.select(pages.only_boolean(F.col("line"), "$.isOut").alias("b")).collect()] == [None, True, None]


def test_fixture_page_fields(spark, sf_dir):
    good, bad = pages.with_data(made.fixture_pages(spark, sf_dir), made.ELEMENT)
    assert good.count() and bad.count()
    assert pages.source_of("series-fixtures").parse(good, made.BASE).count() == pages.fixtures(good, "", f"{made.BASE}.matches").count()


def test_source_registration_and_batches(spark):
    known = spark.createDataFrame([("a", "A", "x"), ("b", "B", None)], "source string, name string, url string")
    new = spark.createDataFrame([("b", None, "y"), ("c", "C", "z")], "source string, name string, url string")
    rows = {r.source: (r.name, r.url) for r in identity.register_sources(known, new).collect()}
    assert rows == {"a": ("A", "x"), "b": ("B", "y"), "c": ("C", "z")}
    dealt = identity.batches(spark.range(100), "id", 7)
    assert dealt.count() == 100 and dealt.agg(F.max("batch")).first()[0] <= 6


def test_national_sides(spark):
    sides = teams.national_teams(spark)
    assert sides.count() == sides.select("side").distinct().count() > 80
    assert sides.filter("side = 'west indies'").first().iso is None
