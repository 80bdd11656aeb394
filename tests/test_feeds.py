"""Feed counters kept by a stream, over restarts, against the same totals of a table."""

import json
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from crease.operators import identity
from crease.streaming import feeds

DAY = datetime(2024, 5, 1)


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    keys = ("feed", "etag", "last_modified", "imported", "failed", "at")
    lines = [json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in zip(keys, r, strict=True) if v is not None}) for r in rows]
    (folder / f"{name}.json").write_text("\n".join(lines))


def run(spark, tmp_path):
    feeds.keep_feeds(spark, str(tmp_path / "in"), str(tmp_path / "feeds"), str(tmp_path / "check"), timedelta(seconds=4), "0 seconds").awaitTermination(60)
    return {r.feed: r for r in feeds.current_feeds(spark, str(tmp_path / "feeds")).collect()}


def test_totals_go_on_from_the_checkpoint(spark, tmp_path):
    at = lambda d, h=0: DAY + timedelta(days=d, hours=h)
    parts = [
        [("all", "e1", None, 5, 0, at(0)), ("cup", "c1", "Mon", 1, 1, at(0)), ("all", None, "Tue", 2, None, at(0, 2)), (None, "x", "x", 9, 9, at(0))],
        [("all", "e0", None, 0, 3, at(0, 1)), ("late", None, None, 4, 0, at(0, 3)), ("cup", None, None, None, None, at(0, 4))],
        [("all", "e3", "Fri", 7, 0, at(5)), ("late", "z", None, 1, 0, at(5))],
        [("cup", "c2", None, 10, 0, at(6))],
    ]
    found = {}
    for n, part in enumerate(parts):
        time.sleep(5 if n == 2 else 0)
        land(tmp_path / "in", f"p{n}", part)
        found = run(spark, tmp_path)  # a query of its own each time: all it knows is in the checkpoint
        if n == 2:
            assert found["cup"].stale and not found["all"].stale and found["cup"].imported == 1
    rows = [r for p in parts for r in p if r[0]]
    patches = spark.createDataFrame(rows, feeds.PATCHES)
    none = spark.createDataFrame([], "feed string, etag string, last_modified string, imported long, failed long")
    table = {r.feed: r for r in identity.feed_state(none, patches).collect()}
    assert set(found) == set(table) == {"all", "cup", "late"}
    for k, r in table.items():
        assert (found[k].etag, found[k].last_modified, found[k].imported, found[k].failed) == (r.etag, r.last_modified, r.imported or 0, r.failed or 0), k
    assert found["all"].last_at == at(5) and not found["cup"].stale
    again = run(spark, tmp_path)  # nothing new has landed
    assert {k: tuple(r) for k, r in again.items()} == {k: tuple(r) for k, r in found.items()}
    assert spark.read.parquet(str(tmp_path / "feeds")).filter(F.col("stale")).count() >= 1
