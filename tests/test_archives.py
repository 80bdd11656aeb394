"""Zip archives as a data source: ranges of members, large and 64-bit archives, broken and odd members."""

import json
import os
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from crease.sources import archives, matchdocs


def write(path, members, mode="w", **how):
    with zipfile.ZipFile(path, mode, **how) as z:
        for name, text in members:
            z.writestr(name, text)


def texts(spark, path, **options):
    return {r.match_id: r.text for r in archives.read_members(spark, str(path), **options).collect()}


def test_many_members_by_many_tasks(spark, tmp_path):
    """100,000 members (more than a 16-bit table holds), dealt by ranges; each task reads its own."""
    write(tmp_path / "all.zip", ((f"x/m{i}.json", f'{{"n": {i}}}') for i in range(100_000)), compression=zipfile.ZIP_DEFLATED, compresslevel=1)
    rows = archives.read_members(spark, str(tmp_path), rangeMembers=9_000)
    by_task = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    assert sorted(r.n for r in by_task.collect()) == [1_000, *[9_000] * 11]
    found = rows.agg(F.sum(F.get_json_object("text", "$.n").cast("long")), F.count_distinct("match_id"), F.count("error")).first()
    assert tuple(found) == (sum(range(100_000)), 100_000, 0)


@pytest.mark.parametrize("gap", [3 << 30, 5 << 30])
def test_large_archive(spark, tmp_path, gap):
    """A sparse file beyond 2 and 4 GB: the members stand at its end, their places need 64 bits."""
    path = tmp_path / "big.zip"
    with open(path, "wb") as f:
        f.seek(gap)
        f.write(b"\0")
    write(path, [(f"m{i}.json", json.dumps({"i": i, "pad": "y" * 5000})) for i in range(50)], "a", compression=zipfile.ZIP_DEFLATED)
    assert os.path.getsize(path) > gap
    rows = archives.read_members(spark, str(path), rangeMembers=20)
    assert rows.rdd.getNumPartitions() == 3
    assert {r.match_id: json.loads(r.text)["i"] for r in rows.collect()} == {f"m{i}": i for i in range(50)}


def test_members_behind_other_bytes(spark, tmp_path):
    """An archive after a prefix that its places know nothing of, with a comment that looks like an end record."""
    write(tmp_path / "plain.zip", [("a.json", "A"), ("b/é.json", "B" * 100_000)])
    with zipfile.ZipFile(tmp_path / "plain.zip", "a") as z:
        z.comment = b"note " + archives.END + b" note"
    (tmp_path / "late.zip").write_bytes(random.Random(1).randbytes(70_000) + (tmp_path / "plain.zip").read_bytes())
    assert texts(spark, tmp_path / "late.zip") == {"a": "A", "é": "B" * 100_000}


def test_ranges_by_bytes_and_folders(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"f{k}.zip", [(f"{k}-{i}.json", "z" * 1000) for i in range(10)])
    (tmp_path / "other.txt").write_text("no archive")
    rows = archives.read_members(spark, f"file://{tmp_path}", rangeBytes=2_500)
    assert rows.rdd.getNumPartitions() == 12 and rows.count() == 30
    assert rows.select("archive").distinct().count() == 3
    write(tmp_path / "empty.zip", [])
    assert archives.read_members(spark, str(tmp_path / "empty.zip")).count() == 0
    with pytest.raises(Exception, match="not a zip archive"):
        archives.read_members(spark, str(tmp_path / "other.txt")).count()
    with pytest.raises(Exception, match="nowhere"):
        archives.read_members(spark, str(tmp_path / "nowhere")).count()


def test_broken_members_stop_nothing(spark, tmp_path):
    path = tmp_path / "x.zip"
    write(path, [("good.json", '{"info": {"venue": "Here"}}'), ("bad.json", "y" * 5000), ("squeezed.json", "1"), ("readme.json", ""), ("notes.txt", "")], compression=zipfile.ZIP_DEFLATED)
    raw = bytearray(path.read_bytes())
    at = raw.index(b"bad.json") + len("bad.json")
    raw[at : at + 4] = b"\xff\xff\xff\xff"
    table = raw.rindex(b"squeezed.json") - archives.MEMBER_PART.size
    struct.pack_into("<H", raw, table + 10, 14)
    path.write_bytes(raw)
    found = {r.match_id: r for r in archives.read_members(spark, str(path)).collect()}
    assert found["good"].error is None and "broken bytes" in found["bad"].error and found["squeezed"].error == "compressed by method 14"
    docs = {r.match_id: r for r in matchdocs.read_archives(spark, str(path)).collect()}
    assert docs["good"].info.venue == "Here" and docs["good"].broken is None and set(docs) == {"good", "bad", "squeezed"}
    good, bad = matchdocs.split_valid(matchdocs.read_archives(spark, str(path)))
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"not JSON"}


def test_only_wanted_members_are_read(spark, tmp_path):
    """With the filter pushed down, the bytes of other members are not looked at: they are broken here, and nothing says so."""
    path = tmp_path / "x.zip"
    write(path, [(f"m{i}.json", f'{{"meta": {{"revision": {i}}}}}') for i in range(20)], compression=zipfile.ZIP_STORED)
    raw = bytearray(path.read_bytes())
    at = raw.index(b'{"meta": {"revision": 7}}')
    raw[at] = 0
    path.write_bytes(raw)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        docs = matchdocs.read_archives(spark, str(path), match_ids=["m3", "m11"])
        assert {r.match_id: r.meta.revision for r in docs.collect()} == {"m3": 3, "m11": 11}
        reader = archives.FilteredZipReader(archives.read_members(spark, str(path)).schema, {"path": str(path)})
        assert list(reader.pushFilters([archives.EqualTo(("match_id",), "m3")])) and reader.wanted == {"m3"}
        read = [n for b in reader.read(reader.partitions()[0]) for n in b.column("match_id").to_pylist()]
        assert read == ["m3"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
