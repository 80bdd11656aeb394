"""Partial rewrites seen at once, and gold kept up by change against a rebuild."""

import pytest
from pyspark.sql import functions as F

from crease.operators import careers, scorecards
from crease.plans import layout, upkeep
from crease.plans.shared import written
from crease.plans.store import Store, StoreConflict
from crease.sources import adapter


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"M{i}", 1 + i % 2, i, ["T20", "ODI"][i % 2], ["2007/08", None, "2020"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "match_id string, innings_no int, runs int, match_class string, season string")
    store = Store(spark, str(tmp_path / "s"), {"balls": ["match_class", "season"], "names": ["k"]})
    change = store.change()
    assert change.replace_all("balls", df) == {"partitions": 6, "rows": 60}
    change.publish()
    return store, df


def test_one_innings_rewrites_one_partition(spark, table):
    store, df = table
    before = store.manifest()["balls"]["parts"]
    new = df.filter("match_id = 'M8'").withColumn("runs", F.lit(99))
    change = store.change()
    assert change.replace_groups("balls", new, ["match_id", "innings_no"]) == {"partitions": 1, "rows": 10}
    assert rows_of(store.read("balls")) == rows_of(df)  # not seen yet
    change.publish()
    after = store.manifest()["balls"]["parts"]
    assert [p for p in after if after[p] != before[p]] == ["match_class=T20/season=2020"] and set(after) == set(before)
    expected = df.withColumn("runs", F.when(F.col("match_id") == "M8", 99).otherwise(F.col("runs")))
    assert rows_of(store.read("balls")) == rows_of(expected) and rows_of(store.read("balls", 1)) == rows_of(df)
    plan = store.read("balls").filter("match_class = 'T20' and season = '2007/08'")
    assert {r[0].rsplit("/", 2)[1] for r in plan.select(F.input_file_name()).collect()} == {"season=2007%252F08"}


def test_groups_that_move_and_go(spark, table):
    """A match whose season changes leaves its old partition; one without rows goes; an emptied partition is named no more."""
    store, df = table
    moved = df.filter("match_id = 'M0'").withColumn("season", F.lit("2031"))
    keys = spark.createDataFrame([("M0",), *[(f"M{i}",) for i in range(1, 60, 6)]], "match_id string")
    change = store.change()
    change.replace_groups("balls", moved, ["match_id"], keys)
    change.publish()
    expected = df.join(keys, "match_id", "left_anti").unionByName(moved)
    assert rows_of(store.read("balls")) == rows_of(expected)
    parts = store.manifest()["balls"]["parts"]
    assert "match_class=T20/season=2031" in parts and not any("__HIVE" in p and "ODI" in p for p in parts)


def test_a_broken_off_change_is_not_seen(spark, table, monkeypatch):
    """The old state stays whether the change breaks off while it writes or before its manifest is named; what is left goes."""
    store, df = table
    change = store.change()
    change.replace_all("balls", df.limit(3))
    bad = df.withColumn("runs", F.raise_error(F.lit("disk full")).cast("int"))
    with pytest.raises(Exception, match="disk full"):
        store.change().replace_groups("balls", bad, ["match_id"])
    assert store.snapshot() == 1 and rows_of(store.read("balls")) == rows_of(df)
    names = lambda: store._names("balls")
    left = len(names()) - 1
    assert left >= 1 and store.vacuum() == left and len(names()) == 1
    assert rows_of(store.read("balls")) == rows_of(df)


def test_of_two_changes_the_later_is_refused(spark, table):
    store, df = table
    first, second = store.change(), store.change()
    first.replace_all("names", df.select("runs", F.lit(1).alias("k")))
    second.replace_all("balls", df.limit(1))
    first.publish()
    with pytest.raises(StoreConflict):
        second.publish()
    assert rows_of(store.read("balls")) == rows_of(df) and store.read("names").count() == 60
    assert store.vacuum(keep=2) == 1 and store.read("balls", 1).count() == 60 and store.read("names", 1) is None


def test_many_folders_become_one(spark, table, monkeypatch):
    store, df = table
    monkeypatch.setattr("crease.plans.store.MOST_FOLDERS", 3)
    for i in (0, 1, 2, 3):
        change = store.change()
        change.replace_groups("balls", df.filter(f"match_id = 'M{i}'"), ["match_id"])
        change.publish()
    assert len(set(store.manifest()["balls"]["parts"].values())) <= 3 and rows_of(store.read("balls")) == rows_of(df)
    store.vacuum()
    assert rows_of(store.read("balls")) == rows_of(df)


def test_gold_kept_up_equals_a_rebuild(spark, sf_dir, tmp_path):
    """New, revised, moved and vanished matches; the extremes that a revision takes away are found again, from few innings."""
    balls, matches = written(adapter.deliveries(spark, sf_dir)), written(adapter.matches(spark, sf_dir))
    players = adapter.players(spark, sf_dir)
    gold = upkeep.store(spark, str(tmp_path / "gold"))
    number = F.substring("match_id", 2, 9).cast("int")
    tens = balls.groupBy("match_id").agg(F.sum("runs_batter").alias("n"))
    high = [r[0] for r in tens.orderBy(F.desc("n")).limit(5).collect()]  # their revision lowers scores, so records fall
    earlier = balls.withColumn("runs_batter", F.when(F.col("match_id").isin(high), F.col("runs_batter") + 9).otherwise(F.col("runs_batter")))
    moved = F.col("match_id") == "M12"
    first = written(earlier.filter(number % 5 != 0).withColumn("season", F.when(moved, F.lit("1999")).otherwise(F.col("season"))))
    extra = written(balls.filter(number == 3).withColumn("match_id", F.lit("X3")))
    first_matches = matches.filter(number % 5 != 0).withColumn("season", F.when(moved, F.lit("1999")).otherwise(F.col("season")))
    extra_match = matches.filter(number == 3).withColumn("match_id", F.lit("X3"))
    upkeep.apply_batch(gold, written(first_matches.unionByName(extra_match)), written(first.unionByName(extra)))
    change = (number % 5 == 0) | F.col("match_id").isin(high) | moved
    gone = spark.createDataFrame([("X3",)], "match_id string")
    batch = written(matches.filter(change)), written(balls.filter(change)), gone
    done = upkeep.apply_batch(gold, *batch)
    rebuilt = layout.gold_tables({"deliveries": balls, "matches": matches, "players": players})
    views = upkeep.gold_views(gold, players)
    for name in ("careers", "career_players", "career_coverage", "innings", "batting", "bowling", "matches", "overs"):
        assert rows_of(views[name]) == rows_of(rebuilt[name].select(*views[name].columns)), name
    assert rows_of(gold.read("deliveries")) == rows_of(balls)
    lines = scorecards.player_innings(balls).filter("strikes > 0 or bowl_first is not null").count()
    assert 0 < done["read"]["rows"] < lines / 2
    upkeep.apply_batch(gold, *batch)  # again: nothing changes
    assert rows_of(upkeep.gold_views(gold, players)["careers"]) == rows_of(rebuilt["careers"])


def test_a_small_batch_touches_little(spark, sf_dir, tmp_path):
    """One corrected match: one class and season of the match tables, its players' parts, and no look back where no record falls."""
    balls, matches = written(adapter.deliveries(spark, sf_dir)), written(adapter.matches(spark, sf_dir))
    gold = upkeep.store(spark, str(tmp_path / "gold"))
    upkeep.apply_batch(gold, matches, balls)
    one = matches.filter("match_id = 'M10'")
    better = balls.filter("match_id = 'M10'").withColumn("runs_batter", F.col("runs_batter") + 100).withColumn("runs_total", F.col("runs_total") + 100)
    done = upkeep.apply_batch(gold, written(one), written(better))
    for name in ("deliveries", "matches", "innings", "batting", "bowling", "overs", "summary"):
        assert done[name]["partitions"] == 1, name
    assert done["deliveries"]["rows"] < balls.count() / 4
    kept = balls.filter("match_id <> 'M10'").unionByName(better)
    assert rows_of(careers.career_lines(gold.read("careers"))) == rows_of(careers.career_stats(kept))


def test_a_batch_sums_its_balls_twice(spark, sf_dir, tmp_path, monkeypatch):
    """Once for the players' innings and once for the overs' parts, whatever tables are taken from them; few rows go to few files."""
    balls, matches = written(adapter.deliveries(spark, sf_dir)), written(adapter.matches(spark, sf_dir))
    summed = []
    for name in ("player_innings", "over_parts", "innings_totals", "over_rollup", "bowler_overs"):
        monkeypatch.setattr(scorecards, name, lambda b, f=getattr(scorecards, name), n=name: summed.append(n) or f(b))
    gold = upkeep.store(spark, str(tmp_path / "gold"))
    upkeep.apply_batch(gold, matches, balls)
    upkeep.apply_batch(gold, written(matches.filter("match_id > 'M5'")), written(balls.filter("match_id > 'M5'")))
    assert sorted(summed) == ["over_parts"] * 2 + ["player_innings"] * 2
    files = list((tmp_path / "gold" / "deliveries").glob("*/*/*/*.parquet"))
    assert len(files) <= 2 * matches.select("match_class", "season").distinct().count()


def test_cards_from_the_parts_of_overs(spark, sf_dir):
    balls = written(adapter.deliveries(spark, sf_dir))
    parts = scorecards.over_parts(balls)
    assert scorecards.rollup_of(parts).dtypes == scorecards.over_rollup(balls).dtypes
    assert rows_of(scorecards.rollup_of(parts)) == rows_of(scorecards.over_rollup(balls))
    assert rows_of(scorecards.totals_of(parts)) == rows_of(scorecards.innings_totals(balls))
    assert rows_of(scorecards.bowler_overs_of(parts)) == rows_of(scorecards.bowler_overs(balls))
