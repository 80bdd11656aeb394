"""Silver and gold kept up by change: a batch of new, revised or vanished matches touches what depends on them, no more.

Totals of a career take the difference of a match's new and old innings. Extremes (highest score, best figures, first and
last date) take the new innings' where these are better, and are worked out again from the player's innings only if an
innings that held one has gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from crease.operators import careers, scorecards
from crease.plans.shared import drop_folder, new_folder, written
from crease.plans.store import Store

PLACE = ["match_class", "season"]
#: Partitions of the tables by player.
PLAYER_PARTS = 64
LAYOUT = {
    "deliveries": PLACE, "matches": PLACE,
    "innings": PLACE, "batting": PLACE, "bowling": PLACE, "overs": PLACE, "summary": PLACE,
    "lines": ["part"], "careers": ["part"], "known": ["part"], "feeds": ["part"],
}


def store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, LAYOUT)


def part_of(player: str, parts: int = PLAYER_PARTS) -> Column:
    return F.pmod(F.xxhash64(player), F.lit(parts)).cast("int").alias("part")


def match_tables(matches: DataFrame, lines: DataFrame, parts: DataFrame) -> dict[str, DataFrame]:
    """The gold tables that depend on single matches, with class and season of the match, from player_innings() and over_parts()."""
    places = matches.select("match_id", *PLACE)
    placed = lambda table: table.join(places, "match_id")
    totals = scorecards.totals_of(parts)
    return {
        "innings": placed(totals),
        "batting": placed(scorecards.card_of_batting(lines)),
        "bowling": placed(scorecards.card_of_bowling(scorecards.bowler_overs_of(parts))),
        "overs": placed(scorecards.json_of_overs(scorecards.rollup_of(parts))),
        "summary": scorecards.summary_of(matches, totals),
    }


def _or_none(rows: DataFrame | None, like: DataFrame) -> DataFrame:
    return like.limit(0) if rows is None else rows


def apply_batch(gold: Store, matches: DataFrame, balls: DataFrame, gone: DataFrame | None = None, more: dict[str, tuple] | None = None) -> dict[str, dict]:
    """Take a batch up as one change: matches and balls that are new or replace those of their match_id; gone: match_ids to delete.

    A match comes with all its balls. Returns per table the partitions and rows written, and as "read" the rows read of
    innings that were looked up again. matches, balls and gone are read several times: give written tables, or what is
    picked from them. Balls are read three times, for their own table, the players' innings and the overs' parts. The new
    state is seen at once, when all tables are written; a batch that is applied again changes nothing. more: other tables
    of the store that change with it, as rows, key and keys of replace_groups().
    """
    change = gold.change()
    spark = gold.spark
    keys = matches.select("match_id")
    keys = keys if gone is None else keys.unionByName(gone.select("match_id"))
    done: dict[str, dict] = {}

    # where the old versions stand: one look at the matches, then only their classes and seasons are read
    old_places = change.places("matches", ["match_id"], keys)
    work = new_folder(spark)
    new_lines = written(scorecards.player_innings(balls).withColumn("part", part_of("player_id")), f"{work}/new")
    over_parts = written(scorecards.over_parts(balls), f"{work}/overs")
    done["deliveries"] = change.replace_groups("deliveries", balls, ["match_id"], keys, had=old_places)
    for name, rows in {"matches": matches, **match_tables(matches, new_lines, over_parts)}.items():
        done[name] = change.replace_groups(name, rows, ["match_id"], keys, had=old_places, gets=matches)

    # players of the old and new versions; the old ones' innings are there already
    old_lines = written(_or_none(change.read("lines"), new_lines).join(keys.distinct(), "match_id", "left_semi"), f"{work}/old")
    touched = new_lines.select("player_id", "part").unionByName(old_lines.select("player_id", "part")).distinct()
    parts = [r.part for r in touched.select("part").distinct().collect()]
    in_parts = F.col("part").isin(parts)
    done["lines"] = change.replace_groups("lines", new_lines, ["match_id"], keys, had=[Row(part=p, part_folder=f"part={p}") for p in parts])

    had = change.read("careers")
    added, removed = careers.career_sums(new_lines), careers.career_sums(old_lines)
    state = added.limit(0) if had is None else had.filter(in_parts).drop("part")
    merged = careers.changed_sums(state, added, removed)
    lost = merged.filter("lost").select(*careers.KEY)
    lines = change.written("lines")
    again = written(careers.career_sums(lines.filter(in_parts).join(lost, careers.KEY, "left_semi")), f"{work}/again")
    rows = careers.with_extremes(merged, again).withColumn("part", part_of("player_id"))
    done["careers"] = change.replace_partitions("careers", rows, [f"part={p}" for p in parts])
    done["read"] = {"rows": again.agg(F.sum("lines")).first()[0] or 0, "parts": len(parts)}
    for name, (rows, key, named) in (more or {}).items():
        done[name] = change.replace_groups(name, rows, key, named)
    change.publish()
    drop_folder(spark, work)
    return done


def gold_views(gold: Store, players: DataFrame, snapshot: int | None = None) -> dict[str, DataFrame]:
    """The gold tables of a snapshot, as a rebuild would write them."""
    sums = gold.read("careers", snapshot).drop("part")
    named = {"innings": "innings", "batting": "batting", "bowling": "bowling", "overs": "overs", "matches": "summary"}
    return {
        "careers": careers.career_lines(sums),
        "career_players": careers.players_from(sums, players),
        "career_coverage": careers.coverage_from(sums),
        **{name: gold.read(table, snapshot).drop(*(PLACE if name != "matches" else [])) for name, table in named.items()},
    }
