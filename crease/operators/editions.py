"""Tournament editions: points table with net run rate, leaderboards, squads, venues; search and paging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crease.functions import rules
from crease.operators.scorecards import count_if

EDITION = ["event_name", "season"]


def standings(matches: DataFrame, innings: DataFrame) -> DataFrame:
    """Points table of every edition; nulls of event and season are editions too.

    A win gives two points, no result or a tie one. A side that is all out is charged its full quota of balls. The
    first innings of each team in a match counts. Matches without both teams are left out.
    """
    played = matches.filter("team_home is not null and team_away is not null")
    first = innings.groupBy("match_id", F.col("batting_team").alias("team")).agg(
        F.min(F.struct("innings_no", "runs", "wickets", "balls")).alias("i")
    )
    first = first.select("match_id", "team", F.col("i.runs").alias("runs"), F.col("i.wickets").alias("wickets"), F.col("i.balls").alias("balls"))
    side = lambda own, other: F.struct(F.col(own).alias("team"), F.col(other).alias("opponent"))
    sides = played.select(
        *EDITION,
        "match_id",
        "match_class",
        "outcome_winner",
        F.explode(F.array(side("team_home", "team_away"), side("team_away", "team_home"))).alias("side"),
    ).select("*", "side.*")
    quota = rules.quota_balls(F.col("match_class"))
    charged = lambda w, b: F.when((quota > 0) & (w >= 10), quota).otherwise(b)
    theirs = first.select(
        "match_id", F.col("team").alias("opponent"), F.col("runs").alias("runs2"), F.col("wickets").alias("wickets2"), F.col("balls").alias("balls2")
    )
    both = F.col("runs").isNotNull() & F.col("runs2").isNotNull()
    only = lambda x: F.coalesce(F.sum(F.when(both, x)), F.lit(0))
    winner = F.col("outcome_winner")
    won, lost = winner.eqNullSafe(F.col("team")), winner.eqNullSafe(F.col("opponent"))
    table = (
        sides.join(first, ["match_id", "team"], "left")
        .join(theirs, ["match_id", "opponent"], "left")
        .groupBy(*EDITION, "team")
        .agg(
            F.count("*").alias("played"),
            count_if(won).alias("won"),
            count_if(lost & ~won).alias("lost"),
            count_if(~won & ~lost).alias("no_result"),
            only(F.col("runs")).alias("rf"),
            only(charged(F.col("wickets"), F.col("balls"))).alias("bf"),
            only(F.col("runs2")).alias("ra"),
            only(charged(F.col("wickets2"), F.col("balls2"))).alias("ba"),
        )
    )
    rate = lambda r, b: F.when(F.col(b) > 0, F.col(r) / (F.col(b) / 6.0)).otherwise(0.0)
    nrr = rate("rf", "bf") - rate("ra", "ba")
    points = F.col("won") * 2 + F.col("no_result")
    place = W.partitionBy(*EDITION).orderBy(F.desc("points"), F.desc("nrr"), "team")
    return (
        table.withColumn("points", points)
        .withColumn("nrr", nrr)
        .select(*EDITION, "team", "played", "won", "lost", "no_result", "points", "nrr", F.row_number().over(place).alias("place"))
    )


def player_key(player_id: Column, name: Column) -> Column:
    return F.coalesce(player_id, F.concat(F.lit("name:"), name))


def batting_totals(matches: DataFrame, card: DataFrame) -> DataFrame:
    """Batting of each player in each edition."""
    return (
        card.join(matches.select("match_id", *EDITION, "match_class"), "match_id")
        .groupBy(*EDITION, player_key(F.col("player_id"), F.col("name")).alias("player"))
        .agg(
            F.sum("runs").alias("runs"),
            F.sum("balls").alias("balls"),
            F.sum("fours").alias("fours"),
            F.sum("sixes").alias("sixes"),
            F.count("*").alias("innings"),
        )
    )


def bowling_totals(matches: DataFrame, card: DataFrame) -> DataFrame:
    return (
        card.join(matches.select("match_id", *EDITION), "match_id")
        .groupBy(*EDITION, player_key(F.col("player_id"), F.col("name")).alias("player"))
        .agg(F.sum("balls").alias("balls"), F.sum("runs").alias("runs"), F.sum("wickets").alias("wickets"))
    )


def edition_class(matches: DataFrame) -> DataFrame:
    """The class of each edition: that of its first match by id."""
    return matches.groupBy(*EDITION).agg(F.min_by("match_class", "match_id").alias("match_class"))


def with_threshold(totals: DataFrame, matches: DataFrame, limited: int, longer: int) -> DataFrame:
    """Totals of those who had enough balls for a rate in their edition."""
    same = lambda a, b: a.eqNullSafe(b)
    kinds = edition_class(matches).select(F.col("event_name").alias("e"), F.col("season").alias("y"), "match_class")
    least = F.when(F.col("match_class").isin(*rules.LIMITED_OVERS), limited).otherwise(longer)
    return totals.join(kinds, same(F.col("event_name"), F.col("e")) & same(F.col("season"), F.col("y"))).filter(F.col("balls") >= least)


def leaders(rows: DataFrame, order: list[Column], k: int, *columns: str) -> DataFrame:
    """The k best of each edition; order must break all ties."""
    place = F.row_number().over(W.partitionBy(*EDITION).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select(*EDITION, "place", *columns)


def most(totals: DataFrame, measure: str, k: int = 10) -> DataFrame:
    """Leaders by a sum; only players who have any."""
    return leaders(totals.filter(F.col(measure) > 0), [F.desc(measure), F.asc("player")], k, "player", measure)


def highest_scores(matches: DataFrame, card: DataFrame, k: int = 10) -> DataFrame:
    rows = card.join(matches.select("match_id", *EDITION), "match_id").withColumn("player", player_key(F.col("player_id"), F.col("name")))
    score = F.concat(F.col("runs").cast("string"), F.when(F.col("out"), "").otherwise("*"))
    return leaders(
        rows.withColumn("score", score), [F.desc("runs"), F.asc("match_id"), F.asc("innings_no"), F.asc("player")], k, "player", "score", "balls"
    )


def best_strike_rate(totals: DataFrame, matches: DataFrame, k: int = 10) -> DataFrame:
    rows = with_threshold(totals, matches, 30, 120).withColumn("rate", F.col("runs").cast("double") / F.col("balls") * 100)
    return leaders(rows, [F.desc("rate"), F.asc("player")], k, "player", "rate")


def most_wickets(totals: DataFrame, k: int = 10) -> DataFrame:
    return leaders(totals.filter("wickets > 0"), [F.desc("wickets"), F.asc("runs"), F.asc("player")], k, "player", "wickets", "runs")


def best_economy(totals: DataFrame, matches: DataFrame, k: int = 10) -> DataFrame:
    rows = with_threshold(totals, matches, 60, 240).withColumn("rate", F.col("runs").cast("double") / (F.col("balls") / 6.0))
    return leaders(rows, [F.asc("rate"), F.asc("player")], k, "player", "rate")


def edition_squads(matches: DataFrame, innings: DataFrame, batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """Players of each team in each edition: matches, runs, wickets; a bowler is of the side that does not bat."""
    teams = innings.select("match_id", "innings_no", "batting_team").join(
        matches.select("match_id", *EDITION, "team_home", "team_away"), "match_id"
    )
    key = player_key(F.col("player_id"), F.col("name")).alias("player")
    zero = F.lit(0).cast("long")
    bat = batting.join(teams, ["match_id", "innings_no"]).select(
        *EDITION, F.col("batting_team").alias("team"), key, "match_id", F.col("runs"), zero.alias("wickets")
    )
    other = F.when(F.col("batting_team") == F.col("team_home"), F.col("team_away")).otherwise(F.col("team_home"))
    bowl = bowling.join(teams, ["match_id", "innings_no"]).select(
        *EDITION, other.alias("team"), key, "match_id", zero.alias("runs"), F.col("wickets")
    )
    return (
        bat.unionByName(bowl)
        .filter("team is not null")
        .groupBy(*EDITION, "team", "player")
        .agg(F.count_distinct("match_id").alias("appearances"), F.sum("runs").alias("runs"), F.sum("wickets").alias("wickets"))
    )


def edition_venues(matches: DataFrame) -> DataFrame:
    return matches.filter("venue is not null").groupBy(*EDITION, "venue", "city").agg(F.count("*").alias("matches"))


def edition_meta(matches: DataFrame) -> DataFrame:
    """Matches, first and last date and the most frequent class (then first by name) of each edition."""
    counts = matches.groupBy(*EDITION, "match_class").agg(
        F.count("*").alias("n"), F.min("match_date").alias("first"), F.max("match_date").alias("last")
    )
    return counts.groupBy(*EDITION).agg(
        F.sum("n").alias("matches"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.min_by("match_class", F.struct(-F.col("n"), "match_class")).alias("main_class"),
    )


def competitions(matches: DataFrame) -> DataFrame:
    """Events with their matches and seasons, newest season first, null last, as JSON."""
    seasons = matches.filter("event_name is not null").groupBy("event_name", "season").agg(F.count("*").alias("n"))
    point = F.struct("season", "n")
    newest = lambda a, b: (
        F.when(a["season"].isNull() & b["season"].isNull(), 0)
        .when(a["season"].isNull(), 1)
        .when(b["season"].isNull(), -1)
        .when(a["season"] > b["season"], -1)
        .when(a["season"] < b["season"], 1)
        .otherwise(0)
    )
    return seasons.groupBy("event_name").agg(
        F.sum("n").alias("total"),
        F.max("season").alias("latest"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(point), newest),
                lambda x: F.concat(F.coalesce(x["season"], F.lit("-")), F.lit(":"), x["n"].cast("string")),
            ),
            ",",
        ).alias("seasons"),
    )


def team_record(matches: DataFrame) -> DataFrame:
    """Played, won, lost, no result and win percentage of every team, home and away."""
    sides = matches.select("outcome_winner", F.explode(F.array("team_home", "team_away")).alias("team")).filter("team is not null")
    winner = F.col("outcome_winner")
    return (
        sides.groupBy("team")
        .agg(
            F.count("*").alias("played"),
            count_if(winner == F.col("team")).alias("won"),
            count_if(winner != F.col("team")).alias("lost"),
            count_if(winner.isNull()).alias("no_result"),
        )
        .withColumn("win_pct", F.round(F.col("won") * 1000.0 / F.col("played")) / 10)
    )


def team_squad(innings: DataFrame, batting: DataFrame, limit: int = 30) -> DataFrame:
    """Each team's players by innings batted, then runs."""
    rows = (
        batting.filter("player_id is not null")
        .join(innings.select("match_id", "innings_no", F.col("batting_team").alias("team")), ["match_id", "innings_no"])
        .groupBy("team", "player_id", "name")
        .agg(F.count("*").alias("innings"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"))
    )
    place = F.row_number().over(W.partitionBy("team").orderBy(F.desc("innings"), F.desc("runs"), "player_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def page_of(page: int, total: int, size: int) -> tuple[int, int]:
    """The page that is shown, clamped to what there is, and the number of pages."""
    pages = max(1, math.ceil(total / size))
    return min(max(1, page), pages), pages


def search_matches(matches: DataFrame, query: str | None = None, match_class: str | None = None, event: str | None = None, season: str | None = None, team: str | None = None) -> DataFrame:
    """Matches that fit all given filters; '' asks for a null event or season."""
    hit = F.lit(True)
    if query:
        hit = rules.contains_any(F.lit(query), *map(F.col, ["team_home", "team_away", "event_name", "venue"]))
    if match_class:
        hit = hit & (F.col("match_class") == match_class)
    if team:
        hit = hit & ((F.col("team_home") == team) | (F.col("team_away") == team))
    hit = hit & rules.optional_match(F.col("event_name"), event) & rules.optional_match(F.col("season"), season)
    return matches.filter(hit)


def newest_first() -> list[Column]:
    return [F.desc_nulls_first("match_date"), F.asc("match_id")]


def oldest_first() -> list[Column]:
    """newest_first() from its end."""
    return [F.asc_nulls_last("match_date"), F.desc("match_id")]


def format_leaders(careers: DataFrame, measure: str, k: int = 10) -> DataFrame:
    """The k best players of each class by a career sum."""
    place = F.row_number().over(W.partitionBy("match_class").orderBy(F.desc(measure), "player_id"))
    return careers.filter(F.col(measure) > 0).withColumn("place", place).filter(F.col("place") <= k).select("match_class", "place", "player_id", measure)
