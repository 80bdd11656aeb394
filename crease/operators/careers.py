"""Careers by player and class, whole-career totals and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.functions import rules
from crease.operators.scorecards import count_if, player_innings

KEY = ["player_id", "match_class"]


def appearances(balls: DataFrame, *columns: str) -> DataFrame:
    """Distinct (player, match, columns) of those who batted as striker or bowled."""
    take = lambda c: balls.select(F.col(c).alias("player_id"), "match_id", *columns).filter("player_id is not null")
    return take("batter_id").union(take("bowler_id")).distinct()


def career_stats(balls: DataFrame) -> DataFrame:
    """Batting and bowling careers by player and class; a player may have either alone."""
    return careers_of(player_innings(balls))


#: What a career adds up, and its extremes with the way they are taken.
SUMS = [
    *["lines", "matches", "bat_innings", "runs", "balls_faced", "not_outs", "fifties", "hundreds", "ducks", "fours", "sixes", "bowl_innings"],
    *["balls_bowled", "runs_conceded", "wickets", "five_wickets", "all_runs", "all_wickets"],
]
EXTREMES = {"high": F.max, "best": F.max, "first_date": F.min, "last_date": F.max, "gender": F.min}


def career_sums(lines: DataFrame) -> DataFrame:
    """Sums and extremes of each player and class from player_innings(); the other columns of a career follow from them.

    The innings of a player go to one place once: matches are told apart there, before they are counted.
    """
    runs, out, col = F.col("runs"), F.col("was_out"), F.col
    bats, bowls = col("strikes") > 0, col("bowl_first").isNotNull()
    summed = lambda when, x: F.coalesce(F.sum(F.when(when, x)), F.lit(0))
    by_match = (
        lines.filter(bats | bowls)
        .repartition("player_id")
        .groupBy(*KEY, "match_id")
        .agg(
            F.count("*").alias("lines"),
            count_if(bats).alias("bat_innings"),
            summed(bats, runs).alias("runs"),
            summed(bats, col("balls")).alias("balls_faced"),
            count_if(bats & ~out).alias("not_outs"),
            count_if(bats & (runs >= 50) & (runs < 100)).alias("fifties"),
            count_if(bats & (runs >= 100)).alias("hundreds"),
            count_if(bats & (runs == 0) & out).alias("ducks"),
            summed(bats, col("fours")).alias("fours"),
            summed(bats, col("sixes")).alias("sixes"),
            count_if(bowls).alias("bowl_innings"),
            summed(bowls, col("bowl_balls")).alias("balls_bowled"),
            summed(bowls, col("conceded")).alias("runs_conceded"),
            summed(bowls, col("wickets")).alias("wickets"),
            count_if(bowls & (col("wickets") >= 5)).alias("five_wickets"),
            F.coalesce(F.sum("runs"), F.lit(0)).alias("all_runs"),
            F.coalesce(F.sum("wickets"), F.lit(0)).alias("all_wickets"),
            F.max(F.when(bats, F.struct(runs.alias("n"), (~out).alias("not_out")))).alias("high"),
            F.max(F.when(bowls, F.struct(col("wickets").alias("n"), (-col("conceded")).alias("saved")))).alias("best"),
            F.min("match_date").alias("first_date"),
            F.max("match_date").alias("last_date"),
            F.min("gender").alias("gender"),
        )
    )
    return by_match.groupBy(*KEY).agg(
        *[(F.count("*") if c == "matches" else F.sum(c)).alias(c) for c in SUMS], *[f(c).alias(c) for c, f in EXTREMES.items()]
    )


def changed_sums(state: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """career_sums() after innings have been added and others removed, with `lost`: only a removed innings is known to have held an extreme.

    Careers without innings are left out. The extremes of lost rows are those of what was there before or is added.
    """
    tagged = lambda rows, tag: rows.select(*KEY, F.lit(tag).alias("tag"), *SUMS, *EXTREMES)
    rows = tagged(state, "state").unionByName(tagged(added, "added")).unionByName(tagged(removed, "removed"))
    gone = F.col("tag") == "removed"
    signed = lambda c: F.sum(F.when(gone, -F.col(c)).otherwise(F.col(c))).alias(c)
    kept = lambda c: F.when(~gone, F.col(c))
    of = lambda tag: [f(F.when(F.col("tag") == tag, F.col(c))).alias(f"{tag}_{c}") for c, f in EXTREMES.items()]
    sums = rows.groupBy(*KEY).agg(*map(signed, SUMS), *[f(kept(c)).alias(c) for c, f in EXTREMES.items()], *of("removed"), *of("added"))
    at = lambda tag, c: F.coalesce(F.col(f"{tag}_{c}") == F.col(c), F.lit(False))
    held = [at("removed", c) & ~at("added", c) for c in EXTREMES]
    lost = held[0]
    for x in held[1:]:
        lost = lost | x
    return sums.filter("lines > 0").select(*KEY, *SUMS, *EXTREMES, lost.alias("lost"))


def with_extremes(sums: DataFrame, again: DataFrame) -> DataFrame:
    """changed_sums() with the extremes of lost rows taken from career_sums() of these careers' innings."""
    fresh = again.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in EXTREMES])
    return sums.join(fresh, KEY, "left").select(*KEY, *SUMS, *[F.when(F.col("lost"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in EXTREMES])


def careers_of(lines: DataFrame) -> DataFrame:
    """career_stats from player_innings()."""
    return career_lines(career_sums(lines))


def career_lines(sums: DataFrame) -> DataFrame:
    """career_stats from career_sums(). The highest score's not-out flag and the best figures come from maxima over structs."""
    col = F.col
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return sums.select(
        *KEY,
        *["matches", "bat_innings", "runs", "balls_faced", "not_outs"],
        zero(col("high.n"), "high_score"),
        F.coalesce("high.not_out", F.lit(False)).alias("high_score_not_out"),
        *["fifties", "hundreds", "ducks", "fours", "sixes"],
        rules.ratio2(col("runs"), col("bat_innings") - col("not_outs")).alias("batting_avg"),
        rules.ratio2(col("runs") * 100, col("balls_faced")).alias("strike_rate"),
        *["bowl_innings", "balls_bowled", "runs_conceded", "wickets"],
        zero(col("best.n"), "best_bowling_wkts"),
        zero(-col("best.saved"), "best_bowling_runs"),
        "five_wickets",
        rules.ratio2(col("runs_conceded"), col("balls_bowled") / 6.0, col("balls_bowled") > 0).alias("economy"),
        rules.ratio2(col("runs_conceded"), col("wickets")).alias("bowling_avg"),
        rules.ratio2(col("balls_bowled"), col("wickets")).alias("bowling_sr"),
    )


def career_players(balls: DataFrame, players: DataFrame) -> DataFrame:
    return players_of(player_innings(balls), players)


def players_of(lines: DataFrame, players: DataFrame) -> DataFrame:
    """One row per player who batted or bowled: identity and whole-career totals."""
    return players_from(career_sums(lines), players)


def players_from(sums: DataFrame, players: DataFrame) -> DataFrame:
    """players_of() from career_sums(): a match is of one class, so matches add up over classes."""
    totals = sums.groupBy("player_id").agg(
        F.min("gender").alias("gender"),
        F.sum("matches").alias("career_matches"),
        F.sum("all_runs").alias("career_runs"),
        F.sum("all_wickets").alias("career_wickets"),
    )
    known = players.groupBy("player_id").agg(F.min("name").alias("name"), F.min("external_id").alias("external_id"))
    return totals.join(known, "player_id", "left").select(
        "player_id", F.coalesce("name", "player_id").alias("name"), "external_id", "gender", "career_matches", "career_runs", "career_wickets"
    )


def career_coverage(balls: DataFrame) -> DataFrame:
    return coverage_of(player_innings(balls))


#: Where the coverage comes from and what is said of it.
COVERAGE_SOURCE, COVERAGE_NOTE = "BALL_BY_BALL", "Open ball-by-ball coverage only; not an official complete career total."


def coverage_of(lines: DataFrame) -> DataFrame:
    """First and last date and number of the matches each (player, class) is known from, with source and note."""
    return coverage_from(career_sums(lines))


def coverage_from(sums: DataFrame) -> DataFrame:
    return sums.select(
        *KEY,
        F.col("first_date").alias("first_match_date"),
        F.col("last_date").alias("last_match_date"),
        F.col("matches").alias("matches_covered"),
        F.lit(COVERAGE_SOURCE).alias("source"),
        F.lit(COVERAGE_NOTE).alias("coverage_note"),
    )


def career_totals(careers: DataFrame) -> DataFrame:
    """Headline totals of each player over all classes."""
    return careers.groupBy("player_id").agg(
        F.sum("matches").alias("matches"), F.sum("runs").alias("runs"), F.sum("wickets").alias("wickets")
    )
