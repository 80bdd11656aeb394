"""Innings, batting and bowling cards, over rollups and match summaries, from ball-by-ball rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crease.functions import rules

INNINGS = ["match_id", "innings_no"]


def count_if(condition) -> F.Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")


def over_rollup(balls: DataFrame) -> DataFrame:
    """Runs, wickets, fours and sixes of each over."""
    return balls.groupBy(*INNINGS, "over_no").agg(
        F.sum("runs_total").alias("r"),
        count_if(F.col("is_wicket")).alias("w"),
        count_if(F.col("runs_batter") == 4).alias("f"),
        count_if(F.col("runs_batter") == 6).alias("s"),
    )


def over_cumulative(balls: DataFrame) -> DataFrame:
    return cumulated(over_rollup(balls))


def cumulated(overs: DataFrame) -> DataFrame:
    """over_cumulative() from over_rollup()."""
    so_far = W.partitionBy(*INNINGS).orderBy("over_no").rowsBetween(W.unboundedPreceding, 0)
    return overs.withColumn("c", F.sum("r").over(so_far))


def overs_json(balls: DataFrame) -> DataFrame:
    """Each innings' overs as one JSON array in over order."""
    return json_of_overs(over_rollup(balls))


def json_of_overs(overs: DataFrame) -> DataFrame:
    """overs_json() from over_rollup()."""
    point = F.struct(F.col("over_no").alias("o"), "r", "w", "f", "s", "c")
    return cumulated(overs).groupBy(*INNINGS).agg(F.to_json(F.array_sort(F.collect_list(point))).alias("overs"))


def innings_totals(balls: DataFrame) -> DataFrame:
    return balls.groupBy(*INNINGS).agg(
        F.min("batting_team").alias("batting_team"),
        F.sum("runs_total").alias("runs"),
        count_if(F.col("is_wicket")).alias("wickets"),
        count_if(rules.is_legal(F.col("extra_type"))).alias("balls"),
    )


def innings_scores(balls: DataFrame) -> DataFrame:
    """Score text of each innings, like 18/2 (1.2)."""
    return scores_of(innings_totals(balls))


def scores_of(totals: DataFrame) -> DataFrame:
    """innings_scores() from innings_totals()."""
    score = rules.score_text(F.col("runs"), F.col("wickets"), F.col("balls"))
    return totals.select(*INNINGS, score.alias("score"))


def match_summary(matches: DataFrame, balls: DataFrame) -> DataFrame:
    """Matches with the scores of their first two innings."""
    return summary_of(matches, innings_totals(balls))


def summary_of(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """match_summary() from innings_totals()."""
    pick = lambda n: F.max(F.when(F.col("innings_no") == n, F.col("score")))
    scores = scores_of(totals).groupBy("match_id").agg(pick(1).alias("inn1_score"), pick(2).alias("inn2_score"))
    return matches.join(scores, "match_id", "left")


def player_innings(balls: DataFrame) -> DataFrame:
    """Batting and bowling figures of each player in each innings, by one aggregation over the roles of every ball.

    A ball counts for its striker (role 0), non-striker (1), dismissed player (2) and bowler (3), with a shuffle of
    partly summed rows only. Cards, careers and coverage are all taken from this table. `bat_first` and `bowl_first`
    are the first ball at either end and as bowler; `was_out` and `dismissal` tell of the first dismissal.
    """
    role = lambda n, who, name=None, kind=None: F.struct(
        F.lit(n).alias("role"), F.col(who).alias("player_id"), (name if name is not None else F.lit(None).cast("string")).alias("name"),
        (kind if kind is not None else F.lit(None).cast("string")).alias("kind"),
    )
    roles = F.array(
        role(0, "batter_id", F.col("batter_name")),
        role(1, "non_striker_id", F.col("non_striker_name")),
        role(2, "player_out_id", kind=F.col("dismissal_kind")),
        role(3, "bowler_id"),
    )
    match = ["match_class", "gender", "match_date"]
    rows = balls.select(
        *INNINGS, *match, "over_no", "ball_in_over", "runs_batter", "runs_extras", "extra_type", "dismissal_kind", F.inline(roles)
    ).filter("player_id is not null")
    is_role = lambda *n: F.col("role").isin(*n)
    strikes, leaves, bowls = is_role(0), is_role(2), is_role(3)
    only = lambda when, x: F.when(when, x)
    # a ball's place as one number, and texts as keys: so the many rows of balls are summed by hash, without a sort
    ball = F.col("over_no").cast("long") * 2**20 + F.col("ball_in_over") * 4
    parts = rows.groupBy(*INNINGS, "player_id", *match, "name", "kind").agg(
        F.min(only(is_role(0, 1), ball + F.col("role"))).alias("bat_at"),
        count_if(strikes).alias("strikes"),
        F.sum(only(strikes, F.col("runs_batter"))).alias("runs"),
        count_if(strikes & rules.is_faced(F.col("extra_type"))).alias("balls"),
        count_if(strikes & (F.col("runs_batter") == 4)).alias("fours"),
        count_if(strikes & (F.col("runs_batter") == 6)).alias("sixes"),
        F.min(only(leaves, ball)).alias("out_at"),
        F.min(only(bowls, ball)).alias("bowl_at"),
        count_if(bowls & rules.is_legal(F.col("extra_type"))).alias("bowl_balls"),
        F.sum(only(bowls, rules.charged_runs(F.col("runs_batter"), F.col("extra_type"), F.col("runs_extras")))).alias("conceded"),
        count_if(bowls & rules.bowler_wicket(F.col("dismissal_kind"))).alias("wickets"),
    )
    lines = parts.groupBy(*INNINGS, "player_id").agg(
        *[F.min(c).alias(c) for c in match],
        F.min("name").alias("bat_name"),
        F.min("bat_at").alias("bat_at"),
        *[F.sum(c).alias(c) for c in ("strikes", "runs", "balls", "fours", "sixes")],
        F.min_by("kind", "out_at").alias("dismissal"),
        F.min("out_at").alias("out_at"),
        F.min("bowl_at").alias("bowl_at"),
        *[F.sum(c).alias(c) for c in ("bowl_balls", "conceded", "wickets")],
    )
    over = lambda at: F.shiftright(at, 20).cast("int").alias("over_no")
    in_over = lambda at: F.shiftright(at.bitwiseAND(2**20 - 1), 2).cast("int").alias("ball_in_over")
    bat, bowl = F.col("bat_at"), F.col("bowl_at")
    return lines.select(
        *INNINGS,
        "player_id",
        *match,
        "bat_name",
        F.when(bat.isNotNull(), F.struct(over(bat), in_over(bat), bat.bitwiseAND(3).cast("int").alias("role"))).alias("bat_first"),
        *["strikes", "runs", "balls", "fours", "sixes"],
        F.col("out_at").isNotNull().alias("was_out"),
        "dismissal",
        F.when(bowl.isNotNull(), F.struct(over(bowl), in_over(bowl))).alias("bowl_first"),
        *["bowl_balls", "conceded", "wickets"],
    )


def dismissals(balls: DataFrame) -> DataFrame:
    """How each dismissed player of an innings was first out."""
    return (
        balls.filter("player_out_id is not null")
        .groupBy(*INNINGS, F.col("player_out_id").alias("player_id"))
        .agg(F.min_by("dismissal_kind", F.struct("over_no", "ball_in_over")).alias("dismissal"))
    )


def batting_order(balls: DataFrame) -> DataFrame:
    """Players of an innings by first appearance, strikers before non-strikers of the same ball, then by id."""
    return card_of_batting(player_innings(balls)).select(*INNINGS, "player_id", "name", F.col("batting_pos").alias("pos"))


def card_of_batting(lines: DataFrame) -> DataFrame:
    """The batting card from player_innings()."""
    place = W.partitionBy(*INNINGS).orderBy("bat_first", "player_id")
    return lines.filter("bat_first is not null").select(
        *INNINGS,
        F.row_number().over(place).alias("batting_pos"),
        "player_id",
        F.col("bat_name").alias("name"),
        F.coalesce("runs", F.lit(0)).alias("runs"),
        "balls",
        "fours",
        "sixes",
        rules.ratio2(F.col("runs") * 100, F.col("balls")).alias("strike_rate"),
        F.col("was_out").alias("out"),
        "dismissal",
    )


def batting_card(balls: DataFrame) -> DataFrame:
    return card_of_batting(player_innings(balls))


def bowler_overs(balls: DataFrame) -> DataFrame:
    """Charged runs and legal balls of each bowler's overs."""
    return (
        balls.filter("bowler_id is not null")
        .groupBy(*INNINGS, F.col("bowler_id").alias("player_id"), "over_no")
        .agg(
            F.sum(rules.charged_runs(F.col("runs_batter"), F.col("extra_type"), F.col("runs_extras"))).alias("r"),
            count_if(rules.is_legal(F.col("extra_type"))).alias("legal"),
            count_if(rules.bowler_wicket(F.col("dismissal_kind"))).alias("w"),
            F.min("bowler_name").alias("name"),
            F.min("ball_in_over").alias("first_ball"),
        )
    )


def maiden_overs(balls: DataFrame, least_balls: int = 6) -> DataFrame:
    """Overs without charged runs; least_balls 0 also counts unfinished ones."""
    return (
        bowler_overs(balls)
        .groupBy(*INNINGS, "player_id")
        .agg(count_if((F.col("r") == 0) & (F.col("legal") >= least_balls)).alias("maidens"))
    )


def bowling_card(balls: DataFrame, least_balls: int = 6, balls_per_over: int = 6) -> DataFrame:
    """Bowlers of an innings in order of their first ball; figures and maidens come from one rollup by over."""
    return card_of_bowling(bowler_overs(balls), least_balls, balls_per_over)


def card_of_bowling(overs: DataFrame, least_balls: int = 6, balls_per_over: int = 6) -> DataFrame:
    """bowling_card() from bowler_overs()."""
    figures = (
        overs.groupBy(*INNINGS, "player_id")
        .agg(
            F.min(F.struct("over_no", "first_ball")).alias("first"),
            F.min("name").alias("name"),
            F.sum("legal").alias("balls"),
            count_if((F.col("r") == 0) & (F.col("legal") >= least_balls)).alias("maidens"),
            F.sum("r").alias("runs"),
            F.sum("w").alias("wickets"),
        )
    )
    place = W.partitionBy(*INNINGS).orderBy("first", "player_id")
    return figures.select(
        *INNINGS,
        F.row_number().over(place).alias("bowling_pos"),
        "player_id",
        "name",
        "balls",
        "maidens",
        "runs",
        "wickets",
        rules.ratio2(F.col("runs"), F.col("balls") / float(balls_per_over), F.col("balls") > 0).alias("economy"),
    )


def over_parts(balls: DataFrame) -> DataFrame:
    """The balls of each over summed by bowler: overs, innings and bowling cards can all be taken from this one pass.

    Texts are keys, so that the many rows of balls are summed by hash, without a sort.
    """
    charged = rules.charged_runs(F.col("runs_batter"), F.col("extra_type"), F.col("runs_extras"))
    return balls.groupBy(*INNINGS, "over_no", "batting_team", "bowler_id", "bowler_name").agg(
        F.sum("runs_total").alias("r"),
        count_if(F.col("is_wicket")).alias("w"),
        count_if(F.col("runs_batter") == 4).alias("f"),
        count_if(F.col("runs_batter") == 6).alias("s"),
        count_if(rules.is_legal(F.col("extra_type"))).alias("legal"),
        F.sum(charged).alias("charged"),
        count_if(rules.bowler_wicket(F.col("dismissal_kind"))).alias("taken"),
        F.min("ball_in_over").alias("first_ball"),
    )


def rollup_of(parts: DataFrame) -> DataFrame:
    """over_rollup() from over_parts()."""
    return parts.groupBy(*INNINGS, "over_no").agg(*[F.sum(c).alias(c) for c in ("r", "w", "f", "s")])


def totals_of(parts: DataFrame) -> DataFrame:
    """innings_totals() from over_parts()."""
    return parts.groupBy(*INNINGS).agg(
        F.min("batting_team").alias("batting_team"), F.sum("r").alias("runs"), F.sum("w").alias("wickets"), F.sum("legal").alias("balls")
    )


def bowler_overs_of(parts: DataFrame) -> DataFrame:
    """bowler_overs() from over_parts()."""
    return (
        parts.filter("bowler_id is not null")
        .groupBy(*INNINGS, F.col("bowler_id").alias("player_id"), "over_no")
        .agg(
            F.sum("charged").alias("r"),
            F.sum("legal").alias("legal"),
            F.sum("taken").alias("w"),
            F.min("bowler_name").alias("name"),
            F.min("first_ball").alias("first_ball"),
        )
    )
