"""Performance lines of the relational store, and career lines, form and splits folded from them.

These lines differ from the cards: only strikers and dismissed players bat, the last dismissal counts, an over of any
length without charged runs is a maiden, and a figure has the two decimals of its binary value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crease.functions import rules, texts
from crease.operators.scorecards import INNINGS, count_if


def batting_performances(balls: DataFrame) -> DataFrame:
    """Batting lines in order of first sight: the striker of a ball comes before a partner who is out on it."""
    out = F.col("is_wicket") & F.col("dismissal_kind").isNotNull()
    seen = F.array(
        F.struct(F.lit(0).alias("role"), F.col("batter_id").alias("player_id")),
        F.struct(F.lit(1).alias("role"), F.when(out, F.col("player_out_id")).alias("player_id")),
    )
    rows = balls.select(
        *INNINGS, "match_class", "match_date", "over_no", "ball_in_over", "runs_batter", "extra_type", "dismissal_kind", F.inline(seen)
    ).filter("player_id is not null")
    bats, leaves = F.col("role") == 0, F.col("role") == 1
    lines = rows.groupBy(*INNINGS, "player_id").agg(
        F.min("match_class").alias("match_class"),
        F.min("match_date").alias("match_date"),
        F.min(F.struct("over_no", "ball_in_over", "role")).alias("first"),
        F.coalesce(F.sum(F.when(bats, F.col("runs_batter"))), F.lit(0)).alias("runs"),
        count_if(bats & rules.is_faced(F.col("extra_type"))).alias("balls"),
        count_if(bats & (F.col("runs_batter") == 4)).alias("fours"),
        count_if(bats & (F.col("runs_batter") == 6)).alias("sixes"),
        F.max_by(F.when(leaves, rules.dismissal_token(F.col("dismissal_kind"))), F.when(leaves, F.struct("over_no", "ball_in_over"))).alias("how"),
    )
    place = W.partitionBy(*INNINGS).orderBy("first", "player_id")
    rate = F.when(F.col("balls") > 0, texts.fixed_number(F.col("runs").cast("double") / F.col("balls") * 100, 2))
    return lines.select(
        *INNINGS,
        "player_id",
        "match_class",
        "match_date",
        F.row_number().over(place).alias("batting_pos"),
        *["runs", "balls", "fours", "sixes"],
        rate.alias("strike_rate"),
        F.coalesce("how", F.lit("NOT_OUT")).alias("dismissal"),
    )


def bowling_performances(balls: DataFrame) -> DataFrame:
    """Bowling lines; a maiden is an over of any length without charged runs."""
    charged = rules.charged_runs(F.col("runs_batter"), F.col("extra_type"), F.col("runs_extras"))
    overs = (
        balls.filter("bowler_id is not null")
        .groupBy(*INNINGS, F.col("bowler_id").alias("player_id"), "over_no")
        .agg(
            F.min("match_class").alias("match_class"),
            F.min("match_date").alias("match_date"),
            count_if(rules.is_legal(F.col("extra_type"))).alias("legal"),
            F.sum(charged).alias("r"),
            count_if(F.col("is_wicket") & rules.bowler_wicket(F.col("dismissal_kind"))).alias("w"),
        )
    )
    lines = overs.groupBy(*INNINGS, "player_id").agg(
        F.min("match_class").alias("match_class"),
        F.min("match_date").alias("match_date"),
        F.sum("legal").alias("balls"),
        count_if(F.col("r") == 0).alias("maidens"),
        F.sum("r").alias("runs"),
        F.sum("w").alias("wickets"),
    )
    economy = F.when(F.col("balls") > 0, texts.fixed_number(F.col("runs") / (F.col("balls") / 6.0), 2))
    return lines.withColumns({"overs_text": rules.overs_text(F.col("balls")), "economy": economy})


def came_to_bat() -> F.Column:
    """Whether a batting line's player came to the crease."""
    return (F.col("balls") > 0) | (F.col("runs") > 0) | (F.col("dismissal") != "NOT_OUT")


def split_batting(batting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those who batted, and those who did not."""
    return batting.filter(came_to_bat()), batting.filter(~came_to_bat())


def batting_fold(batting: DataFrame, *key: str) -> DataFrame:
    """Career lines from batting lines: unrounded rates; the highest score keeps its star on a tie."""
    runs, out = F.col("runs"), F.col("dismissal") != "NOT_OUT"
    table = batting.groupBy(*key).agg(
        F.count("*").alias("innings"),
        count_if(~out).alias("not_outs"),
        F.sum("runs").alias("runs"),
        F.sum("balls").alias("balls"),
        count_if((runs >= 50) & (runs < 100)).alias("fifties"),
        count_if(runs >= 100).alias("hundreds"),
        count_if((runs == 0) & out).alias("zeros"),
        F.sum("fours").alias("fours"),
        F.sum("sixes").alias("sixes"),
        F.max(F.struct("runs", (~out).alias("star"))).alias("high"),
    )
    outs = F.col("innings") - F.col("not_outs")
    return table.withColumns(
        {
            "average": F.when(outs > 0, F.col("runs").cast("double") / outs),
            "strike_rate": F.when(F.col("balls") > 0, F.col("runs").cast("double") / F.col("balls") * 100),
            "high_score": texts.high_score_text(F.col("innings"), F.col("high.runs"), F.col("high.star")),
        }
    ).drop("high")


def bowling_fold(bowling: DataFrame, *key: str) -> DataFrame:
    """Career lines from bowling lines: unrounded rates, best figures by most wickets, then fewest runs."""
    runs, balls, wickets = F.col("runs"), F.col("balls"), F.col("wickets")
    table = bowling.groupBy(*key).agg(
        F.count("*").alias("innings"),
        F.sum("wickets").alias("wickets"),
        F.sum("runs").alias("runs"),
        F.sum("balls").alias("balls"),
        count_if(wickets >= 5).alias("five_wickets"),
        F.max(F.struct("wickets", (-runs).alias("saved"))).alias("top"),
    )
    return table.withColumns(
        {
            "economy": F.when(balls > 0, runs / (balls / 6.0)),
            "average": F.when(wickets > 0, runs.cast("double") / wickets),
            "strike_rate": F.when(wickets > 0, balls.cast("double") / wickets),
            "best": texts.figures_text(F.col("innings"), F.col("top.wickets"), -F.col("top.saved")),
        }
    ).drop("top")


def career_by_class(balls: DataFrame) -> DataFrame:
    """A line of each player in each class, from either kind of performance, with the matches of both.

    One pass over the balls gives each player's part in an innings, as striker, as the one who leaves and as bowler; these
    lines go to their players once, where matches are told apart and summed.
    """
    out = F.col("is_wicket") & F.col("dismissal_kind").isNotNull()
    role = lambda n, who: F.struct(F.lit(n).alias("role"), who.alias("player_id"))
    parts = F.array(role(0, F.col("batter_id")), role(1, F.when(out, F.col("player_out_id"))), role(2, F.col("bowler_id")))
    columns = ["match_class", "over_no", "ball_in_over", "runs_batter", "runs_extras", "extra_type", "is_wicket", "dismissal_kind"]
    rows = balls.select(*INNINGS, *columns, F.inline(parts)).filter("player_id is not null")
    bats, leaves, bowls = (F.col("role") == n for n in range(3))
    charged = rules.charged_runs(F.col("runs_batter"), F.col("extra_type"), F.col("runs_extras"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    # texts as keys and a ball's place as one number: the rows of balls are summed by hash, without a sort
    how = F.when(leaves, rules.dismissal_token(F.col("dismissal_kind")))
    place = F.col("over_no").cast("long") * 2**20 + F.col("ball_in_over")
    pieces = rows.withColumn("how", how).groupBy(*INNINGS, "player_id", "match_class", "how").agg(
        count_if(bats | leaves).alias("batted"),
        zero(F.sum(F.when(bats, F.col("runs_batter")))).alias("runs"),
        count_if(bats & rules.is_faced(F.col("extra_type"))).alias("balls"),
        count_if(bats & (F.col("runs_batter") == 4)).alias("fours"),
        count_if(bats & (F.col("runs_batter") == 6)).alias("sixes"),
        F.max(F.when(leaves, place)).alias("left_at"),
        count_if(bowls).alias("bowled"),
        count_if(bowls & rules.is_legal(F.col("extra_type"))).alias("legal"),
        zero(F.sum(F.when(bowls, charged))).alias("conceded"),
        count_if(bowls & F.col("is_wicket") & rules.bowler_wicket(F.col("dismissal_kind"))).alias("taken"),
    )
    lines = pieces.groupBy(*INNINGS, "player_id").agg(
        F.coalesce(F.min("match_class"), F.lit("OTHER")).alias("match_class"),
        (F.sum("batted") > 0).alias("batted"),
        *[F.sum(c).alias(c) for c in ("runs", "balls", "fours", "sixes")],
        F.max_by("how", "left_at").alias("how"),
        (F.sum("bowled") > 0).alias("bowled"),
        *[F.sum(c).alias(c) for c in ("legal", "conceded", "taken")],
    )
    key = ["player_id", "match_class"]
    batted, bowled = F.col("batted"), F.col("bowled")
    left, runs = F.coalesce("how", F.lit("NOT_OUT")) != "NOT_OUT", F.col("runs")
    counts = {
        "bat_innings": batted, "bat_not_outs": batted & ~left, "bat_fifties": batted & (runs >= 50) & (runs < 100), "bat_hundreds": batted & (runs >= 100),
        "bat_zeros": batted & (runs == 0) & left, "bowl_innings": bowled, "bowl_five_wickets": bowled & (F.col("taken") >= 5),
    }
    sums = {"bat_runs": runs, "bat_balls": F.col("balls"), "bat_fours": F.col("fours"), "bat_sixes": F.col("sixes"), "bowl_wickets": F.col("taken"), "bowl_runs": F.col("conceded"), "bowl_balls": F.col("legal")}
    high, top = F.struct(runs.alias("runs"), (~left).alias("star")), F.struct(F.col("taken").alias("wickets"), (-F.col("conceded")).alias("saved"))
    by_match = (
        lines.repartition("player_id")
        .groupBy(*key, "match_id")
        .agg(
            *[count_if(x).alias(c) for c, x in counts.items()],
            *[F.sum(x).alias(c) for c, x in sums.items()],
            F.max(F.when(batted, high)).alias("high"),
            F.max(F.when(bowled, top)).alias("top"),
        )
    )
    both = by_match.groupBy(*key).agg(F.count("*").alias("matches"), *[F.sum(c).alias(c) for c in (*counts, *sums)], F.max("high").alias("high"), F.max("top").alias("top"))
    per = lambda x, n, times=1: F.when(F.col(n) > 0, F.col(x).cast("double") / F.col(n) * times)
    outs = F.col("bat_innings") - F.col("bat_not_outs")
    return both.withColumns(
        {
            "bat_average": F.when(outs > 0, F.col("bat_runs").cast("double") / outs),
            "bat_strike_rate": per("bat_runs", "bat_balls", 100),
            "bat_high_score": texts.or_dash(texts.high_score_text(F.col("bat_innings"), F.col("high.runs"), F.col("high.star"))),
            "bowl_economy": F.when(F.col("bowl_balls") > 0, F.col("bowl_runs") / (F.col("bowl_balls") / 6.0)),
            "bowl_average": per("bowl_runs", "bowl_wickets"),
            "bowl_strike_rate": per("bowl_balls", "bowl_wickets"),
            "bowl_best": texts.or_dash(texts.figures_text(F.col("bowl_innings"), F.col("top.wickets"), -F.col("top.saved"))),
            "has_batting": F.col("bat_innings") > 0,
            "has_bowling": F.col("bowl_innings") > 0,
            "display_order": rules.class_rank(F.col("match_class")),
        }
    ).drop("high", "top")


def recent_form(batting: DataFrame, k: int = 12) -> DataFrame:
    """Each player's newest batting lines; undated matches come last."""
    newest = W.partitionBy("player_id").orderBy(F.desc_nulls_last("match_date"), "match_id", "innings_no")
    return batting.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= k)
