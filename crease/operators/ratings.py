"""Elo ratings: an order-dependent replay of results in each class."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rating of a new team, weight of a result, scale.
BASE, K, SCALE = 1500.0, 32.0, 400.0


def replay(results: pd.DataFrame) -> pd.DataFrame:
    """Ratings of the teams of one class after its results in order."""
    rating: dict[str, float] = {}
    tally: dict[str, list[int]] = {}
    order = results.sort_values(["date_key", "match_id"], kind="stable")
    for home, away, winner in zip(order["team_home"], order["team_away"], order["outcome_winner"], strict=True):
        h, a = rating.get(home, BASE), rating.get(away, BASE)
        expected = 1 / (1 + 10 ** ((a - h) / SCALE))
        score = 1.0 if winner == home else 0.0 if winner == away else 0.5
        rating[home] = h + K * (score - expected)
        rating[away] = a + K * (expected - score)
        for team, won in ((home, score == 1), (away, score == 0)):
            t = tally.setdefault(team, [0, 0, 0])
            t[0] += 1
            t[1] += won
            t[2] += score != 0.5 and not won
    name = results["match_class"].iloc[0]
    return pd.DataFrame(
        [(name, team, *t, rating[team]) for team, t in tally.items()],
        columns=["match_class", "team", "played", "won", "lost", "raw_rating"],
    )


def elo_ratings(matches: DataFrame, classes: list[str] | None = None, min_matches: int = 15) -> DataFrame:
    """Ratings of teams by class, chronologically (no date first, then by match id); at least min_matches games.

    A rating depends on the one before it, so a class is replayed in one task; a task gets four short columns of its
    matches, tens of bytes a match. No result, tie and draw count as half a win.
    """
    rows = matches.filter("team_home is not null and team_away is not null and team_home <> team_away")
    if classes:
        rows = rows.filter(F.col("match_class").isin(classes))
    rated = (
        rows.select(
            "match_class", "match_id", F.coalesce("match_date", F.lit("")).alias("date_key"), "team_home", "team_away", "outcome_winner"
        )
        .groupBy("match_class")
        .applyInPandas(replay, "match_class string, team string, played long, won long, lost long, raw_rating double")
    )
    return rated.filter(F.col("played") >= min_matches).withColumn("rating", F.floor(F.col("raw_rating") + 0.5).cast("long"))
