"""Chase states as features, and a boosted-tree win probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEATURES = ["ball", "runs", "wkts", "wickets_in_hand", "runs_needed", "balls_left", "req_run_rate", "is_t20"]


def chase_features(balls: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per ball of a second innings in one-day and T20 internationals with a result."""
    d = balls.filter(F.col("match_class").isin("T20I", "ODI") & F.col("batter_id").isNotNull())
    target = d.filter("innings_no = 1").groupBy("match_id").agg(F.sum("runs_total").alias("target")).filter("target > 0")
    so_far = W.partitionBy("match_id").orderBy("over_no", "ball_in_over").rowsBetween(W.unboundedPreceding, 0)
    order = W.partitionBy("match_id").orderBy("over_no", "ball_in_over")
    chase = d.filter("innings_no = 2").select(
        "match_id",
        "batting_team",
        "match_class",
        F.row_number().over(order).alias("ball"),
        F.sum("runs_total").over(so_far).alias("runs"),
        F.sum(F.col("is_wicket").cast("int")).over(so_far).alias("wkts"),
    )
    results = matches.filter("outcome_winner is not null").select("match_id", "outcome_winner")
    most = F.when(F.col("match_class") == "T20I", 120).otherwise(300)
    left = most - F.col("ball")
    needed = F.col("target") + 1 - F.col("runs")
    return (
        chase.join(target, "match_id")
        .join(results, "match_id")
        .select(
            "match_id",
            most.alias("max_balls"),
            "ball",
            "runs",
            "wkts",
            (10 - F.col("wkts")).alias("wickets_in_hand"),
            needed.alias("runs_needed"),
            left.alias("balls_left"),
            (F.col("match_class") == "T20I").cast("int").alias("is_t20"),
            (F.col("outcome_winner") == F.col("batting_team")).cast("int").alias("won"),
            (needed / (F.greatest(left, F.lit(1)) / 6.0)).alias("req_run_rate"),
        )
    )


def split(features: DataFrame, test_share: float = 0.2) -> DataFrame:
    """The rows with `held_out`: by a hash of the match, so that the balls of a match stand on one side, however the rows are partitioned."""
    return features.withColumn("held_out", F.conv(F.substring(F.md5("match_id"), 1, 8), 16, 10).cast("long") % 1000 < round(test_share * 1000))


def train(features: DataFrame, depth: int = 4, rounds: int = 150, seed: int = 42, test_share: float = 0.2):
    """Fit on the matches that are not held out: the model, accuracy and area under the curve on the others, importances."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(split(features, test_share))
    rows = rows.select("features", F.col("won").cast("double").alias("label"), "held_out")
    model = GBTClassifier(maxDepth=depth, maxIter=rounds, seed=seed).fit(rows.filter("NOT held_out").drop("held_out"))
    scored = model.transform(rows.filter("held_out"))
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)
    area = BinaryClassificationEvaluator().evaluate(scored)
    return model, accuracy, area, dict(zip(FEATURES, model.featureImportances.toArray().tolist(), strict=True))


def win_probability(model, state: DataFrame) -> DataFrame:
    """Probability of a win for rows with the feature columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(state))
    return scored.select(*FEATURES, F.get(vector_to_array("probability"), 1).alias("win_probability"))
