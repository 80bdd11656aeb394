"""Sums that must agree across tables, and rules by example."""

from pyspark.sql import functions as F

from crease.functions import rules
from crease.ml import chase
from crease.operators import careers, editions, identity, ratings, scorecards
from crease.sources import adapter, pages

#: Accuracy and area under the curve of the chase model on the held-out matches of the table.
CHASE = (0.69, 0.74)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_runs_agree(spark, sf_dir):
    balls = adapter.deliveries(spark, sf_dir).cache()
    innings, overs, batting = scorecards.innings_totals(balls), scorecards.over_cumulative(balls), scorecards.batting_card(balls)
    runs = total(innings, "runs")
    assert total(overs, "r") == runs
    assert total(overs.groupBy("match_id", "innings_no").agg(F.max("c").alias("c")), "c") == runs
    assert total(batting, "runs") + total(balls, "runs_extras") == runs
    stats = careers.career_stats(balls)
    assert stats.filter("not_outs > bat_innings or high_score > runs").count() == 0
    assert stats.join(careers.career_coverage(balls), ["player_id", "match_class"], "left").filter("matches <> matches_covered or matches_covered is null").count() == 0
    balls.unpersist()


def test_points_agree(spark, sf_dir):
    matches = adapter.matches(spark, sf_dir)
    table = editions.standings(matches, scorecards.innings_totals(adapter.deliveries(spark, sf_dir)))
    assert total(table, "points") == 2 * matches.count()
    assert total(table, "won") == total(table, "lost")


def test_elo_is_zero_sum_and_equals_a_plain_replay(spark, sf_dir):
    matches = adapter.matches(spark, sf_dir)
    rated = {(r.match_class, r.team): r.raw_rating for r in ratings.elo_ratings(matches, min_matches=0).collect()}
    plain = {}
    for m in sorted(matches.collect(), key=lambda m: (m.match_date or "", m.match_id)):
        home, away = (m.match_class, m.team_home), (m.match_class, m.team_away)
        a, b = plain.get(home, 1500), plain.get(away, 1500)
        score = {m.team_home: 1, m.team_away: 0}.get(m.outcome_winner, 0.5)
        gain = 32 * (score - 1 / (1 + 10 ** ((b - a) / 400)))
        plain[home], plain[away] = a + gain, b - gain
    assert rated.keys() == plain.keys()
    assert all(abs(rated[k] - plain[k]) < 1e-9 for k in plain)
    assert abs(sum(rated.values()) - 1500 * len(rated)) < 1e-6


def test_chase_model(spark):
    """The model as it is meant, 150 trees of depth 4: far better than chance on matches that it has not seen, and the same each time."""
    sf_dir = "/root/testdata/sf0.01"
    features = chase.chase_features(adapter.deliveries(spark, sf_dir), adapter.matches(spark, sf_dir)).cache()
    sides = chase.split(features).groupBy("match_id").agg(F.count_distinct("held_out").alias("n"), F.first("held_out").alias("held"))
    assert sides.filter("n > 1").count() == 0 and 0.1 < sides.filter("held").count() / sides.count() < 0.3
    model, accuracy, area, importances = chase.train(features)
    assert model.getNumTrees == 150 and max(t.depth for t in model.trees) == 4
    assert abs(sum(importances.values()) - 1) < 1e-6
    print(f"accuracy {accuracy:.4f}, area under the curve {area:.4f}")
    assert (round(accuracy, 2), round(area, 2)) == CHASE
    _, _, again, _ = chase.train(features.repartition(7), rounds=5)
    _, _, other, _ = chase.train(features.repartition(2), rounds=5)
    assert abs(again - other) < 0.02
    p = chase.win_probability(model, features.limit(3)).collect()
    assert all(0 <= r.win_probability <= 1 for r in p)
    features.unpersist()


def test_paging():
    assert editions.page_of(0, 0, 10) == (1, 1)
    assert editions.page_of(9, 21, 10) == (3, 3)
    assert editions.page_of(2, 21, 10) == (2, 3)


def test_text_rules(spark):
    row = spark.range(1).select(
        rules.url_segment(F.lit("A B/ç")).alias("a"),
        rules.from_segment(F.lit("A%20B%2F%C3%A7")).alias("b"),
        rules.url_segment(F.lit(None).cast("string")).alias("c"),
        rules.strip_tags(F.lit("<b>x</b>\n y")).alias("d"),
        rules.acronym(F.lit("The League of Nine Stars (old)")).alias("e"),
        rules.logo_score(F.lit("LNS_logo.svg"), F.lit("League of Nine Stars")).alias("f"),
        rules.best_logo(F.array(F.lit("Flag_of_x.svg"), F.lit("stars.png"), F.lit("File:LNS.svg")), F.lit("League of Nine Stars")).alias("g"),
        rules.overs_text(F.lit(13)).alias("h"),
        rules.age_years(F.to_date(F.lit("2000-02-29")), F.to_date(F.lit("2024-02-28"))).alias("i"),
        rules.number_or_null(F.lit(" ")).alias("j"),
        rules.number_or_null(F.lit("1e999")).alias("k"),
        rules.number_or_null(F.lit("2.5")).alias("l"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("A%20B%2F%C3%A7", "A B/ç", "-", "x y", "LNS", 8)
    assert (row.g, row.h, row.i, row.j, row.k, row.l) == ("File:LNS.svg", "2.1", 23, None, None, 2.5)


def test_pages(spark):
    html = '<html><title> A <b>b</b>\n c</title><script id="D" type="x">{"p": {"matches": [{"id": 7, "title": "F", "state": "POST", "format": "T20I"}]}}</script>'
    rows = spark.createDataFrame([(1, html), (2, "<p>none"), (3, '<script id="D">{</script>')], "page_id long, html string")
    good, bad = pages.with_data(rows, "D")
    assert sorted(r.page_id for r in bad.collect()) == [2, 3]
    m = pages.fixtures(good, "D", "p.matches").first()
    assert (m.match_id, m.format, m.state, m.has_scorecard) == ("7", "T20", "COMPLETED", False)
    assert {r.page_id: r.title for r in pages.titles(rows).collect()} == {1: "A b c", 2: None, 3: None}


def test_feed_state(spark):
    state = spark.createDataFrame([("f", "e1", "m1", 5, 1)], "feed string, etag string, last_modified string, imported long, failed long")
    patches = spark.sql("select 'f' feed, 'e2' etag, cast(null as string) last_modified, 2L imported, 0L failed, timestamp'2024-01-01' at")
    r = identity.feed_state(state, patches).first()
    assert (r.etag, r.last_modified, r.imported, r.failed) == ("e2", "m1", 7, 1)


def test_frontier(spark):
    jobs = spark.createDataFrame([("a", "1", 2), ("a", "1", 1), ("b", "2", 0)], "page_type string, params string, depth int")
    seen = spark.createDataFrame([("b", "2")], "page_type string, params string")
    assert [(r.page_type, r.depth) for r in identity.crawl_frontier(jobs, seen).collect()] == [("a", 1)]
