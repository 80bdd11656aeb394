"""Queries of the lists, texts, performance lines, parsers and incremental steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions import rules, texts
from crease.ml import chase
from crease.operators import careers, editions, identity, lists, paging, performances, ratings, scorecards
from crease.plans import layout, upkeep
from crease.plans.shared import new_folder, written
from crease.sources import adapter, made, matchdocs, pages, shape, teams

Query = Callable[[SparkSession, str], DataFrame]
FLAGS = "https://flags.example"
IMAGES = "https://img.example"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _balls(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(adapter.deliveries(spark, sf_dir))


def _matches(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(adapter.matches(spark, sf_dir))


def _number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    x = (F.col("p_partkey") - 1000) * F.col("p_size") / 64.0
    return p.select(
        "p_partkey",
        texts.fixed(x, 1).alias("one"),
        texts.fixed(x, 2).alias("two"),
        texts.rate_text(x).alias("rate"),
        texts.thousands(F.col("p_partkey") * 12345).alias("grouped"),
        texts.win_percent_text(F.col("p_size") % 7, F.col("p_size") % 5 + F.col("p_size") % 7).alias("win"),
        texts.figures_text(F.col("p_size") % 3, F.col("p_size"), F.col("p_partkey")).alias("figures"),
        texts.high_score_text(F.col("p_size") % 3, F.col("p_size"), F.col("p_partkey") % 2 == 0).alias("high"),
        texts.number_or(F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")), -1.0).alias("number"),
        rules.number_or_null(F.when(F.col("p_size") % 4 == 1, " ").otherwise(F.col("p_size").cast("string"))).alias("maybe"),
        texts.any_text(F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("string")).otherwise(F.lit("  "))).alias("any_text"),
    )


def _scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    floodlit = F.get(F.array(F.lit("night"), F.lit("day/night"), F.lit("day"), F.lit(" "), F.lit(None).cast("string")), (k % 5).cast("int"))
    path = F.when(k % 3 == 0, F.concat(F.lit("http://a/"), "p_brand")).when(k % 3 == 1, F.concat(F.lit("/b/"), "p_brand"))
    uri = F.concat(F.when(k % 2 == 0, "http://c/wiki/Special:FilePath/").otherwise(""), F.lit("My%20File%2B"), k.cast("string"), F.lit(".png"))
    return p.select(
        "p_partkey",
        texts.full_image_url(path, IMAGES).alias("image"),
        texts.image_file(uri).alias("file"),
        rules.last_segment(F.concat(F.lit("http://x/entity/Q"), k.cast("string"))).alias("entity"),
        texts.day_night(floodlit).alias("day_night"),
        texts.crest(F.when(k % 4 == 0, "logo"), F.when(k % 3 == 0, "flag")).alias("crest"),
        texts.kind_label(k % 2 == 0).alias("kind"),
        rules.gender_label(F.when(k % 3 == 0, "male").when(k % 3 == 1, "female")).alias("gender"),
        rules.toss_decision((k % 4).cast("int")).alias("toss"),
        rules.match_state(F.when(k % 4 == 0, "LIVE").when(k % 4 == 1, "POST").when(k % 4 == 2, "PRE"), F.when(k % 5 == 0, True)).alias("state"),
        rules.url_segment(F.when(k % 6 != 0, F.concat(F.col("p_type"), F.lit(" & / "), F.col("p_size").cast("string")))).alias("segment"),
        rules.from_segment(rules.url_segment(F.when(k % 6 != 0, F.col("p_name")))).alias("back"),
        rules.strip_tags(F.concat(F.lit("<b>"), "p_name", F.lit("</b>  <i> x</i>"))).alias("plain"),
        F.concat_ws("|", "p_brand", F.when(k % 2 == 0, F.col("p_type"))).alias("composite"),
        rules.logo_score(F.concat("p_name", F.when(k % 3 == 0, "_logo.svg").when(k % 3 == 1, ".png").otherwise(" stadium.png")), F.col("p_name")).alias("logo_points"),
        rules.best_logo(F.array(F.lit("Flag_of_x.svg"), F.concat("p_name", F.lit(".png")), F.lit("a_logo.svg")), F.col("p_name")).alias("logo"),
        rules.class_from_format(F.get(F.array(*map(F.lit, ["TEST", "ODI", "T20", "T10", "HUNDRED", "x"])), (k % 6).cast("int")), k % 2 == 0).alias("class"),
    )


def _date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.when(F.col("o_orderkey") % 3 != 0, text).otherwise("no date")
    return o.select(
        "o_orderkey",
        F.date_format(texts.date_only(F.try_to_timestamp(said)), "yyyy-MM-dd HH:mm:ss").alias("day"),
        texts.first_day(text).alias("first_day"),
        rules.age_years(F.col("o_orderdate").cast("date"), F.to_date(F.lit("2024-02-28"))).alias("age"),
        texts.date_span(F.when(F.col("o_orderkey") % 4 != 0, F.lit("1997-01-01")), texts.first_day(text)).alias("span"),
    )


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match's nested innings as a text: number, runs and batters in order."""
    balls = adapter.deliveries(spark, sf_dir)
    tree = layout.match_tree(adapter.matches(spark, sf_dir), scorecards.innings_totals(balls), scorecards.batting_card(balls), scorecards.bowling_card(balls))
    inning = lambda i: F.concat(i["innings_no"].cast("string"), F.lit("="), i["runs"].cast("string"), F.lit(":"), F.array_join(F.transform(i["batting"], lambda b: b["player_id"]), ","), F.lit("/"), F.array_join(F.transform(i["bowling"], lambda b: b["player_id"]), ","))
    return tree.select("match_id", F.array_join(F.transform("innings", inning), ";").alias("tree"))


#: Nations below this number go by the name of a national side.
NATIONAL = 18


def _named_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.array(*[F.lit(f" {side.upper().replace(' ', '  ')}") for side, *_ in teams.NATIONAL_TEAMS[:NATIONAL]])
    nations = _table(spark, sf_dir, "nation")
    return nations.select("n_nationkey", F.when(F.col("n_nationkey") < NATIONAL, F.get(sides, F.col("n_nationkey"))).otherwise(F.col("n_name")).alias("name"))


def _team_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams named after nations, in upper case with odd spaces, counted over customers and suppliers."""
    nations = _named_nations(spark, sf_dir)
    home = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).join(nations, "n_nationkey")
    away = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).join(nations, "n_nationkey")
    names = home.select("name").unionByName(away.select("name"))
    return names.groupBy(rules.normal_name(F.col("name")).alias("team")).agg(F.min("name").alias("display_name"), F.count("*").alias("matches"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    logos = spark.createDataFrame([("india", "never"), ("nation_20", "logo-a"), ("nation_22", "logo-b")], "team string, logo_url string")
    return lists.team_profiles(_team_counts(spark, sf_dir), teams.national_teams(spark), logos, FLAGS)


def _badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").join(_named_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    games = c.select("c_custkey", F.concat(F.lit(" "), "name").alias("team_home"), F.when(F.col("c_custkey") % 2 == 0, "nowhere").alias("team_away"))
    return lists.with_badges(games, _profiles(spark, sf_dir))


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return careers.career_players(adapter.deliveries(spark, sf_dir), adapter.players(spark, sf_dir))


def _number(c: str = "player_id") -> F.Column:
    return F.expr(f"cast(substring({c}, 2) as int)")


def _with_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = adapter.players(spark, sf_dir).filter(_number() % 3 == 0).select("player_id", F.concat(F.lit("photo-"), "player_id").alias("photo_url"), F.lit("role").alias("role"))
    return lists.with_profiles(_players(spark, sf_dir), known)


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adapter.players(spark, sf_dir).filter(_number() % 5 == 0)
    return identity.pending_players(_players(spark, sf_dir), done, limit=40)


def _propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = adapter.players(spark, sf_dir)
    i = _number()
    shared = players.select("player_id", F.when(F.col("external_id").isNotNull(), F.concat(F.lit("X"), (F.floor(i / 2) * 2).cast("string"))).alias("external_id"))
    parsed = spark.range(0, 60).select(F.concat(F.lit("X"), (F.col("id") * 2).cast("string")).alias("external_id"), F.when(F.col("id") % 3 != 0, "bowler").alias("role"), F.when(F.col("id") % 4 != 0, "left").alias("batting_style"), F.lit(None).cast("string").alias("bowling_style"))
    known = shared.filter(i % 2 == 0).select("player_id", "external_id", F.lit("old").alias("role"), F.lit("right").alias("batting_style"), F.lit("spin").alias("bowling_style"))
    return identity.propagate_profiles(shared, parsed, known)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scorecards.player_innings(adapter.deliveries(spark, sf_dir))
    stats = careers.careers_of(lines).select("player_id", "match_class", "matches", "runs")
    cover = careers.coverage_of(lines).filter("match_class <> 'TEST'")
    official = stats.filter(_number() % 2 == 0).select("player_id", "match_class", (F.col("runs") + 100).alias("official_runs"))
    return lists.with_coverage(stats, cover, official)


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_orderkey") % 3 != 0).alias("has_scorecard"))
    return lists.missing_scorecards(flagged, _table(spark, sf_dir, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("match_id")))


def _named_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scorecards.player_innings(adapter.deliveries(spark, sf_dir))
    stats, known = careers.careers_of(lines), careers.players_of(lines, adapter.players(spark, sf_dir))
    return lists.named_leaders(editions.format_leaders(stats, "runs"), stats, known, "runs")


def _squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, b = adapter.matches(spark, sf_dir), adapter.deliveries(spark, sf_dir)
    return lists.ordered_squads(editions.edition_squads(m, scorecards.innings_totals(b), scorecards.batting_card(b), scorecards.bowling_card(b)))


def _batted(b: DataFrame) -> DataFrame:
    """Players of an innings who batted, and partners who were out or stayed without facing or scoring."""
    came, not_came = performances.split_batting(performances.batting_performances(b))
    ids = lambda rows, name: rows.groupBy("match_id", "innings_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batting_pos", "player_id"))), lambda x: x["player_id"]), ",").alias(name))
    return ids(came, "batted").join(ids(not_came, "did_not_bat"), ["match_id", "innings_no"], "full_outer")


def _feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "events")
    state = e.filter("event_id % 3 = 0").select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("feed"), F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")).alias("etag"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("last_modified"), (F.col("event_id") % 10).alias("imported"), F.lit(1).cast("long").alias("failed"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id"),
    )
    return e, state


def _feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, patches = _feeds(spark, sf_dir)
    first = spark.range(0, 5).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("feed"), F.lit("start").alias("etag"), F.lit("old").alias("last_modified"), F.lit(5).cast("long").alias("imported"), F.lit(0).cast("long").alias("failed"))
    return identity.feed_state(first, patches.drop("event_id"))


def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("m"))
    name = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    offered = e.select(name.alias("feed"), F.concat(F.lit("e"), (F.col("m") % 4).cast("string")).alias("etag"), F.when(F.col("m") % 3 == 0, "monday").alias("last_modified"))
    known = e.filter("user_id % 4 <> 0").select(name.alias("feed"), F.concat(F.lit("e"), (F.col("user_id") % 4).cast("string")).alias("etag"), F.when(F.col("user_id") % 2 == 0, "monday").alias("last_modified"))
    return identity.refresh_plan(offered, known)


def _ingest_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode's action for each entry."""
    o = _table(spark, sf_dir, "orders")
    entries = o.select(F.col("o_orderkey").alias("match_id"), (F.col("o_orderkey") % 4 + 1).alias("revision"))
    known = entries.filter("match_id % 3 = 0").select("match_id", (F.col("match_id") % 5).alias("revision"))
    plan = lambda name, **mode: identity.ingest_plan(entries, known, **mode).select("match_id", F.col("action").alias(name))
    out = plan("plain", sweep=False)
    for other in (plan("sweep"), plan("cached", sweep=False, from_cache=True), plan("dry", dry_run=True)):
        out = out.join(other, "match_id")
    return out


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job"), F.when(F.col("event_id") % 5 == 0, 120).when(F.col("event_id") % 5 == 1, 3600).otherwise(86400).alias("every_seconds"), (F.col("event_id") % 7 != 0).alias("enabled"), (F.col("event_id") % 11 == 0).alias("running"), F.when(F.col("event_id") % 13 != 0, F.col("ts").cast("timestamp")).alias("last_run"),
    )
    return identity.due_jobs(e, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("job", "every_seconds")


def _crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = pages.with_data(made.fixture_pages(spark, sf_dir), made.ELEMENT)
    found = pages.fixtures(good, made.ELEMENT, f"{made.BASE}.matches")
    return identity.crawl_jobs(found, "HISTORICAL").unionByName(identity.crawl_jobs(found, "LIVE"))


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_type").alias("page_type"), F.col("user_id").cast("string").alias("params"), (F.col("event_id") % 7).cast("int").alias("depth"))
    return identity.crawl_frontier(jobs, jobs.filter("depth = 0").select("page_type", "params").distinct())


def _fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = pages.with_data(made.fixture_pages(spark, sf_dir), made.ELEMENT)
    return pages.fixtures(good, made.ELEMENT, f"{made.BASE}.matches").drop("start_time", "venue", "team_home", "team_away")


def _pages_without_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_data(made.fixture_pages(spark, sf_dir), made.ELEMENT)[1].select("page_id")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        pages.fixtures_url("https://site.example", F.lit("cup"), k).alias("fixtures"),
        pages.scorecard_url("https://site.example", F.lit("cup"), F.col("o_custkey"), F.lit("a-v-b"), k).alias("scorecard"),
        pages.profile_url("https://site.example", F.lit("some-one"), k).alias("profile"),
    )


def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    checks = [("total", F.col("o_totalprice") >= 50000), ("status", F.col("o_orderstatus").isin("O", "F")), ("priority", F.length("o_orderpriority") >= 6)]
    good, bad = identity.contract(o, checks)
    return good.select("o_orderkey", F.lit("").alias("broken")).unionByName(bad.select("o_orderkey", F.array_join("broken", ",").alias("broken")))


def _optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapter.matches(spark, sf_dir)
    return editions.search_matches(m, event="", season="2019").unionByName(editions.search_matches(m, event="League 1", season="")).select("match_id", "event_name", "season")


def _elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.rankings(ratings.elo_ratings(adapter.matches(spark, sf_dir), min_matches=0)).drop("raw_rating")


def _backfill_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapter.matches(spark, sf_dir)
    return identity.class_batches(m, "match_id")


def _player_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _players(spark, sf_dir)
    top = lambda c: lists.top_players(p, c, 10).select(F.lit(c).alias("measure"), "player_id", F.col(c).alias("n"))
    return top("career_runs").unionByName(top("career_wickets"))


def _doc_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    crosswalk = adapter.players(spark, sf_dir).select("player_id", "external_id")
    return matchdocs.deliveries(made.documents(spark, sf_dir), crosswalk).drop("match_type")


def _doc_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchdocs.matches(made.documents(spark, sf_dir)).drop("match_type", "team_type", "player_of_match")


def _doc_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchdocs.players(made.documents(spark, sf_dir), adapter.players(spark, sf_dir).select("player_id", "external_id"))


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of 50 customers each; every third customer is answered twice."""
    c = _table(spark, sf_dir, "customer").withColumn("again", F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k = F.col("c_custkey").cast("string")
    value = lambda x: F.struct(x.alias("value"))
    binding = F.struct(
        value(k).alias("cid"),
        value(F.concat(F.lit("http://e/entity/Q"), k)).alias("item"),
        F.when(F.col("c_custkey") % 2 == 0, value(F.concat(F.lit("http://e/Special:FilePath/A%20"), k, F.lit(".jpg")))).alias("image"),
        value(F.concat(F.lit("1990-01-0"), (F.col("again") + 1).cast("string"), F.lit("T00:00:00Z"))).alias("dob"),
        value(F.when(F.col("c_custkey") % 4 == 0, "Q12").otherwise(F.col("c_mktsegment"))).alias("birthPlaceLabel"),
        F.when(F.col("c_custkey") % 5 == 0, value(F.lit("bowler"))).alias("roleLabel"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("c_custkey", "again", binding.alias("b"))))
    answers = c.groupBy(F.floor(F.col("c_custkey") / 50)).agg(ordered.alias("all"))
    return pages.profile_bindings(answers.select(F.to_json(F.struct(F.struct(F.col("all.b").alias("bindings")).alias("results"))).alias("json")))


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    value = lambda x: F.struct(x.alias("value"))
    meta = F.struct(value(F.concat(F.lit("<a href='x'>"), "c_name", F.lit("</a>"))).alias("Artist"), F.when(F.col("c_custkey") % 2 == 0, value(F.lit("CC <b>BY</b>"))).alias("LicenseShortName"))
    info = F.when(F.col("c_custkey") % 5 != 0, F.array(F.struct(meta.alias("extmetadata"))))
    page = F.struct(F.concat(F.lit("File:"), k, F.lit(".png")).alias("title"), info.alias("imageinfo"))
    answers = c.groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.map_from_entries(F.collect_list(F.struct(k, page))).alias("pages"))
    return pages.image_licenses(answers.select(F.to_json(F.struct(F.struct("pages").alias("query"))).alias("json")))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    team = lambda p, image: F.struct(text(p).alias("name"), F.lit(p).alias("short_name"), F.lit(None).cast("string").alias("primary_color"), image.alias("image"))
    rows = o.select(
        k.alias("match_id"), text("Match ").alias("title"), F.col("o_orderstatus").alias("status_text"), F.lit("ODI").alias("format"), F.lit("LIVE").alias("state"),
        F.when(k % 5 != 0, F.col("o_orderdate")).alias("start_time"),
        F.when(k % 2 == 0, F.struct(F.lit("Cup").alias("name"), F.lit("cup").alias("slug"), F.lit("2024").alias("season"))).alias("series"),
        F.when(k % 3 == 0, F.struct(text("Ground ").alias("name"), F.lit(None).cast("string").alias("city"))).alias("venue"),
        team("H", text("/h")).alias("home"), F.when(k % 4 != 0, team("A", text("http://a/"))).alias("away"),
        F.lit("10/1").alias("home_score"), F.lit(None).cast("string").alias("away_score"),
    )
    return layout.match_objects(rows, IMAGES)


def _rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Innings 2 of every third match comes again with one run more a ball, and less balls."""
    balls = adapter.deliveries(spark, sf_dir).select("match_id", "innings_no", "over_no", "ball_in_over", "runs_total")
    new = balls.filter((F.col("innings_no") == 2) & (F.expr("cast(substring(match_id, 2) as int)") % 3 == 0) & (F.col("over_no") < 10))
    return layout.replace_groups(balls, new.withColumn("runs_total", F.col("runs_total") + 1), ["match_id", "innings_no"])


def _crawl_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of customers: an order of c links to c + 1, of some to c + 2 or c - 10, below 130: chains with cycles, from two seeds."""
    o = _table(spark, sf_dir, "orders")
    step = F.when(F.col("o_orderkey") % 5 == 0, -10).when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1)
    links = o.select(F.col("o_custkey").cast("string").alias("params"), (F.col("o_custkey") + step).alias("next")).filter("next between 1 and 129")
    seed = _table(spark, sf_dir, "customer").filter("c_custkey <= 2").select(F.lit("profile").alias("page_type"), F.col("c_custkey").cast("string").alias("params"), F.lit(0).alias("depth"))
    expand = lambda found: found.join(links, "params").select("page_type", F.col("next").cast("string").alias("params"), (F.col("depth") + 1).alias("depth"))
    return identity.crawl(seed, expand).select("page_type", "params", "depth")


def _upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Careers after two batches: first most matches, some with other scores and seasons and one that is to vanish; then the rest and the corrections."""
    balls, matches = written(adapter.deliveries(spark, sf_dir)), written(adapter.matches(spark, sf_dir))
    number = F.expr("cast(substring(match_id, 2) as int)")
    early, revised = number % 5 != 0, number % 7 == 3
    other = lambda df: df.withColumn("season", F.when(revised, "1999").otherwise(F.col("season")))
    copy = lambda df: df.filter("match_id = 'M3'").withColumn("match_id", F.lit("X3"))
    scored = balls.filter(early).withColumn("runs_batter", F.when(revised, F.col("runs_batter") + 3).otherwise(F.col("runs_batter")))
    gold = upkeep.store(spark, new_folder(spark))
    upkeep.apply_batch(gold, written(other(matches.filter(early)).unionByName(copy(matches))), other(scored).unionByName(copy(balls)))
    late = ~early | revised
    upkeep.apply_batch(gold, written(matches.filter(late)), balls.filter(late), spark.createDataFrame([("X3",)], "match_id string"))
    return careers.career_lines(gold.read("careers"))


def _shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = shape.rules()
    return made.odd_documents(spark, sf_dir, table).select("o_orderkey", F.array_join(shape.reasons(table), "; ").alias("reasons"))


def _chase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = chase.chase_features(adapter.deliveries(spark, sf_dir), adapter.matches(spark, sf_dir))
    return chase.split(features).select("match_id", "ball", "held_out")


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("match_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("start_time"))


def _competitions(m: DataFrame) -> DataFrame:
    return m.groupBy("event_name").agg(F.count("*").alias("total")).withColumn("name", F.coalesce("event_name", F.lit(lists.OTHER_LABEL)))


def _late_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    paging.write_pages(_starts(spark, sf_dir), [F.asc_nulls_last("start_time"), F.asc("match_id")], 37, path)
    return paging.read_page(spark.read.parquet(path), 30).select("match_id", "place", "page")


def queries() -> dict[str, Query]:
    return {
        "crawl_closure": _crawl_closure,
        "career_upkeep": _upkeep,
        "document_rules": _shape,
        "chase_split": _chase_split,
        "competition_places": _matches(lambda m: paging.placed(_competitions(m), [F.desc("total"), F.asc("name")]).select("name", "total", "place")),
        "team_places": lambda s, d: paging.placed(_profiles(s, d), [F.desc("match_count"), F.asc("display_name")]).select("display_name", "match_count", "place"),
        "canonical_places": lambda s, d: paging.placed(_starts(s, d), [F.asc_nulls_last("start_time"), F.asc("match_id")]).select("match_id", "place"),
        "match_page_written": _late_page,
        "number_texts": _number_texts,
        "scalar_texts": _scalar_texts,
        "date_texts": _date_texts,
        "match_texts": _matches(lists.match_texts),
        "match_tree_text": _tree,
        "innings_json": _balls(lambda b: layout.as_json(scorecards.innings_totals(b))),
        "edition_spans": _matches(lambda m: lists.edition_spans(editions.edition_meta(m)).select("event_name", "season", "span")),
        "date_groups": _matches(lambda m: lists.date_groups(m, "event_name", "season").select("match_id", "event_name", "season", "date_group")),
        "over_extents": _balls(lambda b: lists.over_extents(scorecards.overs_json(b))),
        "innings_slice": _balls(lambda b: lists.innings_slice(scorecards.batting_card(b), 2)),
        "batting_performances": _balls(performances.batting_performances),
        "bowling_performances": _balls(performances.bowling_performances),
        "career_by_class": _balls(performances.career_by_class),
        "career_batting_fold": _balls(lambda b: performances.batting_fold(performances.batting_performances(b), "player_id")),
        "career_bowling_fold": _balls(lambda b: performances.bowling_fold(performances.bowling_performances(b), "player_id")),
        "recent_form": _balls(lambda b: performances.recent_form(performances.batting_performances(b)).select("player_id", "place", "match_id", "innings_no", "runs")),
        "batted_split": _balls(_batted),
        "player_top": _player_top,
        "competitions_by_volume": _matches(lambda m: lists.competitions_by_volume(m.groupBy("event_name").agg(F.count("*").alias("total")))),
        "competition_search": _matches(lambda m: lists.competitions_by_volume(m.groupBy("event_name").agg(F.count("*").alias("total")), " LEAGUE ")),
        "team_profiles": _profiles,
        "team_list_national": lambda s, d: lists.list_teams(_profiles(s, d), "IN", True),
        "team_list_leagues": lambda s, d: lists.list_teams(_profiles(s, d), national=False),
        "match_badges": _badges,
        "players_with_profiles": _with_profiles,
        "named_leaders": _named_leaders,
        "pending_players": _pending,
        "profile_propagation": _propagate,
        "career_coverage_official": _coverage,
        "missing_scorecards": _missing,
        "edition_squads_ordered": _squads,
        "canonical_order": lambda s, d: lists.canonical_order(_table(s, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("start_time"))),
        "elo_rankings": _elo,
        "feed_state": _feed_state,
        "feed_totals": lambda s, d: identity.feed_totals(_feeds(s, d)[1]),
        "refresh_plan": _refresh,
        "ingest_plans": _ingest_plans,
        "due_jobs": _due,
        "crawl_jobs": _crawl_jobs,
        "crawl_frontier": _frontier,
        "class_batches": _backfill_batches,
        "contract_split": _contract,
        "optional_filters": _optional,
        "fixture_pages": _fixtures,
        "pages_without_data": _pages_without_data,
        "scorecard_batting_lines": lambda s, d: pages.batting_lines(made.scorecard_pages(s, d), made.BASE),
        "scorecard_bowling_lines": lambda s, d: pages.bowling_lines(made.scorecard_pages(s, d), made.BASE),
        "scorecard_innings": lambda s, d: pages.page_innings(made.scorecard_pages(s, d), made.BASE),
        "player_profile_pages": lambda s, d: pages.source_of("player-profile").parse(made.profile_pages(s, d), made.BASE),
        "page_urls": _urls,
        "profile_bindings": _bindings,
        "image_licenses": _licenses,
        "match_objects": _objects,
        "innings_rewrite": _rewrite,
        "document_deliveries": _doc_deliveries,
        "document_matches": _doc_matches,
        "document_players": _doc_players,
        "document_innings": lambda s, d: matchdocs.innings(made.documents(s, d)),
        "document_squads": lambda s, d: matchdocs.squads(made.documents(s, d)),
    }
