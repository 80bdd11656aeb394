"""Identities and merges: crosswalks, updates that never lose a value, revisions, class backfill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions import rules
from crease.plans.shared import new_folder, written


def merge_keep_known(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert by key in which a null of the new row never overwrites a known value."""
    values = [c for c in old.columns if c not in key]
    renamed = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in values])
    return old.join(renamed, key, "full_outer").select(*key, *[F.coalesce(f"new_{c}", c).alias(c) for c in values])


def latest_revision(rows: DataFrame, key: str, revision: Column, payload: list[str]) -> DataFrame:
    """Of each key the row of the highest revision, of equal ones the one that sorts last."""
    best = F.max(F.struct(revision.alias("revision"), *payload))
    return rows.groupBy(key).agg(best.alias("row")).select(key, "row.*")


def pending(incoming: DataFrame, known: DataFrame, key: str, sweep: bool = True) -> DataFrame:
    """Incoming rows that are unknown or, in a sweep, of a higher revision than the known one."""
    have = known.groupBy(key).agg(F.max("revision").alias("known_revision"))
    test = F.col("known_revision").isNull()
    if sweep:
        test = test | (F.col("revision") > F.col("known_revision"))
    return incoming.join(have, key, "left").filter(test).drop("known_revision")


def resolve_players(refs: DataFrame, own_map: DataFrame, other_map: DataFrame) -> DataFrame:
    """Canonical id of each player reference (player_id, name, other_id).

    First by the own id, then by the other source's id, then a new id made from the own id or, for an unregistered
    player, from the name. The maps are (id, canonical_id), one row an id.
    """
    key = F.coalesce("player_id", F.concat(F.lit("name:"), rules.normal_name(F.col("name"))))
    keyed = refs.withColumn("key", key)
    own = own_map.select(F.col("id").alias("key"), F.col("canonical_id").alias("own_canonical"))
    other = other_map.select(F.col("id").alias("other_id"), F.col("canonical_id").alias("other_canonical"))
    made = F.substring(F.sha1("key"), 1, 16)
    return (
        keyed.join(own, "key", "left")
        .join(other, "other_id", "left")
        .select(
            "key",
            "player_id",
            "name",
            "other_id",
            F.coalesce("own_canonical", "other_canonical", made).alias("canonical_id"),
            F.when(F.col("own_canonical").isNotNull(), "own").when(F.col("other_canonical").isNotNull(), "other").otherwise("new").alias("how"),
        )
    )


def backfill_class(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Class of each match: exact from its type where known, else from format and whether both teams are national."""
    national = teams.select(F.col("name").alias("team"), "is_national")
    home = national.select(F.col("team").alias("team_home"), F.col("is_national").alias("home_national"))
    away = national.select(F.col("team").alias("team_away"), F.col("is_national").alias("away_national"))
    both = F.coalesce("home_national", F.lit(False)) & F.coalesce("away_national", F.lit(False))
    kind = F.when(F.col("match_type").isNotNull(), rules.match_class(F.col("match_type"), F.col("team_type"))).otherwise(
        rules.class_from_format(F.col("match_format"), both)
    )
    return matches.join(home, "team_home", "left").join(away, "team_away", "left").select(*matches.columns, kind.alias("match_class"))


def feed_state(state: DataFrame, patches: DataFrame) -> DataFrame:
    """Feed control rows after patches: counters add up, the latest patch's marks win, nulls keep what is known."""
    rows = state.withColumn("at", F.lit(None).cast("timestamp")).unionByName(patches)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.coalesce("at", F.timestamp_seconds(F.lit(0)))))
    return rows.groupBy("feed").agg(
        last("etag").alias("etag"), last("last_modified").alias("last_modified"), F.sum("imported").alias("imported"), F.sum("failed").alias("failed")
    )


def team_counts(matches: DataFrame) -> DataFrame:
    """Matches of each team by normalised name, home and away added up."""
    side = lambda c: matches.filter(F.col(c).isNotNull()).select(rules.normal_name(F.col(c)).alias("team"))
    return side("team_home").unionByName(side("team_away")).groupBy("team").agg(F.count("*").alias("matches"))


def fresh_snapshots(snapshots: DataFrame, now: Column, max_age_seconds: int, number: str | None = None) -> DataFrame:
    """The newest payload of each page, if young enough; of several of one moment that of the least `number`, a numeric column, where given."""
    before = [] if number is None else [(-F.col(number)).alias("before")]
    newest = snapshots.groupBy("page_type", F.sha1("url").alias("key")).agg(F.max(F.struct("fetched_at", *before, "payload")).alias("row"))
    age = now.cast("timestamp").cast("double") - F.col("row.fetched_at").cast("timestamp").cast("double")
    return newest.filter(age <= max_age_seconds).select("page_type", "key", "row.fetched_at", "row.payload")


def crawl_frontier(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """New jobs, each (page_type, params) once, at its least depth."""
    return jobs.groupBy("page_type", "params").agg(F.min("depth").alias("depth")).join(seen, ["page_type", "params"], "left_anti")


def pending_players(players: DataFrame, done: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Players with an external id that have not been enriched yet, most runs first."""
    rows = players.filter("external_id is not null")
    if not force:
        rows = rows.join(done.select("player_id"), "player_id", "left_anti")
    rows = rows.orderBy(F.desc("career_runs"), "player_id")
    return rows if limit is None else rows.limit(limit)


def batches(rows: DataFrame, key: str, count: int) -> DataFrame:
    """Distinct keys dealt over `count` batches by hash: a batch that failed is found again by its number."""
    return rows.select(key).distinct().withColumn("batch", F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))


def propagate_profiles(players: DataFrame, parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Profiles (role, batting_style, bowling_style) of players: parsed ones, by external id, over the known ones.

    One external id may belong to several players; a null of the parsed profile never overwrites a known value.
    """
    fields = ["role", "batting_style", "bowling_style"]
    found = players.filter("external_id is not null").select("player_id", "external_id").join(parsed.select("external_id", *fields), "external_id")
    return merge_keep_known(known.select("player_id", "external_id", *fields), found, ["player_id"])


def refresh_plan(feeds: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """What to do with each offered feed (feed, etag, last_modified): fetch it, or nothing if its marks are the known ones."""
    known = state.select("feed", F.col("etag").alias("known_etag"), F.col("last_modified").alias("known_modified"))
    same = lambda mark, old: F.col(mark).isNotNull() & (F.col(mark) == F.col(old))
    unchanged = F.coalesce(same("etag", "known_etag") | same("last_modified", "known_modified"), F.lit(False))
    action = F.when(F.lit(force) | ~unchanged, "fetch").otherwise("not-modified")
    return feeds.join(known, "feed", "left").select(*feeds.columns, action.alias("action"))


def ingest_plan(entries: DataFrame, known: DataFrame, sweep: bool = True, from_cache: bool = False, dry_run: bool = False) -> DataFrame:
    """What happens to each entry of a feed: ingest, would-ingest in a dry run, or skip.

    Everything is taken again from a cache; else unknown matches, and in a sweep those of a higher revision.
    """
    have = known.groupBy("match_id").agg(F.max("revision").alias("known_revision"))
    new = F.col("known_revision").isNull() | F.lit(from_cache)
    if sweep:
        new = new | (F.col("revision") > F.col("known_revision"))
    take = "would-ingest" if dry_run else "ingest"
    return entries.join(have, "match_id", "left").select(*entries.columns, F.when(new, take).otherwise("skip").alias("action"))


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (job, every_seconds, enabled, running, last_run) that a tick should start: due, switched on, not still running."""
    due = F.col("last_run").isNull() | (now.cast("timestamp").cast("long") - F.col("last_run").cast("timestamp").cast("long") >= F.col("every_seconds"))
    return jobs.filter(F.col("enabled") & ~F.col("running") & due)


def crawl_jobs(matches: DataFrame, mode: str, depth: int = 0) -> DataFrame:
    """Scorecard jobs from the matches of a fixtures page: with a scorecard and both slugs, in LIVE mode only live ones.

    Live matches are fetched again whatever is cached; others come from the cache if they are there.
    """
    live = F.coalesce(F.col("state") == "LIVE", F.lit(False))
    wanted = F.coalesce("has_scorecard", F.lit(False)) & (live | F.lit(mode != "LIVE"))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return matches.filter(wanted & some("slug") & some("series_slug") & some("series_id")).select(
        F.lit("scorecard").alias("page_type"),
        F.concat_ws("/", F.concat_ws("-", "series_slug", "series_id"), F.concat_ws("-", "slug", "match_id")).alias("params"),
        F.lit(mode).alias("mode"),
        F.lit(depth + 1).alias("depth"),
        live.alias("force_refetch"),
    )


def crawl(seed: DataFrame, expand: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Breadth-first closure of jobs (page_type, params, depth): each found once, at its least depth.

    expand(frontier) gives the jobs that pages of the frontier link to. A round expands only what the round before has
    found for the first time, and writes what is new into a folder of its own; it ends when a round finds nothing, on
    any graph, as pages are finite and none is expanded twice. The rounds, as many as the site is deep, are the driver's
    only loop; the pages stay on the cluster.
    """
    spark = seed.sparkSession
    path, key = new_folder(spark), ["page_type", "params"]
    frontier, number = crawl_frontier(seed, seed.select(*key).limit(0)), 0
    while True:
        found = written(frontier, f"{path}/round={number}")
        seen = spark.read.schema(found.schema).parquet(path)
        if found.isEmpty():
            return seen
        frontier, number = crawl_frontier(expand(found), seen.select(*key)), number + 1


def class_batches(classified: DataFrame, key: str) -> DataFrame:
    """Rows of each class to be written back: their number and the range of their keys."""
    return classified.groupBy("match_class").agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def feed_totals(results: DataFrame) -> DataFrame:
    """Sums over the feeds of one run."""
    return results.agg(F.coalesce(F.sum("imported"), F.lit(0)).alias("imported"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))


def register_sources(known: DataFrame, new: DataFrame) -> DataFrame:
    """Sources by key, new ones added, known ones updated where the new row says something."""
    return merge_keep_known(known, new, ["source"])


def contract(rows: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all (name, condition) checks, and the others with the names of those they break.

    A condition that is null counts as broken.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks]))
    judged = rows.withColumn("broken", broken)
    return judged.filter(F.size("broken") == 0).drop("broken"), judged.filter(F.size("broken") > 0)
