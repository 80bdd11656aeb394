"""A refresh driven by change: an archive that is not the known one is looked through, and what is new in it goes into silver and gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators import identity
from crease.plans import upkeep
from crease.plans.shared import drop_folder, new_folder, written
from crease.plans.store import Store
from crease.sources import matchdocs

MARKS = "feed string, etag string, last_modified string"
KNOWN = "match_id string, revision int, feed string, part int"


def feed_marks(gold: Store) -> DataFrame:
    """The marks (feed, etag, last_modified) of the archives that the store has taken up."""
    found = gold.read("feeds")
    return gold.spark.createDataFrame([], MARKS) if found is None else found.drop("part")


def known_matches(gold: Store) -> DataFrame:
    """match_id, revision and feed of every match that the store has."""
    found = gold.read("known")
    return gold.spark.createDataFrame([], KNOWN) if found is None else found


def refresh(spark: SparkSession, path: str, archive: str, feed: str, etag: str | None = None, last_modified: str | None = None, crosswalk: DataFrame | None = None, complete: bool = False, force: bool = False) -> dict:
    """Bring the store at path up to an archive offered as `feed` with these marks; returns what was done.

    An archive whose etag or date is the known one is not opened. Else its documents are read once for their revisions;
    only unknown matches and higher revisions are taken further (with force, all), and of the tables only what depends
    on them is written. complete: the archive holds all matches of the feed, so those that it no longer has are deleted.
    Matches, gold tables, known revisions and marks are seen together, or not at all if the refresh breaks off; it can
    then be run again. Broken documents are counted and stop nothing; of several documents of a match the one of the highest
    revision counts.
    """
    gold = upkeep.store(spark, path)
    offered = spark.createDataFrame([(feed, etag, last_modified)], MARKS)
    if identity.refresh_plan(offered, feed_marks(gold), force).first().action != "fetch":
        return {"action": "not-modified", "taken": 0, "rejected": 0, "deleted": 0}
    work = new_folder(spark)
    good, bad = matchdocs.split_valid(matchdocs.read_archives(spark, archive))
    revision = F.greatest(F.lit(1), F.coalesce(F.col("meta.revision"), F.lit(1)))
    dated = good.withColumn("revision", revision)
    seen = written(dated.groupBy("match_id").agg(F.max("revision").alias("revision")), f"{work}/seen")
    known = known_matches(gold)
    plan = identity.ingest_plan(seen, known, from_cache=force).filter("action = 'ingest'").select("match_id", "revision")
    wanted = written(plan, f"{work}/wanted")
    docs = written(dated.join(wanted, ["match_id", "revision"], "left_semi").dropDuplicates(["match_id"]), f"{work}/docs")
    lost = known.filter((F.col("feed") == feed) & F.lit(complete)).select("match_id").join(seen, "match_id", "left_anti")
    gone = written(lost, f"{work}/gone")
    rejected = bad.count()
    matches = written(matchdocs.matches(docs), f"{work}/matches")
    balls = written(matchdocs.deliveries(docs, crosswalk), f"{work}/balls")
    marks = offered.withColumn("part", F.lit(0))
    news = written(wanted.withColumns({"feed": F.lit(feed), "part": upkeep.part_of("match_id")}), f"{work}/known")
    more = {"known": (news, ["match_id"], news.select("match_id").unionByName(gone)), "feeds": (marks, ["feed"], marks)}
    done = upkeep.apply_batch(gold, matches, balls, gone, more)
    taken, deleted = wanted.count(), gone.count()
    drop_folder(spark, work)
    return {"action": "fetch", "taken": taken, "rejected": rejected, "deleted": deleted, "tables": done}
