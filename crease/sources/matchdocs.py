"""Match documents: one nested JSON object a match, from folders or zip archives, to flat silver rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions import rules
from crease.sources import archives

_PEOPLE = "map<string,string>"
_WICKET = "struct<kind:string,player_out:string,fielders:array<struct<name:string>>>"
_BALL = (
    "struct<batter:string,bowler:string,non_striker:string,runs:struct<batter:int,extras:int,total:int>,"
    f"extras:map<string,int>,wickets:array<{_WICKET}>>"
)
_OVER = f"struct<over:int,deliveries:array<{_BALL}>>"

#: A document's fields that are read. Extras are a map, which keeps their order; a struct would not.
SCHEMA = (
    "meta struct<revision:int>, "
    "info struct<balls_per_over:int,city:string,dates:array<string>,event:struct<name:string,match_number:int>,gender:string,"
    "match_type:string,outcome:struct<winner:string>,player_of_match:array<string>,players:map<string,array<string>>,"
    f"registry:struct<people:{_PEOPLE}>,season:string,team_type:string,teams:array<string>,"
    "toss:struct<decision:string,winner:string>,venue:string>, "
    f"innings array<struct<team:string,overs:array<{_OVER}>>>, broken string"
)


def stem(path: Column) -> Column:
    """File name without folder and .json: a document's match id."""
    return F.regexp_extract(path, r"([^/]*)\.json$", 1)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder or of one file; readme.json is left out, broken ones have `broken` set."""
    rows = (
        spark.read.schema(SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "broken")
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    name = F.col("_metadata.file_name")
    return rows.filter(F.lower(name) != "readme.json").withColumn("match_id", stem(name))


def read_archives(spark: SparkSession, path: str, match_ids: list[str] | None = None, **options: int) -> DataFrame:
    """Documents inside zip archives, read by all tasks by ranges of members; `broken` tells of members that are not JSON or cannot be unpacked.

    match_ids: only these; the others' bytes are left alone where spark.sql.python.filterPushdown.enabled is set.
    """
    members = archives.read_members(spark, path, **options)
    if match_ids is not None:
        members = members.filter(F.col("match_id").isin(match_ids))
    parsed = F.from_json("text", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    docs = members.select("match_id", "error", parsed.alias("d")).select("match_id", "error", "d.*")
    return docs.withColumn("broken", F.coalesce("error", "broken")).drop("error")


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of newline-delimited JSON with the given column types; nothing is inferred."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def cached_register(spark: SparkSession, cache: str, download: Callable[[str], None], max_age_seconds: int = 7 * 86400, force: bool = False, **columns: str) -> DataFrame:
    """read_register() of a cached file, which download(cache) writes anew if it is missing, too old or forced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = store.exists(target) and time.time() - store.getFileStatus(target).getModificationTime() / 1000 < max_age_seconds
    if force or not fresh:
        download(cache)
    return read_register(spark, cache, **columns)


def split_valid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that can be used, and the rest with the reason; one broken file stops nothing else."""
    reason = (
        F.when(F.col("broken").isNotNull(), "not JSON")
        .when(F.coalesce(F.col("match_id"), F.lit("")) == "", "no match id")
        .when(F.col("info").isNull(), "no info")
        .when(F.exists(F.coalesce("innings", F.array()), lambda i: F.exists(
            F.coalesce(i["overs"], F.array()),
            lambda o: (F.coalesce(o["over"], F.lit(0)) < 0)
            | F.exists(F.coalesce(o["deliveries"], F.array()), lambda d: F.coalesce(d["runs"]["total"], F.lit(0)) < 0),
        )), "negative number")
    )
    judged = docs.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason", "broken"), judged.filter("reason is not null").select("match_id", "reason")


def _reference(name: Column) -> Column:
    """Id of a person by name, null if the document's register does not have it."""
    return rules.text_or_null(F.try_element_at(F.col("people"), F.trim(name)))


def deliveries(docs: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """One row per ball. Only the first wicket and the first kind of extra of a ball count.

    crosswalk: (player_id, external_id); joined for batter and bowler where given.
    """
    info = F.col("info")
    per_match = docs.select(
        "match_id",
        rules.match_class(info["match_type"], info["team_type"]).alias("match_class"),
        *[rules.text_or_null(info[c]).alias(c) for c in ("match_type", "gender", "season", "venue", "city")],
        rules.text_or_null(info["event"]["name"]).alias("event_name"),
        F.get(info["dates"], 0).alias("match_date"),
        F.coalesce(info["teams"], F.array().cast("array<string>")).alias("teams"),
        info["registry"]["people"].alias("people"),
        F.posexplode("innings").alias("i", "inn"),
    )
    overs = per_match.select("*", F.explode("inn.overs").alias("over"))
    balls = overs.select("*", F.posexplode("over.deliveries").alias("b", "d"))
    d = F.col("d")
    batting = F.coalesce(rules.text_or_null(F.col("inn.team")), F.lit("Unknown team"))
    batter, bowler = rules.text_or_null(d["batter"]), rules.text_or_null(d["bowler"])
    runs, extras = F.coalesce(d["runs"]["batter"], F.lit(0)), F.coalesce(d["runs"]["extras"], F.lit(0))
    wicket = F.get(d["wickets"], 0)
    fielders = F.filter(F.transform(wicket["fielders"], lambda f: rules.text_or_null(f["name"])), lambda n: n.isNotNull())
    flat = balls.select(
        "match_id",
        "match_class",
        "match_type",
        "gender",
        "season",
        "event_name",
        "venue",
        "city",
        "match_date",
        (F.col("i") + 1).alias("innings_no"),
        F.coalesce("over.over", F.lit(0)).alias("over_no"),
        (F.col("b") + 1).alias("ball_in_over"),
        batting.alias("batting_team"),
        F.get(F.filter("teams", lambda t: t != batting), 0).alias("bowling_team"),
        _reference(d["batter"]).alias("batter_id"),
        F.coalesce(batter, F.lit("Unknown batter")).alias("batter_name"),
        _reference(d["bowler"]).alias("bowler_id"),
        F.coalesce(bowler, F.lit("Unknown bowler")).alias("bowler_name"),
        _reference(d["non_striker"]).alias("non_striker_id"),
        rules.text_or_null(d["non_striker"]).alias("non_striker_name"),
        runs.alias("runs_batter"),
        extras.alias("runs_extras"),
        F.coalesce(d["runs"]["total"], runs + extras).alias("runs_total"),
        F.get(F.map_keys(d["extras"]), 0).alias("extra_type"),
        wicket.isNotNull().alias("is_wicket"),
        F.when(wicket.isNotNull(), F.coalesce(rules.text_or_null(wicket["kind"]), F.lit("unknown"))).alias("dismissal_kind"),
        _reference(wicket["player_out"]).alias("player_out_id"),
        rules.text_or_null(wicket["player_out"]).alias("player_out_name"),
        F.nullif(F.array_join(fielders, ";"), F.lit("")).alias("fielders"),
    )
    if crosswalk is None:
        return flat
    for who in ("batter", "bowler"):
        known = crosswalk.select(F.col("player_id").alias(f"{who}_id"), F.col("external_id").alias(f"{who}_external"))
        flat = flat.join(known, f"{who}_id", "left")
    return flat


def innings(docs: DataFrame) -> DataFrame:
    """Totals of each innings, added up inside its nested overs: nothing is exploded to balls or shuffled."""
    rows = docs.select("match_id", F.posexplode("innings").alias("i", "inn"))
    balls = F.flatten(F.transform(F.coalesce("inn.overs", F.array()), lambda o: F.coalesce(o["deliveries"], F.array())))
    added = lambda f: F.aggregate("balls", F.lit(0).cast("long"), lambda acc, d: acc + f(d))
    part = lambda d, name: F.coalesce(d["runs"][name], F.lit(0))
    legal = lambda d: rules.is_legal(F.get(F.map_keys(d["extras"]), 0))
    table = rows.withColumn("balls", balls).select(
        "match_id",
        (F.col("i") + 1).alias("innings_no"),
        F.coalesce(rules.text_or_null(F.col("inn.team")), F.lit("Unknown team")).alias("batting_team"),
        added(lambda d: F.coalesce(d["runs"]["total"], part(d, "batter") + part(d, "extras"))).alias("runs"),
        added(lambda d: F.when(F.get(d["wickets"], 0).isNotNull(), 1).otherwise(0)).alias("wickets"),
        added(lambda d: F.when(legal(d), 1).otherwise(0)).alias("balls"),
    )
    return table.withColumn("overs_text", rules.overs_text(F.col("balls")))


def matches(docs: DataFrame) -> DataFrame:
    """One row per document."""
    info = F.col("info")
    decision = F.lower(rules.text_or_null(info["toss"]["decision"]))
    return docs.select(
        "match_id",
        rules.match_class(info["match_type"], info["team_type"]).alias("match_class"),
        *[rules.text_or_null(info[c]).alias(c) for c in ("match_type", "team_type", "gender", "season", "venue", "city")],
        rules.text_or_null(info["event"]["name"]).alias("event_name"),
        info["event"]["match_number"].alias("event_match_number"),
        F.get(info["dates"], 0).alias("match_date"),
        F.get(info["teams"], 0).alias("team_home"),
        F.get(info["teams"], 1).alias("team_away"),
        rules.text_or_null(info["toss"]["winner"]).alias("toss_winner"),
        F.when(decision.isin("bat", "field"), decision).alias("toss_decision"),
        rules.text_or_null(info["outcome"]["winner"]).alias("outcome_winner"),
        F.nullif(F.array_join(info["player_of_match"], ";"), F.lit("")).alias("player_of_match"),
        F.coalesce(info["balls_per_over"], F.lit(6)).alias("balls_per_over"),
        F.greatest(F.lit(1), F.coalesce(F.col("meta.revision"), F.lit(1))).alias("revision"),
    )


def players(docs: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """One row per registered person: the smallest of their names, and the external id."""
    people = docs.select(F.explode("info.registry.people").alias("name", "id"))
    named = people.select(rules.text_or_null(F.col("id")).alias("player_id"), "name").filter("player_id is not null and name <> ''")
    return named.groupBy("player_id").agg(F.min("name").alias("name")).join(crosswalk, "player_id", "left")


def squads(docs: DataFrame) -> DataFrame:
    """The players named for each team of a match."""
    teams = docs.select("match_id", F.explode("info.players").alias("team", "names"))
    return teams.select("match_id", "team", F.explode("names").alias("name"))


def read_register(spark: SparkSession, path: str, identifier: str = "identifier", external: str = "key_external") -> DataFrame:
    """Crosswalk (player_id, external_id) from a register CSV with quoted fields; of repeated ids the last row counts.

    Rows without either id are left out; a file without the two columns is an error.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    missing = {identifier, external} - set(rows.columns)
    if missing:
        raise ValueError(f"the register has no column {', '.join(sorted(missing))}")
    kept = rows.select(
        rules.text_or_null(F.col(identifier)).alias("player_id"),
        rules.text_or_null(F.col(external)).alias("external_id"),
        F.monotonically_increasing_id().alias("line"),
    ).filter("player_id is not null and external_id is not null")
    return kept.groupBy("player_id").agg(F.max_by("external_id", "line").alias("external_id"))


def feeds(spark: SparkSession, known: list[tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """Archive of each feed key: the known (key, file, label), else a name made from the key."""
    table = spark.createDataFrame(known, "feed string, file string, label string")
    asked = spark.createDataFrame([(k,) for k in keys], "feed string")
    return asked.join(table, "feed", "left").select(
        "feed", F.coalesce("file", F.concat("feed", F.lit("_json.zip"))).alias("file"), F.coalesce("label", "feed").alias("label")
    )
