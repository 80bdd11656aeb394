"""Sessions, silver layout and gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crease.functions import texts
from crease.operators import careers, scorecards
from crease.plans.shared import rows_seen

#: Settings the engine relies on; shuffle partitions follow the cluster, AQE joins small ones and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.parquet.compression.codec": "zstd",
}

GOLD = ["careers", "career_players", "career_coverage", "innings", "batting", "bowling", "matches", "overs"]


def session(builder: SparkSession.Builder | None = None) -> SparkSession:
    builder = builder or SparkSession.builder
    return builder.config(map=SETTINGS).getOrCreate()


def write_silver(deliveries: DataFrame, matches: DataFrame, players: DataFrame, path: str, single_files: bool = False) -> None:
    """Replace the silver layer: deliveries by class and season, zstd; rows of a partition are brought together first.

    single_files: matches and players as one file each, for readers that want that; one task then writes each.
    """
    if single_files:
        matches, players = matches.coalesce(1), players.coalesce(1)
    out = deliveries.repartition("match_class", "season", F.pmod(F.xxhash64("match_id"), F.lit(16)))
    out.sortWithinPartitions("match_class", "season", "match_id", "innings_no", "over_no", "ball_in_over").write.partitionBy(
        "match_class", "season"
    ).mode("overwrite").option("compression", "zstd").parquet(f"{path}/deliveries")
    matches.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/matches")
    players.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/players")


def read_silver(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The silver tables, registered as views; seasons stay text whatever they look like."""
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("deliveries", "matches", "players")}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return tables


def gold_tables(silver: dict[str, DataFrame], lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every gold table as a DataFrame over silver; lines: player_innings() where it has been written already."""
    balls, matches, players = silver["deliveries"], silver["matches"], silver["players"]
    lines = scorecards.player_innings(balls) if lines is None else lines
    return {
        "careers": careers.careers_of(lines),
        "career_players": careers.players_of(lines, players),
        "career_coverage": careers.coverage_of(lines),
        "innings": scorecards.innings_totals(balls),
        "batting": scorecards.card_of_batting(lines),
        "bowling": scorecards.bowling_card(balls),
        "matches": scorecards.match_summary(matches, balls),
        "overs": scorecards.overs_json(balls),
    }


def write_gold(silver: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Replace all gold tables; returns their row counts, taken while they are written. The players' innings are written once and feed four tables."""
    spark = silver["deliveries"].sparkSession
    scorecards.player_innings(silver["deliveries"]).write.mode("overwrite").parquet(f"{path}/player_innings")
    lines = spark.read.parquet(f"{path}/player_innings")
    counts = {}
    for name, table in gold_tables(silver, lines).items():
        seen = Observation()
        table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = rows_seen(seen)
    return counts


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects, the form in which they are served."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def match_objects(matches: DataFrame, image_base: str) -> DataFrame:
    """Matches as nested JSON for a client: id, text fields, start in ISO form, series, venue and the teams that are known.

    matches: match_id, title, status_text, format, state, start_time, the structs series (name, slug, season), venue
    (name, city), home and away (name, short_name, primary_color, image), each null if unknown, and both scores.
    """
    iso = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def team(side: str) -> Column:
        t = F.col(side)
        logo = texts.full_image_url(t["image"], image_base)
        value = F.struct(
            t["name"].alias("name"), t["short_name"].alias("shortName"), F.col(f"{side}_score").alias("score"), t["primary_color"].alias("primaryColor"), logo.alias("logoUrl")
        )
        return F.when(t.isNotNull(), value)

    series, venue = F.col("series"), F.col("venue")
    value = F.struct(
        F.col("match_id").alias("id"),
        "title",
        series["season"].alias("season"),
        F.col("status_text").alias("statusText"),
        "format",
        "state",
        iso.alias("startTime"),
        F.when(series.isNotNull(), F.struct(series["name"].alias("name"), series["slug"].alias("slug"))).alias("series"),
        F.when(venue.isNotNull(), F.struct(venue["name"].alias("name"), venue["city"].alias("city"))).alias("venue"),
        F.array_compact(F.array(team("home"), team("away"))).alias("teams"),
    )
    return matches.select("match_id", F.to_json(value, {"ignoreNullFields": "false"}).alias("json"))


def replace_groups(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with every group (such as an innings) that new has rows of replaced by those rows; the same again if run again."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def match_tree(matches: DataFrame, innings: DataFrame, batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """Each match with its innings, and in them the batting and bowling lines in order, as nested arrays."""
    key = ["match_id", "innings_no"]

    def lines(card: DataFrame, place: str, name: str) -> DataFrame:
        rest = [c for c in card.columns if c not in (*key, place)]
        return card.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(place, *rest))).alias(name))

    full = innings.join(lines(batting, "batting_pos", "batting"), key, "left").join(lines(bowling, "bowling_pos", "bowling"), key, "left")
    rest = [c for c in full.columns if c not in key]
    nested = full.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("innings_no", *rest))).alias("innings"))
    return matches.join(nested, "match_id", "left")


def write_ndjson(rows: DataFrame, path: str) -> None:
    """Rows as newline-delimited JSON, nulls kept."""
    as_json(rows).select("json").write.mode("overwrite").text(path)


def append_snapshots(rows: DataFrame, path: str) -> None:
    """Page snapshots (page_type, url, fetched_at, payload) added to those that are there; the newest one is read."""
    rows.write.mode("append").partitionBy("page_type").parquet(path)


#: Gold tables in the order in which a relational store is filled: parents before children; emptied the other way.
STORE_ORDER = ["career_players", "careers", "career_coverage", "matches", "innings", "batting", "bowling", "overs"]


def replace_in_store(tables: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None, batch: int = 1000) -> dict[str, int]:
    """Replace relational tables by JDBC, in batched inserts by all tasks; tables keep their definition. Returns row counts.

    A table is written from its own files: give tables that have been written, not plans that are worked out twice.
    """
    options = {"url": url, "batchsize": str(batch), "truncate": "true", **(properties or {})}
    names = [n for n in STORE_ORDER if n in tables] + [n for n in tables if n not in STORE_ORDER]
    spark = next(iter(tables.values())).sparkSession
    for name in names:
        tables[name].write.format("jdbc").options(**options, dbtable=name).mode("overwrite").save()
    return {n: read_store(spark, url, n, properties).count() for n in names}


def read_store(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 8) -> DataFrame:
    """A relational table by JDBC; with an integer key and its bounds, in parts by ranges of the key."""
    options = {"url": url, "dbtable": table, **(properties or {})}
    if key:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()
