"""Lists as they are served: orders, searches, names and images joined on, groups by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crease.functions import rules, texts

#: Fixed value: the name of the matches without an event.
OTHER_LABEL = "Other / Bilateral matches"


def name_search(name: Column, query: str | None) -> Column:
    """Whether a name contains the query, ignoring case; a blank query fits all."""
    query = (query or "").strip()
    return F.contains(F.lower(name), F.lit(query.lower())) if query else F.lit(True)


def top_players(players: DataFrame, measure: str, k: int) -> DataFrame:
    """The k players of the highest career sum, ties by id: a bounded top-k, no full sort."""
    return players.orderBy(F.desc(measure), "player_id").limit(k)


def competitions_by_volume(competitions: DataFrame, query: str | None = None) -> DataFrame:
    """Competitions by matches, most first; event_name null is the bucket of all other matches."""
    named = competitions.withColumn("name", F.coalesce("event_name", F.lit(OTHER_LABEL)))
    return named.filter(name_search(F.col("name"), query)).orderBy(F.desc("total"), "name")


def canonical_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.asc_nulls_last("start_time"), "match_id")


def rankings(rated: DataFrame) -> DataFrame:
    """Ratings with each team's place in its class: by rating, then wins, then name."""
    order = W.partitionBy("match_class").orderBy(F.desc("rating"), F.desc("won"), "team")
    return rated.withColumn("place", F.row_number().over(order))


def date_groups(matches: DataFrame, *edition: str) -> DataFrame:
    """Matches of each edition, newest first, with the number of their run of equal dates.

    Only neighbours in the order are grouped: a change flag against the row before, and its running sum.
    """
    newest = W.partitionBy(*edition).orderBy(F.desc_nulls_first("match_date"), "match_id")
    before = F.lag("match_date").over(newest)
    changed = (F.row_number().over(newest) == 1) | ~F.col("match_date").eqNullSafe(before)
    flagged = matches.withColumn("changed", changed.cast("int"))
    number = F.sum("changed").over(newest.rowsBetween(W.unboundedPreceding, 0))
    return flagged.withColumn("date_group", number).drop("changed")


def edition_spans(meta: DataFrame) -> DataFrame:
    return meta.withColumn("span", texts.date_span(F.col("first_date"), F.col("last_date")))


OVER_POINT = "array<struct<o:int,r:bigint,w:bigint,f:bigint,s:bigint,c:bigint>>"


def over_extents(overs: DataFrame) -> DataFrame:
    """Chart extents of each match from its innings' overs JSON: most overs, most runs so far, most runs of an over."""
    points = overs.select("match_id", F.from_json("overs", OVER_POINT).alias("points"))
    largest = lambda part: F.array_max(F.transform("points", lambda p: p[part]))
    return points.groupBy("match_id").agg(
        F.greatest(F.lit(1), F.max(F.size("points"))).alias("max_overs"),
        F.greatest(F.lit(1), F.max(largest("c"))).alias("max_cumulative"),
        F.greatest(F.lit(1), F.max(largest("r"))).alias("max_runs"),
    )


def innings_slice(card: DataFrame, innings_no: int) -> DataFrame:
    """One innings' rows of a card."""
    return card.filter(F.col("innings_no") == innings_no)


def team_profiles(counts: DataFrame, national: DataFrame, logos: DataFrame, flag_base: str) -> DataFrame:
    """Profile of each team of counts (team: normalised name, display_name, matches).

    A national side gets country, colour and flag; a logo (team, logo_url) wins over the flag as crest. Both tables
    are small dimensions, joined by normalised name; Spark broadcasts them if their size allows.
    """
    from crease.sources.teams import flag_url

    sides = national.select(F.col("side").alias("team"), "iso", "country", "color")
    joined = counts.join(sides, "team", "left").join(logos.select("team", "logo_url"), "team", "left")
    is_national = F.col("country").isNotNull()
    flag = flag_url(F.col("iso"), flag_base)
    return joined.select(
        F.col("team").alias("id"),
        "display_name",
        "country",
        is_national.alias("is_national"),
        flag.alias("flag_url"),
        F.when(~is_national, F.col("logo_url")).alias("logo_url"),
        F.col("color").alias("primary_color"),
        F.col("matches").alias("match_count"),
        texts.crest(F.when(~is_national, F.col("logo_url")), flag).alias("image"),
        texts.kind_label(is_national).alias("kind_label"),
    )


def list_teams(profiles: DataFrame, query: str | None = None, national: bool | None = None) -> DataFrame:
    """Teams by matches, then name, that fit the search and, if given, are national or are not."""
    rows = profiles.filter(name_search(F.col("display_name"), query))
    if national is not None:
        rows = rows.filter(F.col("is_national") == national)
    return rows.orderBy(F.desc("match_count"), "display_name")


def with_badges(matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """Matches with id, crest and colour of both teams, looked up by normalised name; unknown teams have none."""
    out = matches
    for side in ("home", "away"):
        known = profiles.select(
            F.col("id").alias(f"{side}_id"), F.col("image").alias(f"{side}_image"), F.col("primary_color").alias(f"{side}_color")
        )
        out = out.join(known, rules.normal_name(F.col(f"team_{side}")) == F.col(f"{side}_id"), "left")
    return out


def with_profiles(players: DataFrame, profiles: DataFrame) -> DataFrame:
    """Players with photo and role from their profiles, one a player; none if there is no profile."""
    return players.join(profiles.select("player_id", "photo_url", "role"), "player_id", "left")


def named_leaders(leaders: DataFrame, careers: DataFrame, players: DataFrame, measure: str) -> DataFrame:
    """Leaders of each class with names, the figure with separators and a line of detail."""
    average = texts.or_dash(texts.fixed(F.col("batting_avg"), 1))
    stats = careers.select("player_id", "match_class", "matches", "batting_avg")
    return (
        leaders.join(players.select("player_id", "name"), "player_id")
        .join(stats, ["player_id", "match_class"])
        .select(
            "match_class",
            "place",
            "player_id",
            "name",
            texts.thousands(F.col(measure)).alias("value"),
            F.concat(F.col("matches").cast("string"), F.lit(f" M{texts.DOT}avg "), average).alias("detail"),
        )
    )


def with_coverage(careers: DataFrame, coverage: DataFrame, official: DataFrame) -> DataFrame:
    """Career lines with the coverage and the official figures of the same player and class, where there are any."""
    key = ["player_id", "match_class"]
    return careers.join(coverage, key, "left").join(official, key, "left")


def missing_scorecards(matches: DataFrame, innings: DataFrame) -> DataFrame:
    """Matches that are said to have a scorecard but have no innings."""
    return matches.filter("has_scorecard").join(innings.select("match_id"), "match_id", "left_anti")


def ordered_squads(squads: DataFrame) -> DataFrame:
    """Members of each edition's teams with their place: by appearances, then runs, then name."""
    order = W.partitionBy("event_name", "season", "team").orderBy(F.desc("appearances"), F.desc("runs"), "player")
    return squads.withColumn("place", F.row_number().over(order))


def match_texts(matches: DataFrame) -> DataFrame:
    c = F.col
    return matches.select(
        "match_id",
        texts.match_title(c("team_home"), c("team_away"), c("event_name")).alias("title"),
        texts.result_text(c("outcome_winner")).alias("result"),
        texts.meta_line(c("match_date"), c("venue"), c("city")).alias("meta"),
        texts.toss_text(c("toss_winner"), c("toss_decision")).alias("toss"),
    )
