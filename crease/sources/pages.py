"""Data embedded in pages, and JSON by ordered paths."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions import rules, texts


def embedded_json(html: Column, element_id: str) -> Column:
    """The JSON text inside the script element of this id; null if there is none."""
    found = F.regexp_extract(html, f'(?s)<script id="{element_id}"[^>]*>(.*?)</script>', 1)
    return F.nullif(found, F.lit(""))


def with_data(pages: DataFrame, element_id: str, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Pages with their embedded JSON as `data`, and apart from them those that have none or a broken one."""
    rows = pages.withColumn("data", embedded_json(F.col(html), element_id))
    good = F.col("data").isNotNull() & F.try_parse_json("data").isNotNull()
    return rows.filter(good), rows.filter(~good)


def first_path(json: Column, paths: list[str]) -> Column:
    """The first of the paths that has a value."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def first_value(value: Column, paths: list[str]) -> Column:
    """The first of the paths of a parsed value that is there, as text."""
    return F.coalesce(*[F.try_variant_get(value, p, "string") for p in paths])


def first_list(value: Column, paths: list[str]) -> Column:
    """The first of the paths of a parsed value that is a list, as parsed values."""
    return F.coalesce(*[F.try_variant_get(value, p, "array<variant>") for p in paths])


def titles(pages: DataFrame) -> DataFrame:
    """Title of each page, tags and entities aside, white space collapsed; null without one."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", F.nullif(rules.strip_tags(title), F.lit("")).alias("title"))


def fixtures(pages: DataFrame, element_id: str, base: str) -> DataFrame:
    """Matches listed in a fixtures page's embedded JSON, with teams, venue and series; fields may go by several names.

    A page is parsed once; its fields are then looked up in the parsed values.
    """
    rows = pages.select("page_id", F.explode(first_list(F.try_parse_json("data"), [f"$.{base}"])).alias("m"))
    pick = lambda *paths: first_value(F.col("m"), [f"$.{p}" for p in paths])
    text = lambda *paths: rules.text_or_null(pick(*paths))
    state = F.when(pick("state").isin("PRE", "LIVE", "POST"), pick("state"))
    cancelled = parsed_boolean(F.col("m"), "$.isCancelled")
    return rows.select(
        "page_id",
        text("objectId", "id").alias("match_id"),
        text("slug").alias("slug"),
        text("title").alias("title"),
        rules.page_format(pick("format", "internationalClassId")).alias("format"),
        rules.match_state(state, cancelled).alias("state"),
        text("statusText", "status").alias("status_text"),
        rules.toss_decision(pick("tossWinnerChoice").try_cast("int")).alias("toss_decision"),
        F.try_to_timestamp(pick("startTime", "startDate")).alias("start_time"),
        texts.day_night(pick("floodlit")).alias("day_night"),
        text("series.slug").alias("series_slug"),
        text("series.objectId", "series.id").alias("series_id"),
        text("ground.longName", "ground.name").alias("venue"),
        text("teams[0].team.longName", "teams[0].team.name").alias("team_home"),
        text("teams[1].team.longName", "teams[1].team.name").alias("team_away"),
        F.coalesce(parsed_boolean(F.col("m"), "$.hasScorecard"), F.lit(False)).alias("has_scorecard"),
    )


def only_boolean(json: Column, path: str) -> Column:
    """A JSON true or false; null for anything else, the texts "true" and "false" among them."""
    return parsed_boolean(F.try_parse_json(json), path)


def parsed_boolean(value: Column, path: str) -> Column:
    """only_boolean() of a parsed value."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


#: Where a scorecard page keeps its innings, and an innings its lines.
INNINGS_PATHS = ["scorecard.innings", "innings", "match.innings"]
BATTING_LISTS = ["inningBatsmen", "batsmen", "batting"]
BOWLING_LISTS = ["inningBowlers", "bowlers", "bowling"]


def _innings(pages: DataFrame, base: str, fields: dict[str, str]) -> DataFrame:
    """A row for each innings of scorecard pages, with its number, the one given, else its place, and fields of these types.

    A page is parsed once and looked at once for all of this: an innings that is first taken out as a parsed value is built again, whole.
    """
    wanted = ",".join(f"{name}:{of}" for name, of in {"inningNumber": "string", "inningsNumber": "string", **fields}.items())
    parsed = pages.select("page_id", F.try_parse_json("data").alias("page"))
    given = F.coalesce(*[F.try_variant_get("page", f"$.{base}.{p}" if base else f"$.{p}", f"array<struct<{wanted}>>") for p in INNINGS_PATHS])
    rows = parsed.select("page_id", F.posexplode(given).alias("i", "innings"))
    rows = rows.select("page_id", "i", F.coalesce("innings.inningNumber", "innings.inningsNumber").alias("number"), *[F.col(f"innings.{name}") for name in fields])
    return rows.select("page_id", F.coalesce(rules.number_or_null(F.col("number")).cast("int"), F.col("i") + 1).alias("innings_no"), *fields)


def page_innings(pages: DataFrame, base: str) -> DataFrame:
    """Totals of the innings of scorecard pages."""
    return _innings(pages, base, dict.fromkeys(["runs", "wickets", "overs"], "string")).select(
        "page_id",
        "innings_no",
        rules.number_or_null(F.col("runs")).cast("int").alias("runs"),
        rules.number_or_null(F.col("wickets")).cast("int").alias("wickets"),
        rules.text_or_null(F.col("overs")).alias("overs"),
    )


def line_fields(paths: list[str], flags: tuple[str, ...] = ()) -> dict[str, str | dict[str, str]]:
    """The fields of a line that paths of one or two steps need: texts and objects of texts; what may be either, and flags, stay parsed values."""
    fields: dict[str, str | dict[str, str]] = {}
    for top, _, rest in (p.partition(".") for p in paths):
        had = fields.get(top, {} if rest else "string")
        fields[top] = had | {rest: "string"} if rest and isinstance(had, dict) else "string" if not rest and had == "string" else "variant"
    return fields | dict.fromkeys(flags, "variant")


def _type_text(of: str | dict) -> str:
    return of if isinstance(of, str) else f"struct<{','.join(f'{name}:{_type_text(t)}' for name, t in of.items())}>"


def _lines(pages: DataFrame, base: str, names: list[str], place: str, words: dict[str, list[str]], numbers: dict[str, list[str]], *flags: str) -> DataFrame:
    """A row for each line with its words and numbers, each the first of its paths that is there, and its flags.

    Lists of lines are taken with their innings in one look, all fields of a line at once, before rules ask for them
    several times; a loop over the lines of more code than the JVM compiles (8000 bytes) runs many times slower.
    """
    fields = line_fields([p for where in [*words.values(), *numbers.values()] for p in where], flags)
    innings = _innings(pages, base, dict.fromkeys(names, f"array<{_type_text(fields)}>"))
    rows = innings.select("page_id", "innings_no", F.posexplode(F.coalesce(*names)).alias("p", "line"))
    # by place: some fields differ in case only
    at = {name: f"field{i}" for i, name in enumerate(fields)}
    rows = rows.select("page_id", "innings_no", "p", "line.*").toDF("page_id", "innings_no", "p", *at.values())

    def value(path: str) -> Column:
        top, _, rest = path.partition(".")
        if fields[top] == "variant":
            return F.try_variant_get(at[top], f"$.{rest}" if rest else "$", "string")
        return F.col(f"{at[top]}.{rest}" if rest else at[top])

    first = lambda where: F.coalesce(*map(value, where))
    found = rows.select(
        "page_id",
        "innings_no",
        (F.col("p") + 1).alias(place),
        *[F.trim(first(where)).alias(name) for name, where in words.items()],
        *[first(where).try_cast("double").alias(name) for name, where in numbers.items()],
        *[parsed_boolean(F.col(at[flag]), "$").alias(flag) for flag in flags],
    )
    return found.select(
        "page_id", "innings_no", place, *[F.nullif(F.col(c), F.lit("")).alias(c) for c in words], *[rules.finite(F.col(c)).alias(c) for c in numbers], *flags
    )


def batting_lines(pages: DataFrame, base: str) -> DataFrame:
    """Batting lines of scorecard pages; runs and balls are 0 where they are missing."""
    words = {
        "name": ["player.longName", "player.name", "batsman.longName", "batsman.name"],
        "said": ["dismissalText.long", "dismissalText.short", "dismissalText.commentary", "dismissalText"],
    }
    numbers = {
        "source_id": ["player.objectId", "batsman.objectId"],
        "runs": ["runs"],
        "balls": ["balls", "ballsFaced"],
        "fours": ["fours"],
        "sixes": ["sixes"],
        "strike_rate": ["strikerate", "strikeRate"],
    }
    return _lines(pages, base, BATTING_LISTS, "batting_pos", words, numbers, "isOut").select(
        "page_id",
        "innings_no",
        "batting_pos",
        F.col("source_id").cast("long").alias("source_id"),
        "name",
        F.coalesce("runs", F.lit(0)).cast("int").alias("runs"),
        F.coalesce("balls", F.lit(0)).cast("int").alias("balls"),
        F.col("fours").cast("int").alias("fours"),
        F.col("sixes").cast("int").alias("sixes"),
        "strike_rate",
        F.col("isOut").alias("out"),
        rules.dismissal_text(F.col("said"), F.col("isOut")).alias("dismissal"),
    )


def bowling_lines(pages: DataFrame, base: str) -> DataFrame:
    """Bowling lines of scorecard pages; wickets and runs are 0 where they are missing."""
    words = {"name": ["player.longName", "player.name", "bowler.longName", "bowler.name"], "overs": ["overs"]}
    numbers = {
        "source_id": ["player.objectId", "bowler.objectId"],
        "wickets": ["wickets"],
        "runs": ["conceded", "runs"],
        "balls": ["balls"],
        "maidens": ["maidens"],
        "economy": ["economy"],
    }
    return _lines(pages, base, BOWLING_LISTS, "bowling_pos", words, numbers).select(
        "page_id",
        "innings_no",
        "bowling_pos",
        F.col("source_id").cast("long").alias("source_id"),
        "name",
        F.coalesce("wickets", F.lit(0)).cast("int").alias("wickets"),
        F.coalesce("runs", F.lit(0)).cast("int").alias("runs"),
        "overs",
        F.col("balls").cast("int").alias("balls"),
        F.col("maidens").cast("int").alias("maidens"),
        "economy",
    )


def player_profiles(pages: DataFrame, base: str) -> DataFrame:
    """Profiles of player pages (page_id, data)."""
    pick = lambda *paths: first_value(F.col("player"), [f"$.{p}" for p in paths])
    text = lambda *paths: rules.text_or_null(pick(*paths))
    inside = F.try_variant_get(F.try_parse_json("data"), f"$.{base}" if base else "$", "variant")
    return pages.select("page_id", F.explode(F.array(inside)).alias("player")).select(
        "page_id",
        rules.number_or_null(pick("objectId", "id")).cast("long").cast("string").alias("external_id"),
        text("longName", "name").alias("name"),
        text("country.name", "teamName").alias("country"),
        text("playingRole", "role").alias("role"),
        text("longBattingStyles[0]", "battingStyle").alias("batting_style"),
        text("longBowlingStyles[0]", "bowlingStyle").alias("bowling_style"),
    )


def fixtures_url(base: str, slug: Column, number: Column) -> Column:
    return F.concat(F.lit(f"{base}/series/"), slug, F.lit("-"), number.cast("string"), F.lit("/match-schedule-fixtures-and-results"))


def scorecard_url(base: str, series_slug: Column, series: Column, slug: Column, match: Column) -> Column:
    series, match = F.concat_ws("-", series_slug, series.cast("string")), F.concat_ws("-", slug, match.cast("string"))
    return F.concat(F.lit(f"{base}/series/"), series, F.lit("/"), match, F.lit("/full-scorecard"))


def profile_url(base: str, slug: Column, number: Column) -> Column:
    return F.concat(F.lit(f"{base}/cricketers/"), slug, F.lit("-"), number.cast("string"))


class PageSource(NamedTuple):
    """What is known of a type of page: how to read it from (page_id, data) and which pages it leads to."""

    parse: Callable[[DataFrame, str], DataFrame]
    leads_to: tuple[str, ...]


#: Types of pages; others are added with register_source().
SOURCES: dict[str, PageSource] = {
    "series-fixtures": PageSource(lambda pages, base: fixtures(pages, "", f"{base}.matches" if base else "matches"), ("scorecard",)),
    "scorecard": PageSource(batting_lines, ()),
    "player-profile": PageSource(player_profiles, ()),
}


def register_source(page_type: str, source: PageSource) -> None:
    SOURCES[page_type] = source


def source_of(page_type: str) -> PageSource:
    if page_type not in SOURCES:
        raise KeyError(f"no source is registered for pages of type {page_type}")
    return SOURCES[page_type]


def blank_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


_BINDING = "struct<cid:struct<value:string>,item:struct<value:string>,image:struct<value:string>,dob:struct<value:string>,birthPlaceLabel:struct<value:string>,roleLabel:struct<value:string>>"


def profile_bindings(responses: DataFrame) -> DataFrame:
    """Profiles from answers (json) of a knowledge base, in the SPARQL result format; the first binding of an id counts.

    Labels that are only an entity's number say nothing and become null.
    """
    parsed = F.from_json("json", f"results struct<bindings:array<{_BINDING}>>")
    rows = responses.select(parsed["results"]["bindings"].alias("all")).select(F.posexplode("all").alias("at", "b"))
    named = lambda field: F.when(~F.col(f"b.{field}.value").rlike(r"^Q\d+$"), blank_null(F.col(f"b.{field}.value")))
    picked = rows.select(
        blank_null(F.col("b.cid.value")).alias("external_id"),
        F.struct(
            "at",
            rules.last_segment(F.coalesce("b.item.value", F.lit(""))).alias("entity"),
            texts.image_file(blank_null(F.col("b.image.value"))).alias("image"),
            texts.first_day(blank_null(F.col("b.dob.value"))).alias("born"),
            named("birthPlaceLabel").alias("birth_place"),
            named("roleLabel").alias("role"),
        ).alias("row"),
    ).filter("external_id is not null")
    first = picked.groupBy("external_id").agg(F.min("row").alias("row"))
    return first.select("external_id", "row.*").drop("at")


def image_licenses(responses: DataFrame) -> DataFrame:
    """Author and license of image files from answers (json) of a media archive, tags stripped."""
    meta = "struct<Artist:struct<value:string>,LicenseShortName:struct<value:string>>"
    page = f"struct<title:string,imageinfo:array<struct<extmetadata:{meta}>>>"
    pages = F.from_json("json", f"query struct<pages:map<string,{page}>>")["query"]["pages"]
    rows = responses.select(F.explode(F.map_values(pages)).alias("p"))
    info = F.get(F.col("p.imageinfo"), 0)["extmetadata"]
    said = lambda part: rules.strip_tags(blank_null(info[part]["value"]))
    file = blank_null(F.regexp_replace("p.title", "^File:", ""))
    found = rows.filter(info.isNotNull()).select(file.alias("file"), said("Artist").alias("credit"), said("LicenseShortName").alias("license"))
    return found.filter("file is not null")
