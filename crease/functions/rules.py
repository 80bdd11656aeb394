"""Scalar rules as column expressions; everything stays in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dismissals that count for the bowler, extras that are no legal ball.
BOWLER_KINDS = ("bowled", "caught", "lbw", "stumped", "caught and bowled", "hit wicket")
ILLEGAL_EXTRAS = ("wides", "noballs")

#: Classes of cricket in display order, labels, balls of a full innings.
CLASS_ORDER = ["TEST", "ODI", "T20I", "FIRST_CLASS", "LIST_A", "T20", "T10", "HUNDRED", "OTHER"]
CLASS_LABELS = {
    "TEST": "Tests",
    "ODI": "ODIs",
    "T20I": "T20Is",
    "FIRST_CLASS": "First-class",
    "LIST_A": "List A",
    "T20": "T20s",
    "T10": "T10",
    "HUNDRED": "The Hundred",
    "OTHER": "Other",
}
INTERNATIONAL = ("TEST", "ODI", "T20I")
LIMITED_OVERS = ("ODI", "T20I", "LIST_A", "T20", "T10", "HUNDRED")


def ratio2(top: Column, bottom: Column, when: Column | None = None) -> Column:
    """top / bottom to two places, the same in any engine; null unless bottom (or when) is positive."""
    value = F.round(top.cast("double") / bottom * 100) / 100
    return F.when(bottom > 0 if when is None else when, value)


def is_legal(extra: Column) -> Column:
    return extra.isNull() | ~extra.isin(*ILLEGAL_EXTRAS)


def is_faced(extra: Column) -> Column:
    return ~extra.eqNullSafe("wides")


def charged_runs(batter: Column, extra: Column, extras: Column) -> Column:
    """Runs that count against the bowler."""
    return batter + F.when(extra.isin(*ILLEGAL_EXTRAS), extras).otherwise(0)


def bowler_wicket(kind: Column) -> Column:
    return kind.isin(*BOWLER_KINDS)


def overs_text(balls: Column) -> Column:
    return F.concat(F.floor(balls / 6).cast("int").cast("string"), F.lit("."), (balls % 6).cast("string"))


def score_text(runs: Column, wickets: Column, balls: Column) -> Column:
    return F.concat(runs.cast("string"), F.lit("/"), wickets.cast("string"), F.lit(" ("), overs_text(balls), F.lit(")"))


def normal_name(name: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def token(raw: Column) -> Column:
    """Upper-cased letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]", "")


def text_or_null(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def finite(value: Column) -> Column:
    """A double, null for what is no finite number; NaN is greater than infinity."""
    return F.when(F.abs(value) < float("inf"), value)


def number_or_null(x: Column) -> Column:
    return finite(x.cast("string").try_cast("double"))


def match_class(match_type: Column, team_type: Column) -> Column:
    """Class of cricket from the match type and whether the teams are international."""
    t = token(match_type)
    both = F.lower(F.coalesce(team_type, F.lit(""))) == "international"
    either = lambda yes, no: F.when(both, yes).otherwise(no)
    return (
        F.when(t == "TEST", either("TEST", "FIRST_CLASS"))
        .when(t == "MDM", "FIRST_CLASS")
        .when(t == "ODI", either("ODI", "LIST_A"))
        .when(t == "ODM", "LIST_A")
        .when(t == "T20", either("T20I", "T20"))
        .when(t == "IT20", "T20I")
        .when(t == "T10", "T10")
        .when(t.isin("HUNDRED", "THEHUNDRED"), "HUNDRED")
        .otherwise("OTHER")
    )


def page_format(raw: Column) -> Column:
    """Match format from the token on a page."""
    t = token(raw)
    return (
        F.when(t.isin("T20", "T20I"), "T20")
        .when(t.isin("ODI", "OD", "LISTA"), "ODI")
        .when(t.isin("TEST", "FIRSTCLASS"), "TEST")
        .when(t == "T10", "T10")
        .when(t.isin("HUNDRED", "THEHUNDRED", "100BALL"), "HUNDRED")
        .otherwise("OTHER")
    )


def archive_format(raw: Column) -> Column:
    """Match format from the token in a match document."""
    t = token(raw)
    return (
        F.when(t.isin("T20", "IT20"), "T20")
        .when(t.isin("ODI", "ODM"), "ODI")
        .when(t.isin("TEST", "MDM"), "TEST")
        .when(t.isin("HUNDRED", "THEHUNDRED"), "HUNDRED")
        .otherwise("OTHER")
    )


def match_state(state: Column, cancelled: Column) -> Column:
    return (
        F.when(F.coalesce(cancelled, F.lit(False)), "ABANDONED")
        .when(state == "LIVE", "LIVE")
        .when(state == "POST", "COMPLETED")
        .otherwise("SCHEDULED")
    )


def dismissal_token(kind: Column) -> Column:
    """Dismissal from the token in a match document."""
    k = F.lower(F.trim(kind))
    known = {
        "bowled": "BOWLED",
        "caught": "CAUGHT",
        "lbw": "LBW",
        "run out": "RUN_OUT",
        "stumped": "STUMPED",
        "caught and bowled": "CAUGHT_AND_BOWLED",
        "hit wicket": "HIT_WICKET",
        "retired hurt": "RETIRED_OUT",
        "retired out": "RETIRED_OUT",
        "retired not out": "RETIRED_OUT",
        "obstructing the field": "OBSTRUCTING",
        "timed out": "TIMED_OUT",
    }
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, k), F.lit("OTHER"))


def dismissal_text(text: Column, out: Column) -> Column:
    """Dismissal from the words on a page; the first rule that fits decides."""
    t = F.lower(F.trim(text))
    blank = F.coalesce(text, F.lit("")) == ""
    return (
        F.when(out.eqNullSafe(False), "NOT_OUT")
        .when(blank & F.coalesce(out, F.lit(False)), "OTHER")
        .when(blank | t.contains("not out"), "NOT_OUT")
        .when(t.contains("run out"), "RUN_OUT")
        .when(t.startswith("st ") | t.contains("stumped"), "STUMPED")
        .when(t.startswith("lbw"), "LBW")
        .when(t.contains("c & b") | t.contains("c and b") | t.contains("caught and bowled"), "CAUGHT_AND_BOWLED")
        .when(t.startswith("c ") | t.contains("caught"), "CAUGHT")
        .when(t.contains("hit wicket"), "HIT_WICKET")
        .when(t.startswith("b ") | t.contains("bowled"), "BOWLED")
        .when(t.contains("retired"), "RETIRED_OUT")
        .otherwise("OTHER")
    )


def toss_decision(choice: Column) -> Column:
    return F.when(choice == 1, "BAT").when(choice == 2, "FIELD")


def quota_balls(match_class: Column) -> Column:
    """Balls of a full innings; 0 where there is no limit."""
    return (
        F.when(match_class.isin("ODI", "LIST_A"), 300)
        .when(match_class.isin("T20", "T20I"), 120)
        .when(match_class == "HUNDRED", 100)
        .when(match_class == "T10", 60)
        .otherwise(0)
    )


def class_label(match_class: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, match_class), match_class, F.lit("Other"))


def class_rank(match_class: Column) -> Column:
    """Place in the display order; unknown classes last."""
    place = F.array_position(F.array(*map(F.lit, CLASS_ORDER)), match_class)
    return F.when(place > 0, place - 1).otherwise(len(CLASS_ORDER)).cast("int")


def class_from_format(match_format: Column, national: Column) -> Column:
    """Class of an older row that has only its format and whether both teams are national."""
    both = F.coalesce(national, F.lit(False))
    return (
        F.when(match_format == "TEST", F.when(both, "TEST").otherwise("FIRST_CLASS"))
        .when(match_format == "ODI", F.when(both, "ODI").otherwise("LIST_A"))
        .when(match_format == "T20", F.when(both, "T20I").otherwise("T20"))
        .when(match_format.isin("T10", "HUNDRED"), match_format)
        .otherwise("OTHER")
    )


def gender_label(gender: Column) -> Column:
    return F.when(gender == "male", "Men's cricket").when(gender == "female", "Women's cricket")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


#: Words that give no letter to an acronym, and files that are page furniture.
SMALL_WORDS = ("the", "of", "and")
FURNITURE = r"commons-logo|wiki|ambox|edit-|question_book|folder|symbol|red_x|yes_check|disambig|pictogram|flag_of|crystal|nuvola|magnify|portal|padlock|loudspeaker|increase|decrease|steady|sound-icon|kit[ _]|kit_body|stadium|\.jpg$|\.jpeg$"


def name_words(name: Column) -> Column:
    """Lower-cased words of more than one character, without what is in brackets."""
    plain = F.regexp_replace(F.regexp_replace(name, r"\(.*?\)", " "), "[^A-Za-z0-9 ]", " ")
    return F.filter(F.split(F.lower(F.trim(plain)), r"\s+"), lambda w: F.length(w) > 1)


def acronym(name: Column) -> Column:
    """First letters of the words of a name but for small words."""
    words = F.filter(name_words(name), lambda w: ~w.isin(*SMALL_WORDS))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def logo_score(file: Column, name: Column) -> Column:
    """How likely an image file is the logo of a name; -100 for what cannot be one."""
    low = F.lower(file)
    short = acronym(name)
    bare = F.regexp_replace(F.regexp_replace(file, "(?i)^file:", ""), r"(?i)\.[a-z]+$", "")
    bare = F.upper(F.regexp_replace(bare, "[^A-Za-z0-9]", ""))
    points = (
        F.when(F.contains(low, F.lit("logo")), 3).otherwise(0)
        + F.when(F.endswith(low, F.lit(".svg")), 2).when(F.endswith(low, F.lit(".png")), 1).otherwise(0)
        + F.size(F.filter(name_words(name), lambda w: F.contains(low, w)))
        + F.when((F.length(short) >= 2) & F.startswith(bare, short), 3).otherwise(0)
    )
    return F.when(low.rlike(FURNITURE) | ~low.rlike(r"\.(svg|png|jpg|jpeg)$"), -100).otherwise(points)


def best_logo(names: Column, name: Column, least: int = 3) -> Column:
    """The best-scoring file of a list, the first of equals; null below the least score."""
    scored = F.transform(names, lambda f, i: F.struct(logo_score(f, name).alias("s"), (-i).alias("i"), f.alias("f")))
    best = F.array_max(scored)
    return F.when(best["s"] >= least, best["f"])


def url_segment(text: Column) -> Column:
    """Percent-encoded text; '-' stands for null."""
    return F.coalesce(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("-"))


def from_segment(segment: Column) -> Column:
    return F.when(segment != "-", F.url_decode(segment))


def age_years(born: Column, today: Column) -> Column:
    """Whole years, null outside 0 to 119."""
    years = F.floor(F.months_between(today, born) / 12).cast("int")
    return F.when((years >= 0) & (years < 120), years)


def contains_any(query: Column, *columns: Column) -> Column:
    """Whether any column contains the query, ignoring case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(query)), F.lit(False))
    return out


def optional_match(column: Column, value: str | None) -> Column:
    """No filter for None; '' asks for null; otherwise equality."""
    return F.lit(True) if value is None else column.eqNullSafe(F.nullif(F.lit(value), F.lit("")))


def edition(event: Column, season: Column, event_name: str | None, season_name: str | None) -> Column:
    return event.eqNullSafe(F.lit(event_name)) & season.eqNullSafe(F.lit(season_name))
