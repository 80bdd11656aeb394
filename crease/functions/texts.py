"""Text forms of figures, matches, teams and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crease.functions import rules

#: What stands for a missing figure, between parts of a line, and between two dates.
DASH, DOT, SPAN = "—", " · ", " – "
#: Fixed value: the part of an image address before the file.
FILE_PATH = "Special:FilePath/"


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, by its exact binary value; an exact tie goes away from zero."""
    x = x.cast("double")
    unit = 10.0**places
    twice = F.abs(x) * (2 * unit)
    tie = (twice == F.floor(twice)) & (twice % 2 == 1)
    up = F.signum(x) * (F.floor(F.abs(x) * unit) + 1) / unit
    return F.replace(F.format_number(F.when(tie, up).otherwise(x), places), F.lit(","), F.lit(""))


def fixed_number(x: Column, places: int) -> Column:
    return fixed(x, places).cast("double")


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def or_dash(x: Column) -> Column:
    return F.coalesce(x, F.lit(DASH))


def rate_text(nrr: Column) -> Column:
    """A net run rate with its sign and three decimals."""
    return F.concat(F.when(nrr > 0, "+").otherwise(""), fixed(nrr, 3))


def win_percent_text(won: Column, played: Column) -> Column:
    return or_dash(F.when(played > 0, fixed(won.cast("double") / played * 100, 1)))


def high_score_text(innings: Column, runs: Column, not_out: Column) -> Column:
    return F.when(innings > 0, F.concat(runs.cast("string"), F.when(not_out, "*").otherwise(""))).otherwise(DASH)


def figures_text(innings: Column, wickets: Column, runs: Column) -> Column:
    return F.when(innings > 0, F.concat(wickets.cast("string"), F.lit("/"), runs.cast("string"))).otherwise(DASH)


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def match_title(home: Column, away: Column, event: Column) -> Column:
    both = blank_to_null(home).isNotNull() & blank_to_null(away).isNotNull()
    return F.when(both, F.concat(home, F.lit(" vs "), away)).otherwise(F.coalesce(event, F.lit("Match")))


def result_text(winner: Column) -> Column:
    return F.coalesce(F.concat(blank_to_null(winner), F.lit(" won")), F.lit(f"Result {DASH}"))


def meta_line(*parts: Column) -> Column:
    """The parts that are not blank, with dots between them."""
    return F.array_join(F.array(*map(blank_to_null, parts)), DOT)


def toss_text(winner: Column, decision: Column) -> Column:
    return F.concat(blank_to_null(winner), F.lit(" won the toss and chose to "), blank_to_null(decision))


def date_span(first: Column, last: Column) -> Column:
    """One date, or two with a dash between; null without both."""
    first, last = blank_to_null(first), blank_to_null(last)
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(SPAN), last))


def full_image_url(path: Column, base: str) -> Column:
    """An absolute address as it is, a path behind the base, null for none."""
    path = blank_to_null(path)
    return F.when(F.startswith(path, F.lit("http")), path).otherwise(F.concat(F.lit(base), path))


def image_file(uri: Column) -> Column:
    """The decoded file name behind the file path, or the whole decoded text."""
    file = F.when(F.contains(uri, F.lit(FILE_PATH)), F.substring_index(uri, FILE_PATH, -1)).otherwise(uri)
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def day_night(floodlit: Column) -> Column:
    """Whether a match is played under lights; null if nothing is said."""
    said = rules.text_or_null(floodlit)
    return F.when(said.isNotNull(), said.isin("night", "day/night"))


def crest(logo: Column, flag: Column) -> Column:
    return F.coalesce(logo, flag)


def kind_label(is_national: Column) -> Column:
    return F.when(is_national, "International").otherwise("League / Domestic")


def date_only(at: Column) -> Column:
    """Midnight of a time's day in the session's zone (UTC)."""
    return F.date_trunc("day", at)


def first_day(text: Column) -> Column:
    """The date at the start of a timestamp text."""
    return F.substring(text, 1, 10)


def number_or(x: Column, fallback: float) -> Column:
    return F.coalesce(rules.number_or_null(x), F.lit(fallback))


def any_text(x: Column) -> Column:
    """A text or number as trimmed text, null if empty."""
    return rules.text_or_null(x.cast("string"))
