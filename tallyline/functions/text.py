"""Names and labels: cleaning, team and competition aliases, format labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
FORMATS = ("TEST", "ODI", "T20I", "T20", "T10", "HUNDRED", "FIRST_CLASS", "LIST_A", "OTHER")
LIMITED_OVERS = ("ODI", "T20I", "T20", "T10", "HUNDRED", "LIST_A")
UNLIMITED_OVERS = ("TEST", "FIRST_CLASS")
MODES = ("PRE_TOSS", "POST_TOSS")

MATCH_TYPES = {
    "test": "TEST",
    "odi": "ODI",
    "t20i": "T20I",
    "it20": "T20I",
    "t20": "T20",
    "t10": "T10",
    "the hundred": "HUNDRED",
    "hundred": "HUNDRED",
    "100": "HUNDRED",
    "mdm": "FIRST_CLASS",
    "first class": "FIRST_CLASS",
    "first-class": "FIRST_CLASS",
    "fc": "FIRST_CLASS",
    "odm": "LIST_A",
    "list a": "LIST_A",
    "list-a": "LIST_A",
}

COMPETITIONS = {
    "indian premier league": "IPL",
    "ipl": "IPL",
    "tamil nadu premier league": "TNPL",
    "tnpl": "TNPL",
    "big bash league": "BBL",
    "bbl": "BBL",
    "women's big bash league": "WBBL",
    "wbbl": "WBBL",
    "pakistan super league": "PSL",
    "psl": "PSL",
    "caribbean premier league": "CPL",
    "cpl": "CPL",
    "the hundred": "The Hundred",
    "hundred": "The Hundred",
    "bangladesh premier league": "BPL",
    "lanka premier league": "LPL",
    "women's premier league": "WPL",
    "major league cricket": "MLC",
    "international league t20": "ILT20",
    "ilt20": "ILT20",
    "sa20": "SA20",
    "super smash": "Super Smash",
    "t20 blast": "T20 Blast",
    "syed mushtaq ali trophy": "SMAT",
    "county championship": "County Championship",
}

TEAMS = {
    "royal challengers bangalore": "Royal Challengers Bengaluru",
    "kings xi punjab": "Punjab Kings",
    "delhi daredevils": "Delhi Capitals",
    "rising pune supergiant": "Rising Pune Supergiants",
    "st lucia zouks": "St Lucia Kings",
    "st lucia stars": "St Lucia Kings",
    "barbados tridents": "Barbados Royals",
}

MODE_ALIASES = {
    "PRE_TOSS": "PRE_TOSS",
    "PRETOSS": "PRE_TOSS",
    "POST_TOSS": "POST_TOSS",
    "POSTTOSS": "POST_TOSS",
    "LIVE": "LIVE",
}
# ----------------------------------------------------------------------------


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL when the key is absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def collapse(value: Column | str) -> Column:
    """Trim and turn every run of white space into one blank; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(value).cast("string"), F.lit("")), r"\s+", " "))


def clean(value: Column | str) -> Column:
    return F.lower(collapse(value))


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def has_any(text: Column, markers: Iterable[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | text.contains(marker)
    return found


def canonical_team(name: Column | str, aliases: Mapping[str, str] = TEAMS) -> Column:
    """Stable team name; unknown names are only trimmed, NULL becomes ''."""
    tidy = collapse(name)
    return F.coalesce(lookup(aliases, F.lower(tidy)), tidy)


def canonical_competition(name: Column | str) -> Column:
    tidy = clean(name)
    known = F.coalesce(lookup(COMPETITIONS, tidy), F.trim(col(name)))
    return F.when(tidy != "", known)


def contest_format(
    match_type: Column | str,
    team_type: Column | str,
    competition: Column | str,
    balls_per_over: Column,
    scheduled_overs: Column,
) -> Column:
    """Format label; the order of the rules is part of the result."""
    kind, name = clean(match_type), clean(competition)
    national = clean(team_type) == "international"
    plain = lookup(MATCH_TYPES, kind)
    twenty = F.when(national, "T20I").otherwise("T20")
    return (
        F.when((balls_per_over == 5) | name.contains("hundred"), "HUNDRED")
        .when((scheduled_overs == 10) | has_any(name, ("t10", "t:10", "t-10")), "T10")
        .when(plain == "T20", twenty)
        .when(plain.isNotNull(), plain)
        .when(kind.contains("test"), "TEST")
        .when(kind.isin("twenty20 international", "twenty20 internationals"), "T20I")
        .when(kind.contains("odi"), "ODI")
        .when(has_any(kind, ("t20", "twenty20")), twenty)
        .otherwise("OTHER")
    )


def prediction_mode(value: Column | str) -> Column:
    """Mode label from its spellings, NULL when unknown."""
    return lookup(MODE_ALIASES, F.replace(F.upper(F.trim(col(value))), F.lit("-"), F.lit("_")))


def passes_filters(
    format_: Column,
    competition: Column,
    formats: Iterable[str] | None = None,
    competitions: Iterable[str] | None = None,
) -> Column:
    """Format is listed and the competition contains a listed name, ignoring case."""
    keep = F.lit(True)
    if formats:
        keep = keep & format_.isin(*[f.upper() for f in formats])
    if competitions:
        name = F.lower(F.coalesce(competition, F.lit("")))
        keep = keep & has_any(name, [c.lower() for c in competitions])
    return keep
