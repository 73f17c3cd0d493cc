"""Tags for free-text messages: what is asked, about whom, in which mode, when."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import collapse, lookup

# --- Fixed values -----------------------------------------------------------
INTENT_RULES = (
    (r"\b(what formats|which formats|capabilities|what can you predict)\b", "model_capabilities"),
    (r"^\s*(help|how do i|what can you)\b", "help"),
    (r"\b(why|explain|drivers?)\b", "explain_prediction"),
    (r"\b(need \d+|from \d+ balls|wickets left|live)\b", "live_prediction"),
    (r"\b(predict|who will win|who wins|before toss|pre[- ]toss)\b", "predict_match"),
    (r"\bvs\b|\bversus\b", "predict_match"),
)
INTENT_ALIASES = {
    "predict_match": "predict_match",
    "predict": "predict_match",
    "pre_toss": "predict_match",
    "live_prediction": "live_prediction",
    "live": "live_prediction",
    "explain_prediction": "explain_prediction",
    "explain": "explain_prediction",
    "why": "explain_prediction",
    "model_capabilities": "model_capabilities",
    "capabilities": "model_capabilities",
    "help": "help",
}
TEAM_SHORTCUTS = {
    "mi": "Mumbai Indians",
    "csk": "Chennai Super Kings",
    "rcb": "Royal Challengers Bengaluru",
    "kkr": "Kolkata Knight Riders",
    "dc": "Delhi Capitals",
    "rr": "Rajasthan Royals",
    "srh": "Sunrisers Hyderabad",
    "pbks": "Punjab Kings",
    "gt": "Gujarat Titans",
    "lsg": "Lucknow Super Giants",
    "ind": "India",
    "india": "India",
    "aus": "Australia",
    "australia": "Australia",
    "eng": "England",
    "england": "England",
}
LEAD_WORDS = ("predict", "who", "will", "win", "wins", "please", "can", "you", "for")
STOP_WORDS = ("tomorrow", "today", "before", "after", "in", "on", "t20i", "t20", "ipl", "odi")
SEPARATOR = r"(?i)\s+(?:vs\.?|versus)\s+"
EDGE_MARKS = " .,?!"
WORDS_PER_TEAM = 4
# ----------------------------------------------------------------------------


def intent(message: Column) -> Column:
    text = F.lower(F.trim(message))
    label = None
    for pattern, name in INTENT_RULES:
        hit = text.rlike(pattern)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise("unknown")


def intent_alias(name: Column) -> Column:
    return lookup(INTENT_ALIASES, F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_")))


def expand_team(name: Column) -> Column:
    tidy = collapse(name)
    return F.coalesce(lookup(TEAM_SHORTCUTS, F.lower(tidy)), tidy)


def teams(message: Column) -> tuple[Column, Column]:
    """The two sides around 'vs'; both NULL when there is no usable pair."""
    parts = F.split(message, SEPARATOR, 2)

    def words(side: Column) -> Column:
        return F.transform(F.split(side, r"\s+"), lambda w: F.btrim(w, F.lit(EDGE_MARKS)))

    left = F.filter(words(F.element_at(parts, 1)), lambda w: w != "")
    start = F.array_position(F.transform(left, lambda w: ~F.lower(w).isin(*LEAD_WORDS)), True)
    left = F.when(start > 0, F.slice(left, start.cast("int"), F.size(left))).otherwise(
        F.array().cast("array<string>")
    )
    left = F.slice(left, F.greatest(F.size(left) - (WORDS_PER_TEAM - 1), F.lit(1)), WORDS_PER_TEAM)
    right = words(F.try_element_at(parts, F.lit(2)))
    stop = F.array_position(F.transform(right, lambda w: F.lower(w).isin(*STOP_WORDS)), True)
    right = F.when(stop > 0, F.slice(right, 1, (stop - 1).cast("int"))).otherwise(right)
    right = F.slice(F.filter(right, lambda w: w != ""), 1, WORDS_PER_TEAM)
    one = expand_team(F.concat_ws(" ", left))
    two = expand_team(F.concat_ws(" ", right))
    usable = (F.size(parts) == 2) & (one != "") & (two != "") & (F.lower(one) != F.lower(two))
    return F.when(usable, one), F.when(usable, two)


def format_hint(message: Column) -> Column:
    text = F.lower(message)
    return (
        F.when(text.contains("t20i") | text.contains("twenty20 international"), "T20I")
        .when(text.contains("hundred"), "HUNDRED")
        .when(text.rlike(r"\bodi\b"), "ODI")
        .when(text.rlike(r"\bt20\b") | text.contains("ipl"), "T20")
    )


def mode_hint(message: Column) -> Column:
    text = F.lower(message)
    return (
        F.when(text.rlike("after toss|post[ -]toss"), "POST_TOSS")
        .when(text.rlike("before toss|pre[ -]toss"), "PRE_TOSS")
        .when(text.contains("live") | text.contains("need "), "LIVE")
    )


def competition_hint(message: Column) -> Column:
    return F.when(message.rlike(r"(?i)\bipl\b"), "IPL")


def date_hint(message: Column, today: Column) -> Column:
    text = F.lower(message)
    written = F.regexp_extract(message, r"\b(20\d{2}-\d{2}-\d{2})\b", 1)
    return (
        F.when(text.contains("tomorrow"), F.date_add(today, 1))
        .when(text.contains("today"), today)
        .when(written != "", F.try_to_date(written, "yyyy-MM-dd"))
    )
