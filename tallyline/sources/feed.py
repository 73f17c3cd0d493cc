"""Live feed pages: untrusted records turned into checked columns.

Everything is a stateless projection, so the same functions serve a folder read
in batch and one read as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import schemas
from tallyline.functions.binding import bind
from tallyline.functions.scoring import live_metrics, overs_text_to_balls
from tallyline.functions.text import blank_to_null, canonical_team, clean, has_any
from tallyline.sources.documents import iso_date

# --- Fixed values -----------------------------------------------------------
TERMINAL_MARKERS = (
    " won by ",
    " won the match",
    "awarded the match",
    "abandoned",
    "cancelled",
    "canceled",
    "no result",
    "refused to play",
    "forfeit",
    "forfeited",
    "match tied",
    "match drawn",
)
RAIN_MARKERS = (
    "dls",
    "duckworth",
    "revised target",
    "due to rain",
    "rain reduced",
    "reduced due to rain",
    "overs game due to rain",
)
COMPETITION_MARKERS = (
    ("tamil nadu premier league", "TNPL"),
    ("indian premier league", "IPL"),
    ("caribbean premier league", "CPL"),
    ("pakistan super league", "PSL"),
    ("big bash league", "BBL"),
    ("women's big bash league", "WBBL"),
    ("womens big bash league", "WBBL"),
    ("women's premier league", "WPL"),
    ("womens premier league", "WPL"),
    ("bangladesh premier league", "BPL"),
    ("lanka premier league", "LPL"),
    ("major league cricket", "MLC"),
    ("t20 blast", "T20 Blast"),
    ("syed mushtaq ali trophy", "SMAT"),
    ("the hundred", "The Hundred"),
)
RAIN_WARNING = (
    "Possible rain/DLS-adjusted chase detected but currentMatches did not provide a reliable target."
)
FULL_INNINGS = 120
# ----------------------------------------------------------------------------
# Innings of the formats that are scored: the first two entries count.
MAX_SCORES = 2
# Our own wording.
HUNDRED_WARNING = (
    "The Hundred is excluded from the T20 live model because its feed reports balls, not overs."
)
OUTSIDE_WARNING = "A domestic T20 outside the original training league; historical coverage may be weak."


def feed_format(match_type: Column, name: Column, strict: bool = False) -> Column:
    """Format from the match name first, its type second.

    ``strict`` asks for whole words, so that 'latest' is no test match.
    """
    title, kind = clean(name), clean(match_type)

    def says(word: str) -> Column:
        return title.rlike(rf"\b{word}\b") if strict else title.contains(word)

    return (
        F.when(title.contains("hundred"), "HUNDRED")
        .when(has_any(title, ("t20i", "twenty20 international")), "T20I")
        .when(says("odi") | title.contains("one-day international"), "ODI")
        .when(says("test"), "TEST")
        .when(kind.isin("t20i", "t20", "odi", "test"), F.upper(kind))
        .otherwise("OTHER")
    )


def feed_competition(name: Column, strict: bool = False) -> Column:
    """First marker in the name wins; ``strict`` tries the longest marker first."""
    title = clean(name)
    markers = COMPETITION_MARKERS
    if strict:
        markers = tuple(sorted(markers, key=lambda m: -len(m[0])))
    return F.coalesce(*[F.when(title.contains(m), label) for m, label in markers])


def feed_gender(name: Column, team1: Column, team2: Column) -> Column:
    joined = clean(F.concat_ws(" ", name, team1, team2))
    return F.when(joined.contains("women"), "female").otherwise("male")


def overs_text(value: Column) -> Column:
    """Overs as text, '15' for 15.0 and '' when absent."""
    return F.coalesce(F.regexp_replace(F.trim(value), r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def label_team(label: Column, team1: Column, team2: Column) -> Column:
    """The one team a label names; NULL when it names none or both."""
    text = clean(label)
    first, second = text.contains(clean(team1)), text.contains(clean(team2))
    return F.when(first & ~second, team1).when(second & ~first, team2)


def derive_target(status: Column, scores: Column) -> tuple[Column, Column]:
    """(target, warning) of a chase from its status text or the first total."""
    text = clean(status)
    two = F.size(scores) >= 2
    stated = F.regexp_extract(text, r"\btarget(?:\s+of|\s+is|:)?\s+(\d+)\b", 1)
    needed = F.regexp_extract(text, r"\bneeds?\s+(\d+)\s+runs?\b", 1)
    current = F.try_element_at(scores, F.lit(-1))
    rain = has_any(text, RAIN_MARKERS)
    target = F.when(
        two,
        F.when(stated != "", stated.try_cast("int"))
        .when(needed != "", current["runs"] + needed.try_cast("int"))
        .when(~rain, F.try_element_at(scores, F.lit(1))["runs"] + 1),
    )
    return target, F.when(two & (stated == "") & (needed == "") & rain, RAIN_WARNING)


def is_terminal(status: Column, ended: Column) -> Column:
    text = F.concat(F.lit(" "), F.lower(F.trim(status)), F.lit(" "))
    return ended | has_any(text, TERMINAL_MARKERS)


def _truthy(value: Column) -> Column:
    return F.coalesce(~F.lower(value).isin("false", "", "0"), F.lit(False))


# A page is one line: no text has this in it.
PAGE_END = "\0" * 8


def _json(reader, path: str, utf8: bool) -> DataFrame:
    """Pages by one of Spark's two readers; for JSON in UTF-8, as the standard asks for, they give the same rows.

    The multi-line reader asks the file anew for each number or mark it reads as text, which takes several times as long
    as all else; a line is read from memory. In UTF-16 and UTF-32 a line loses these values.
    """
    reader = reader.schema(schemas.FEED_PAGE)
    return (reader.option("lineSep", PAGE_END) if utf8 else reader.option("multiLine", True)).json(path)


def read_pages(spark: SparkSession, path: str, utf8: bool = True) -> DataFrame:
    return _json(spark.read, path, utf8)


def stream_pages(spark: SparkSession, path: str, utf8: bool = True) -> DataFrame:
    return _json(spark.readStream, path, utf8)


def records(pages: DataFrame) -> DataFrame:
    """Records of successful pages."""
    return pages.where(F.col("status") == "success").select(F.explode("data").alias("raw")).where(
        F.col("raw").isNotNull()
    )


def normalize(raws: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Checked feed records: at most two scores, sides assigned, target derived.

    Records without an id or without exactly two teams are dropped.
    """
    r = F.col("raw")
    base = raws.where(
        (F.size(r["teams"]) == 2) & (F.trim(F.coalesce(r["id"], F.lit(""))) != "")
    ).select(
        *keep,
        F.trim(r["id"]).alias("match_id"),
        F.trim(F.coalesce(r["name"], F.lit(""))).alias("name"),
        r["matchType"].alias("match_type_raw"),
        F.trim(F.coalesce(r["status"], F.lit(""))).alias("status"),
        blank_to_null(F.trim(r["venue"])).alias("venue"),
        F.coalesce(iso_date(r["date"]), iso_date(r["dateTimeGMT"])).alias("date"),
        r["teams"][0].alias("team1"),
        r["teams"][1].alias("team2"),
        blank_to_null(F.trim(r["tossWinner"])).alias("toss_winner"),
        blank_to_null(F.lower(F.trim(r["tossChoice"]))).alias("_toss"),
        _truthy(r["matchStarted"]).alias("match_started"),
        _truthy(r["matchEnded"]).alias("match_ended"),
        F.slice(
            F.filter(F.coalesce(r["score"], F.array()), lambda s: s.isNotNull()), 1, MAX_SCORES
        ).alias("_raw"),
    )
    team1, team2 = F.col("team1"), F.col("team2")
    base = base.select(
        "*",
        feed_format(F.col("match_type_raw"), F.col("name"), strict).alias("format"),
        feed_competition(F.col("name"), strict).alias("competition"),
        feed_gender(F.col("name"), team1, team2).alias("gender"),
        F.when(F.col("_toss") == "bowl", "field").otherwise(F.col("_toss")).alias("toss_decision"),
    )
    labels = F.transform("_raw", lambda s: label_team(s["inning"], team1, team2))
    sides = bind(labels, lambda known: _alternate(known, team1, team2))
    scores = bind(sides, _scores)
    state = bind(scores, lambda s: bind(_state(s), lambda st: _verdict(s, st)))
    out = base.select(
        *keep, "match_id", "name", "match_type_raw", "format", "competition", "gender", "status", "venue",
        "date", "team1", "team2", "toss_winner", "toss_decision", "match_started", "match_ended",
        F.col("format").isin("T20", "T20I").alias("supported_format"), state.alias("_s"),
    )
    return out.select("*", "_s.*").drop("_s")


def _alternate(known: Column, team1: Column, team2: Column) -> Column:
    """Sides alternate: one known side gives the other, a repeat is corrected."""
    one, two = F.try_element_at(known, F.lit(1)), F.try_element_at(known, F.lit(2))

    def other(side: Column) -> Column:
        return F.when(side == team1, team2).otherwise(team1)

    first = F.when(one.isNull() & two.isNotNull(), other(two)).otherwise(one)
    second = F.when(one.isNotNull() & (two.isNull() | (one == two)), other(one)).otherwise(two)
    return F.when(F.size(known) >= 2, F.array(first, second)).otherwise(known)


def _number(text: Column) -> Column:
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, 0).otherwise(text.try_cast("double").try_cast("int"))


def _scores(sides: Column) -> Column:
    """Score entries with numbers, legal balls and the side that bats."""
    t20 = F.col("format").isin("T20", "T20I")
    entries = F.transform(
        "_raw",
        lambda s, i: F.struct(
            (i + 1).alias("entry"),
            _number(s["r"]).alias("runs"),
            _number(s["w"]).alias("wickets"),
            overs_text(s["o"]).alias("overs_text"),
            F.when(t20, overs_text_to_balls(overs_text(s["o"]))).alias("legal_balls"),
            F.coalesce(s["inning"], F.lit("")).alias("innings_label"),
            F.get(sides, i).alias("batting_team"),
        ),
    )
    return F.filter(entries, lambda s: s["runs"].isNotNull() & s["wickets"].isNotNull())


def _state(scores: Column) -> Column:
    target, rain = derive_target(F.col("status"), scores)
    current = F.try_element_at(scores, F.lit(-1))
    return F.struct(
        target.alias("target"),
        rain.alias("rain"),
        F.when(F.size(scores) > 0, F.least(F.size(scores), F.lit(2))).alias("innings_number"),
        *[current[n].alias(n) for n in ("batting_team", "runs", "wickets", "legal_balls")],
        is_terminal(F.col("status"), F.col("match_ended")).alias("terminal"),
    )


def _verdict(scores: Column, state: Column) -> Column:
    """All derived columns of a record, with its warnings and refusals."""
    t20 = F.col("format").isin("T20", "T20I")
    unknown_side = F.transform(
        F.filter(scores, lambda s: s["batting_team"].isNull()),
        lambda s: F.concat(
            F.lit("Could not identify batting team for score entry "), s["entry"].cast("string"), F.lit(".")
        ),
    )
    bad_overs = F.transform(
        F.filter(scores, lambda s: t20 & s["legal_balls"].isNull()),
        lambda s: F.concat(
            F.lit("Could not parse overs for score entry "), s["entry"].cast("string"), F.lit(": '"),
            s["overs_text"], F.lit("'."),
        ),
    )
    notes = F.array(
        state["rain"],
        F.when(F.col("competition") == "The Hundred", HUNDRED_WARNING),
        F.when((F.col("format") == "T20") & (F.col("competition") != "IPL"), OUTSIDE_WARNING),
    )
    refused = refusals(scores, state)
    names = ("target", "innings_number", "batting_team", "runs", "wickets", "legal_balls", "terminal")
    return bind(
        refused,
        lambda why: F.struct(
            scores.alias("scores"),
            *[state[n].alias(n) for n in names],
            F.concat(unknown_side, bad_overs, F.array_compact(notes)).alias("warnings"),
            why.alias("refusals"),
            ((F.size(why) == 0) & F.col("date").isNotNull()).alias("predictable"),
        ),
    )


def refusals(scores: Column, state: Column) -> Column:
    """Why a record cannot be scored, in a fixed order."""
    t20 = F.col("format").isin("T20", "T20I")
    return F.array_compact(
        F.array(
            F.when(~F.col("match_started"), "match has not started"),
            F.when(state["terminal"], "match is already terminal"),
            F.when(~t20, F.concat(F.lit("unsupported format "), "format")),
            F.when(F.size(scores) == 0, "no score available").when(
                state["legal_balls"].isNull(), "overs could not be parsed"
            ),
            F.when(F.coalesce(state["batting_team"], F.lit("")) == "", "batting team is ambiguous"),
            F.when(
                (state["innings_number"] == 2) & state["target"].isNull(), "chase target is unavailable"
            ),
        )
    )


def state_label() -> Column:
    return (
        F.when(F.col("predictable"), "LIVE/PREDICTABLE")
        .when(F.col("terminal"), "ENDED/TERMINAL")
        .when(~F.col("match_started"), "UPCOMING")
        .when(~F.col("supported_format"), F.concat(F.lit("UNSUPPORTED/"), "format"))
        .otherwise("LIVE/AMBIGUOUS")
    )


def score_text() -> Column:
    parts = F.transform(
        "scores",
        lambda s: F.concat(
            F.coalesce(s["batting_team"], F.lit("?")), F.lit(" "), s["runs"].cast("string"), F.lit("/"),
            s["wickets"].cast("string"), F.lit(" ("),
            F.when(s["overs_text"] != "", s["overs_text"]).otherwise("?"), F.lit(")"),
        ),
    )
    return F.when(F.size("scores") == 0, "no score").otherwise(F.array_join(parts, " | "))


def listing(feed: DataFrame) -> DataFrame:
    return feed.select(
        "match_id", "name", "format", "competition", state_label().alias("state"),
        score_text().alias("score"), "target", "predictable", "refusals",
    )


def live_metadata(feed: DataFrame) -> DataFrame:
    """Match facts of the records that can be scored now."""
    t20 = F.col("supported_format")
    return feed.where("predictable").select(
        "match_id", "format", "competition", "date", "venue", "team1", "team2", "toss_winner",
        "toss_decision", "gender",
        F.when(F.col("format") == "T20I", "international").alias("team_type"),
        F.when(t20, 6).alias("balls_per_over"), F.when(t20, 20).alias("scheduled_overs"),
    )


def _bowling(batting: Column) -> Column:
    first = canonical_team("team1")
    return F.when(canonical_team(batting) == first, canonical_team("team2")).otherwise(first)


def current_innings(feed: DataFrame) -> DataFrame:
    """Scoreboard of the innings in progress, one row per record with a known side."""
    rows = feed.where(F.col("innings_number").isNotNull() & F.col("batting_team").isNotNull())
    balls = F.coalesce("legal_balls", F.lit(0))
    limit = F.when(F.col("legal_balls").isNotNull(), F.lit(FULL_INNINGS))
    chase = F.col("innings_number") == 2
    goal = F.when(chase, F.col("target"))
    m = live_metrics(F.col("runs"), F.col("wickets"), balls, goal, limit, F.lit(6))
    last = F.element_at("scores", -1)
    return rows.select(
        "match_id", "innings_number", canonical_team("batting_team").alias("batting_team"),
        _bowling(F.col("batting_team")).alias("bowling_team"), "runs", "wickets",
        last["overs_text"].try_cast("double").alias("overs"), balls.alias("balls"),
        goal.alias("target"), m["runs_required"].alias("required_runs"),
        *[m[n].alias(n) for n in ("balls_remaining", "current_run_rate", "required_run_rate")],
    )


def innings_history(feed: DataFrame) -> DataFrame:
    """One row per listed innings whose side is known."""
    rows = feed.select("match_id", "team1", "team2", "target", F.posexplode("scores").alias("_i", "s"))
    s = F.col("s")
    return rows.where(s["batting_team"].isNotNull()).select(
        "match_id", (F.col("_i") + 1).alias("innings_number"),
        canonical_team(s["batting_team"]).alias("batting_team"),
        _bowling(s["batting_team"]).alias("bowling_team"), s["runs"].alias("runs"),
        s["wickets"].alias("wickets"), s["overs_text"].try_cast("double").alias("overs"),
        F.coalesce(s["legal_balls"], F.lit(0)).alias("balls"),
        F.when(F.col("_i") == 1, F.col("target")).alias("target"),
    )


def scoring_requests(feed: DataFrame) -> DataFrame:
    """Requests for every record that can be scored; lineups are unknown."""
    nobody = F.array().cast("array<string>")
    return feed.where("predictable").select(
        "match_id", "date", "format", F.lit("LIVE").alias("mode"), "gender", "venue", "competition",
        "team1", "team2", "toss_winner", "toss_decision", nobody.alias("team1_xi"),
        nobody.alias("team2_xi"), "batting_team", F.col("innings_number").alias("innings"), "runs",
        "wickets", "legal_balls", F.lit(None).cast("string").alias("overs"),
        F.when(F.col("innings_number") == 2, F.col("target")).alias("target"),
    )


def choose(feed: DataFrame, match_id: str | None = None, search: str | None = None) -> DataFrame:
    """Matching records; callers that need exactly one check the count."""
    if match_id is not None:
        return feed.where(F.col("match_id") == match_id)
    if search is not None:
        text = F.lower(F.concat_ws("\n", "name", "team1", "team2"))
        return feed.where(text.contains(search.lower()))
    return feed.where("predictable")
