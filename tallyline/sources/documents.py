"""Match documents: find, unpack, parse, and set bad ones aside.

One nested document per match becomes three flat tables. Innings totals are
computed from the nested arrays in place, so only the delivery table multiplies
rows, and none of the three needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.outcomes import NOT_A_WICKET, other_team, result_of
from tallyline.functions.scoring import is_legal, overs_notation
from tallyline.functions.text import canonical_competition, contest_format
from tallyline.sources.archives import read_archives  # noqa: F401

# --- Fixed values -----------------------------------------------------------
MALFORMED = "Malformed JSON"
NOT_AN_OBJECT = "Match file root must be a JSON object"
NO_INFO = "Expected object for info"
NO_TEAMS = "Match is missing two team names"
# ----------------------------------------------------------------------------


def _json_files(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.[jJ][sS][oO][nN]"
    )


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, match_id, text) of every JSON file below a folder.

    Spark's scans skip files of zero bytes, so those are neither loaded nor
    reported; a file with only white space is reported as malformed.
    """
    texts = _json_files(spark).option("wholetext", True).text(path)
    return texts.select(
        F.col("_metadata.file_path").alias("path"),
        stem(F.col("_metadata.file_name")).alias("match_id"),
        F.col("value").alias("text"),
    )


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def archive_documents(members: DataFrame) -> DataFrame:
    """JSON members as documents; those that could not be read are left out."""
    return members.where(F.lower("member").endswith(".json") & F.col("text").isNotNull()).select(
        F.concat_ws("!", "archive", "member").alias("path"), stem(F.col("member")).alias("match_id"), "text"
    )


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, files, newest, bytes) of a corpus; file contents are not read."""
    files = _json_files(spark).format("binaryFile").load(path).select("modificationTime", "length")
    return files.agg(
        F.lit(path).alias("path"),
        F.count(F.lit(1)).alias("files"),
        F.max("modificationTime").alias("newest"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
    )


def iso_date(text: Column) -> Column:
    """Date in the first ten characters, NULL when they are not one."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def _int(value: Column) -> Column:
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(0))


def _whole(value: Column) -> Column:
    """An integer as the document writes one; anything else is NULL."""
    return F.when(value.rlike(r"^-?\d+$"), value.try_cast("int"))


def _text(value: Column) -> Column:
    return F.when(value != "", value)


def _true(value: Column) -> Column:
    return F.coalesce(~F.lower(value).isin("", "false", "0", "null", "[]", "{}"), F.lit(False))


# What is read of a document. Every field is text, so a value of the wrong type costs only itself.
_INFO = """struct<balls_per_over:string,city:string,gender:string,match_type:string,match_type_number:string,overs:string,
season:string,team_type:string,venue:string,dates:array<string>,player_of_match:array<string>,teams:array<string>,
event:struct<name:string,match_number:string>,outcome:struct<winner:string,result:string,eliminator:string,bowl_out:string>,
toss:struct<decision:string,winner:string>,players:map<string,array<string>>>"""
_DELIVERY = """struct<actual_delivery:string,batter:string,batsman:string,bowler:string,non_striker:string,
runs:struct<batter:string,extras:string,total:string>,extras:struct<wides:string,noballs:string>,
wickets:array<struct<kind:string,player_out:string>>>"""
_INNINGS = f"""array<struct<team:string,target:struct<overs:string,runs:string>,penalty_runs:struct<pre:string,post:string>,
declared:string,forfeited:string,super_over:string,overs:array<struct<over:string,deliveries:array<{_DELIVERY}>>>>>"""
_HEAD = f"struct<info:{_INFO},innings:array<struct<team:string>>>"


def _got(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind.replace("\n", ""))


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed once: no filter on it is pushed below it and takes a copy along."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Add ``doc`` (parsed), ``date`` and ``reason`` (why it is rejected, or NULL).

    A document is taken or rejected as a whole, so a rejected one leaves nothing
    in any table. Inside an accepted one a value of the wrong type costs only
    itself. Whether a document is sound shows in its head, the match facts and the
    teams of its innings; overs are only read for tables that need them.
    """
    read = _once(documents.select("path", "match_id", "text"), F.try_parse_json("text"), "_v")
    read = _once(read.drop("text"), _got(F.col("_v"), "$", _HEAD), "_head")
    read = _once(read, _reason(F.col("_v"), F.col("_head")), "reason")
    info = F.col("_head.info")
    doc = F.struct(info.alias("info"), _got(F.col("_v"), "$.innings", _INNINGS).alias("innings"))
    first_date = F.try_element_at(info["dates"], F.lit(1))
    return read.select("path", "match_id", doc.alias("doc"), iso_date(first_date).alias("date"), "reason")


def _reason(v: Column, head: Column) -> Column:
    teams = F.filter(head["info"]["teams"], lambda t: t != "")
    nameless = F.transform(
        head["innings"], lambda i: i.isNotNull() & (F.coalesce(i["team"], F.lit("")) == "")
    )
    bad_innings = F.array_position(nameless, True)
    return (
        F.when(v.isNull(), MALFORMED)
        .when(head.isNull(), NOT_AN_OBJECT)
        .when(head["info"].isNull(), NO_INFO)
        .when(F.coalesce(F.size(teams), F.lit(0)) < 2, NO_TEAMS)
        .when(
            bad_innings > 0,
            F.concat(F.lit("Innings "), bad_innings.cast("string"), F.lit(" is missing a batting team")),
        )
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("path", "match_id", "reason")


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull())


def matches(parsed: DataFrame, source: str = "archive") -> DataFrame:
    """One row of facts per accepted match."""
    info = F.col("doc.info")
    teams = F.filter(info["teams"], lambda t: t != "")
    event = info["event"]
    competition = canonical_competition(event["name"])
    bpo, overs = _whole(info["balls_per_over"]), _whole(info["overs"])
    winner, kind = result_of(info["outcome"])
    number = F.when(event.isNotNull(), event["match_number"]).otherwise(info["match_type_number"])
    label = F.coalesce(competition, event["name"])

    def listed(team: Column) -> Column:
        players = F.try_element_at(info["players"], team)
        return F.when(F.size(players) > 0, players)

    return good(parsed).select(
        "match_id", "path",
        contest_format(info["match_type"], info["team_type"], label, bpo, overs).alias("format"),
        competition.alias("competition"),
        info["season"].alias("season"),
        number.try_cast("double").try_cast("int").alias("match_number"),
        "date",
        _text(info["venue"]).alias("venue"),
        _text(info["city"]).alias("city"),
        teams[0].alias("team1"),
        teams[1].alias("team2"),
        _text(info["toss"]["winner"]).alias("toss_winner"),
        _text(info["toss"]["decision"]).alias("toss_decision"),
        winner.alias("winner"),
        kind.alias("result_type"),
        F.try_element_at(info["player_of_match"], F.lit(1)).alias("player_of_match"),
        F.lit(source).alias("source"),
        _text(info["gender"]).alias("gender"),
        _text(info["team_type"]).alias("team_type"),
        bpo.alias("balls_per_over"),
        overs.alias("scheduled_overs"),
        listed(teams[0]).alias("team1_players"),
        listed(teams[1]).alias("team2_players"),
    )


def _counting_wickets(delivery: Column) -> Column:
    return F.filter(
        delivery["wickets"],
        lambda w: w.isNotNull() & ~F.lower(F.trim(F.coalesce(w["kind"], F.lit("")))).isin(*NOT_A_WICKET),
    )


def _is_wicket(delivery: Column) -> Column:
    return F.coalesce(F.size(_counting_wickets(delivery)) > 0, F.lit(False))


def _legal(delivery: Column) -> Column:
    return is_legal(_int(delivery["extras"]["wides"]), _int(delivery["extras"]["noballs"]))


def _exploded_innings(parsed: DataFrame) -> DataFrame:
    rows = good(parsed).select(
        "match_id",
        F.filter("doc.info.teams", lambda t: t != "").alias("_teams"),
        _whole(F.col("doc.info.balls_per_over")).alias("_bpo"),
        F.posexplode("doc.innings").alias("_pos", "inn"),
    )
    return rows.where(F.col("inn").isNotNull()).withColumn("innings", F.col("_pos") + 1)


def innings(parsed: DataFrame) -> DataFrame:
    """Totals per innings, penalty runs included."""
    rows = _exploded_innings(parsed)
    balls = F.filter(
        F.flatten(
            F.transform(
                F.filter("inn.overs", lambda o: o.isNotNull() & o["deliveries"].isNotNull()),
                lambda o: F.filter(o["deliveries"], lambda d: d.isNotNull()),
            )
        ),
        lambda d: d.isNotNull(),
    )
    rows = rows.withColumn("_d", balls)
    penalty = _int(F.col("inn.penalty_runs.pre")) + _int(F.col("inn.penalty_runs.post"))
    rows = rows.select(
        "match_id", "innings", "inn", "_teams",
        F.coalesce(F.when(F.col("_bpo") != 0, F.col("_bpo")), F.lit(6)).alias("_bpo"),
        (
            penalty
            + F.coalesce(
                F.aggregate("_d", F.lit(0), lambda acc, d: acc + _int(d["runs"]["total"])), F.lit(0)
            )
        ).alias("runs"),
        F.coalesce(F.size(F.filter("_d", _is_wicket)), F.lit(0)).alias("wickets"),
        F.coalesce(F.size(F.filter("_d", _legal)), F.lit(0)).alias("balls"),
    )
    target = F.col("inn.target.runs").try_cast("double").try_cast("int")
    run_rate = F.try_divide(F.col("runs"), F.col("balls")) * F.col("_bpo")
    return rows.select(
        "match_id",
        F.col("innings").alias("innings_number"),
        F.col("inn.team").alias("batting_team"),
        other_team(F.col("inn.team"), F.col("_teams")[0], F.col("_teams")[1]).alias("bowling_team"),
        "runs", "wickets",
        overs_notation(F.col("balls"), F.col("_bpo")).alias("overs"),
        "balls",
        target.alias("target"),
        F.col("inn.target.overs").try_cast("double").alias("target_overs"),
        (target - F.col("runs")).alias("required_runs"),
        F.bround(run_rate, 2).alias("current_run_rate"),
        _true(F.col("inn.declared")).alias("declared"),
        _true(F.col("inn.forfeited")).alias("forfeited"),
        _true(F.col("inn.super_over")).alias("super_over"),
    )


def deliveries(parsed: DataFrame) -> DataFrame:
    """One row per delivery; ``seq`` orders the deliveries of a match."""
    overs = _exploded_innings(parsed).select(
        "match_id", "innings", F.col("inn.team").alias("batting_team"),
        F.posexplode("inn.overs").alias("_over_pos", "_over"),
    )
    balls = overs.where(F.col("_over").isNotNull()).select(
        "match_id", "innings", "batting_team", "_over_pos",
        _int(F.col("_over.over")).alias("over"),
        F.posexplode("_over.deliveries").alias("_ball_pos", "d"),
    )
    d = F.col("d")
    first = F.try_element_at(_counting_wickets(d), F.lit(1))
    position = (F.col("innings").cast("long") * 100_000 + F.col("_over_pos")) * 100_000
    return balls.where(d.isNotNull()).select(
        "match_id", "innings",
        (position + F.col("_ball_pos")).alias("seq"),
        "over",
        (F.col("_ball_pos") + 1).alias("ball"),
        "batting_team",
        F.coalesce(_text(d["batter"]), _text(d["batsman"]), F.lit("")).alias("striker"),
        F.coalesce(d["non_striker"], F.lit("")).alias("non_striker"),
        F.coalesce(d["bowler"], F.lit("")).alias("bowler"),
        _int(d["runs"]["batter"]).alias("runs_batter"),
        _int(d["runs"]["extras"]).alias("runs_extras"),
        _int(d["runs"]["total"]).alias("runs_total"),
        _is_wicket(d).alias("wicket"),
        _text(first["kind"]).alias("wicket_type"),
        _text(first["player_out"]).alias("player_out"),
        _text(d["actual_delivery"]).alias("actual_delivery"),
        (_int(d["extras"]["wides"]) != 0).alias("is_wide"),
        (_int(d["extras"]["noballs"]) != 0).alias("is_noball"),
    )
