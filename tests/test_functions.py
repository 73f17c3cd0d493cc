"""Literal values through column functions, and small operator checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyline.functions import confidence, messages, outcomes, requests, scoring, text
from tallyline.operators import contests as C
from tallyline.operators import frames, metrics, quality, resolve


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def L(v):
    return F.lit(v)


def test_ball_arithmetic(spark):
    none = F.lit(None).cast("int")
    m = scoring.live_metrics(L(150), L(3), L(90), L(181), L(120), L(6))
    over = scoring.live_metrics(L(150), L(3), L(121), none, L(120), L(6))
    r = values(
        spark,
        notation=scoring.overs_notation(L(106), L(6)), back=scoring.notation_to_balls(L(17.4), L(6)),
        fives=scoring.overs_notation(L(17), L(5)), negative=scoring.overs_notation(L(-3), L(6)),
        strict=scoring.overs_text_to_balls(L("15.3")), plain=scoring.overs_text_to_balls(L("15")),
        bad=scoring.overs_reject_reason(L("15.6")), empty=scoring.overs_reject_reason(L(" ")),
        word=scoring.overs_reject_reason(L("x")), minus=scoring.overs_reject_reason(L("-1.2")),
        need=m["runs_required"], left=m["balls_remaining"], rrr=m["required_run_rate"], rr=m["current_run_rate"],
        none_left=over["balls_remaining"], open_target=over["runs_required"],
        hundred=scoring.ball_limit(L("HUNDRED"), none, none, none), t10=scoring.ball_limit(L("T10"), none, none, none),
        cut=scoring.ball_limit(L("T20"), L(20), L(6), L(12.3)), test=scoring.ball_limit(L("TEST"), L(90), L(6), none),
        zero=scoring.rate(L(3), L(0)), elo=scoring.elo_probability(L(400.0)),
        overlap=scoring.overlap_ratio(F.array(*map(L, "ABCD")), F.array(*map(L, "BCDE"))),
        rest=scoring.log_rest_days(L(500)), clean=scoring.finite_or_zero(L("inf")), kept=scoring.finite_or_zero(L("2.5")),
    )
    assert (r.notation, r.back, r.fives, r.negative, r.strict, r.plain) == (17.4, 106, 3.2, 0.0, 93, 90)
    assert "0-5" in r.bad and "empty" in r.empty and "notation" in r.word and "negative" in r.minus
    assert (r.need, r.left, r.none_left, r.open_target) == (31, 30, 0, None)
    assert r.rrr == pytest.approx(6.2) and r.rr == pytest.approx(10)
    assert (r.hundred, r.t10, r.cut, r.test, r.zero) == (100, 60, 75, None, None)
    assert r.elo == pytest.approx(10 / 11) and r.overlap == 0.75
    assert r.rest == pytest.approx(4.795790545596741) and (r.clean, r.kept) == (0.0, 2.5)


def test_names_and_formats(spark):
    none = F.lit(None).cast("int")

    def fmt(kind, team=None, name=None, bpo=none, overs=none):
        return text.contest_format(L(kind), L(team), L(name), bpo, overs)

    r = values(
        spark,
        ipl=text.canonical_competition(L(" Indian  premier League ")), other=text.canonical_competition(L(" Cup ")),
        blank=text.canonical_competition(L(" ")), team=text.canonical_team(L("Kings  XI punjab")),
        nobody=text.canonical_team(F.lit(None)), a=fmt("T20", "international"), b=fmt("T20", "club"), c=fmt("IT20"),
        d=fmt("T20", "club", "The Hundred"), e=fmt("T20", bpo=L(5)), f=fmt("T20", overs=L(10)), g=fmt("MDM"),
        h=fmt("weird"), mode=text.prediction_mode(L(" post-toss ")), unknown=text.prediction_mode(L("soon")),
    )
    assert (r.ipl, r.other, r.blank, r.team, r.nobody) == ("IPL", "Cup", None, "Punjab Kings", "")
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (
        "T20I", "T20", "T20I", "HUNDRED", "HUNDRED", "T10", "FIRST_CLASS", "OTHER")
    assert (r.mode, r.unknown) == ("POST_TOSS", None)


def test_outcomes_and_confidence(spark):
    tie = F.from_json(L('{"result": "tie", "eliminator": "A"}'), "struct<winner:string,result:string,eliminator:string,bowl_out:string>")
    out = F.from_json(L('{"eliminator": "A"}'), "struct<winner:string,result:string,eliminator:string,bowl_out:string>")
    label, reasons = confidence.assess(
        probability=L(0.8), format_=L("T20"), mode=L("PRE_TOSS"), history1=L(30), history2=L(3), venue_known=L(False),
        previous_xi_complete=L(False), lineup_complete=F.lit(None).cast("boolean"), parse_errors=L(1), terminal=L(False),
        innings=F.lit(None).cast("int"), balls=F.lit(None).cast("int"),
    )
    sure, _ = confidence.assess(
        probability=L(0.8), format_=L("T20I"), mode=L("POST_TOSS"), history1=L(30), history2=L(20), venue_known=L(True),
        previous_xi_complete=F.lit(None).cast("boolean"), lineup_complete=L(True), parse_errors=L(0), terminal=L(False),
        innings=F.lit(None).cast("int"), balls=F.lit(None).cast("int"),
    )
    r = values(
        spark, w=outcomes.result_of(tie)[0], k=outcomes.result_of(tie)[1], ew=outcomes.result_of(out)[0],
        ek=outcomes.result_of(out)[1], edge=outcomes.edge_label(L(0.3)), even=outcomes.favourite(L("A"), L("B"), L(0.5)),
        label=label, reasons=reasons, sure=sure,
    )
    assert (r.w, r.k, r.ew, r.ek, r.edge, r.even) == (None, "tie", "A", "eliminator", "moderate", "A")
    assert r.label == "LOW" and r.sure == "HIGH" and len(r.reasons) == 6


def test_messages(spark):
    one, two = messages.teams(L("Who will win RCB vs. csk tomorrow?"))
    same, _ = messages.teams(L("MI vs mumbai indians"))
    r = values(
        spark, one=one, two=two, same=same, i=messages.intent(L("Explain why")), j=messages.intent(L("A vs B")),
        alias=messages.intent_alias(L("Pre-Toss")), mode=messages.mode_hint(L("need 20 from 12 balls")),
        bad=messages.date_hint(L("on 2024-02-31"), L(dt.date(2024, 1, 1))),
        day=messages.date_hint(L("tomorrow"), L(dt.date(2024, 1, 31))),
    )
    assert (r.one, r.two, r.same) == ("Royal Challengers Bengaluru", "Chennai Super Kings", None)
    assert (r.i, r.j, r.alias, r.mode, r.bad) == ("explain_prediction", "predict_match", "predict_match", "LIVE", None)
    assert r.day == dt.date(2024, 2, 1)


def test_format_guard(spark):
    r = values(
        spark, ok=requests.format_reject_reason(L("t20i"), F.lit(None).cast("string")),
        hundred=requests.format_reject_reason(L("T20"), L("the hundred")),
        odi=requests.format_reject_reason(L("odi"), F.lit(None).cast("string")),
    )
    assert r.ok is None and r.hundred == requests.HUNDRED_REFUSED and "ODI" in r.odi


CONTEST = "match_id string, date date, format string, gender string, venue string, team1 string, team2 string, winner string, result_type string"


def test_two_match_sequence_and_no_result(spark):
    rows = [
        ("m1", dt.date(2024, 6, 1), "T20I", None, "MCG", "India", "Australia", "India", "win"),
        ("m2", dt.date(2024, 6, 8), "T20I", None, "MCG", "India", "Australia", "Australia", "win"),
        ("m3", dt.date(2024, 6, 9), "T20I", None, "MCG", "India", "Australia", None, "no result"),
        ("m4", dt.date(2024, 6, 10), "T20I", None, "MCG", "India", "Australia", None, "tie"),
        ("m5", dt.date(2024, 6, 11), "T20I", None, None, "India", "Australia", "India", "eliminator"),
        ("m6", dt.date(2024, 6, 12), "T20I", None, "MCG", "India", "Australia", "India", "win"),
    ]
    log = C.team_rows(C.prepare(spark.createDataFrame(rows, CONTEST)))
    out = C.team_at_venue(C.head_to_head(C.team_form(log)))
    got = {r.match_id: r for r in out.where("team = 'India'").collect()}
    assert [got[m].matches_before for m in sorted(got)] == [0, 1, 2, 2, 3, 4]
    assert [got[m].wins_before for m in sorted(got)] == [0, 1, 1, 1, 1, 2]
    assert [got[m].h2h_matches_before for m in sorted(got)] == [0, 1, 2, 2, 2, 3]
    assert [got[m].team_matches_at_venue for m in sorted(got)] == [0, 1, 2, 2, 0, 2]


def test_later_matches_never_change_earlier_rows(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(80):
        a, b = rng.sample("ABCD", 2)
        rows.append((f"{i:03d}", dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(30)), "T20", "m", "V", a, b, rng.choice([a, b, None]), "win"))
    rows.sort(key=lambda r: (r[1], r[0]))

    def features(part):
        log = C.team_rows(C.prepare(spark.createDataFrame(part, CONTEST)))
        out = C.head_to_head(C.team_form(log)).select("match_id", "team", "matches_before", "wins_last_5", "h2h_team_wins")
        return {tuple(r)[:2]: tuple(r)[2:] for r in out.collect()}

    whole, half = features(rows), features(rows[:40])
    assert {k: whole[k] for k in half} == half


def test_pair_problems_and_many_to_one(spark):
    def row(match, team, win, won_toss=None):
        return (match, team, win, "POST_TOSS", won_toss, "field", 1.0)

    rows = [row("ok", "Beta", 0, False), row("ok", "Alpha", 1, True), row("one", "A", 1, True),
            row("both", "A", 1, True), row("both", "B", 1, False), row("toss", "A", 1, None), row("toss", "B", 0, None)]
    df = spark.createDataFrame(rows, "match_id string, team string, team_win int, prediction_mode string, team_won_toss boolean, toss_decision string, x double")
    pairs = frames.pair_rows(df, "POST_TOSS", ["x"], carry=())
    got = {r.match_id: r for r in pairs.collect()}
    assert got["ok"].problem is None and got["ok"].team_a == "Alpha" and got["ok"].toss_field_advantage == 1.0
    assert "expected exactly 2" in got["one"].problem and "one winner" in got["both"].problem
    assert "toss ownership" in got["toss"].problem
    with pytest.raises(ValueError):
        frames.checked_pairs(pairs)
    with pytest.raises(ValueError):
        frames.join_many_to_one(df, df, ["match_id"])
    with pytest.raises(ValueError, match="Missing"):
        frames.pair_rows(df.drop("x"), "POST_TOSS", ["x"], carry=())


def test_split_edges_and_weights(spark):
    rows = [("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 3, 1)), ("b", dt.date(2024, 2, 1)), ("c", None)]
    df = spark.createDataFrame(rows, "match_id string, date date")
    got = {(r.match_id, r.split) for r in frames.temporal_split(df, "2024-01-31").collect()}
    assert got == {("a", "train"), ("b", "test")}
    with pytest.raises(ValueError):
        frames.temporal_split(df, "2024-01-31", "2023-01-01")
    w = [r.weight for r in frames.equal_weights(spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "match_id string")).collect()]
    assert sorted(w) == pytest.approx([2 / 3, 2 / 3, 2 / 3, 2.0])


def test_metrics_edges(spark):
    one_class = spark.createDataFrame([(1, 0.3), (1, 0.9)], "y int, p double")
    assert metrics.binary_metrics(one_class, "y", "p").first()["roc_auc"] is None
    edge = spark.createDataFrame([(0, 0.3)], "y int, p double").select(metrics.ece_bin(F.col("p")).alias("b"))
    assert edge.first()["b"] == 2
    reverse = spark.createDataFrame([(int(i < 5), float(i)) for i in range(10)], "y int, x double")
    assert metrics.orientation_free_auc(reverse, "y", "x").first()["auc"] == 1.0
    empty = reverse.withColumn("x", F.lit(float("nan")))
    assert metrics.orientation_free_auc(empty, "y", "x").first()["auc"] is None
    even = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 4.0, 10.0, None)], "g string, v double")
    assert metrics.exact_median(even, "v", ["g"], "m").first()["m"] == 3.0


def test_quality_and_resolution(spark):
    clean = spark.createDataFrame(
        [("m", dt.date(2024, 1, 1), "A", "T20", 1, "PRE_TOSS"), ("m", dt.date(2024, 1, 1), "B", "T20", 0, "PRE_TOSS")],
        "match_id string, date date, team string, format string, team_win int, prediction_mode string",
    )
    assert quality.check_prematch(clean).count() == 0
    issues = {r.check: r["count"] for r in quality.check_prematch(clean.unionByName(clean)).collect()}
    assert issues == {"duplicate_prediction_rows": 2, "inconsistent_winners_PRE_TOSS": 1}
    ts = dt.datetime(2024, 1, 1)
    fields = spark.createDataFrame(
        [("e", "runs", v, s, k, p, ts) for v, s, k, p in
         ((" ", "one", "live", 1), ("98", "two", "live", 2), ("99", "three", "search", 3), ("98", "four", "search", 4))],
        "entity string, field string, value string, source string, kind string, priority int, ts timestamp",
    )
    chosen = resolve.resolve(fields).first()
    assert (chosen.value, chosen.source, chosen.reliability) == ("98", "two", "high")
    assert [(r.rejected_value, r.rejected_reliability) for r in resolve.conflicts(fields).collect()] == [("99", "low")]


def test_typed_resolution(spark):
    schema = "entity string, source string, kind string, priority int, ts timestamp, xi array<string>, toss {}, note string"
    ts = dt.datetime(2024, 1, 1)

    def cells(rows, toss):
        wide = spark.createDataFrame([(e, s, "live", p, ts, xi, t, n) for e, s, p, xi, t, n in rows], schema.format(toss))
        return resolve.long_fields(wide, ("xi", "toss", "note"), typed=True)

    fields = cells(
        [("e", "one", 1, [], {}, "[]"), ("f", "one", 1, ["a"], {"b": 1, "a": 2}, " "), ("g", "one", 1, None, None, None)],
        "map<string, int>",
    ).unionByName(cells(
        [("e", "two", 2, ["x", "y"], 7, "{}"), ("f", "two", 2, [], 0, "n"), ("g", "two", 2, [], None, "")], "int"
    )).unionByName(cells([("f", "three", 3, ["a"], (2, 1), "n")], "struct<a: int, b: int>"))
    chosen = resolve.resolve(fields)
    got = {(r.entity, r.field): (r.json, r.source) for r in chosen.selectExpr("*", "to_json(value) AS json").collect()}
    assert got == {
        ("e", "xi"): ('["x","y"]', "two"), ("e", "toss"): ("7", "two"), ("e", "note"): ('"[]"', "one"),
        ("f", "xi"): ('["a"]', "one"), ("f", "toss"): ('{"a":2,"b":1}', "one"), ("f", "note"): ('"n"', "two"),
    }
    # The struct of source three equals the map of source one; zero and the text of another source do not.
    rejected = resolve.conflicts(fields).selectExpr("entity", "field", "to_json(rejected_value) AS json").collect()
    assert sorted(map(tuple, rejected)) == [("e", "note", '"{}"'), ("f", "toss", "0")]
    wide = {r.entity: r for r in resolve.rebuild(chosen, ("xi", "toss", "note")).selectExpr(
        "entity", "variant_get(xi, '$', 'array<string>') AS xi", "variant_get(note, '$', 'string') AS note", "primary_source"
    ).collect()}
    assert (wide["e"].xi, wide["e"].note, wide["e"].primary_source) == (["x", "y"], "[]", "one")
    # As text, too, an empty list is missing and the text [] is not.
    plain = spark.createDataFrame([("e", "one", "live", 1, ts, [], "[]")], "entity string, source string, kind string, priority int, ts timestamp, xi array<string>, note string")
    assert [r.field for r in resolve.resolve(resolve.long_fields(plain, ("xi", "note"))).collect()] == ["note"]
