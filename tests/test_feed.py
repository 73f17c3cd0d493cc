import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyline import schemas
from tallyline.sources import feed as L


def record(**changes):
    base = {
        "id": "x1", "name": "Alpha vs Beta, 3rd Match, Indian Premier League 2026", "matchType": "t20",
        "status": "Beta need 25 runs", "venue": "Ground", "date": "2026-04-01", "dateTimeGMT": None,
        "teams": ["Alpha", "Beta"], "tossWinner": "alpha", "tossChoice": "bowl",
        "matchStarted": True, "matchEnded": False,
        "score": [
            {"r": 180, "w": 6, "o": 20, "inning": "Alpha Inning 1"},
            {"r": 156, "w": 4, "o": 17.0, "inning": "Alpha,Beta Inning 1"},
        ],
    }
    base.update(changes)
    return base


CASES = {
    "base": record(),
    "rain": record(status="18 overs game due to rain"),
    "stated": record(status="Revised target: 150 runs"),
    "plain": record(status="Beta chasing"),
    "won": record(status="Alpha won by 5 runs"),
    "undated": record(date=None),
    "hundred": record(name="Alpha vs Beta, The Hundred"),
    "three_teams": record(teams=["A", "B", "C"]),
    "no_id": record(id=" "),
    "no_score": record(score=None),
    "bad_overs": record(score=[{"r": 10, "w": 0, "o": 3.7, "inning": "Alpha Inning 1"}]),
    "upcoming": record(matchStarted=False, score=[]),
    "wbbl": record(name="X, Women's Big Bash League"),
    "gmt": record(date="soon", dateTimeGMT="2026-04-02T10:00:00"),
}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("feed")
    data = [{**r, "id": k if r["id"] == "x1" else r["id"]} for k, r in CASES.items()]
    (path / "p1.json").write_text(json.dumps({"status": "success", "info": {"hitsToday": 3}, "data": data}))
    (path / "p2.json").write_text(json.dumps({"status": "failure", "data": [record(id="never")]}))
    rows = L.normalize(L.records(L.read_pages(spark, str(path))))
    return rows


def test_normalised_values(feed):
    got = {r.match_id: r for r in feed.collect()}
    assert set(got) == set(CASES) - {"three_teams", "no_id"}
    base = got["base"]
    assert (base.target, base.legal_balls, base.batting_team, base.predictable) == (181, 102, "Beta", True)
    assert (base.competition, base.format, base.gender, base.toss_decision) == ("IPL", "T20", "male", "field")
    assert base.date == dt.date(2026, 4, 1) and base.warnings == []
    assert got["rain"].target is None and not got["rain"].predictable
    assert got["rain"].warnings == [L.RAIN_WARNING]
    assert got["stated"].target == 150 and got["plain"].target == 181
    assert got["won"].terminal and got["won"].refusals == ["match is already terminal"]
    assert not got["undated"].predictable and got["gmt"].date == dt.date(2026, 4, 2)
    assert got["hundred"].format == "HUNDRED" and got["hundred"].legal_balls is None
    assert got["no_score"].refusals == ["no score available", "batting team is ambiguous"]
    assert "overs could not be parsed" in got["bad_overs"].refusals
    # The shorter marker comes first in the list, so it wins unless strict.
    assert got["wbbl"].competition == "BBL" and got["wbbl"].gender == "female"


def test_strict_rules(spark):
    df = spark.range(1).select(
        L.feed_competition(F.lit("Women's Big Bash League"), strict=True).alias("c"),
        L.feed_format(F.lit(None), F.lit("The latest final")).alias("loose"),
        L.feed_format(F.lit(None), F.lit("The latest final"), strict=True).alias("strict"),
    ).first()
    assert (df.c, df.loose, df.strict) == ("WBBL", "TEST", "OTHER")


def test_listing_scoreboard_and_requests(feed):
    states = {r.match_id: (r.state, r.score) for r in L.listing(feed).collect()}
    assert states["base"] == ("LIVE/PREDICTABLE", "Alpha 180/6 (20) | Beta 156/4 (17)")
    assert states["upcoming"] == ("UPCOMING", "no score")
    assert states["hundred"][0] == "UNSUPPORTED/HUNDRED"
    board = {r.match_id: r for r in L.current_innings(feed).collect()}["base"]
    assert (board.required_runs, board.balls_remaining, board.bowling_team) == (25, 18, "Alpha")
    assert board.current_run_rate == pytest.approx(156 / 17)
    assert board.required_run_rate == pytest.approx(25 / 3)
    history = [r for r in L.innings_history(feed).collect() if r.match_id == "base"]
    assert sorted((r.innings_number, r.batting_team, r.target) for r in history) == [
        (1, "Alpha", None), (2, "Beta", 181)]
    request = {r.match_id: r for r in L.scoring_requests(feed).collect()}["base"]
    assert (request.mode, request.innings, request.target, request.team1_xi) == ("LIVE", 2, 181, [])
    assert "base" in {r.match_id for r in L.live_metadata(feed).collect()}
    assert L.choose(feed, match_id="won").count() == 1
    assert L.choose(feed, search="HUNDRED").count() == 1


def test_pages_are_read_like_multi_line_json(spark, tmp_path):
    """Over many lines, with numbers and marks read as text, with a byte order mark, as an array of pages, blank, empty and broken."""
    from tallyline.sources import feed

    page = '{"status": "success",\n "data": [\n {"id": "é1", "matchStarted": true, "score": [{"r": 7, "w": 1, "o": 15.20, "inning": "A"}]},\r\n\n null]\n}\n'
    texts = {"one": page, "two": f"[{page}, {page}]", "mark": "\ufeff" + page, "blank": " \n", "empty": "", "broken": page[:60]}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    got = feed.read_pages(spark, str(tmp_path))
    plain = feed.read_pages(spark, str(tmp_path), utf8=False)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    good = got.where("status = 'success'").collect()
    assert len(good) == 4
    assert all(r.data[0].id == "é1" and r.data[0].matchStarted == "true" and r.data[0].score[0].o == "15.20" for r in good)
