import datetime as dt
import zipfile

import pytest
from fixtures import ball, match, write

from tallyline.plans.build import build_feature_datasets
from tallyline.sources import documents as D
from tallyline.sources import tables as T


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    hurt = match(date="2024-04-03")
    hurt["innings"][0]["overs"][0]["deliveries"] = [
        ball(wickets=[{"kind": "Retired Hurt ", "player_out": "A1"}]),
        ball(runs=2, wickets=[{"kind": "retired hurt"}, {"kind": "run out", "player_out": "A2"}]),
        {"batsman": "A9", "bowler": 7, "runs": "broken"},
        "not a delivery",
    ]
    hurt["innings"][0]["penalty_runs"] = {"pre": 5, "post": "3"}
    nameless = match()
    nameless["innings"][1].pop("team")
    root = tmp_path_factory.mktemp("corpus")
    path = write(
        root,
        m1=match(),
        broken="{\"info\": ",
        empty=" \n",
        one_team=match(teams=("Reds", "")),
        listed="[1, 2]",
        no_info={"info": 3, "innings": []},
        nameless=nameless,
    )
    write(root / "deeper", hurt=hurt, void=match(date="not a date", winner=None, teams=("Reds", "Greens")))
    return path


def test_matches_and_quarantine(spark, corpus):
    parsed = D.parse_documents(D.read_documents(spark, corpus))
    bad = {r.match_id: r.reason for r in D.quarantine(parsed).collect()}
    assert bad == {
        "broken": D.MALFORMED,
        "empty": D.MALFORMED,
        "one_team": D.NO_TEAMS,
        "listed": D.NOT_AN_OBJECT,
        "no_info": D.NO_INFO,
        "nameless": "Innings 2 is missing a batting team",
    }
    rows = {r.match_id: r for r in D.matches(parsed).collect()}
    assert set(rows) == {"m1", "hurt", "void"}
    m1 = rows["m1"]
    assert (m1.format, m1.competition, m1.season, m1.match_number) == ("T20", "IPL", "2024", 1)
    assert (m1.date, m1.winner, m1.result_type) == (dt.date(2024, 4, 1), "Blues", "win")
    assert (m1.team1_players, m1.player_of_match, m1.scheduled_overs) == (["A1", "A2"], "B1", 20)
    assert rows["void"].date is None and rows["void"].result_type == "no result"


def test_innings_and_deliveries(spark, corpus):
    parsed = D.parse_documents(D.read_documents(spark, corpus))
    innings = {(r.match_id, r.innings_number): r for r in D.innings(parsed).collect()}
    one, two = innings["m1", 1], innings["m1", 2]
    assert (one.runs, one.wickets, one.balls, one.overs) == (5, 1, 2, 0.2)
    assert (two.runs, two.target, two.required_runs, two.bowling_team) == (6, 6, 0, "Reds")
    assert one.current_run_rate == 15.0
    assert (innings["hurt", 1].runs, innings["hurt", 1].wickets) == (10, 1)
    balls = D.deliveries(parsed).where("match_id = 'hurt' AND innings = 1").orderBy("seq").collect()
    assert [b.wicket for b in balls] == [False, True, False]
    assert (balls[1].wicket_type, balls[1].player_out) == ("run out", "A2")
    assert (balls[2].striker, balls[2].bowler, balls[2].runs_total) == ("A9", "7", 0)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/m1.json", "first")
        z.writestr("y/m1.json", "second")
        z.writestr("../escape.json", "no")
        z.writestr("/abs.json", "no")
        z.writestr(".hidden.json", "no")
        z.writestr("tool.exe", "no")
        z.writestr("README.txt", "yes")
    (tmp_path / "b.zip").write_text("not a zip")
    rows = D.read_archives(spark, str(tmp_path)).collect()
    got = {(r.archive.rsplit("/", 1)[1], r.member): (r.text, r.error) for r in rows}
    assert got == {
        ("a.zip", "m1.json"): ("first", None),
        ("a.zip", "README.txt"): ("yes", None),
        ("b.zip", None): (None, "Invalid zip archive"),
    }
    again = D.read_archives(spark, str(tmp_path), overwrite=True).where("member = 'm1.json'").first()
    assert again.text == "second"
    assert [r.match_id for r in D.archive_documents(D.read_archives(spark, str(tmp_path))).collect()] == ["m1"]


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    from tallyline.sources import archives as A

    texts = {f"m{k:03d}.json": f'{{"n": {k}, "pad": "{"é" * (k * 37 % 900)}"}}' for k in range(120)}
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k, (name, text) in enumerate(texts.items()):
            z.writestr(zipfile.ZipInfo(f"deep/{name}"), text, zipfile.ZIP_DEFLATED if k % 3 else zipfile.ZIP_STORED)
        z.writestr("empty.txt", "")
        z.writestr("odd.md", "x", zipfile.ZIP_BZIP2)
    members = D.read_archives(spark, str(tmp_path / "many.zip"), split_bytes=500)
    assert members.rdd.getNumPartitions() > 20
    rows = {r.member: r for r in members.collect()}
    assert {m: r.text for m, r in rows.items() if m.endswith(".json")} == texts
    assert rows["empty.txt"].text == "" and "method" in rows["odd.md"].error and rows["odd.md"].text is None
    # A damaged member costs itself alone.
    raw = bytearray((tmp_path / "many.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "many.zip") as z:
        info = z.getinfo("deep/m004.json")
    raw[info.header_offset + 60] ^= 255
    (tmp_path / "hurt.zip").write_bytes(bytes(raw))
    hurt = {r.member: r.error for r in D.read_archives(spark, [str(tmp_path / "hurt.zip")], split_bytes=500).collect()}
    assert [m for m, e in hurt.items() if e and m.endswith(".json")] == ["m004.json"]
    (tmp_path / "none").mkdir()
    assert D.read_archives(spark, str(tmp_path / "none")).count() == 0
    assert all(len(p.members) <= 120 for p in A.planned(str(tmp_path / "many.zip"), False, 1))


def test_silver_is_parsed_once_per_fingerprint(spark, corpus, tmp_path):
    cache = str(tmp_path / "cache")
    first, errors = T.load_matches(spark, corpus, cache)
    assert first["matches"].count() == 3 and errors.first()[0] == 6
    key = T.fingerprint_key(spark, corpus)
    assert key == T.fingerprint_key(spark, corpus)
    assert T.silver(spark, corpus, cache)["deliveries"].count() > 0


def test_build(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    report = build_feature_datasets(spark, corpus, out).first()
    assert report.matches_discovered == 9 and report.matches_parsed == 2
    # A malformed file counts as undated, because the date is looked at first.
    assert report.skipped["missing_or_invalid_date"] == 5 and report.skipped["parse_error"] == 2
    assert report.formats == {"T20": 2} and report.prematch_rows == 8
    assert report.validation_issues == []
    rows = spark.read.parquet(f"{out}/prematch_features")
    later = rows.where("match_id = 'hurt' AND team = 'Blues' AND prediction_mode = 'PRE_TOSS'").first()
    assert (later.matches_before, later.wins_before, later.h2h_team_wins) == (1, 1, 1)
    assert later.team_elo_before == 1510.0 and later.team_won_toss is None
    first = rows.where("match_id = 'm1' AND team = 'Blues' AND prediction_mode = 'POST_TOSS'").first()
    assert first.team_won_toss is False and first.xi_batters_with_history == 0
    live = spark.read.parquet(f"{out}/live_states").where("match_id = 'm1'").orderBy("seq").collect()
    assert [r.runs for r in live] == [4, 5, 5, 6]
    assert [r.legal_balls_bowled for r in live] == [1, 1, 2, 1]
    assert live[3].target == 6 and live[3].batting_team_eventual_win == 1


def test_build_filters_before_history_and_leaves_live_alone(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    report = build_feature_datasets(spark, corpus, out, limit=1, include_live=False).first()
    assert report.prematch_rows == 4 and report.live_generation_enabled is False
    assert not T.exists(spark, f"{out}/live_states")
    none = build_feature_datasets(spark, corpus, str(tmp_path / "none"), competitions=["bbl"], include_live=False).first()
    assert none.skipped["filtered"] == 2 and none.prematch_rows == 0


def test_roster_table_is_stored_by_fingerprint(spark, corpus, tmp_path, monkeypatch):
    import os
    import shutil

    from tallyline.plans import build as P

    cache, raw = str(tmp_path / "cache"), str(tmp_path / "raw")
    shutil.copytree(corpus, raw)
    first = P.roster_sides(spark, raw, cache)
    rows = sorted(map(str, first.collect()))
    assert rows and {"previous_xi_known", "log_rest_days"} <= set(first.columns)
    # Nothing changed: the second call reads no document.
    monkeypatch.setattr(P.T.D, "read_documents", lambda *a: pytest.fail("read again"))
    monkeypatch.setattr(P, "roster_features", lambda *a, **k: pytest.fail("built again"))
    assert sorted(map(str, P.roster_sides(spark, raw, cache).collect())) == rows
    monkeypatch.undo()
    names = set(os.listdir(f"{cache}/rosters"))
    # Another cut-off and a changed corpus are other tables; no draft stays behind.
    P.roster_sides(spark, raw, cache, cutoff="2024-04-01")
    write(tmp_path / "raw", late=match(date="2024-05-03"))
    assert P.roster_sides(spark, raw, cache).count() == len(rows) + 2
    after = set(os.listdir(f"{cache}/rosters"))
    assert names < after and len(after) == 3 and not any(n.startswith("_draft") for n in after)


def test_two_builders_leave_one_table(spark, tmp_path):
    root = str(tmp_path / "t")

    def build():
        spark.range(3).write.parquet(f"{root}/k")  # the other run gets there first
        return spark.range(5)

    assert T.published(spark, root, "k", build).count() == 3
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["k"]


def test_documents_are_parsed_once_and_overs_only_where_needed(spark, corpus):
    parsed = D.parse_documents(D.read_documents(spark, corpus))

    def parts(df):
        """Nodes of the plan: how often texts are parsed, and whether overs are read."""
        text = df._jdf.queryExecution().optimizedPlan().toJSON()
        return text.lower().count('"functionname":"parsejson"'), "deliveries" in text

    assert [parts(t(parsed)) for t in (D.matches, D.quarantine)] == [(1, False)] * 2
    assert [parts(t(parsed)) for t in (D.innings, D.deliveries)] == [(1, True)] * 2


def test_values_of_the_wrong_type_cost_only_themselves(spark, tmp_path):
    odd = match()
    odd["info"] |= {"players": {"Reds": "A1", "Blues": ["B1", 2]}, "event": "IPL", "toss": [1], "player_of_match": "B1", "venue": {"a": 1}}
    odd["innings"][0]["overs"] = [3, {"over": 0, "deliveries": "none"}, {"over": 1, "deliveries": [ball(wickets=["x", None, {"kind": "bowled"}]), 5]}]
    odd["innings"][0]["target"] = "many"
    odd["innings"] += ["an innings", None]
    path = write(tmp_path, odd=odd, number="3", null="null", info_only={"info": odd["info"]})
    parsed = D.parse_documents(D.read_documents(spark, path))
    assert {r.match_id: r.reason for r in D.quarantine(parsed).collect()} == {"number": D.NOT_AN_OBJECT, "null": D.NOT_AN_OBJECT}
    row = D.matches(parsed).where("match_id = 'odd'").first()
    assert (row.team1_players, row.team2_players, row.competition, row.toss_winner) == (None, ["B1", "2"], None, None)
    assert (row.player_of_match, row.venue) == (None, '{"a":1}')
    first, second = D.innings(parsed).orderBy("innings_number").collect()
    assert (first.balls, first.wickets, first.target) == (1, 1, None) and second.balls > 0
    assert [r.wicket_type for r in D.deliveries(parsed).where("innings = 1").collect()] == ["bowled"]
