import datetime as dt
import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import contests as C
from tallyline.operators import frames
from tallyline.plans import models as M
from tallyline.plans import score as S
from tallyline.plans import train as T

FAST = (M.Candidate(M.LOGISTIC), M.Candidate(M.TREES, rounds=3, depth=2, min_leaf=5))


def _paired(spark, n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        x, z = rng.gauss(0, 1), rng.gauss(0, 2)
        y = int(rng.random() < 1 / (1 + np.exp(-(0.9 * x - 0.3 * z))))
        day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
        rows.append((f"m{i}", day, "T20" if i % 2 else "T20I", "male", "cup", y, x, z if i % 9 else None))
    return spark.createDataFrame(
        rows, "match_id string, date date, format string, gender string, competition string, team_a_win int, x double, z double"
    )


def _newton(x, y):
    """Minimise sum of log losses + |w|^2 / 2 on standardised columns."""
    x = (x - x.mean(0)) / x.std(0)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w)
    return w


def test_logistic_matches_the_stated_objective(spark):
    df = _paired(spark)
    model = M.fit(M.Candidate(M.LOGISTIC), df, ["x", "z"])
    pdf = df.select("x", "z", "team_a_win").toPandas().fillna(0.0)
    x = pdf[["x", "z"]].to_numpy()
    x, y = np.vstack([x, -x]), np.concatenate([pdf.team_a_win, 1 - pdf.team_a_win])
    _, scaler, logistic = model.stages
    n = len(x)
    # Its scaler divides by n - 1, so its coefficients are larger by this factor.
    assert np.array(logistic.coefficients) * np.sqrt((n - 1) / n) == pytest.approx(_newton(x, y), rel=1e-5)


def test_symmetric_probability_is_complementary(spark):
    df = _paired(spark)
    for candidate in FAST:
        b = M.Bundle(candidate.name, ("x", "z"), "PRE_TOSS", "T20", M.fit(candidate, df, ["x", "z"]))
        there = M.probability(b, df)
        back = M.probability(b, df.withColumns({"x": -F.col("x"), "z": -F.col("z")}), "q")
        gap = there.join(back.select("match_id", "q"), "match_id").agg(F.max(F.abs(F.col("p") + F.col("q") - 1)))
        assert gap.first()[0] < 1e-12
        assert there.columns == [*df.columns, "p"]


def test_router_folds_and_acceptance(spark, tmp_path):
    df = _paired(spark)
    ends = {"train_end": "2020-06-30", "valid_end": "2020-08-31", "candidates": FAST}
    bundles, rows = T.train_router(df, mode="PRE_TOSS", features=["x", "z"], **ends)
    assert set(bundles) == {"T20", "T20I"}
    assert rows.groupBy("domain", "split").count().count() == 4
    assert M.routed_probability(bundles, df).count() == df.count()
    with pytest.raises(ValueError):
        M.routed_probability({"T20": bundles["T20"]}, df)
    M.save(spark, list(bundles.values()), str(tmp_path / "m"))
    loaded = {b.domain: b for b in M.load(spark, str(tmp_path / "m"))}
    a = M.probability(bundles["T20"], df).agg(F.sum("p")).first()[0]
    assert M.probability(loaded["T20"], df).agg(F.sum("p")).first()[0] == pytest.approx(a)
    out = {(r.dimension, r.group): r for r in T.compare(df, df, loaded["T20"], bundles["T20"], "2020-08-31").collect()}
    assert out["all", "all"].brier_score_delta == pytest.approx(0) and ("gender", "male") in out
    table, gate = T.feature_group_folds(
        df, ["z"], {"g": ["x"]}, (("a", "2020-05-31", "2020-07-31"), ("b", "2020-07-31", "2020-09-30")), FAST[:1]
    )
    assert table.count() == 2 and gate.first()["improved_folds"] == 2
    bundle, report = T.finalize_candidate(df, mode="PRE_TOSS", base=["z"], extra=["x"], **ends)
    assert bundle is not None and bundle.feature_family == M.ROSTER_FAMILY and report.count() == 2
    with pytest.raises(RuntimeError):
        T.train_domain(df, mode="PRE_TOSS", domain="T20", features=["x"], train_end="2030-01-01", valid_end="2031-01-01", candidates=FAST[:1])


def test_models_that_fit_a_route(spark):
    kinds = [
        M.Bundle(M.ELO, ("d",), "PRE_TOSS", "T20I"),
        M.Bundle(M.ELO, (), "PRE_TOSS", "T20I"),
        M.Bundle(M.LOGISTIC, ("x",), "PRE_TOSS", "T20I"),
        M.Bundle(M.ELO, ("d",), M.LIVE_MODE, "LIVE", innings_number=1),
        M.Bundle(M.ELO, ("d",), "PRE_TOSS", "T20I", feature_family=M.ROSTER_FAMILY),
        M.Bundle(M.ELO, ("d",), "PRE_TOSS", "T20", feature_family=M.ROSTER_FAMILY),
    ]
    table = spark.createDataFrame(
        [(*row, False, n) for n, row in enumerate(M.registry_values(kinds))], f"{M.REGISTRY}, fitted boolean, number int"
    )
    got = {(r.number, r.match_format, r.route_innings): set(r.problems) for r in M.route_fit(table).collect()}
    assert got[0, "T20I", None] == set() and got[0, "T20", None] == {"other_domain", "other_family"}
    assert got[1, "T20I", None] == {"no_features"} and got[2, "T20I", None] == {"not_fitted"}
    assert got[3, "T20", 1] == set() and got[3, "T20", 2] == {"other_innings"}
    assert got[4, "T20I", None] == {"other_family"} and got[5, "T20", None] == set()
    assert all(k[0] != 0 or k[2] is None for k in got)



CONTESTS = "match_id string, date date, format string, gender string, venue string, team1 string, team2 string, winner string, result_type string, team1_players array<string>, team2_players array<string>"
REQUESTS = "request_id long, date date, format string, mode string, gender string, venue string, competition string, team1 string, team2 string, toss_winner string, toss_decision string, team1_xi array<string>, team2_xi array<string>, batting_team string, innings int, runs int, wickets int, legal_balls int, overs string, target int"


def _request(i, fmt="T20I", mode="pre-toss", date="2024-03-01", **kw):
    base = dict(request_id=i, date=dt.date.fromisoformat(date), format=fmt, mode=mode, gender="male", venue="V", competition=None,
                team1="India", team2="Australia", toss_winner=None, toss_decision=None, team1_xi=[], team2_xi=[], batting_team=None,
                innings=None, runs=None, wickets=None, legal_balls=None, overs=None, target=None)
    return tuple({**base, **kw}.values())


@pytest.fixture(scope="module")
def scored(spark):
    rows = []
    for i in range(12):
        fmt = "T20I" if i % 2 else "T20"
        winner = "India" if i % 3 else "Australia"
        rows.append((f"c{i}", dt.date(2024, 1, 1) + dt.timedelta(days=5 * i), fmt, "male", "V", "India", "Australia", winner, "win", ["a", "b"], ["x", "y"]))
    contests = spark.createDataFrame(rows, CONTESTS)
    batting = spark.createDataFrame([(f"c{i}", 1, p, 10 + i, 8, True, 1) for i in range(12) for p in "abxy"], "match_id string, innings int, player string, runs int, balls int, out boolean, first_seq long")
    bowling = spark.createDataFrame([(f"c{i}", 1, p, 12, 15, 1, 1) for i in range(12) for p in "abxy"], "match_id string, innings int, player string, balls int, runs int, wickets int, first_seq long")
    bundles = [
        M.Bundle(M.ELO, (M.ELO_FEATURE,), "PRE_TOSS", "T20I"),
        M.Bundle(M.ELO, (M.ELO_FEATURE,), "POST_TOSS", "T20I"),
        M.Bundle(M.ELO, ("previous_xi_core_batting_recent_runs_diff",), "PRE_TOSS", "T20", feature_family=M.ROSTER_FAMILY),
        M.Bundle(M.ELO, ("elo_difference",), M.LIVE_MODE, "LIVE", innings_number=2),
    ]
    requests = spark.createDataFrame(
        [
            _request(1),
            _request(2, date="2024-01-01"),
            _request(3, mode="POST_TOSS", toss_winner="India", toss_decision="bowl", team1_xi=["a"], venue=None),
            _request(4, fmt="T20", team1_xi=["a"]),
            _request(5, mode="live", batting_team="Australia", innings=2, runs=150, wickets=4, overs="17.4", target=150),
            _request(6, mode="live", batting_team="Australia", innings=2, runs=100, wickets=4, legal_balls=90, target=150),
            _request(7, fmt="ODI"),
            _request(8, mode="live", batting_team="India", innings=1, runs=1, wickets=0, legal_balls=3),
            _request(9, date="2024-01-06"),
        ],
        REQUESTS,
    )
    good, bad = S.score_requests(requests, contests, batting, bowling, bundles, parse_errors=2)
    return {r.request_id: r for r in good.collect()}, {r.request_id: r.reject_reasons for r in bad.collect()}


def test_scoring_routes_and_rejects(scored):
    good, bad = scored
    assert set(good) == {1, 2, 3, 4, 5, 6, 9} and set(bad) == {7, 8}
    assert "ODI" in bad[7][0] and "No production model" in bad[8][0]
    assert good[1].model_family == "international T20I" and good[4].model_family == "roster-aware T20"


def test_scoring_sees_only_earlier_days(scored):
    good, _ = scored
    assert (good[2].team1_history_matches, good[2].team1_probability, good[2].matches_applied) == (0, 0.5, 0)
    # A contest on the request's own day stays hidden.
    assert good[9].team1_history_matches == 0 and good[9].matches_applied == 1
    assert good[1].team1_history_matches == 6 and good[1].matches_applied == 12


def test_scoring_result_fields(scored):
    good, _ = scored
    for r in good.values():
        assert r.team1_probability + r.team2_probability == pytest.approx(1)
    assert good[5].terminal and good[5].team2_probability == 1.0 and good[5].predicted_team == "Australia"
    assert S.TERMINAL_USED in good[5].warnings and "Terminal chase state: target reached." in good[5].warnings
    assert good[6].terminal is False and good[6].model_kind == "chase"
    assert good[3].lineup_mode == "partial_xi" and good[1].lineup_mode is None
    assert good[4].previous_xi_team1_known is True and good[1].previous_xi_team1_known is None
    assert any("ignored" in w for w in good[4].warnings)
    assert good[2].confidence == "LOW" and "India has only 0 prior T20I matches in the loaded corpus." in good[2].warnings
    assert "2 historical files could not be parsed and were skipped." in good[1].warnings
    assert len(set(good[2].warnings)) == len(good[2].warnings)


def test_registered_training_uses_the_production_candidates(monkeypatch):
    from checks import model_queries as C

    asked = {}
    monkeypatch.setattr(C, "paired", lambda spark, sf: None)
    for name in ("train_domain", "train_router", "feature_group_folds", "finalize_candidate"):
        whole = inspect.signature(getattr(C.T, name))

        def kept(*args, name=name, whole=whole, **options):
            bound = whole.bind(*args, **options)
            bound.apply_defaults()
            asked[name] = bound.arguments
            return None, None

        monkeypatch.setattr(C.T, name, kept)
    for query in ("train_trees", "train_router", "feature_group_folds", "finalize_candidate"):
        C.QUERIES[query](None, None)
    every = tuple(C.M.PAIRED_CANDIDATES)
    assert tuple(asked["train_domain"]["candidates"]) == every[1:]
    assert tuple(asked["train_router"]["options"].get("candidates", every)) == every
    assert all(tuple(asked[n]["candidates"]) == every for n in ("feature_group_folds", "finalize_candidate"))
    assert len(asked["feature_group_folds"]["folds"]) == 3
