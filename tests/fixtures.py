"""Hand-written match documents."""

from __future__ import annotations

import json
from pathlib import Path


def ball(batter="A1", bowler="B1", runs=0, extras=None, wickets=None, total=None):
    given = sum((extras or {}).values())
    out = {
        "batter": batter, "bowler": bowler, "non_striker": "N1",
        "runs": {"batter": runs, "extras": given, "total": runs + given if total is None else total},
    }
    if extras:
        out["extras"] = extras
    if wickets:
        out["wickets"] = wickets
    return out


def match(date="2024-04-01", teams=("Reds", "Blues"), winner="Blues", **info):
    first = [
        ball("A1", "B1", 4),
        ball("A1", "B1", 0, {"wides": 1}),
        ball("A1", "B1", 0, None, [{"kind": "caught", "player_out": "A1"}]),
    ]
    second = [ball("B1", "A1", 6)]
    base = {
        "balls_per_over": 6, "city": "Town", "dates": [date],
        "event": {"name": "Indian Premier League", "match_number": 1}, "gender": "male",
        "match_type": "T20", "outcome": {"winner": winner, "by": {"wickets": 10}} if winner else {"result": "no result"},
        "overs": 20, "player_of_match": ["B1"],
        "players": {teams[0]: ["A1", "A2"], teams[1]: ["B1", "B2"]},
        "season": 2024, "team_type": "club", "teams": list(teams),
        "toss": {"decision": "bat", "winner": teams[0]}, "venue": "The Park",
    }
    base.update(info)
    return {
        "meta": {"data_version": "1.2.0"},
        "info": base,
        "innings": [
            {"team": teams[0], "overs": [{"over": 0, "deliveries": first}]},
            {"team": teams[1], "target": {"overs": 20, "runs": 6},
             "overs": [{"over": 0, "deliveries": second}]},
        ],
    }


def write(folder: Path, **documents) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    for name, document in documents.items():
        text = document if isinstance(document, str) else json.dumps(document)
        (folder / f"{name}.json").write_text(text)
    return str(folder)
