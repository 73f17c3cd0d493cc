import pandas as pd

from tallyline.streaming import live as R


class State:
    hasTimedOut, exists, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, at):
        self.at = at

    def getCurrentWatermarkMs(self):
        return 0


def _batch(seqs):
    return pd.DataFrame(
        {
            "seq": seqs, "ts": pd.to_datetime(seqs, unit="s"), "batting_team": "A", "runs_total": [1] * len(seqs),
            "wicket": [s % 2 == 0 for s in seqs], "is_wide": [s == 3 for s in seqs], "is_noball": False,
        }
    )


def test_late_and_repeated_deliveries_come_last_and_count_nowhere(monkeypatch):
    # Rows without gaps go over arrays; a frame for each step would cost milliseconds.
    taken = []
    plain = R._advanced
    monkeypatch.setattr(R, "_advanced", lambda *a: taken.append(1) or plain(*a))
    state = State()
    first = next(R._advance(("m", 1), iter([_batch([3, 2]), _batch([5, 3])]), state))
    assert first["seq"].tolist() == [2, 3, 5, 3] and first["late"].tolist() == [False, False, False, True]
    assert first["runs"].tolist() == [1, 2, 3, 3] and first["legal_balls_bowled"].tolist() == [1, 1, 2, 2]
    second = next(R._advance(("m", 1), iter([_batch([4, 6])]), state))
    assert second["seq"].tolist() == [6, 4] and second["late"].tolist() == [False, True]
    assert state.get == (4, 2, 3, 6) and len(taken) == 2
