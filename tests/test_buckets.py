"""The streams' keyed state holds many innings or matches in one value, read and written once a call."""

import pandas as pd

from tallyline.streaming import ordered as O
from tallyline.streaming import pages as P


class Handle:
    """One value and the timers of one bucket, with the calls counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _run(state, handle, now, rows, columns):
    frames = state.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), Now(now))
    out = [tuple(r) for f in frames for r in f.itertuples(index=False, name=None)]
    assert len(handle.timers) == (handle.value is not None)
    return out


def _fire(state, handle, now):
    at = handle.timers[0]
    assert at < now
    out = [tuple(r) for f in state.handleExpiredTimer((0,), Now(now), None) for r in f.itertuples(index=False, name=None)]
    handle.timers.remove(at)
    assert len(handle.timers) == (handle.value is not None)
    return out


def test_innings_of_a_bucket_share_state_and_timer():
    state, handle = O.Innings(idle_ms=1000), Handle()
    state.init(handle)
    columns = ["match_id", "innings", "seq", "at", "batting_team", "runs", "wicket", "legal"]
    rows = [(f"m{k}", 1, seq, (10 * seq + k) * 1000, "A", seq, False, True) for k in range(50) for seq in (2, 1)]
    assert _run(state, handle, 0, rows, columns) == []
    assert handle.calls == 1 and handle.timers == [11]
    # All first deliveries of the first 24 innings and the second ones of the first 15 are to be counted.
    got = _fire(state, handle, 35)
    assert handle.calls == 3
    expected = {(f"m{k}", 1): 1 for k in range(24)} | {(f"m{k}", 2): 3 for k in range(15)}
    assert {(r[0], r[2]): r[5] for r in got} == expected and len(got) == 39
    # One innings gets a late and a new delivery, and others of the bucket are due at the same watermark.
    got = _run(state, handle, 100, [("m0", 1, 2, 20_000, "A", 9, False, True), ("m0", 1, 3, 90_000, "A", 4, True, True)], columns)
    mine = [(2, 20_000, "A", 3, 0, 2, True, False), (3, 90_000, "A", 7, 1, 3, False, False)]
    assert [r[2:] for r in got if r[0] == "m0"] == mine
    assert len(got) == 2 + 2 * 50 - 39
    # After a rest the scores go and marks stay, after another one nothing is left.
    assert _fire(state, handle, 2000) == []
    got = _run(state, handle, 2500, [("m1", 1, 1, 2_400_000, "A", 5, False, True)], columns)
    assert [(r[0], r[5], r[9]) for r in got] == [("m1", 5, True)]
    _fire(state, handle, 10_000)
    _fire(state, handle, 20_000)
    assert handle.value is None and handle.timers == []


def test_matches_of_a_bucket_share_state_and_timer():
    state, handle = P.Newest(idle_ms=1000), Handle()
    state.init(handle)
    columns = ["match_id", "seen", "page", "place", "digest", "record"]
    rows = [(str(k), (100 + k) * 1000, "p", place, k + place, f"r{place}") for k in range(50) for place in (1, 0)]
    got = _run(state, handle, 0, rows, columns)
    assert sorted(got, key=lambda r: r[1]) == [(str(k), (100 + k) * 1000, "p", 1, "r1") for k in range(50)]
    assert handle.calls == 1 and handle.timers == [1100]
    # An older record and one that repeats what is known say nothing; a newer one does.
    rows = [("0", 99_000, "o", 0, 7, "old"), ("1", 300_000, "q", 0, 2, "r1"), ("2", 300_000, "q", 1, 9, "new")]
    assert _run(state, handle, 200, rows, columns) == [("2", 300_000, "q", 1, "new")]
    assert handle.calls == 3
    _fire(state, handle, 1110)
    assert sorted(int(r[0]) for r in handle.value[1]) == [1, 2, *range(10, 50)] and handle.timers == [1110]
    _fire(state, handle, 5000)
    assert handle.value is None and handle.timers == []
