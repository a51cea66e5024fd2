"""Event uniqueness against a count of every event and day, for any overlap of events."""

import datetime as dt

import numpy as np

from tickloom.operators.labels import uniqueness_weights

DAY = dt.date(2024, 1, 1)


def test_uniqueness_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    days = sorted(rng.choice(60, 40, replace=False).tolist())
    events = []
    for symbol in (1, 2, 3):
        for _ in range(25 if symbol < 3 else 1):
            a = int(rng.integers(0, 55))
            events.append((symbol, a, None if rng.random() < 0.15 or symbol == 3 else a + int(rng.integers(0, 15))))
    date = lambda n: None if n is None else DAY + dt.timedelta(days=n)
    df = spark.createDataFrame([(i, s, date(a), date(b)) for i, (s, a, b) in enumerate(events)], "id int, symbol long, t0 date, t1 date")
    out = uniqueness_weights(df, spark.createDataFrame([(date(d),) for d in days], "trade_date date"), "t0", "t1")
    got = {r.id: r.uniqueness for r in out.collect()}
    inside = [[d for d in days if b is not None and a <= d <= b] for _, a, b in events]
    want = {}
    for i, (s, _, _) in enumerate(events):
        shares = [1.0 / sum(d in inside[j] for j, e in enumerate(events) if e[0] == s) for d in inside[i]]
        want[i] = np.mean(shares) if shares else None
    for s in (1, 2, 3):
        known = [want[i] for i, e in enumerate(events) if e[0] == s and want[i] is not None]
        for i, e in enumerate(events):
            if e[0] == s and want[i] is None:
                want[i] = np.mean(known) if known else None
    assert got.keys() == want.keys()
    assert all((got[i] is None) == (want[i] is None) and (want[i] is None or abs(got[i] - want[i]) < 1e-12) for i in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no symbol x session grid
