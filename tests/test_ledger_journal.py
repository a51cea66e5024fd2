"""The stateful ledger against a batch replay over restarts; the journal's versions, pruning and inventory."""

import datetime as dt
import random

import pandas as pd
import pytest

from tickloom.sources import journal as JO
from tickloom.streaming import events as ST
from tickloom.streaming import ledger as LG
from pyspark.sql import functions as F

SCHEMA = "symbol long, ts timestamp, event_id long, state string"
LEGAL = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")]
OPTS = {"key": "symbol", "time": "ts", "ident": "event_id", "state": "state", "legal": LEGAL}


def deliveries(seed, batches=4, n=400):
    """Events dealt to batches out of order; some come twice, in the same batch or in a later one."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    events = [(rng.randrange(6) if i % 3 else 0, start + dt.timedelta(seconds=rng.randrange(20_000)), i, rng.choice("abc")) for i in range(n)]
    out = [[] for _ in range(batches)]
    for e in events:
        first = min(batches - 1, int((e[1] - start).total_seconds() / 20_000 * batches) + rng.choice([0, 0, 0, 1]))
        out[first].append(e)
        if rng.random() < 0.1:
            out[rng.randrange(first, batches)].append(e)
    return [rng.sample(b, len(b)) for b in out]


def plain_ledger(batches, keep=None):
    """Every key by itself, batch after batch."""
    held = {}
    for batch in batches:
        for symbol, ts, ident, state in sorted(batch, key=lambda e: (e[1], e[2])):
            k = held.setdefault(symbol, {"last": None, "state": None, "ids": {}, "admitted": 0, "illegal": 0, "duplicates": 0, "late": 0})
            if ident in k["ids"]:
                k["duplicates"] += 1
            elif k["last"] is not None and (ts, ident) < k["last"]:
                k["late"] += 1
            else:
                k["illegal"] += k["state"] is not None and (k["state"], state) not in LEGAL
                k["last"], k["state"], k["admitted"] = (ts, ident), state, k["admitted"] + 1
                k["ids"][ident] = ts
        if keep is not None:
            for k in held.values():
                k["ids"] = {i: t for i, t in k["ids"].items() if t >= k["last"][0] - dt.timedelta(seconds=keep)}
    return {s: (k["last"][1], k["state"], k["admitted"], k["illegal"], k["duplicates"], k["late"]) for s, k in held.items()}


def told(df):
    return {r["key"]: (r.event_id, r.state, r.admitted, r.illegal, r.duplicates, r.late) for r in df.collect()}


@pytest.mark.parametrize("keep", [10.0**7, 900.0])
def test_ledger_equals_a_replay_after_restarts(spark, tmp_path, keep):
    batches = deliveries(3)
    for i, batch in enumerate(batches):  # each run starts a new query on the old checkpoint
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/arrival={i}")
        LG.run_ledger(ST.file_stream(spark, f"{tmp_path}/in/*", SCHEMA), f"{tmp_path}/out", f"{tmp_path}/cp", keep=keep, **OPTS)
    out = spark.read.parquet(f"{tmp_path}/out")
    want = plain_ledger(batches, keep)
    assert told(LG.current_states(out)) == want
    assert out.where("kind = 'duplicate'").count() == sum(v[4] for v in want.values()) > 0
    assert out.where("kind = 'late'").count() == sum(v[5] for v in want.values()) > 0
    if keep > 10**6:
        rows = [(*e, i) for i, batch in enumerate(batches) for e in batch]
        table = spark.createDataFrame(rows, SCHEMA + ", arrival int")
        assert told(LG.replay_states(table, "symbol", "ts", "event_id", "state", "arrival", LEGAL, F.date_trunc("hour", F.col("ts")))) == want


JOURNAL, KEYS = "v double, day date, symbol string", ["day", "symbol"]


def rows(spark, spec):
    return spark.createDataFrame([(float(v), f"2024-01-{d:02d}", s) for d, s, v in spec], "v double, d string, symbol string").selectExpr("v", "to_date(d) AS day", "symbol")


def test_journal_versions(spark, tmp_path):
    root = str(tmp_path / "j")
    first = JO.append_journal(rows(spark, [(1, "a", 1), (1, "a", 2), (2, "b", 3)]), root, KEYS)
    assert {r.decision for r in first.collect()} == {"NEW"}
    again = JO.append_journal(rows(spark, [(1, "a", 2), (1, "a", 1), (2, "b", 4), (3, "a", 5)]), root, KEYS)
    assert {(r.day.day, r.symbol): r.decision for r in again.collect()} == {(1, "a"): "DEDUPLICATED", (2, "b"): "CONFLICT", (3, "a"): "NEW"}
    values = lambda: sorted(r.v for r in JO.read_journal(spark, root, JOURNAL, KEYS).collect())
    assert values() == [1.0, 2.0, 3.0, 5.0]
    JO.append_journal(rows(spark, [(2, "b", 4), (2, "b", 6)]), root, KEYS, supersede=True)
    assert values() == [1.0, 2.0, 4.0, 5.0, 6.0]
    told = {(r.day.day, r.symbol): (r.rows, r.versions) for r in JO.inventory(spark, root, JOURNAL, KEYS).collect()}
    assert told == {(1, "a"): (2, 1), (2, "b"): (2, 2), (3, "a"): (1, 1)}


def test_journal_read_prunes_by_the_joined_table(spark, tmp_path):
    root = str(tmp_path / "j")
    JO.append_journal(rows(spark, [(d, s, d) for d in range(1, 20) for s in "abc"]), root, KEYS)
    wanted = JO.inventory(spark, root, JOURNAL, KEYS).where("symbol = 'a' AND day > '2024-01-15'").select(*KEYS)
    df = JO.read_journal(spark, root, JOURNAL, KEYS, wanted)
    assert sorted(r.v for r in df.collect()) == [16.0, 17.0, 18.0, 19.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    counted = JO.inventory(spark, root, JOURNAL, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "/data" not in counted


def test_a_key_reads_and_writes_its_state_once_a_batch():
    class Held:
        exists, get, reads, writes = False, None, 0, 0

        def update(self, value):
            self.exists, self.get, self.writes = True, value, self.writes + 1

    held, fold = Held(), LG.key_ledger(LEGAL, 60.0)
    for start in (0, 1500):
        rows = pd.DataFrame({"event_time": [i * 1_000_000 for i in range(start, start + 2000)], "event_id": range(start, start + 2000), "state": ["a", "b"] * 1000})
        out = pd.concat(list(fold((7,), iter([rows.iloc[:900], rows.iloc[900:]]), held)))
    assert held.writes == 2 and len(held.get[-1]) == 61  # ids of the last minute
    assert out["kind"].value_counts().to_dict() == {"late": 439, "duplicate": 61, "state": 1}
    assert out.iloc[-1][["admitted", "duplicates", "late", "seen"]].tolist() == [3500, 61, 439, 4000]
