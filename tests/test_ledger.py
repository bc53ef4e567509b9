import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataloom.operators import ledger
from strataloom.operators.ledger import StaleWriter, WorkLedger, item_states

REV = "revision_id long, input_root string, completed_at string, state string"
CH = "revision_id long, file_id string, path string, change_kind string, root string"
RUN = "run_id long, attempt long, input_root string, started_at timestamp_ntz, finished_at timestamp_ntz, outcome string, read_until timestamp_ntz"
T = dt.datetime


def run(spark, changes, revisions, runs, **kw):
    s = item_states(spark.createDataFrame(changes, CH), spark.createDataFrame(revisions, REV), spark.createDataFrame(runs, RUN), **kw)
    return sorted((r.revision_id, r.file_id, r.state) for r in s.collect())


REVISIONS = [
    (1, "r", "2025-01-01T02:00:00+02:00", None), (2, "r", "2025-01-01T00:00:00.000001Z", None), (3, "r", "", None), (4, "r", None, None),
    (5, "q", "2024-12-31T20:00:00.5-08:00", None), (2, "r", "2025-01-01T00:00:00.000001Z", None), (6, None, "2025-01-01T00:00:00Z", None), (7, "r", "no time", None),
]
RUNS = [
    (1, 1, "r", None, None, "failed", T(2030, 1, 1)), (1, 2, "r", None, None, "ok", T(2025, 1, 1)), (2, 1, "r", None, None, "ok", T(2024, 1, 1)),
    (3, 1, "r", T(2025, 1, 2), None, "running", T(2025, 6, 1)), (4, 1, None, None, None, "ok", T(2030, 1, 1)), (5, 1, "r", None, None, "ok", None),
]
CHANGES = [
    (1, "a", "p", "inserted", "x"), (2, "a", "p", " Updated\t", "x"), (2, "a", "./p", "UPDATED", "x"), (2, "b", None, "unsupported", "x"), (2, None, "p", "deleted", "x"),
    (3, "a", "p", "inserted", "x"), (4, "a", "p", "inserted", "x"), (5, "z", "p", "Deleted", "x"), (6, "a", "p", "inserted", "x"), (None, "a", "p", "inserted", "x"), (7, "a", "p", "inserted", "x"), (2, "c", "p", None, "x"),
]


def test_states(spark):
    # as of the history's last instant, the start of the running attempt
    assert run(spark, CHANGES, REVISIONS, RUNS) == [(1, "a", "done"), (2, "a", "leased"), (5, "z", "pending")]
    assert run(spark, CHANGES, REVISIONS, RUNS, pending_only=True) == [(2, "a", "leased"), (5, "z", "pending")]


def test_lease_expires(spark):
    us = int(T(2025, 1, 2, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert (2, "a", "leased") in run(spark, CHANGES, REVISIONS, RUNS, now_us=us + 60_000_000)
    assert (2, "a", "pending") in run(spark, CHANGES, REVISIONS, RUNS, now_us=us + 7_200_000_000)


def test_entries(spark):
    runs = [
        (1, 1, "r", T(2025, 1, 1), None, "ok", T(2025, 1, 1)), (2, 1, "r", T(2025, 1, 2), None, "failed", T(2025, 1, 2)), (2, 2, "r", T(2025, 1, 2), None, "ok", T(2025, 1, 2)),
        (3, 1, "r", T(2025, 1, 3), None, "running", T(2025, 1, 3)), (4, 1, "r", T(2025, 1, 4), None, "ok", T(2024, 1, 1)), (5, 1, "r", T(2025, 1, 5), None, "running", T(2025, 1, 5)),
        (5, 1, "r", T(2025, 1, 5), None, "running", T(2025, 1, 5)), (6, 1, "q", T(2025, 1, 5), None, "ok", None),
    ]
    got = {tuple(r.token): (r.state, r.low_us, r.high_us) for r in ledger.entries(spark.createDataFrame(runs, RUN)).collect()}
    day = lambda n: int(T(2025, 1, n, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert got[(1, 1)] == ("done", None, day(1)) and got[(2, 1)][0] == "released" and got[(2, 2)] == ("done", day(1), day(2))
    assert got[(3, 1)][0] == "expired" and got[(4, 1)][0] == "stale" and got[(5, 1)][0] == "leased" and len(got) == 6


def test_items_know_the_token_that_committed_them(spark):
    revisions = [(i, "r", f"2025-01-0{i}T00:00:00Z", None) for i in range(1, 7)]
    changes = [(i, "a", "p", "inserted", "x") for i in range(1, 7)]
    runs = [
        (1, 1, "r", T(2025, 2, 1), None, "ok", T(2025, 1, 2)), (2, 1, "r", T(2025, 2, 2), None, "ok", T(2025, 1, 1)),
        (3, 1, "r", T(2025, 2, 3), None, "ok", T(2025, 1, 4)), (4, 1, "r", T(2025, 2, 4), None, "running", T(2025, 1, 5)),
    ]
    s = item_states(spark.createDataFrame(changes, CH), spark.createDataFrame(revisions, REV), spark.createDataFrame(runs, RUN))
    got = {r.revision_id: (r.state, r.token and r.token.run_id) for r in s.collect()}
    assert got == {1: ("done", 1), 2: ("done", 1), 3: ("done", 3), 4: ("done", 3), 5: ("leased", 4), 6: ("pending", None)}


def test_the_query_hangs_on_the_ledger(spark, monkeypatch):
    from strataloom.plans.problems import QUERIES

    from tests.conftest import DATA

    right = QUERIES["p3_found"](spark, DATA).count()
    true = ledger.entries
    monkeypatch.setattr(ledger, "entries", lambda *a, **k: true(*a, **k).where("state <> 'done'"))
    assert QUERIES["p3_found"](spark, DATA).count() > right


def test_empty(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, CHANGES, REVISIONS, []) == [(1, "a", "pending"), (2, "a", "pending"), (5, "z", "pending")]


def test_work_ledger(spark, tmp_path):
    now = [0.0]
    led = WorkLedger(spark, str(tmp_path / "ledger"), ttl=10, clock=lambda: now[0])
    assert led.add(["a", "b"]) == 2 and led.add(["a"]) == 0
    first = led.lease("w1", "a")
    assert led.state("a") == "leased" and led.lease("w2", "a") is None
    now[0] = 11
    assert led.state("a") == "pending"
    second = led.lease("w2", "a")
    assert second.token == first.token + 1
    rows = lambda item: spark.range(3).select(F.lit(item).alias("item"), "id")
    rows("a").write.parquet(led.staging(first))
    with pytest.raises(StaleWriter):
        led.commit(first)
    rows("a").write.parquet(led.staging(second))
    led.commit(second)
    with pytest.raises(StaleWriter):
        led.commit(second)
    assert led.process("w3", rows) == ["b"]
    assert led.results().groupBy("item").count().collect().__len__() == 2
    assert led.results().count() == 6
    assert led.process("w3", rows) == [] and set(led.states().values()) == {"done"}


def test_failed_work_leaves_the_item_pending(spark, tmp_path):
    now = [0.0]
    led = WorkLedger(spark, str(tmp_path / "l"), ttl=5, clock=lambda: now[0])
    led.add(["x"])

    def fail(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        led.process("w", fail)
    assert led.results() is None and led.state("x") == "leased"
    now[0] = 6
    assert led.process("w", lambda i: spark.range(2)) == ["x"]
    assert led.results().count() == 2


def test_a_crash_after_publishing_is_taken_up(spark, tmp_path):
    now = [0.0]
    led = WorkLedger(spark, str(tmp_path / "l"), ttl=5, clock=lambda: now[0])
    led.add(["x", "y"])
    spark.range(3).write.parquet(led.output("x"))  # published, then lost before its mark
    assert led.process("w", lambda i: spark.range(3)) == ["x", "y"]
    assert led.results().count() == 6


def test_a_stale_writer_does_not_stop_the_others(spark, tmp_path):
    now = [0.0]
    led = WorkLedger(spark, str(tmp_path / "l"), ttl=5, clock=lambda: now[0])
    led.add(["x", "y"])

    def slow(item):
        if item == "x":
            now[0] += 6
            other = led.lease("w2", "x")
            spark.range(1).write.parquet(led.staging(other))
            led.commit(other)
        return spark.range(1)

    assert led.process("w1", slow) == ["y"]
    assert led.results().count() == 2
