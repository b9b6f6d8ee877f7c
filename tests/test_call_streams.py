import random
from functools import partial

import pytest

from lodestack.operators import calls, ledger
from lodestack.streaming.calls import PROVIDER, paid_stream, replay_stream

ATTEMPTS = "period string, seq long, key string, provider string, model string, task string, quoted_provider string, quoted_model string, amount long, request_fingerprint string, outcome string, actual long"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    yield spark
    spark.conf.set(PROVIDER[0], before)


def attempt(rng, seq):
    period, amount = f"p{rng.randrange(2)}", rng.randrange(1, 9)
    key = f"{period}-{rng.randrange(25)}" if rng.random() < 0.9 else f"{period}-x{seq}"
    amount = 5 if rng.random() < 0.8 else amount
    outcome = rng.choice(["response", "response", "not_sent", "error", "mismatch", "prepared", None])
    actual = rng.choice([1, amount, amount + (rng.random() < 0.02)])
    return period, seq, key, "x", "m", "t", rng.choice(["x"] * 9 + ["other"]), "m", amount, rng.choice(["f"] * 9 + ["g"]), outcome, actual


def event(rng, seq):
    period = f"p{rng.randrange(2)}"
    return period, seq, rng.choice(["reserve", "reserve", "settle", "cancel"]), f"{period}-{rng.randrange(30)}", rng.choice([4, 4, 4, 5, (1 << 53) + 1])


def run(spark, rows, schema, stream, folder, triggers, **trigger):
    """Each trigger's rows come in a run of its own that starts from the last one's checkpoint."""
    source, out = str(folder / "in"), str(folder / "out")
    step = -(-len(rows) // triggers)
    for lo in range(0, len(rows), step):
        spark.createDataFrame(rows[lo : lo + step], schema).coalesce(1).write.mode("append").parquet(source)
        q = stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / "cp")).trigger(**(trigger or {"availableNow": True})).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def test_paid_stream_equals_batch_over_restarts(rocks, tmp_path):
    rng = random.Random(11)
    rows = [attempt(rng, k) for k in range(300)]
    want = calls.paid(rocks.createDataFrame(rows, ATTEMPTS), 150)
    got = run(rocks, rows, ATTEMPTS, lambda a: paid_stream(a, 150), tmp_path, 3)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    decisions = {r["decision"] for r in want.collect()}
    assert {"quote", "contract", "replay", "dispatched", "prepared", "exceeded", "conflict"} <= decisions


def test_replay_stream_equals_batch_over_restarts(rocks, tmp_path):
    rng = random.Random(5)
    schema = "period string, seq long, op string, key string, amount long"
    rows = [event(rng, k) for k in range(300)]
    want = ledger.replay(rocks.createDataFrame(rows, schema), 1 << 54).select("period", "seq", "key", "outcome", "active_micros", "spent_micros")
    got = run(rocks, rows, schema, lambda e: replay_stream(e, 1 << 54), tmp_path, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_unanswered_dispatch_becomes_uncertain(rocks, tmp_path):
    base = ("x", "m", "t", "x", "m", 5, "f")
    rows = [("p", 1, "a", *base, None, None), ("p", 2, "b", *base, "response", 4), ("p", 3, "a", *base, "response", 4), ("p", 4, "c", *base, None, None)]
    got = run(rocks, rows, ATTEMPTS, lambda a: paid_stream(a, 50, patience=0), tmp_path, 2, once=True)
    found = [(r["seq"], r["decision"], r["call_status"], r["active_micros"], r["spent_micros"]) for r in got.collect()]
    # One batch a run: with timers by the clock there always is another one, so that availableNow has no end.
    assert (1, "unanswered", "uncertain", 5, 4) in found or (1, "unanswered", "uncertain", 10, 4) in found
    assert (1, "dispatched", "dispatching", 5, 0) in found and [f for f in found if f[:2] == (3, "replay")]
    assert sum(f[1] == "unanswered" and f[0] == 1 for f in found) == 1 and not any(f[1] == "unanswered" and f[0] == 2 for f in found)


def test_null_keys_and_amounts_raise(rocks, tmp_path):
    base = ("x", "m", "t", "x", "m")
    for name, row, error in (("key", ("p", 1, None, *base, 5, "f", None, None), "a key is null"), ("amount", ("p", 1, "a", *base, None, "f", None, None), "NoneType")):
        (tmp_path / name).mkdir()
        with pytest.raises(Exception, match=error):
            run(rocks, [row], ATTEMPTS, lambda a: paid_stream(a, 50), tmp_path / name, 1)


def test_needs_rocksdb(spark):
    rows = spark.createDataFrame([], ATTEMPTS)
    with pytest.raises(ValueError, match="keyed state needs"):
        paid_stream(rows, 5)


def test_shards_of_a_period_are_decided_apart(rocks, tmp_path):
    """The decisions are those of one state, by many tasks; changes sum to the totals; what other keys could decide raises."""
    rng = random.Random(3)
    rows = [r for r in (attempt(rng, k) for k in range(300)) if r[-1] <= r[8]]
    want = calls.paid(rocks.createDataFrame(rows, ATTEMPTS), 1 << 40)
    got = run(rocks, rows, ATTEMPTS, lambda a: paid_stream(a, 1 << 40, shards=16), tmp_path, 2)
    columns = ["period", "seq", "key", "decision", "call_status", "reservation_status"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
    active, spent = {}, {}
    changes = {r["seq"]: r for r in got.collect()}
    for r in want.orderBy("seq").collect():
        p = r["period"]
        active[p], spent[p] = active.get(p, 0) + changes[r["seq"]]["active_change"], spent.get(p, 0) + changes[r["seq"]]["spent_change"]
        assert (active[p], spent[p]) == (r["active_micros"], r["spent_micros"])
    base = ("x", "m", "t", "x", "m")
    for name, row in (("limit", ("p", 1, "a", *base, 50, "f", None, None)), ("breach", ("p", 1, "a", *base, 5, "f", "response", 6))):
        (tmp_path / name).mkdir()
        with pytest.raises(Exception, match="use shards=1"):
            run(rocks, [row], ATTEMPTS, lambda a: paid_stream(a, 160, shards=16), tmp_path / name, 1)
