import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import calls, ledger, migrations, models
from lodestack.plans.store import Store
from lodestack.schemas import ContractError, EngineError
from lodestack.streaming.ledger import admit_stream


def amount(spark, text, **kw):
    return spark.createDataFrame([(text,)], "a string").select(ledger.micros(F.col("a").cast("decimal(38,18)"), **kw)).first()[0]


def test_money_rounds_up(spark):
    assert amount(spark, "0.0000001") == 1 and amount(spark, "3.25") == 3_250_000 and amount(spark, "0", allow_zero=True) == 0
    assert str(spark.range(1).select(ledger.from_micros(F.lit(1_234_567))).first()[0]) == "1.234567"
    for bad in ("-1", "0", "10000000000000000"):
        with pytest.raises(Exception, match="not a valid amount"):
            amount(spark, bad)


def replay(spark, limit, *events):
    df = spark.createDataFrame([("p", k, *e) for k, e in enumerate(events)], "period string, seq long, op string, key string, amount long")
    return [(r["outcome"], r["active_micros"], r["spent_micros"]) for r in ledger.replay(df, limit).orderBy("seq").collect()]


def test_ledger_rules(spark):
    assert replay(spark, 20, ("reserve", "a", 3), ("settle", "a", 1), ("settle", "a", 1), ("settle", "a", 2), ("cancel", "a", 0), ("reserve", "a", 3)) == [("accepted", 3, 0), ("settled", 0, 1), ("existing", 0, 1), ("conflict", 0, 1), ("conflict", 0, 1), ("conflict", 0, 1)]
    assert [o for o, _, _ in replay(spark, 2, ("reserve", "a", 2), ("reserve", "b", 1), ("reserve", "a", 2), ("cancel", "a", 0), ("cancel", "a", 0), ("reserve", "b", 2))] == ["accepted", "exceeded", "existing", "cancelled", "existing", "accepted"]
    assert [o for o, _, _ in replay(spark, 20, ("reserve", "a", 1), ("reserve", "c", 1), ("settle", "a", 2), ("settle", "a", 2), ("reserve", "b", 1), ("reserve", "c", 1), ("settle", "x", 1))] == ["accepted", "accepted", "breached", "invariant", "locked", "existing", "unknown"]


def test_admission_and_stream_agree(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(3)}", k, rng.randrange(1, 50)) for k in range(200)]
    df = spark.createDataFrame(rows, "period string, seq long, amount long")
    held, expected = {}, {}
    for p, k, a in rows:
        fits = held.get(p, 0) + a <= 300
        held[p] = held.get(p, 0) + a * fits
        expected[k] = (fits, held[p])
    assert {r["seq"]: (r["accepted"], r["held"]) for r in ledger.admit(df, 300).collect()} == expected
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = admit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 300)
    q = out.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["seq"]: (r["accepted"], r["held"]) for r in spark.table("admitted").collect()} == expected


def test_ledger_audits(spark):
    df = spark.createDataFrame([("a", "active", 5, None, None), ("b", "settled", 5, 6, "t"), ("c", "breached", 5, 6, "t"), ("d", "cancelled", 5, 1, "t")], "key string, status string, reserved_micros long, actual_micros long, closed_at string")
    assert {r["key"] for r in ledger.misshapen(df).collect()} == {"b", "d"}
    p = df.withColumn("period", F.lit("2026-08"))
    assert ledger.locked_periods(p).count() == 1
    b = ledger.balances(p, spark.createDataFrame([("2026-08", 20), ("2026-09", 20)], "period string, limit_micros long"))
    assert {r["period"]: r["available_micros"] for r in b.collect()} == {"2026-08": 20 - 12 - 5, "2026-09": 20}


def test_calls(spark):
    e = spark.createDataFrame([("a", 1, "response"), ("a", 2, "error"), ("b", 1, None), ("c", 1, "not_sent"), ("d", 1, "mismatch")], "key string, seq long, outcome string")
    assert {r["key"]: (r["call_status"], r["reservation_status"], r["refused"]) for r in calls.fold(e).collect()} == {"a": ("completed", "settled", 1), "b": ("dispatching", "active", 0), "c": ("not_sent", "cancelled", 0), "d": ("uncertain", "active", 0)}
    h = spark.createDataFrame([("a", 1, "prepared"), ("a", 2, "dispatching"), ("a", 3, "completed"), ("a", 4, "prepared"), ("b", 1, "completed")], "key string, seq long, status string")
    assert {(r["key"], r["seq"]) for r in calls.bad_steps(h).collect()} == {("a", 4), ("b", 1)}
    texts = ['é "q" \\ \n\x01', "plain", "漢😀\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", calls.request_fingerprint({"b": F.col("t"), "a": F.lit("x")}).alias("f"))
    for r in df.collect():
        assert r["f"] == hashlib.sha256(json.dumps({"a": "x", "b": r["t"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Adapter:
    def __init__(self, name):
        self.name = name


def test_registry():
    assert calls.AdapterRegistry([Adapter(" x ")])["x"].name == " x "
    with pytest.raises(ValueError):
        calls.AdapterRegistry([Adapter("x"), Adapter(" x")])


def test_models(spark):
    payloads = ['{"data":[{"id":"qwen"},{"id":" coder "}]}', '{"data":[]}', '{"data":[{"id":"a"},{"id":"a"}]}', "nonsense"]
    df = spark.createDataFrame([(p,) for p in payloads], "p string").select(models.model_ids(F.col("p")).alias("ids")).select("ids", models.health(F.lit(True), F.col("ids")).alias("h"))
    assert [(r["ids"], r["h"]) for r in df.collect()] == [(["qwen", "coder"], "ready"), ([], "degraded"), (None, "degraded"), (None, "degraded")]
    c = spark.createDataFrame([('{"choices":[{"message":{"content":"hi"},"finish_reason":"stop"}]}',), ('{"choices":[]}',)], "p string").select(models.completion(F.col("p"), "m").alias("c")).collect()
    assert (c[0]["c"]["model"], c[0]["c"]["text"]) == ("m", "hi") and c[1]["c"] is None
    assert models.checked_loopback("http://127.0.0.1:8080/") == "http://127.0.0.1:8080"
    for bad in ("http://localhost:1", "https://127.0.0.1", "http://10.0.0.1", "http://u@127.0.0.1"):
        with pytest.raises(ContractError):
            models.checked_loopback(bad)


def test_migrations(spark):
    a = migrations.discover(spark.createDataFrame([("001_a.sql", "1"), ("002_b.sql", "2"), ("004_d.sql", "4"), ("005_e.sql", "5")], "filename string, text string"))
    b = migrations.discover(spark.createDataFrame([("001_a.sql", "1"), ("002_b.sql", "!"), ("003_c.sql", "3"), ("004_x.sql", "4"), ("006_f.sql", "6")], "filename string, text string"))
    assert {r["version"]: r["state"] for r in migrations.reconcile(a, b).collect()} == {1: "applied", 2: "changed", 3: "backfilled", 4: "renamed", 5: "missing", 6: "pending"}
    with pytest.raises(Exception, match="invalid migration name"):
        migrations.discover(spark.createDataFrame([("x.sql", "")], "filename string, text string")).collect()


def test_a_key_is_one_reservation_over_all_periods(spark):
    """The state of every key is that of a ledger which takes all events one by one."""
    rng = random.Random(11)
    events = [(f"2026-{1 + k // 40:02}", k, rng.choice(["reserve", "reserve", "settle", "cancel"]), f"k{rng.randrange(25)}", rng.randrange(1, 6), rng.choice("ab")) for k in range(160)]
    events += [("2026-02", 300 + k, "reserve", f"k{k}", 1, "a") for k in range(12)]  # late events of an early period
    seen, state, expected = {}, {}, {}
    for p, seq, op, key, amount, provider in sorted(events, key=lambda e: e[1]):
        s = state.setdefault(p, {"active": 0, "spent": 0, "locked": False})
        entry, own = seen.get(key), None
        if entry and entry["period"] == p:
            own = entry
        if op == "reserve":
            if entry:
                same = (entry["period"], entry["amount"], entry["provider"]) == (p, amount, provider)
                out = "existing" if same and entry["status"] == "active" else "conflict"
            elif s["locked"]:
                out = "locked"
            elif s["active"] + s["spent"] + amount > 20:
                out = "exceeded"
            else:
                out, seen[key] = "accepted", {"period": p, "amount": amount, "provider": provider, "status": "active", "actual": None}
                s["active"] += amount
        elif not own:
            out = "unknown"
        elif op == "cancel":
            out = {"active": "cancelled", "cancelled": "existing"}.get(own["status"], "conflict")
            if out == "cancelled":
                own["status"] = "cancelled"
                s["active"] -= own["amount"]
        elif own["status"] == "active":
            out = own["status"] = "breached" if amount > own["amount"] else "settled"
            own["actual"] = amount
            s["active"] -= own["amount"]
            s["spent"] += amount
            s["locked"] |= out == "breached"
        elif own["actual"] == amount:
            out = {"settled": "existing", "breached": "invariant"}[own["status"]]
        else:
            out = "conflict"
        expected[seq] = (out, s["active"], s["spent"])
    df = spark.createDataFrame(events, "period string, seq long, op string, key string, amount long, provider string")
    assert {r["seq"]: (r["outcome"], r["active_micros"], r["spent_micros"]) for r in ledger.replay(df, 20, ["provider"]).collect()} == expected
    assert {"conflict", "locked", "existing", "accepted", "unknown"} <= {o for o, _, _ in expected.values()}


def test_period_policy_is_fixed_by_the_first_accepted(spark):
    rows = [("p", 1, "reserve", "a", 9, 5), ("p", 2, "reserve", "b", 3, 10), ("p", 3, "reserve", "c", 1, 5), ("p", 4, "reserve", "b", 3, 5), ("p", 5, "reserve", "b", 3, 10)]
    df = spark.createDataFrame(rows, "period string, seq long, op string, key string, amount long, limit_micros long")
    assert [r["outcome"] for r in ledger.replay(df, 0).orderBy("seq").collect()] == ["exceeded", "accepted", "policy", "policy", "existing"]
    limits = spark.createDataFrame([("p", 10), ("q", 12)], "period string, limit_micros long")
    none = df.limit(0).select("period", F.lit("active").alias("status"), F.col("amount").alias("reserved_micros"), F.col("amount").alias("actual_micros"))
    assert ledger.balances(none, limits.where("period = 'p'"), 10).first()["available_micros"] == 10
    with pytest.raises(Exception, match="not the configured one: q"):
        ledger.balances(none, limits, 10).collect()


def test_paid_calls(spark):
    rows = [
        ("p", 1, "a", "x", 5, "f1", "prepared", None),
        ("p", 2, "a", "x", 5, "f1", "response", 4),  # resumes
        ("p", 3, "a", "x", 5, "f1", "response", 4),  # its reservation is closed
        ("p", 4, "b", "x", 5, "f2", None, None),
        ("p", 5, "b", "x", 5, "f2", "response", 1),  # a replay
        ("p", 6, "b", "x", 5, "f3", "response", 1),  # another request
        ("p", 7, "b", "x", 6, "f2", "response", 1),  # another amount
        ("p", 8, "c", "other", 5, "f4", "response", 1),  # quoted by another
        ("p", 9, "d", "x", 50, "f5", "response", 1),
        ("p", 10, "e", "x", 2, "f6", "not_sent", None),
        ("p", 11, "g", "x", 2, "f7", "error", None),
        ("p", 12, "h", "x", 2, "f8", "response", 3),  # a breach
        ("p", 13, "i", "x", 1, "f9", "response", 1),
        ("q", 14, "a", "x", 5, "f1", "response", 1),  # the key is another period's
        ("q", 15, "i", "x", 1, "f9", "response", 1),
    ]
    df = spark.createDataFrame([(p, n, k, "x", "m", "t", q, "m", a, f, o, c) for p, n, k, q, a, f, o, c in rows], "period string, seq long, key string, provider string, model string, task string, quoted_provider string, quoted_model string, amount long, request_fingerprint string, outcome string, actual long")
    got = [(r["decision"], r["call_status"], r["reservation_status"], r["active_micros"], r["spent_micros"]) for r in calls.paid(df, 20).orderBy("seq").collect()]
    assert got == [
        ("prepared", "prepared", "active", 5, 0),
        ("dispatched", "completed", "settled", 0, 4),
        ("conflict", "completed", "settled", 0, 4),
        ("dispatched", "dispatching", "active", 5, 4),
        ("replay", "dispatching", "active", 5, 4),
        ("contract", "dispatching", "active", 5, 4),
        ("conflict", "dispatching", "active", 5, 4),
        ("quote", None, None, 5, 4),
        ("exceeded", None, None, 5, 4),
        ("dispatched", "not_sent", "cancelled", 5, 4),
        ("dispatched", "uncertain", "active", 7, 4),
        ("dispatched", "completed", "breached", 7, 7),
        ("locked", None, None, 7, 7),
        ("conflict", None, None, 0, 0),
        ("dispatched", "completed", "settled", 0, 1),
    ]


def test_call_audits(spark):
    r = spark.createDataFrame([(1, "a", "x", "m", "active"), (2, "b", "x", "m", "settled"), (3, "c", "x", "n", "active")], "reservation_id long, key string, provider string, model string, status string")
    c = spark.createDataFrame([(n, n, k, "x", "m", "prepared") for n, k in enumerate("abcd", 1)], "call_id long, reservation_id long, key string, provider string, model string, status string")
    assert sorted(x["call_id"] for x in calls.unbound(c, r).collect()) == [2, 3, 4]
    assert {(x["call_id"], x["reason"]) for x in calls.incoherent(c, r).collect()} == {(2, "status"), (3, "identity"), (4, "missing")}
    closings = spark.createDataFrame([(1, 5, "settled"), (2, 5, "cancelled"), (3, 1, "settled"), (4, 5, "active"), (5, 5, "settled")], "reservation_id long, seq long, status string")
    history = spark.createDataFrame([(1, 1, "prepared"), (1, 2, "dispatching"), (2, 1, "prepared"), (3, 2, "prepared"), (5, 1, "dispatching"), (5, 3, "uncertain")], "reservation_id long, seq long, status string")
    assert {(x["reservation_id"], x["call_status"]) for x in calls.unsent_closings(closings, history).collect()} == {(2, "prepared"), (5, "uncertain")}


def test_time_is_utc_whatever_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        df = spark.createDataFrame([(1769903999, 0), (1769903999, 5)], "s long, m long").select(F.timestamp_micros(F.col("s") * 1_000_000 + F.col("m")).alias("t"))
        for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(ledger.period(F.col("t")), ledger.iso_timestamp(F.col("t")), ledger.period(F.lit("2026-03-01").cast("date"))).collect()
            assert [tuple(r) for r in got] == [("2026-01", "2026-01-31T23:59:59+00:00", "2026-03"), ("2026-01", "2026-01-31T23:59:59.000005+00:00", "2026-03")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_migrations_are_applied_once(spark, tmp_path):
    store, ran = Store(spark, str(tmp_path / "m")), []
    files = [("001_a.sql", "1"), ("002_b.sql", "2"), ("003_c.sql", "3")]
    found = lambda n: migrations.discover(spark.createDataFrame(files[:n], "filename string, text string"))
    assert migrations.apply_pending(store, found(2), lambda v, f: ran.append((v, f))) == [1, 2]
    assert migrations.apply_pending(store, found(3), lambda v, f: ran.append((v, f))) == [3] and migrations.apply_pending(store, found(3), None) == []
    assert ran == [(1, "001_a.sql"), (2, "002_b.sql"), (3, "003_c.sql")] and store.table("migrations").count() == 3
    with pytest.raises(EngineError, match="missing"):
        migrations.apply_pending(store, found(2), None)

    def broken(v, f):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        migrations.apply_pending(store, migrations.discover(spark.createDataFrame([*files, ("004_d.sql", "4")], "filename string, text string")), broken)
    assert store.table("migrations").count() == 3


def plain_admission(rows, limit):
    held, out = {}, []
    for period, seq, amount in sorted(rows):
        fits = held.get(period, 0) + amount <= limit
        held[period] = held.get(period, 0) + amount * fits
        out.append((period, seq, amount, fits, held[period]))
    return sorted(out)


def test_admission_in_blocks_equals_the_plain_fold(spark):
    import random

    rng = random.Random(4)
    for round_ in range(6):
        high = rng.choice([3, 40, 1000])
        rows = [(f"p{rng.randrange(3)}", n, rng.randrange(1, high)) for n in range(400)]
        if round_ == 4:  # every other request is larger than the room, which shrinks by one
            rows = [("p", n, 1 if n % 2 == 0 else 100 - n // 2) for n in range(150)]
        df = spark.createDataFrame(rows, "period string, seq long, amount long")
        for limit in (rng.randrange(1, 200), 100, 10**6):
            got = sorted(map(tuple, ledger.admit_in_blocks(df, limit, block=rng.choice([7, 64])).collect()))
            assert got == plain_admission(rows, limit)


def test_large_periods_are_admitted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ledger, "DIRECT", 50)
    monkeypatch.setattr(ledger, "BLOCK", 16)
    rows = [("big", n, n % 9 + 1) for n in range(200)] + [("small", n, 5) for n in range(20)]
    df = spark.createDataFrame(rows, "period string, seq long, amount long")
    assert sorted(map(tuple, ledger.admit(df, 300).collect())) == plain_admission(rows, 300)
    assert ledger.admit(df.where("false"), 300).count() == 0


def test_a_chain_of_periods_folds_only_what_changed(spark, monkeypatch):
    """Each period's key is also asked for in the next one, so owners settle one after the other."""
    n = 12
    events = []
    for p in range(n):
        events.append((f"2024-{p:02d}", 10 * p, "reserve", f"k{p}", 60, None))
        events.append((f"2024-{p:02d}", 10 * p + 1, "reserve", f"k{p - 1}", 60, None))
    events += [(f"2030-{p:02d}", 1000 + p, "reserve", f"own{p}", 5, None) for p in range(40)]
    seen = []
    plain = ledger._fold
    monkeypatch.setattr(ledger, "_fold", lambda df, *rest: (seen.append(df.count()), plain(df, *rest))[1])
    df = spark.createDataFrame(events, "period string, seq long, op string, key string, amount long, limit_micros long")
    out = {r["seq"]: r["outcome"] for r in ledger.replay(df, 100).collect()}
    assert out[0] == "accepted" and out[1] == "exceeded"
    for p in range(1, n):
        assert out[10 * p] == "accepted" and out[10 * p + 1] == "conflict"
    assert all(out[1000 + p] == "accepted" for p in range(40))
    assert seen[0] == len(events) and all(k <= 2 * n for k in seen[1:]) and len(seen) >= 2


def test_keys_of_periods_without_a_binding_limit_are_folded_apart(spark, monkeypatch):
    """Outcomes and totals are those of the fold by period, also after breaches and for keys of several periods, and no period is one group."""
    import random

    rng, groups = random.Random(9), []
    plain = ledger._fold
    monkeypatch.setattr(ledger, "_fold", lambda df, columns, *rest: (groups.append(columns[0]), plain(df, columns, *rest))[1])
    monkeypatch.setattr(ledger, "BLOCK", 16)
    for most in (5, 6):  # without breaches, and with
        rows = [(f"p{rng.randrange(3)}", n, rng.choice(["reserve", "reserve", "settle", "cancel"]), rng.choice([None, *(f"k{rng.randrange(60)}" for _ in range(20)), *[f"new{n}"] * 5]), n, None) for n in range(400)]
        rows = [(p, n, op, k, rng.choice([3, 5, 5, most]) if op == "settle" else 5, None) for p, n, op, k, *_ in rows]
        df = spark.createDataFrame(rows, "period string, seq long, op string, key string, amount long, limit_micros long")
        groups.clear()
        got = sorted(map(tuple, ledger.replay(df, 1 << 40).collect()), key=str)
        assert set(groups) == {"_key"}
        with monkeypatch.context() as m:
            m.setattr(ledger, "apart", lambda *_: None)
            want = sorted(map(tuple, ledger.replay(df, 1 << 40).collect()), key=str)
        assert got == want and (most == 5 or any("locked" in r for r in want))
        tries = [(p, n, k, "x", "m", "t", rng.choice(["x"] * 9 + ["y"]), "m", 5, rng.choice(["f"] * 9 + ["g"]), rng.choice(["response", "not_sent", "error", "prepared", None]), rng.choice([4, most if rng.random() < 0.1 else 5])) for p, n, _, k, *_ in rows]
        a = spark.createDataFrame(tries, "period string, seq long, key string, provider string, model string, task string, quoted_provider string, quoted_model string, amount long, request_fingerprint string, outcome string, actual long")
        got = sorted(map(tuple, calls.paid(a, 1 << 40).collect()), key=str)
        with monkeypatch.context() as m:
            m.setattr(ledger, "apart", lambda *_: None)
            want = sorted(map(tuple, calls.paid(a, 1 << 40).collect()), key=str)
        assert got == want
