"""Ledger events and paid calls as streams: one keyed state for each period, in RocksDB.

A period's totals are one value, each reservation and its call one entry of a map, so a trigger reads and writes the keys that it meets,
whatever else the period holds. The rules are those of the batch functions, ``ledger.event`` and ``calls.attempt``.

Rows of a trigger are taken by seq, triggers as they come; a period's rows of one trigger are held for that, which the source's rows or
files a trigger bound, and are one task's work, as each decision hangs on those before. A key belongs to one period here: only the batch
functions see all periods at once. A null key raises, and a null amount does where it would be reserved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import calls, ledger

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Entries of a period's map that a task holds at once, before it writes them back.
HELD = 10_000
TOTALS = "active long, spent long, locked boolean, asked long"
ENTRY = "amount long, identity string, reservation string, actual long, fingerprint string, call string"


class _Period(StatefulProcessor):
    """step(state, row) over a period's rows. A call that is dispatching when ``patience`` milliseconds have gone by becomes uncertain."""

    def __init__(self, step: Callable, names: list[str], patience: int | None = None):
        self.step, self.names, self.patience = step, names, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.entries = handle.getMapState("entries", "key string", ENTRY)
        # When an answer is due, and whose: a key's place in the map of those that wait.
        self.waiting = handle.getMapState("waiting", "due long, key string", "seq long")

    def _open(self) -> dict:
        state = ledger.opened() | {"calls": {}}
        if self.totals.exists():
            state["active"], state["spent"], state["locked"], state["limit"] = self.totals.get()
        return state

    def _load(self, state: dict, key: str) -> None:
        if key in state["met"]:
            return
        state["met"].add(key)
        if self.entries.containsKey((key,)):
            amount, identity, status, actual, fingerprint, call = self.entries.getValue((key,))
            state["known"][key] = {"status": status, "identity": (amount, identity), "actual": actual}
            if call is not None:
                state["calls"][key] = {"fingerprint": fingerprint, "status": call}

    def _store(self, state: dict) -> None:
        for key in sorted(state["met"] & state["known"].keys()):
            entry, call = state["known"][key], state["calls"].get(key, {})
            self.entries.updateValue((key,), (*entry["identity"], entry["status"], entry["actual"], call.get("fingerprint"), call.get("status")))
        state["known"], state["calls"], state["met"] = {}, {}, set()
        self.totals.update((state["active"], state["spent"], state["locked"], state["limit"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._open() | {"met": set()}
        due = None if self.patience is None else timerValues.getCurrentProcessingTimeInMs() + self.patience
        waits = False
        for row in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
            if len(state["met"]) >= HELD:
                self._store(state)
            if row["key"] is None:
                raise ValueError("a key is null")
            self._load(state, row["key"])
            found = self.step(state, row)
            if due is not None and found[:2] == ("dispatched", "dispatching"):
                self.waiting.updateValue((due, row["key"]), (row["seq"],))
                waits = True
            yield Row(period=key[0], seq=row["seq"], key=row["key"], **dict(zip(self.names, found, strict=True)))
        self._store(state)
        if waits:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        late = sorted((seq, due, name) for (due, name), (seq,) in self.waiting.iterator() if due <= now)
        state = self._open() | {"met": set()}
        for seq, due, name in late:
            self.waiting.removeKey((due, name))
            self._load(state, name)
            call = state["calls"][name]
            if call["status"] == "dispatching":
                call["status"] = "uncertain"
                sums = (state["active"], state["spent"]) if "active_micros" in self.names else (0, 0)
                found = ("unanswered", "uncertain", state["known"][name]["status"], *sums)
                yield Row(period=key[0], seq=seq, key=name, **dict(zip(self.names, found, strict=True)))
            if len(state["met"]) >= HELD:
                self._store(state)
        self._store(state)


def _needs_rocks(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER[0], None) != PROVIDER[1]:
        raise ValueError(f"keyed state needs {PROVIDER[0]} = {PROVIDER[1]}")


def _names(added: str) -> list[str]:
    return [c.split()[0] for c in added.split(",")]


def _apart(step: Callable, limit: int, shards: int) -> Callable:
    """step() of a state that has one of the shards of a period's keys: the totals become changes, and what other keys could decide raises."""

    def one(state: dict, row: dict) -> tuple:
        active, spent = state["active"], state["spent"]
        found = step(state, row)
        if row.get("limit_micros") not in (None, limit) or state["locked"] or found[0] == "exceeded" or state["active"] + state["spent"] > limit // shards:
            raise ValueError(f"period {row['period']} comes near its limit, is locked or has several limits, so its keys cannot be decided apart: use shards=1")
        return (*found[:-2], state["active"] - active, state["spent"] - spent)

    return one


def _stream(slim: DataFrame, step: Callable, limit: int, added: str, patience: int | None, shards: int) -> DataFrame:
    _needs_rocks(slim.sparkSession)
    by = ["period"]
    if shards > 1:
        step, added = _apart(step, limit, shards), added.replace("_micros", "_change")
        by, slim = ["period", "shard"], slim.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return slim.groupBy(*by).transformWithState(_Period(step, _names(added), patience), f"period string, seq long, key string, {added}", "append", "None" if patience is None else "ProcessingTime")


def replay_stream(events: DataFrame, limit: int, identity: list[str] | None = None, shards: int = 1) -> DataFrame:
    """``ledger.replay`` of a stream of events (period, seq, op, key, amount): period, seq, key, outcome, active_micros, spent_micros (with
    shards: active_change, spent_change)."""
    return _stream(ledger.slim_events(events, identity), lambda state, row: ledger.event(state, row, limit), limit, ledger.EVENT, None, shards)


def paid_stream(attempts: DataFrame, limit: int, patience: int | None = None, shards: int = 1) -> DataFrame:
    """``calls.paid`` of a stream of attempts: the same columns (with shards: active_change, spent_change).

    patience: milliseconds after which a dispatch without an answer is uncertain for good; the trigger that finds this adds a row of decision
    ``unanswered``, with the seq of the attempt. Without it such a call stays dispatching.
    """
    return _stream(calls.slim_attempts(attempts), lambda state, row: calls.attempt(state, row, limit), limit, calls.ATTEMPT, patience, shards)
