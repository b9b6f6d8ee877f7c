"""Exact-money ledger: reservations, settlements, admission and balances.

Amounts are whole millionths. Decisions that hang on earlier ones are folded in order: rows are sorted by period and
sequence within partitions and stream through a running state, so no period is gathered in memory. Keys of periods that cannot come to their limits
hang on their own events alone, and are folded by key. Admission to a period of more than
DIRECT requests is split over tasks by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.shared import kept

#: Largest amount that a long holds.
MOST = (1 << 63) - 1
#: Requests of a period that one task admits one after the other; a larger period is admitted in blocks of BLOCK requests.
DIRECT, BLOCK = 1 << 18, 1 << 14


def micros(amount: Column, allow_zero: bool = False) -> Column:
    """A decimal amount in whole millionths, rounded up; null, negative, zero (unless allowed) and overflowing ones raise."""
    scaled = F.ceil(amount.cast("decimal(38,18)") * F.lit(1_000_000).cast("decimal(7,0)"))
    bad = amount.isNull() | (amount < 0) | ((amount == 0) & F.lit(not allow_zero)) | (scaled > F.lit(MOST))
    return F.when(bad, F.raise_error(F.lit("not a valid amount"))).otherwise(scaled.cast("long"))


def from_micros(amount: Column) -> Column:
    return (amount.cast("decimal(19,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(25,6)")


def utc(ts: Column) -> Column:
    """A timestamp's wall clock in UTC, whatever the session's time zone; dates and timestamps without a zone are UTC as they are."""
    return F.when(F.typeof(ts) == "timestamp", F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")).otherwise(ts.cast("timestamp_ntz"))


def period(ts: Column) -> Column:
    """UTC month."""
    return F.date_format(utc(ts), "yyyy-MM")


def iso_timestamp(ts: Column) -> Column:
    """UTC in ISO form with a zone of +00:00; the fraction, of six digits, only where there is one."""
    at = utc(ts)
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def totals(reservations: DataFrame, by: list[str]) -> DataFrame:
    """spent (settled and breached actuals) and active (reserved) of each period."""
    return reservations.groupBy(*by).agg(
        F.sum(F.when(F.col("status").isin("settled", "breached"), F.col("actual_micros")).otherwise(0)).alias("spent_micros"),
        F.sum(F.when(F.col("status") == "active", F.col("reserved_micros")).otherwise(0)).alias("active_micros"),
    )


def balances(reservations: DataFrame, limits: DataFrame, configured: int | None = None) -> DataFrame:
    """period, limit, spent, active and what is available; a period without reservations has all of its limit. configured: the limit that is set
    now; a period that holds another one raises when the result is computed."""
    if configured is not None:
        differs = F.raise_error(F.concat(F.lit("the limit of a period is not the configured one: "), F.col("period"))).cast("long")
        limits = limits.withColumn("limit_micros", F.when(F.col("limit_micros") == configured, F.col("limit_micros")).otherwise(differs))
    out = limits.join(totals(reservations, ["period"]), "period", "left")
    spent, active = F.coalesce("spent_micros", F.lit(0)), F.coalesce("active_micros", F.lit(0))
    return out.select("period", "limit_micros", spent.alias("spent_micros"), active.alias("active_micros"), (F.col("limit_micros") - spent - active).alias("available_micros"))


def period_policies(requests: DataFrame) -> DataFrame:
    """The first request of a period fixes its limit; requests with another one are counted."""
    first = requests.groupBy("period").agg(F.min_by("limit_micros", "seq").alias("limit_micros"))
    return requests.select("period", F.col("limit_micros").alias("asked")).join(first, "period").groupBy("period", "limit_micros").agg(F.count_if(F.col("asked") != F.col("limit_micros")).alias("mismatches"))


def _fold(df: DataFrame, columns: list[str], order: list[str], added: str, start, step) -> DataFrame:
    """Rows with what step(state, row) returns; state = start() at each new first column. Sorted partitions stream by."""
    names = [c.split()[0] for c in added.split(",")]
    schema = T.StructType([*df.select(*columns).schema.fields, *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, key, state = to_arrow_schema(schema), object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[columns[0]] != key:
                    key, state = row[columns[0]], start()
                out.append(step(state, row))
            made = [pa.array([o[k] for o in out], kinds.field(n).type) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(kinds.field(c).type) for k, c in enumerate(columns)), *made], schema=kinds)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*columns).repartition(n, columns[0]).sortWithinPartitions(columns[0], *order).mapInArrow(run, schema)


def admit(requests: DataFrame, limit: int) -> DataFrame:
    """period, seq, amount, accepted, held: in order, a request is accepted if what is held and it stay within the limit; equality is allowed."""
    slim = requests.select("period", "seq", "amount")
    large = kept(slim.groupBy("period").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("amount") < 0, F.lit(True))).alias("odd")).where((F.col("n") > DIRECT) & (F.col("odd") == 0)).select("period"))
    if large.isEmpty():
        return admit_in_order(slim, limit)
    return admit_in_order(slim.join(large, "period", "left_anti"), limit).unionByName(admit_in_blocks(slim.join(large, "period", "left_semi"), limit))


def admit_in_order(requests: DataFrame, limit: int) -> DataFrame:
    """admit() by one task a period."""

    def step(state: dict, row: dict) -> tuple:
        fits = state["held"] + row["amount"] <= limit
        state["held"] += row["amount"] * fits
        return fits, state["held"]

    return _fold(requests, ["period", "seq", "amount"], ["seq"], "accepted boolean, held long", lambda: {"held": 0}, step)


def admit_in_blocks(requests: DataFrame, limit: int, block: int | None = None) -> DataFrame:
    """admit() of amounts that are not negative, with a period's requests split over all tasks.

    Requests are sorted into blocks. Room only shrinks, so what is larger than the room is refused wherever it stands; of the rest, all blocks
    before the one in which the sum passes the room are accepted by their sums alone, that one is folded request by request, and the next round
    starts behind it with the room that it left. The room has then fallen below a request that fitted before, so few rounds are left,
    and none reads what is decided. Rounds end in intervals of places, each with the largest amount that it accepts: verdicts
    are a join with these, and what is held at each request is a sum over blocks and one within its block.
    """
    spark = requests.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = block or BLOCK
    ordered = requests.repartitionByRange(parts, "period", "seq").sortWithinPartitions("period", "seq", "amount")
    # The numbers grow with the order, and belong to what was written.
    rows = kept(ordered.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("block", F.expr(f"(at >> 33) * {(1 << 33) // size + 1} + (at & {(1 << 33) - 1}) div {size}"))
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    state = requests.select("period").distinct().select("period", F.lit(-1).cast("long").alias("after"), F.lit(limit).cast("decimal(38,0)").alias("room"))
    intervals, singles = [], []
    before = Window.partitionBy("period").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        state = kept(state)
        live = rows.join(state, "period").where("at > after AND amount <= room")
        sums = live.groupBy("period", "block").agg(big("amount").alias("s"), F.min("at").alias("first"), F.max("at").alias("last"), F.first("room").alias("room"))
        upto = sums.withColumn("b", F.coalesce(F.sum("s").over(before), F.lit(0).cast("decimal(38,0)")))
        crossing = kept(upto.where("b + s > room").groupBy("period").agg(F.min_by(F.struct("block", "first", "last", "b", "room"), "block").alias("c")).select("period", "c.*"))
        # All that fits up to the crossing block, or to the period's end.
        intervals.append(state.join(crossing.select("period", "first"), "period", "left").select("period", "after", F.coalesce(F.col("first") - 1, F.lit(MOST)).alias("upto"), F.col("room").alias("most")))
        if crossing.isEmpty():
            break
        there = rows.join(crossing, ["period", "block"]).where("at >= first AND amount <= room").select("period", "at", "amount", F.col("b").cast("long").alias("b"), F.col("room").cast("long").alias("room"))

        def step(held: dict, row: dict) -> tuple:
            left = held.setdefault("left", row["room"] - row["b"])
            fits = row["amount"] <= left
            held["left"] -= row["amount"] * fits
            return fits, held["left"]

        folded = kept(_fold(there, ["period", "at", "amount", "b", "room"], ["at"], "fits boolean, left_over long", dict, step))
        singles.append(folded.where("fits").select("period", "at"))
        ends = folded.groupBy("period").agg(F.min("left_over").cast("decimal(38,0)").alias("room"))
        state = crossing.select("period", F.col("last").alias("after")).join(ends, "period")
    spans = intervals[0]
    for more in intervals[1:]:
        spans = spans.unionByName(more)
    spans = kept(spans.groupBy("period").agg(F.collect_list(F.struct("after", "upto", "most")).alias("spans")))
    inside = F.exists("spans", lambda s: (F.col("at") > s["after"]) & (F.col("at") <= s["upto"]) & (F.col("amount") <= s["most"]))
    judged = rows.join(spans, "period").select("period", "seq", "amount", "at", "block", inside.alias("accepted"))
    if singles:
        one = singles[0]
        for more in singles[1:]:
            one = one.unionByName(more)
        judged = judged.join(one.withColumn("single", F.lit(True)), ["period", "at"], "left").withColumn("accepted", F.col("accepted") | F.coalesce("single", F.lit(False))).drop("single")
    judged = kept(judged)
    took = F.when(F.col("accepted"), F.col("amount")).otherwise(F.lit(0))
    held = judged.groupBy("period", "block").agg(F.sum(took).alias("s")).select("period", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("b"))
    within = Window.partitionBy("period", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return judged.withColumn("w", F.sum(took).over(within)).join(held, ["period", "block"]).select("period", "seq", "amount", "accepted", (F.col("b") + F.col("w")).alias("held"))


def reserve(state: dict, row: dict, limit: int) -> str:
    """Outcome of one reservation, and what it does to a period's state.

    A known key: conflict where its identity or period differs, then policy (another limit than the period's), then conflict where it is
    terminal, else existing. A new key: policy, locked after a breach, exceeded, else accepted; the first that is accepted fixes the limit.
    """
    key, amount, entry = row["key"], row["amount"], state["known"].get(row["key"])
    asked = row.get("limit_micros")
    asked = limit if asked is None else asked
    identity = (amount, row.get("identity"))
    if row.get("foreign") or (entry and entry["identity"] != identity):
        return "conflict"
    if state["limit"] is not None and state["limit"] != asked:
        return "policy"
    if entry:
        return "existing" if entry["status"] == "active" else "conflict"
    if state["locked"]:
        return "locked"
    if state["spent"] + state["active"] + amount > asked:
        return "exceeded"
    state["limit"] = asked
    state["known"][key] = {"status": "active", "identity": identity, "actual": None}
    state["active"] += amount
    return "accepted"


def cancel(state: dict, key: str) -> str:
    entry = state["known"].get(key)
    if not entry:
        return "unknown"
    outcome = {"active": "cancelled", "cancelled": "existing"}.get(entry["status"], "conflict")
    if outcome == "cancelled":
        entry["status"] = "cancelled"
        state["active"] -= entry["identity"][0]
    return outcome


def settle(state: dict, key: str, actual: int) -> str:
    entry = state["known"].get(key)
    if not entry:
        return "unknown"
    if entry["status"] == "active":
        held = entry["identity"][0]
        entry["status"], entry["actual"] = ("breached" if actual > held else "settled"), actual
        state["active"] -= held
        state["spent"] += actual
        state["locked"] |= actual > held
        return entry["status"]
    same = entry["actual"] == actual
    return {"settled": "existing", "breached": "invariant"}.get(entry["status"], "conflict") if same else "conflict"


def opened() -> dict:
    """A period's state before its first event."""
    return {"known": {}, "active": 0, "spent": 0, "locked": False, "limit": None}


#: What event() adds to a row.
EVENT = "outcome string, active_micros long, spent_micros long"


def event(state: dict, row: dict, limit: int) -> tuple:
    """One event (op: reserve, settle or cancel) on a period's state."""
    if row["op"] == "reserve":
        outcome = reserve(state, row, limit)
    else:
        outcome = cancel(state, row["key"]) if row["op"] == "cancel" else settle(state, row["key"], row["amount"])
    return outcome, state["active"], state["spent"]


def across_periods(events: DataFrame, fold, accepted: str) -> DataFrame:
    """fold(events with column foreign) where a key belongs to the period that first accepted it: in others it is foreign from then on.

    Keys of one period, as nearly all are, need no second look. For the others owners are a written table, and in each round only those periods are
    folded again in which an event becomes foreign, or ceases to be, by the owners that the last round gave; each round settles at least
    the earliest event that was wrong. Nothing of this comes to the driver.
    """
    shared = events.where("op = 'reserve'").groupBy("key").agg(F.count_distinct("period").alias("n")).where("n > 1").select("key")
    out = fold(events.withColumn("foreign", F.lit(False)))
    if shared.isEmpty():
        return out
    events, shared, out = kept(events), kept(shared), kept(out)
    mine, marks = events.join(shared, "key", "left_semi"), None
    while True:
        owner = out.where(F.col("outcome").isin(*accepted.split())).join(shared, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct("period", "seq"), "seq").alias("owner"))
        foreign = (F.col("owner.period") != F.col("period")) & (F.col("seq") > F.col("owner.seq"))
        now = kept(mine.join(owner, "key").where(foreign).select("period", "seq", "key").distinct())
        changed = now if marks is None else now.exceptAll(marks).union(marks.exceptAll(now))
        periods = kept(changed.select("period").distinct())
        if periods.isEmpty():
            return out
        marks = now
        some = events.join(periods, "period", "left_semi").join(marks.withColumn("marked", F.lit(True)), ["period", "seq", "key"], "left")
        again = fold(some.withColumn("foreign", F.coalesce("marked", F.lit(False))).drop("marked"))
        out = kept(out.join(periods, "period", "left_anti").unionByName(again))


def _unlimited(events: DataFrame, limit: int, actual: Column) -> tuple[bool, bool]:
    """Whether no period can come to its limit, whatever the order of its events, and whether any period can be breached. A key is held once at most
    in a period, so the largest amounts of its keys bound what it holds. actual: what an event may settle with, else null."""
    asked = F.coalesce(F.col("limit_micros"), F.lit(limit)) if "limit_micros" in events.columns else F.lit(limit)
    asks, amount = F.col("op") == "reserve", F.col("amount")
    keys = events.groupBy("period", "key").agg(
        F.max(F.when(asks, amount)).alias("most"), F.min(F.when(asks, amount)).alias("least"), F.count_if(asks & amount.isNull()).alias("odd"),
        F.max(actual).alias("actual"), F.min(F.when(asks, asked)).alias("low"), F.max(F.when(asks, asked)).alias("high"),
    )
    periods = keys.groupBy("period").agg(
        F.sum(F.col("most").cast("decimal(38,0)")).alias("most"), F.min("least").alias("least"), F.sum("odd").alias("odd"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.bool_or(F.col("actual") > F.col("least")).alias("breach"),
    )
    tight = (F.col("most") > F.col("low")) | (F.col("low") != F.col("high")) | (F.col("least") < 0) | (F.col("odd") > 0)
    found = periods.agg(F.coalesce(F.bool_or(tight), F.lit(False)).alias("tight"), F.coalesce(F.bool_or("breach"), F.lit(False)).alias("breach")).first()
    return not found["tight"], found["breach"]


def _by_key(events: DataFrame, added: str, step) -> DataFrame:
    """Events with what step(state, row) returns, where no period comes to its limit: keys are folded apart from each other, over all periods, and
    the last two of what it returns, sums of a period, are changes. A key belongs to the period that accepts it; events with late come after their
    period's breach. One key's record is held."""

    def one(held: dict, row: dict) -> tuple:
        owned = bool(held) and bool(held["state"]["known"])
        if not owned or row["period"] == held["period"]:
            if not owned:
                held["state"], held["period"] = opened(), row["period"]
            state, row["foreign"] = held["state"], False
        else:
            state, row["foreign"] = opened(), True
        state["locked"] = row["late"]
        active, spent = state["active"], state["spent"]
        found = step(state, row)
        return (*found[:-2], state["active"] - active, state["spent"] - spent)

    # A null key is one of its period only.
    keyed = events.withColumn("_key", F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.concat(F.lit("p"), "period"), F.lit("")))
    return _fold(keyed, ["_key", *events.columns], ["seq"], added, dict, one).drop("_key")


def apart(events: DataFrame, limit: int, added: str, step, actual: Column, breached: Column) -> DataFrame | None:
    """Events with the outcomes of step(), keys apart from each other, or None where a period could come to its limit: then they hang on each other.

    A breach refuses what is new in its period from then on. Where there can be any, folds are repeated with the first breach of each period in the
    last one, until these stay the same; each round settles at least the earliest one that was wrong."""
    free, breach = _unlimited(events, limit, actual)
    if not free:
        return None
    if not breach:
        return _by_key(events.withColumn("late", F.lit(False)), added, step).drop("late")
    events, locks = kept(events), None
    while True:
        if locks is None:
            late = events.withColumn("late", F.lit(False))
        else:
            late = events.join(F.broadcast(locks.withColumnRenamed("period", "_period")), F.col("period").eqNullSafe(F.col("_period")), "left").withColumn("late", F.coalesce(F.col("seq") > F.col("breach"), F.lit(False))).select(*events.columns, "late")
        out = kept(_by_key(late, added, step).drop("late"))
        now = kept(out.where(breached).groupBy("period").agg(F.min("seq").alias("breach")))
        if now.isEmpty() if locks is None else now.exceptAll(locks).union(locks.exceptAll(now)).isEmpty():
            return out
        locks = now


def with_totals(changed: DataFrame) -> DataFrame:
    """Rows (period, seq) whose active_micros and spent_micros are changes, with the sums up to each row; a large period is split into blocks."""
    n = int(changed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The numbers grow with the order, and belong to what was written.
    rows = kept(changed.repartitionByRange(n, "period", "seq").sortWithinPartitions("period", "seq").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_block", F.expr(f"(_at >> 33) * {(1 << 33) // BLOCK + 1} + (_at & {(1 << 33) - 1}) div {BLOCK}"))
    names = ["active_micros", "spent_micros"]
    before = Window.partitionBy("period").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("period", "_block").agg(*(F.sum(c).alias(c) for c in names))
    sums = sums.select(F.col("period").alias("_period"), F.col("_block").alias("_of"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in names))
    within = Window.partitionBy("period", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({c: F.sum(c).over(within) for c in names})
    out = out.join(sums, (F.col("_block") == F.col("_of")) & F.col("period").eqNullSafe(F.col("_period")))
    return out.select(*(F.col(c) + F.col(f"_{c}") if c in names else F.col(c) for c in changed.columns)).toDF(*changed.columns)


def slim_events(events: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """What event() reads of events."""
    given = F.to_json(F.struct(*identity)) if identity else F.lit(None).cast("string")
    asked = F.col("limit_micros").cast("long") if "limit_micros" in events.columns else F.lit(None).cast("long")
    return events.select("period", "seq", "op", "key", "amount", given.alias("identity"), asked.alias("limit_micros"))


def replay(events: DataFrame, limit: int, identity: list[str] | None = None, totals: bool = True) -> DataFrame:
    """Outcome of each event (period, seq, op, key, amount) under the ledger's rules; op: reserve, settle or cancel.

    reserve: accepted, existing, conflict, policy, locked or exceeded (see reserve()). settle: settled, breached, existing, conflict,
    invariant (a breach repeated) or unknown. cancel: cancelled, existing, conflict or unknown. identity: further columns that a key is
    bound to, such as provider, model and task; a column limit_micros, if there, is the limit that an event was made under. A key is one
    reservation over all periods: seq orders the events of all. Where no period can come to its limit, keys are folded apart from each other. Else
    periods are, in order, and one small record a reservation of the period is held. totals: with active_micros and spent_micros.
    """
    slim = slim_events(events, identity)
    names = [c for c in slim.columns if c not in ("identity", "limit_micros")]
    shown = [*names, *(c.split()[0] for c in EVENT.split(",") if totals or "_micros" not in c)]
    found = apart(slim, limit, EVENT, lambda state, row: event(state, row, limit), F.when(F.col("op") == "settle", F.col("amount")), F.col("outcome") == "breached")
    if found is not None:
        return (with_totals(found) if totals else found).select(*shown)

    def fold(rows: DataFrame) -> DataFrame:
        return _fold(rows, ["period", "seq", "op", "key", "amount", "identity", "limit_micros", "foreign"], ["seq"], EVENT, opened, lambda state, row: event(state, row, limit))

    return across_periods(slim, fold, "accepted").select(*shown)


def settle_status(reserved: Column, actual: Column) -> Column:
    """A larger actual is a breach, recorded all the same; zero is allowed."""
    return F.when(actual > reserved, "breached").otherwise("settled")


def locked_periods(reservations: DataFrame) -> DataFrame:
    return reservations.where("status = 'breached'").select("period").distinct()


def key_conflicts(requests: DataFrame, identity: list[str]) -> DataFrame:
    """Later requests of a key that differ from its first one (the period is part of a request's identity)."""
    w = Window.partitionBy("key").orderBy("seq")
    first = requests.withColumn("first", F.first(F.struct(*identity)).over(w)).withColumn("rank", F.row_number().over(w))
    return first.where("rank > 1").select("key", "seq", F.when(F.struct(*identity).eqNullSafe(F.col("first")), "existing").otherwise("conflict").alias("outcome"))


def terminal_changes(history: DataFrame) -> DataFrame:
    """Audit of an append-only history (key, seq, status): steps away from a terminal status."""
    before = F.lag("status").over(Window.partitionBy("key").orderBy("seq"))
    return history.withColumn("before", before).where("before IN ('settled', 'cancelled', 'breached') AND status <> before").select("key", "seq", "before", "status")


def misshapen(reservations: DataFrame) -> DataFrame:
    """Audit: statuses whose columns do not fit them."""
    s = F.col("status")
    ok = F.when(s == "active", F.col("actual_micros").isNull() & F.col("closed_at").isNull()).when(s == "settled", (F.col("actual_micros") <= F.col("reserved_micros")) & F.col("closed_at").isNotNull())
    ok = ok.when(s == "breached", (F.col("actual_micros") > F.col("reserved_micros")) & F.col("closed_at").isNotNull()).when(s == "cancelled", F.col("actual_micros").isNull() & F.col("closed_at").isNotNull())
    return reservations.where(~F.coalesce(ok, F.lit(False)))
