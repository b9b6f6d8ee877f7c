"""Journal of paid calls: a keyed state machine, and its coherence with the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import digest, json_string
from . import ledger

#: Steps that a call may take.
STEPS = (("prepared", "dispatching"), ("dispatching", "completed"), ("dispatching", "not_sent"), ("dispatching", "uncertain"))
#: Status of the reservation that a call's status goes with.
HELD = {"prepared": ("active",), "dispatching": ("active",), "uncertain": ("active",), "completed": ("settled", "breached"), "not_sent": ("cancelled",)}
#: What becomes of a call and its reservation for each way an attempt ends.
OUTCOMES = {"response": ("completed", "settled"), "over_quote": ("completed", "breached"), "not_sent": ("not_sent", "cancelled"), "error": ("uncertain", "active"), "mismatch": ("uncertain", "active")}


def _pick(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def fold(attempts: DataFrame) -> DataFrame:
    """Final status of each key's call, its reservation's, and how many later attempts were refused. attempts: key, seq, outcome (null: it broke off while dispatching).

    The first attempt decides: a call in any state but prepared blocks a replay.
    """
    first = attempts.groupBy("key").agg(F.min_by("outcome", "seq").alias("outcome"), (F.count("*") - 1).alias("refused"))
    call = F.coalesce(_pick({k: v[0] for k, v in OUTCOMES.items()}, F.col("outcome")), F.lit("dispatching"))
    held = F.coalesce(_pick({k: v[1] for k, v in OUTCOMES.items()}, F.col("outcome")), F.lit("active"))
    return first.select("key", call.alias("call_status"), held.alias("reservation_status"), "refused")


def bad_steps(history: DataFrame) -> DataFrame:
    """Audit of a history (key, seq, status): steps that are not allowed; a call begins as prepared."""
    before = F.lag("status").over(Window.partitionBy("key").orderBy("seq"))
    step = F.concat_ws(">", F.coalesce("before", F.lit("")), "status")
    allowed = [">prepared", *(f"{a}>{b}" for a, b in STEPS)]
    return history.withColumn("before", before).where(~step.isin(allowed)).select("key", "seq", "before", "status")


#: What attempt() adds to a row.
ATTEMPT = "decision string, call_status string, reservation_status string, active_micros long, spent_micros long"


def attempt(state: dict, row: dict, limit: int) -> tuple:
    """One attempt at a paid call on a period's state: decision, the key's call_status and reservation_status, active and spent."""
    calls, key = state.setdefault("calls", {}), row["key"]
    decision = None
    if (row["quoted_provider"], row["quoted_model"]) != (row["provider"], row["model"]):
        decision = "quote"
    elif (held := ledger.reserve(state, row, limit)) not in ("accepted", "existing"):
        decision = held
    else:
        call = calls.setdefault(key, {"fingerprint": row["request_fingerprint"], "status": "prepared"})
        if call["fingerprint"] != row["request_fingerprint"]:
            decision = "contract"
        elif call["status"] != "prepared":
            decision = "replay"
    if decision is None:
        decision, call = "dispatched", calls[key]
        if row["outcome"] == "prepared":
            decision = "prepared"
        elif row["outcome"] is None:
            call["status"] = "dispatching"
        elif row["outcome"] == "response":
            ledger.settle(state, key, row["actual"])
            call["status"] = "completed"
        elif row["outcome"] == "not_sent":
            ledger.cancel(state, key)
            call["status"] = "not_sent"
        else:
            call["status"] = "uncertain"
    call, entry = calls.get(key), state["known"].get(key)
    return decision, call and call["status"], entry and entry["status"], state["active"], state["spent"]


def slim_attempts(attempts: DataFrame) -> DataFrame:
    """What attempt() reads of attempts."""
    return attempts.select("period", "seq", "key", "provider", "model", "quoted_provider", "quoted_model", "amount", F.to_json(F.struct("provider", "model", "task")).alias("identity"), "request_fingerprint", "outcome", "actual", F.lit("reserve").alias("op"))


def paid(attempts: DataFrame, limit: int, totals: bool = True) -> DataFrame:
    """The whole life of paid calls: each attempt, in the order of seq, is quoted, reserved, recorded, dispatched, settled and finished.

    attempts: period, seq, key, provider, model, task, quoted_provider, quoted_model, amount (the quote), request_fingerprint, outcome,
    actual. outcome: response (settled with actual, or breached where that is more than the quote), not_sent, error, mismatch, null (it
    broke off while dispatching) or prepared (it broke off before). Result columns: decision (quote, a refusal of the ledger, contract:
    the key is bound to another request, replay: its call is past prepared, or dispatched), call_status and reservation_status of the
    key after the attempt (null where none exists), active_micros and spent_micros of the period (totals).
    """

    slim = slim_attempts(attempts)
    shown = ["period", "seq", "key", *(c.split()[0] for c in ATTEMPT.split(",") if totals or "_micros" not in c)]
    breached = (F.col("decision") == "dispatched") & (F.col("reservation_status") == "breached")
    found = ledger.apart(slim, limit, ATTEMPT, lambda state, row: attempt(state, row, limit), F.when(F.col("outcome") == "response", F.col("actual")), breached)
    if found is not None:
        return (ledger.with_totals(found) if totals else found).select(*shown)

    def fold(rows: DataFrame) -> DataFrame:
        columns = [*slim.columns, "foreign"]
        out = ledger._fold(rows, columns, ["seq"], ATTEMPT, ledger.opened, lambda state, row: attempt(state, row, limit))
        kept = F.col("decision").isin("dispatched", "prepared", "contract", "replay")
        return out.withColumn("outcome", F.when(kept, "accepted").otherwise("refused"))

    found = ledger.across_periods(slim, fold, "accepted")
    return found.select(*shown)


def incoherent(calls: DataFrame, reservations: DataFrame) -> DataFrame:
    """Audit: calls without a reservation of the same key, provider and model (where both have that column), or whose reservation's status
    does not go with theirs."""
    same = [c for c in ("key", "provider", "model") if c in calls.columns and c in reservations.columns]
    held = reservations.select("reservation_id", *(F.col(c).alias(f"held_{c}") for c in same), F.col("status").alias("held_status"))
    goes, differs = F.lit(False), F.lit(False)
    for status, fits in HELD.items():
        goes |= (F.col("status") == status) & F.col("held_status").isin(*fits)
    for c in same:
        differs |= F.col(c) != F.col(f"held_{c}")
    why = F.when(F.col("held_status").isNull(), "missing").when(differs, "identity").when(~goes, "status")
    return calls.join(held, "reservation_id", "left").select("call_id", "reservation_id", "status", "held_status", why.alias("reason")).where("reason IS NOT NULL")


def unbound(inserted: DataFrame, reservations: DataFrame) -> DataFrame:
    """Audit of calls as they are inserted: those without an active reservation of the same id, key, provider and model."""
    active = reservations.where("status = 'active'").select("reservation_id", "key", "provider", "model")
    return inserted.join(active, ["reservation_id", "key", "provider", "model"], "left_anti")


def unsent_closings(closings: DataFrame, history: DataFrame) -> DataFrame:
    """Audit: reservations (reservation_id, seq, status) that became settled, cancelled or breached while their call, if they have one, was
    not dispatching. history: reservation_id, seq, status of calls, in one order with the closings."""
    both = history.select("reservation_id", "seq", F.lit(0).alias("side"), F.col("status").alias("call_status"), F.lit(None).cast("string").alias("status"))
    ends = closings.where(F.col("status").isin("settled", "cancelled", "breached")).select("reservation_id", "seq", F.lit(1).alias("side"), F.lit(None).cast("string").alias("call_status"), "status")
    before = F.last("call_status", True).over(Window.partitionBy("reservation_id").orderBy("seq", "side").rowsBetween(Window.unboundedPreceding, -1))
    seen = both.union(ends).withColumn("before", before)
    return seen.where("side = 1 AND before IS NOT NULL AND before <> 'dispatching'").select("reservation_id", "seq", "status", F.col("before").alias("call_status"))


def request_fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of canonical JSON whose strings keep their characters: quotes, backslashes and controls alone are escaped."""
    parts = []
    for k, v in sorted(fields.items()):
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), F.coalesce(plain_json(v), F.lit("null"))]
    return digest(F.concat(*parts, F.lit("}")))


def plain_json(text: Column) -> Column:
    """Escapes of controls, quotes and backslashes; letters beyond ASCII stay."""
    whole = F.concat(F.lit('"'), F.array_join(F.transform(F.split(text, ""), lambda c: F.when((c > "~") & (c != "\x7f"), c).when(c == "\x7f", c).otherwise(F.substring(json_string(c), F.lit(2), F.length(json_string(c)) - 2))), ""), F.lit('"'))
    return F.when(text.rlike(r'\A[^\x00-\x1f"\\]*\z'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(whole)


class AdapterRegistry:
    """Providers by their stripped, unique names. An adapter has name, quote(request) and execute(request)."""

    def __init__(self, adapters):
        self._by_name: dict[str, object] = {}
        for a in adapters:
            name = a.name.strip()
            if not name or name in self._by_name:
                raise ValueError(f"provider names must be unique and not blank: {name!r}")
            self._by_name[name] = a

    def __getitem__(self, name: str):
        return self._by_name[name.strip()]
