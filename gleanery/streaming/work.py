"""Work over streams that keeps state by key and lets it go: versions of search results, a ledger of failures with expiry, and sessions with budgets.

Each has a batch form in DataFrame operations and a stream form that keeps the least state it needs, drops it by event-time timers, and gives the same rows. The stream forms need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``); ``stateful`` sets it where the session says nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How long an item that timed out is left alone, and the budgets of a background session.
RETRY_MINUTES, SESSION_ITEMS, SESSION_SECONDS = 10, 40, 420
#: Which kind of result gives way to which.
KINDS = {"lexical": 1, "hybrid": 2}
STORE = "spark.sql.streaming.stateStore.providerClass"


def stateful(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _kind(kind: Column) -> Column:
    out = F.lit(0)
    for name, rank in KINDS.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _millis(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ms]").astype("int64")


# Versions of search results


def current_results(results: DataFrame) -> DataFrame:
    """session, query, kind, payload: of each session's last query the hybrid results, or the lexical ones as long as there are no others.

    results: session, query (a number that grows), kind, at, payload. Of several results of one kind the first by time, then payload, counts. Rows without a session or query, or of another kind, are nobody's.
    """
    own = results.filter(F.col("session").isNotNull() & F.col("query").isNotNull()).withColumn("_k", _kind(F.col("kind"))).filter("_k > 0")
    merit = F.struct("query", "_k", (-_micros("at")).alias("_t"))
    best = own.groupBy("session").agg(F.max(merit).alias("_m"))
    met = own.join(best, "session").filter((F.col("query") == F.col("_m.query")) & (F.col("_k") == F.col("_m._k")) & (-_micros("at") == F.col("_m._t")))
    return met.groupBy("session", "query", "kind").agg(F.min("payload").alias("payload"))


class _Upgrades(StatefulProcessor):
    """A session's best result so far; what isn't better isn't published again."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "query long, kind int, at long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.best.get() if self.best.exists() else None
        best = (old[0], old[1], -old[2], old[3]) if old else None
        start = best
        for frame in rows:
            for query, kind, at, payload in zip(frame["query"], frame["kind"], _millis(frame["at"]), frame["payload"]):
                rank = KINDS.get(kind, 0)
                one = (int(query), rank, -int(at), payload)
                if rank and (best is None or one[:3] > best[:3] or (one[:3] == best[:3] and (one[3] or "") < (best[3] or ""))):
                    best = one
        if best is not None and best != start:
            self.best.update(best[:2] + (-best[2], best[3]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-best[2] + self.quiet)
            yield pd.DataFrame({"session": [key[0]], "query": [best[0]], "kind": [next(n for n, r in KINDS.items() if r == best[1])], "payload": [best[3]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def published_results(results: DataFrame, quiet_minutes: int = 10, late: str = "1 minute") -> DataFrame:
    """A stream of what to show: a row whenever a session's result gets better. A late lexical result never takes the place of a hybrid one, nor an older query that of a newer.

    The last row of a session equals current_results(), whatever the order of arrival. A session's state goes when the watermark is ``quiet_minutes`` past its last published result; older rows are late by then.
    """
    stateful(results.sparkSession)
    kind = dict(results.dtypes)["session"]
    own = results.filter("session is not null and query is not null").select("session", F.col("query").cast("long").alias("query"), "kind", "at", F.col("payload").cast("string").alias("payload")).withWatermark("at", late)
    return own.groupBy("session").transformWithStateInPandas(_Upgrades(quiet_minutes * 60_000), f"session {kind}, query long, kind string, payload string", "Append", "eventTime")


# A ledger of failures


def admitted(events: DataFrame, model: str, retry_minutes: int = RETRY_MINUTES) -> DataFrame:
    """id, item, at, admitted, reason of each attempt: an item that timed out is left alone for ``retry_minutes``, one that failed under this model until it succeeds or is cleared.

    events: id, item, at, kind (``attempt``, ``timeout``, ``failed``, ``done``, ``cleared``), model. An event bears on later attempts by (at, id). A failure under another model doesn't count. Nothing is written back: attempts are
    judged by the outcomes there are.
    """
    order = Window.partitionBy("item").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda what, when: F.last(F.when(when, what), ignorenulls=True).over(order)
    kind = F.col("kind")
    outcome = kind.isin("failed", "done", "cleared", "timeout")
    state = F.struct("kind", "model", "at")
    seen = events.withColumns({"_stamp": last(state, kind.isin("failed", "done", "cleared")), "_any": last(state, outcome)}).filter(kind == "attempt")
    stamped = F.coalesce((F.col("_stamp.kind") == "failed") & (F.col("_stamp.model") == model), F.lit(False))
    waiting = F.coalesce((F.col("_any.kind") == "timeout") & (_micros("at") - _micros("_any.at") < retry_minutes * 60_000_000), F.lit(False))
    reason = F.when(stamped, "failed").when(waiting, "timeout")
    return seen.select("id", "item", "at", reason.isNull().alias("admitted"), reason.alias("reason"))


class _Ledger(StatefulProcessor):
    def __init__(self, model: str, retry_ms: int):
        self.model, self.retry = model, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getValueState("failed", "model string")
        self.until = handle.getValueState("until", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        failed = self.failed.get()[0] if self.failed.exists() else None
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for number, at, micros, kind, model in zip(frame["id"], frame["at"], frame["at"].astype("datetime64[us]").astype("int64"), frame["kind"], frame["model"]):
            if kind == "attempt":
                reason = "failed" if failed == self.model else "timeout" if until is not None and micros < until else None
                out.append((number, key[0], at, reason is None, reason))
            elif kind == "timeout":
                until = int(micros) + self.retry * 1000
            elif kind in ("failed", "done", "cleared"):
                until, failed = None, model if kind == "failed" else None
        for state, value in ((self.failed, failed), (self.until, until)):
            if value is None:
                state.clear()
            else:
                state.update((value,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(until // 1000)
        if out:
            yield pd.DataFrame(out, columns=["id", "item", "at", "admitted", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def admitted_stream(events: DataFrame, model: str, retry_minutes: int = RETRY_MINUTES, late: str = "1 minute") -> DataFrame:
    """As admitted(), over a stream whose batches come in order of time. A time-out's state goes when its span is over; a failure's stays, as long as it holds."""
    stateful(events.sparkSession)
    kind = dict(events.dtypes)
    own = events.select("id", "item", "at", "kind", "model").withWatermark("at", late)
    return own.groupBy("item").transformWithStateInPandas(_Ledger(model, retry_minutes * 60_000), f"id {kind['id']}, item {kind['item']}, at timestamp, admitted boolean, reason string", "Append", "eventTime")


# Sessions with budgets


def _session(waiting: list[tuple], start: int, items: int, seconds: float) -> tuple[list[tuple], list[tuple]]:
    """What a session takes from the head of the queue, and what is left: it begins an item as long as both budgets last."""
    spent, n = 0.0, 0
    while n < len(waiting) and n < items and spent < seconds:
        spent += waiting[n][2]
        n += 1
    return [(start, i, *w[:2]) for i, w in enumerate(waiting[:n])], waiting[n:]


def _run(owner, rows: list[tuple], waiting: list[tuple], items: int, seconds: float) -> tuple[list[tuple], list[tuple]]:
    """(owner, session, position, id, at) of the items taken by the starts among ``rows`` (at, id, kind, seconds), and the items left."""
    out: list[tuple] = []
    at = 0
    for number, id_, kind, cost in rows:
        if kind == "item":
            waiting.append((id_, number, cost))
        elif kind == "start":
            taken, rest = _session(waiting[at : at + items], id_, items, seconds)
            out += [(owner, session, place, item, when) for session, place, item, when in taken]
            at += len(taken)
    return out, waiting[at:]


def sessions(events: DataFrame, items: int = SESSION_ITEMS, seconds: float = SESSION_SECONDS) -> DataFrame:
    """owner, session (the id of its start), position, id, queued_at: what each session works off, first come first served; what its budgets leave waits for the next one.

    events: id, owner, at, kind (``item`` or ``start``), seconds (an item's length; null: 0). An owner's events are sorted by (at, id) and pass through one task in Arrow batches, since each session depends on those before; only
    items that wait are held. ``items=1`` is the single step.
    """
    kinds = dict(events.dtypes)
    dealt = events.filter("owner is not null").select("owner", "at", "id", "kind", F.coalesce("seconds", F.lit(0.0)).cast("double").alias("seconds"))
    dealt = dealt.repartition("owner").sortWithinPartitions("owner", "at", "id")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, waiting = None, []
        for frame in frames:
            out: list[tuple] = []
            for name, own in frame.groupby("owner", sort=False):
                if name != owner:
                    owner, waiting = name, []
                found, waiting = _run(name, list(zip(own["at"], own["id"], own["kind"], own["seconds"])), waiting, items, seconds)
                out += found
            yield pd.DataFrame(out, columns=["owner", "session", "position", "id", "queued_at"])

    return dealt.mapInPandas(look, f"owner {kinds['owner']}, session {kinds['id']}, position int, id {kinds['id']}, queued_at {kinds['at']}")


class _Sessions(StatefulProcessor):
    def __init__(self, items: int, seconds: float):
        self.items, self.seconds = items, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "id long, at long, seconds double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        micros = frame["at"].astype("datetime64[us]").astype("int64")
        waiting = [(w[0], w[1], w[2]) for w in self.waiting.get()] if self.waiting.exists() else []
        found, waiting = _run(key[0], list(zip(micros.tolist(), frame["id"].tolist(), frame["kind"], frame["seconds"].tolist())), waiting, self.items, self.seconds)
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        if found:
            out = pd.DataFrame(found, columns=["owner", "session", "position", "id", "queued_at"])
            out["queued_at"] = [datetime.fromtimestamp(m / 1e6, timezone.utc).replace(tzinfo=None) for m in out["queued_at"]]
            yield out

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, items: int = SESSION_ITEMS, seconds: float = SESSION_SECONDS) -> DataFrame:
    """As sessions(), over a stream whose batches come in order of time; the state is what waits."""
    stateful(events.sparkSession)
    kind = dict(events.dtypes)["owner"]
    own = events.filter("owner is not null").select(F.col("id").cast("long").alias("id"), "owner", "at", "kind", F.coalesce("seconds", F.lit(0.0)).cast("double").alias("seconds"))
    return own.groupBy("owner").transformWithStateInPandas(_Sessions(items, seconds), f"owner {kind}, session long, position int, id long, queued_at timestamp", "Append", "none")
