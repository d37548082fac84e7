"""Sliding-log rate limit: at most ``limit`` admitted requests of a client in ``window_s`` seconds. Rejected requests aren't recorded; one exactly that old still counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import fixed as fx


def admissions(requests: DataFrame, limit: int = fx.RATE_LIMIT, window_s: int = fx.RATE_WINDOW_S) -> DataFrame:
    """query_id, client, t, admitted for a batch of (query_id, client, t in seconds); equal times go by query_id.

    Requests stream through a task in order of client and time, sorted by Spark, so memory holds one log of admitted times, however many a client sends.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, current = deque(), object()
        for frame in frames:
            flags = []
            for client, t in zip(frame["client"], frame["t"], strict=True):
                if client != current:
                    log, current = deque(), client
                while log and log[0] < t - window_s:
                    log.popleft()
                flags.append(len(log) < limit)
                if flags[-1]:
                    log.append(t)
            yield frame.assign(admitted=flags)

    known = requests.where("client is not null and t is not null").select("query_id", "client", F.col("t").cast("double").alias("t"))
    ordered = known.repartition("client").sortWithinPartitions("client", "t", "query_id")
    types = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInPandas(run, f"query_id {types['query_id']}, client {types['client']}, t double, admitted boolean")


def limited(requests: DataFrame, limit: int = fx.RATE_LIMIT, window_s: int = fx.RATE_WINDOW_S) -> DataFrame:
    """client, n_requests, n_admitted for a batch of (client, t in seconds)."""
    flags = admissions(requests.select(F.lit(0).alias("query_id"), "client", "t"), limit, window_s)
    return flags.groupBy("client").agg(F.count("*").alias("n_requests"), F.count_if("admitted").alias("n_admitted"))


def limited_stream(requests: DataFrame, limit: int = fx.RATE_LIMIT, window_s: int = fx.RATE_WINDOW_S, expire: bool = False) -> DataFrame:
    """client, t, admitted, and query_id where there is one, for a stream of (client, t): the state of a client is its log of admitted requests.

    A request without a client or time isn't limited and has no row. Within a micro-batch requests go by time and id; one that comes after later ones is judged against the
    log as it stands. With ``expire`` the log of a client that asks nothing for two windows goes; such a stream runs a batch for each timeout and so is never idle.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    own = ["query_id"] if "query_id" in kinds else []

    def admit(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t", *own], kind="stable")
        admitted = []
        for t in rows["t"].tolist():
            log = [x for x in log if x >= t - window_s]
            admitted.append(len(log) < limit)
            if admitted[-1]:
                log.append(t)
        state.update((log,))
        if expire:
            state.setTimeoutDuration(2000 * window_s)
        yield rows[["client", "t", *own]].assign(admitted=admitted)[["client", "t", "admitted", *own]]

    known = requests.where("client is not null and t is not null").select("client", F.col("t").cast("double").alias("t"), *own)
    schema = f"client {kinds['client']}, t double, admitted boolean" + "".join(f", {c} {kinds[c]}" for c in own)
    return known.groupBy("client").applyInPandasWithState(admit, schema, "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


class _EventTimeLog(StatefulProcessor):
    """Of a client: requests that wait for the watermark, and the times of those admitted."""

    def __init__(self, limit: int, window_s: int, id_type: str | None):
        self.limit, self.window_s, self.id_type = limit, window_s, id_type

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t double, query_id {self.id_type or 'string'}")
        self.log = handle.getListState("log", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, times = [], set()
        for frame in rows:
            new += zip(frame["t"].tolist(), frame["query_id"].tolist() if self.id_type else [None] * len(frame), strict=True)
            times.update(frame["t"].tolist())
        if new:
            self.waiting.appendList(new)
        for t in times:
            self.handle.registerTimer(int(t * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All of a client's requests up to the timer's moment: no earlier one can come any more."""
        upto = (expiredTimerInfo.getExpiryTimeInMs() - 1) / 1000
        rows = sorted(((t, q) for t, q in self.waiting.get()), key=lambda r: (r[0], *((r[1],) if self.id_type else ())))
        due = [r for r in rows if int(r[0] * 1000) / 1000 <= upto]
        if not due:
            return
        rest = rows[len(due) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        log = [r[0] for r in self.log.get()]
        kept, out = deque(log), []
        for t, query in due:
            while kept and kept[0] < t - self.window_s:
                kept.popleft()
            out.append((key[0], t, len(kept) < self.limit, query))
            if out[-1][2]:
                kept.append(t)
        self.log.put([(t,) for t in kept]) if kept else self.log.clear()
        yield pd.DataFrame(out, columns=["client", "t", "admitted", "query_id"])

    def close(self) -> None:
        pass


def limited_in_event_time(requests: DataFrame, late: str = "1 minute", limit: int = fx.RATE_LIMIT, window_s: int = fx.RATE_WINDOW_S) -> DataFrame:
    """client, t, admitted, and query_id where there is one, for a stream of (client, t) whose rows may be out of order by ``late``: each is judged once the watermark has passed it, by time and id, as ``admissions``
    judges a table of them.

    State is kept in lists (requests that wait; times admitted within the window), timers of event time wake a client when something of it is due. What comes later than the watermark is dropped
    by it; a request without a client or time isn't limited and has no row. Times count in whole milliseconds as to when they are due. The session needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    own = ["query_id"] if "query_id" in kinds else []
    known = requests.where("client is not null and t is not null").select("client", F.col("t").cast("double").alias("t"), *own).withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("at", late)
    out = known.groupBy("client").transformWithStateInPandas(_EventTimeLog(limit, window_s, kinds.get("query_id")), f"client {kinds['client']}, t double, admitted boolean, query_id {kinds.get('query_id', 'string')}", "append", "EventTime")
    return out.select("client", "t", "admitted", *own)
