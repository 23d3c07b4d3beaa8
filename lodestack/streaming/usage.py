"""Streaming forms of the usage rules, and batching event sinks."""

from __future__ import annotations

import hmac
import json
import logging
import math
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import formula_safe

logger = logging.getLogger(__name__)


class LoggedEvents(StatefulProcessor):
    """Per person: an event is logged unless it repeats the last logged one within the window."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double, key string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t, last = self.last.get() if self.last.exists() else (None, None)
        kept = []
        batch = pd.concat(list(rows)).sort_values(["t", "event_id"], kind="stable")
        for at, event, what in zip(batch["t"], batch["event_id"], batch["key"]):
            if t is None or what != last or at - t >= self.seconds:
                t, last = float(at), what
                kept.append(event)
        if kept:
            self.last.update((t, last))
            yield pd.DataFrame({"user_id": [key[0]] * len(kept), "event_id": kept})

    def close(self) -> None:
        pass


def logged(events: DataFrame, seconds: float = 10) -> DataFrame:
    """(user_id, event_id) of the events to log; events: user_id, event_id, t (seconds), key. Needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(LoggedEvents(seconds), outputStructType="user_id long, event_id long", outputMode="append", timeMode="None")


#: State of a rule between events: times in seconds, and the last key.
Past = tuple[list[float], str | None]


class Limit:
    """At most ``limit`` allowed events in any window; denied ones do not count, and an allowed one expires exactly ``seconds`` later."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def accept(self, past: Past, t: float, key: str) -> tuple[bool, Past]:
        recent = [x for x in past[0] if x > t - self.seconds]
        allowed = len(recent) < self.limit
        return allowed, (recent + [t] if allowed else recent, None)


class NotAgain:
    """An event is accepted unless it has the key of the last accepted one less than ``seconds`` before."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def accept(self, past: Past, t: float, key: str) -> tuple[bool, Past]:
        if past[0] and key == past[1] and t - past[0][-1] < self.seconds:
            return False, past
        return True, ([t], key)


class InOrder(StatefulProcessor):
    """Applies a rule to each key's events in the order of time and id, whatever order they arrive in.

    Events wait in a list until the watermark has passed them; a timer at the earliest one wakes the key. What the rule
    remembers ends ``rule.seconds`` after the last accepted event, by a timer too, so a key that falls silent has no
    state at all. A key holds its events of one watermark delay, and what the rule remembers.
    """

    def __init__(self, rule: Limit | NotAgain, output: list[str]):
        self.rule, self.output = rule, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, event_id long, key string")
        self.past = handle.getValueState("past", "times array<double>, key string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        self.waiting.appendList(list(zip(batch["t"].astype(float), batch["event_id"].astype(int), batch["key"].where(batch["key"].notna(), None))))
        self.handle.registerTimer(_millis(batch["t"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted(((t, i, k) for t, i, k in held if _millis(t) <= now), key=lambda e: e[:2])
        rest = [e for e in held if _millis(e[0]) > now]
        past: Past = ([], None)
        if self.past.exists():
            times, last = self.past.get()
            past = list(times), last
        kept = []
        for t, event, what in due:
            good, past = self.rule.accept(past, t, what)
            if good:
                kept.append(event)
        if rest:
            self.waiting.put([tuple(e) for e in rest])
            self.handle.registerTimer(_millis(min(e[0] for e in rest)))
        elif held:
            self.waiting.clear()
        if past[0] and _millis(past[0][-1] + self.rule.seconds) > now:
            self.past.update(past)
            self.handle.registerTimer(_millis(past[0][-1] + self.rule.seconds))
        elif self.past.exists():
            self.past.clear()
        if kept:
            yield pd.DataFrame({self.output[0]: [key[0]] * len(kept), self.output[1]: kept})

    def close(self) -> None:
        pass


def _millis(seconds: float) -> int:
    """A timer that has not fired before the time has passed."""
    return math.ceil(float(seconds) * 1000)


def _in_order(events: DataFrame, user: str, at: str, event_id: str, key: Column, rule: Limit | NotAgain, delay: str) -> DataFrame:
    kinds = dict(events.dtypes)
    seen = events.withWatermark(at, delay).select(F.col(user), F.col(at), F.col(at).cast("double").alias("t"), F.col(event_id).cast("long").alias("event_id"), key.cast("string").alias("key"))
    schema = f"{user} {kinds[user]}, {event_id} long"
    return seen.groupBy(user).transformWithStateInPandas(InOrder(rule, [user, event_id]), outputStructType=schema, outputMode="append", timeMode="EventTime")


def rate_limited(events: DataFrame, user: str, at: str, event_id: str, limit: int, seconds: float, delay: str = "1 minute") -> DataFrame:
    """(user, event_id) of the allowed events of a stream: operators.usage.rate_limited, for events at most ``delay`` late.

    at is a timestamp. An event comes out when the watermark has passed it. Needs the RocksDB state store.
    """
    return _in_order(events, user, at, event_id, F.lit(None), Limit(limit, seconds), delay)


def new_reports(reports: DataFrame, known: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """(file_type, id) of the reports of a stream to store: operators.usage.new_reports, for reports at most ``delay`` late.

    reports: id, document_id, type, created_at. known is a table of documents, read anew for each micro-batch. State of
    a file and type ends ``hours`` after its last stored report.
    """
    timed = reports.join(known.select("document_id").distinct(), "document_id", "left_semi").withColumn("file_type", F.concat_ws("|", "document_id", "type"))
    return _in_order(timed, "file_type", "created_at", "id", F.lit("x"), NotAgain(hours * 3600), delay)


def post_json(url: str, body: bytes) -> None:
    urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=10).close()


def deliver(rows: Iterator, send: Callable[[bytes], None], size: int = 50, attempts: int = 3, sleep: Callable[[float], object] = time.sleep, secret: str = "") -> tuple[int, int]:
    """(sent, dropped): rows in batches of ``size``; a batch that fails every attempt is dropped, nothing is raised. A secret goes with each batch."""
    sent = dropped = 0
    batch: list[dict] = []

    def flush() -> None:
        nonlocal sent, dropped, batch
        for k in range(attempts):
            try:
                send(json.dumps({"events": batch, **({"secret": secret} if secret else {})}, default=str, sort_keys=True).encode())
                sent += len(batch)
                break
            except OSError:
                if k < attempts - 1:
                    sleep(2**k)
        else:
            dropped += len(batch)
        batch = []

    for row in rows:
        batch.append(row if isinstance(row, dict) else row.asDict(recursive=True))
        if len(batch) == size:
            flush()
    if batch:
        flush()
    return sent, dropped


def webhook(events: DataFrame, url: str, checkpoint: str, send: Callable[[str, bytes], None] = post_json) -> DataStreamWriter:
    """A stream writer that posts events every ten seconds, each partition in batches of fifty."""

    def batch(df: DataFrame, _: int) -> None:
        df.foreachPartition(lambda rows: deliver(rows, lambda body: send(url, body)))

    return events.writeStream.foreachBatch(batch).trigger(processingTime="10 seconds").option("checkpointLocation", checkpoint)


class EventSink(Protocol):
    """Where usage events go. Sending never raises."""

    def send(self, event: dict, urgent: bool = False) -> None: ...

    def flush(self) -> None: ...

    def close(self) -> None: ...


class NullSink:
    def send(self, event: dict, urgent: bool = False) -> None:
        pass

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass


class BufferedSink:
    """Events of one process: up to ``most`` are held, and further ones dropped while it is full. They are posted when
    ``flush_at`` are held, ``seconds`` after the last post, or at once for an urgent one."""

    def __init__(self, post: Callable[[bytes], None], most: int = 1000, flush_at: int = 50, seconds: float = 10, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.post, self.most, self.flush_at, self.seconds, self.clock, self.sleep = post, most, flush_at, seconds, clock, sleep
        self.held: list[dict] = []
        self.last, self.sent, self.dropped = clock(), 0, 0

    def send(self, event: dict, urgent: bool = False) -> None:
        if len(self.held) >= self.most:
            self.dropped += 1
        else:
            self.held.append(event)
        if urgent or len(self.held) >= self.flush_at or self.clock() - self.last >= self.seconds:
            self.flush()

    def flush(self) -> None:
        rows, self.held, self.last = self.held, [], self.clock()
        sent, dropped = deliver(rows, self.post, sleep=self.sleep)
        self.sent, self.dropped = self.sent + sent, self.dropped + dropped

    def close(self) -> None:
        self.flush()


class BackgroundSink:
    """Events that a thread of its own posts: ``send`` only queues and never waits for the receiver.

    The sender wakes when ``flush_at`` events are held, for an urgent one, and ``seconds`` after it last slept; it posts
    in batches of ``flush_at``. Up to ``most`` events are held, and further ones dropped. close() sends what is left.
    """

    def __init__(self, post: Callable[[bytes], None], most: int = 1000, flush_at: int = 50, seconds: float = 10, secret: str = ""):
        self.post, self.most, self.flush_at, self.seconds, self.secret = post, most, flush_at, seconds, secret
        self.held: list[dict] = []
        self.sent = self.dropped = 0
        self._lock, self._posting = threading.Lock(), threading.Lock()
        self._wake, self._stop = threading.Event(), threading.Event()
        self._sender = threading.Thread(target=self._run, name="event-sink", daemon=True)
        self._sender.start()

    def send(self, event: dict, urgent: bool = False) -> None:
        with self._lock:
            if len(self.held) >= self.most:
                self.dropped += 1
                return
            self.held.append(event)
            full = len(self.held) >= self.flush_at
        if urgent or full:
            self._wake.set()

    def flush(self) -> None:
        """Post all that is held now, in the caller's thread."""
        with self._posting:
            while True:
                with self._lock:
                    batch, self.held = self.held[: self.flush_at], self.held[self.flush_at :]
                if not batch:
                    return
                # between attempts the sender sleeps until it is stopped
                sent, dropped = deliver(batch, self.post, self.flush_at, sleep=self._stop.wait, secret=self.secret)
                with self._lock:
                    self.sent, self.dropped = self.sent + sent, self.dropped + dropped

    def close(self, seconds: float = 20) -> None:
        self._stop.set()
        self._wake.set()
        self._sender.join(seconds)
        if not self._sender.is_alive():  # else it hangs in a post, and holds the right to post
            self.flush()

    def _run(self) -> None:
        while not self._stop.is_set():
            self._wake.wait(self.seconds)
            self._wake.clear()
            try:
                self.flush()
            except Exception:  # a post that fails in a way of its own must not end the sender
                logger.exception("events were lost")


def build_sink(url: str, secret: str = "") -> EventSink:
    return BackgroundSink(lambda body: post_json(url, body), secret=secret) if url else NullSink()


def received(tab: DataFrame, events: DataFrame, secret: str, given: str) -> DataFrame:
    """A tab of an event sheet with new events; columns that it lacks are added, and cells that a spreadsheet would run
    are guarded. A wrong secret raises."""
    if not secret or not hmac.compare_digest(secret, given):
        raise PermissionError("the shared secret is wrong")
    kinds = dict(events.dtypes)
    safe = events.select(*[formula_safe(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in events.columns])
    return tab.unionByName(safe, allowMissingColumns=True)
