"""Stateful rules over usage events: repeats, rate limits, duplicate reports.

Each rule's anchor is the last *accepted* event, so lag() cannot express it: a person's events are read in order. Where a
pause is as long as the rule's window, nothing before it matters, so events are first cut into bursts by a window that
sorts and spills, and bursts are dealt to tasks; none is ever held whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPEAT_SECONDS = 10
MIN_QUERY, MAX_QUERY = 3, 200


def loggable(query: Column, has_filters: Column) -> Column:
    return (F.length(F.trim(query)) >= MIN_QUERY) | has_filters


def logged_text(query: Column) -> Column:
    return F.substring(F.trim(query), 1, MAX_QUERY)


def _accepted(events: DataFrame, user: str, time: str, event_id: str, columns: list[str], seconds: float, rule: Callable[[], Callable[..., bool]]) -> DataFrame:
    """(user, event_id) of the events that a person's rule accepts, in the order of time and id.

    The events of a burst are sorted in one task and read in batches; ``rule`` makes an acceptor for each burst, which
    holds what it needs of the past and no more.
    """
    w = Window.partitionBy(user).orderBy(time, event_id)
    pause = F.coalesce(F.col(time) - F.lag(time).over(w) >= seconds, F.lit(True))
    cut = events.withColumn("_pause", pause.cast("int")).withColumn("_burst", F.sum("_pause").over(w)).select(user, "_burst", *columns, event_id)
    place = [user, "_burst", time, event_id]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        burst, accept = None, rule()
        for batch in batches:
            kept = []
            for who, n, *values in zip(batch.column(user).to_pylist(), batch.column("_burst").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
                if (who, n) != burst:
                    burst, accept = (who, n), rule()
                kept.append(accept(*values))
            yield batch.select([user, event_id]).filter(pa.array(kept, pa.bool_()))

    kind = dict(events.dtypes)[user]
    return cut.repartition(user, "_burst").sortWithinPartitions(*place).mapInArrow(work, f"{user} {kind}, {event_id} bigint")


def dedupe(events: DataFrame, user: str, time: str, event_id: str, key: str, seconds: float = REPEAT_SECONDS) -> DataFrame:
    """Events that are logged: not those with the key of the person's last logged event less than ``seconds`` before."""

    def rule() -> Callable[[float, str], bool]:
        last: list = [None, None]

        def accept(t: float, what: str) -> bool:
            if what is not None and what == last[1] and t - last[0] < seconds:
                return False
            last[:] = t, what
            return True

        return accept

    seen = events.select(user, F.col(time).cast("double").alias(time), F.col(event_id).cast("bigint").alias(event_id), F.col(key).cast("string").alias(key))
    return _accepted(seen, user, time, event_id, [time, key], seconds, rule)


def rate_limited(events: DataFrame, user: str, time: str, event_id: str, limit: int, seconds: float) -> DataFrame:
    """(user, event_id) of allowed events: at most ``limit`` allowed ones in any window; denied ones do not count, and
    an allowed one expires exactly ``seconds`` later."""

    def rule() -> Callable[[float], bool]:
        recent: deque[float] = deque()

        def accept(t: float) -> bool:
            while recent and recent[0] <= t - seconds:
                recent.popleft()
            if len(recent) >= limit:
                return False
            recent.append(t)
            return True

        return accept

    seen = events.select(user, F.col(time).cast("double").alias(time), F.col(event_id).cast("bigint").alias(event_id))
    return _accepted(seen, user, time, event_id, [time], seconds, rule)


def new_reports(reports: DataFrame, known: DataFrame, hours: int = 24) -> DataFrame:
    """Reports to store: their file is known and no report of the same file and type was stored within the window.

    reports: id, document_id, type, created_at.
    """
    timed = reports.join(known.select("document_id").distinct(), "document_id", "left_semi")
    timed = timed.withColumn("_key", F.concat_ws("|", "document_id", "type")).withColumn("_t", F.unix_timestamp("created_at").cast("double"))
    kept = dedupe(timed.withColumn("_one", F.lit("x")), "_key", "_t", "id", "_one", hours * 3600)
    return timed.join(kept.select("id"), "id", "left_semi").drop("_key", "_t")


def retained(log: DataFrame, cutoff: Column) -> DataFrame:
    return log.where(F.col("created_at") >= cutoff)
