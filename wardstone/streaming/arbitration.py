"""Idempotency arbitration and audit append over streams, with the state of a key or workspace kept by Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import key_of


def arbitrated_stream(requests: DataFrame, ttl_seconds: int = 86_400, keep_seconds: int | None = None, late: str = "1 hour") -> DataFrame:
    """(request_id, outcome) of a stream of requests (the key's columns, request_hash, request_id, requested_at).

    A key's first request is acquired, another hash is a mismatch, the same one in progress until its time is over. A
    key's requests are taken in the order of their time within a batch, as the batch operator does over a whole log. The
    state is one hash and one instant a key. Records are kept for ever, as the batch operator keeps them, or, with
    ``keep_seconds``, dropped so long after their time is over, by a watermark of ``late``; a key that comes again after
    that is acquired whatever its hash.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, until = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"], kind="stable")  # one key's requests of one batch
        out = []
        for at, request, asked in zip(rows["at"].tolist(), rows["request_id"].tolist(), rows["request_hash"].tolist()):
            if held is None or held == asked and until < at:
                held, until = asked, at + ttl_seconds * 1_000_000
                out.append((request, "Acquired"))
            else:
                out.append((request, "InProgress" if held == asked else "Mismatch"))
        state.update((held, until))
        if keep_seconds is not None:
            state.setTimeoutTimestamp(max(until // 1000 + keep_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["request_id", "outcome"])

    at = F.col("requested_at").cast("timestamp")
    if keep_seconds is None:
        slim, kind = requests.select(key_of().alias("key"), F.unix_micros(at).alias("at"), "request_id", "request_hash"), GroupStateTimeout.NoTimeout
    else:
        seen = requests.withColumn("__ws_at", at).withWatermark("__ws_at", late)
        slim, kind = seen.select(key_of().alias("key"), F.unix_micros("__ws_at").alias("at"), "request_id", "request_hash", "__ws_at"), GroupStateTimeout.EventTimeTimeout
    return slim.groupBy("key").applyInPandasWithState(step, "request_id long, outcome string", "held string, until long", "append", kind)


def chained_stream(events: DataFrame) -> DataFrame:
    """(workspace_id, event_id, sequence, previous_event_hash, event_hash) of a stream of events (workspace_id long, event_id long, body string).

    ``body`` is what is hashed of an event. A workspace's events of a batch are chained in the order of their ids. The
    state is a sequence number and a hash for each workspace.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, last = state.get if state.exists else (0, None)
        out = []
        for event, body in sorted((e, b) for frame in frames for e, b in zip(frame["event_id"].tolist(), frame["body"])):
            new = hashlib.sha256((bytes.fromhex(last) if last else b"") + b"\0" + body.encode()).hexdigest()
            sequence += 1
            out.append((key[0], event, sequence, last, new))
            last = new
        state.update((sequence, last))
        yield pd.DataFrame(out, columns=["workspace_id", "event_id", "sequence", "previous_event_hash", "event_hash"])

    schema = "workspace_id long, event_id long, sequence long, previous_event_hash string, event_hash string"
    return events.groupBy("workspace_id").applyInPandasWithState(step, schema, "sequence long, last string", "append", GroupStateTimeout.NoTimeout)


def activity_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream of events (occurred_at timestamp, workspace_id, action_code) by window, late rows dropped."""
    return events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", width), "workspace_id", "action_code").count()
