"""Validity and status at an instant, as columns. ``t`` is always given; no function reads a clock.

Null operands follow SQL: an open end is a null, and a null start is never active.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: str | datetime | Column) -> Column:
    """A zone-less timestamp."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def membership_active(t: Column, status="status", start="valid_from", end="valid_until") -> Column:
    return (_c(status) == "active") & (_c(start) <= t) & (_c(end).isNull() | (_c(end) > t))


def grant_active(t: Column, expires="expires_at", revoked="revoked_at") -> Column:
    """As evaluated in memory: not revoked by ``t``, not expired at ``t``; when it was granted does not matter."""
    return ~(_c(revoked).isNotNull() & (t >= F.coalesce(_c(revoked), t))) & (_c(expires).isNull() | (t < _c(expires)))


def grant_active_stored(t: Column, expires="expires_at", revoked="revoked_at") -> Column:
    """As the store filters: never revoked, even for a later day, and not expired."""
    return _c(revoked).isNull() & (_c(expires).isNull() | (_c(expires) > t))


def session_active(t: Column, revoked="revoked_at", idle="idle_expires_at", absolute="absolute_expires_at") -> Column:
    return _c(revoked).isNull() & (t < _c(idle)) & (t < _c(absolute))


def session_expired(t: Column, idle="idle_expires_at", absolute="absolute_expires_at") -> Column:
    return (t >= _c(idle)) | (t >= _c(absolute))


def session_status(t: Column) -> Column:
    return F.when(F.col("revoked_at").isNotNull(), "revoked").when(session_expired(t), "expired").otherwise("active")


def session_evaluated(t: Column, idle_timeout: str = "12 hours") -> Column:
    """The status, and expired as well if the last use is longer ago than the timeout."""
    late = t - F.col("last_seen_at") > F.expr(f"interval {idle_timeout}")
    return F.when(F.col("revoked_at").isNotNull(), "revoked").when(session_expired(t) | late, "expired").otherwise("active")


def transaction_valid(t: Column, expires="expires_at", consumed="consumed_at") -> Column:
    return _c(consumed).isNull() & (t < _c(expires))


def token_times(now, issued, not_before, expires, skew: int = 60) -> Column:
    """The first failing check of a token's times (epoch seconds), or 'ok'."""
    now, issued, not_before, expires = map(_c, (now, issued, not_before, expires))
    return (
        F.when(now >= expires + skew, "expired").when(not_before.isNotNull() & (not_before > now + skew), "not_yet_valid").when(issued > now + skew, "bad_issued_at")
        .otherwise("ok")
    )


def principal_active(status="status") -> Column:
    return _c(status) == "active"


def audience(aud, azp, client) -> Column:
    """The first failing rule of audience (array) and authorised party, or 'ok'."""
    aud, azp, client = map(_c, (aud, azp, client))
    return (
        F.when(~F.array_contains(aud, client), "bad_audience").when((F.size(aud) > 1) & azp.isNull(), "azp_missing")
        .when(azp.isNotNull() & (azp != client), "azp_mismatch").otherwise("ok")
    )


#: Legal moves of a worker; fixed values. A move to the same state does nothing and is legal.
MOVES = (
    ("Starting", "Ready"), ("Starting", "Failed"), ("Ready", "ShuttingDown"), ("Ready", "Failed"), ("ShuttingDown", "Stopped"), ("ShuttingDown", "Failed"),
)


def move_legal(before, after) -> Column:
    before, after = map(_c, (before, after))
    return before.isNull() | (before == after) | F.concat_ws(">", before, after).isin(*(f"{a}>{b}" for a, b in MOVES))
