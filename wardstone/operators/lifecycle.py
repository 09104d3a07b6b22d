"""Idempotency arbitration, sessions, identities and mutations. A mutation takes a snapshot and gives the next one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug_error, unicode_trim
from ..functions.temporal import session_active
from ..sources.shared import stored

# --- idempotency ------------------------------------------------------------------------------------------------------

KEY = ("workspace_id", "principal_id", "route_code", "key_hash")


def key_of() -> Column:
    """A key's columns as one text, in which a null is none of the values and no two keys are the same."""
    return F.to_json(F.struct(*KEY))


def _same(own: tuple[str, ...], prefix: str = "r_") -> Column:
    held = F.lit(True)
    for c in own:
        held = held & F.col(c).eqNullSafe(F.col(prefix + c))
    return held


def arbitrated(requests: DataFrame, records: DataFrame, t: Column) -> DataFrame:
    """Each request with its outcome against the stored records.

    In order: no record is acquired; another request hash is a mismatch; a finished one is replayed, even when expired;
    an expired one is acquired again; else it is in progress. A null workspace matches a null one.
    """
    r = records.select(*(F.col(c).alias(f"r_{c}") for c in (*KEY, "request_hash", "response_status", "response_body", "expires_at")))
    rows = requests.join(r, _same(KEY), "left")
    outcome = (
        F.when(F.col("r_key_hash").isNull(), "Acquired").when(F.col("request_hash") != F.col("r_request_hash"), "Mismatch")
        .when(F.col("r_response_status").isNotNull(), "Replay").when(F.col("r_expires_at") < t, "Acquired").otherwise("InProgress")
    )
    rows = rows.withColumn("outcome", outcome)
    replay = F.col("outcome") == "Replay"
    return rows.select(
        *requests.columns, "outcome", F.when(replay, F.col("r_response_status")).alias("status_code"), F.when(replay, F.col("r_response_body")).alias("body"),
        F.when(F.col("outcome") == "Mismatch", F.col("r_request_hash")).alias("expected_hash"),
    )


def completed(records: DataFrame, results: DataFrame) -> DataFrame:
    """Records with the given results (record id, status, body) filled in, once: a finished record keeps its own."""
    new = results.select(F.col("record_id").alias("__id"), F.col("status").alias("__status"), F.col("body").alias("__body"))
    rows = records.join(new, F.col("record_id") == F.col("__id"), "left")
    open_ = F.col("response_status").isNull()
    rows = rows.withColumn("response_body", F.when(open_, F.col("__body")).otherwise(F.col("response_body")))
    return rows.withColumn("response_status", F.when(open_, F.col("__status")).otherwise(F.col("response_status"))).select(*records.columns)


def failed(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records without those of ``ids`` (record_id) that are unfinished."""
    gone = records.where("response_status is null").join(ids, "record_id", "left_semi").select("record_id")
    return records.join(gone, "record_id", "left_anti")


def replayed_log(log: DataFrame) -> DataFrame:
    """A request log through arbitration, if each request is finished before the next with its key and none expires."""
    w = Window.partitionBy(*KEY).orderBy("requested_at", "request_id")
    rows = log.withColumn("__n", F.row_number().over(w)).withColumn("__first", F.first("request_hash").over(w))
    outcome = F.when(F.col("__n") == 1, "Acquired").when(F.col("request_hash") == F.col("__first"), "Replay").otherwise("Mismatch")
    return rows.withColumn("outcome", outcome).drop("__n", "__first")


def replayed_log_ttl(log: DataFrame, ttl_seconds: int) -> DataFrame:
    """A request log of requests that never finish: a key is in progress for a time, then acquired anew. Gives request_id and outcome.

    A key is held by its first request's hash, and only requests of that hash renew it. Each such instant points to the
    first one more than the time to live later; those that can be reached from the first are acquired. Pointers double, so a
    key's renewals take rounds in the logarithm of how many fit in its span. Each look ahead stays within a key's stretch of
    the time to live, and instants are pre-aggregated, so a hot key's work splits by time. Only keys of several requests go
    this way, each under a number in place of its text.
    """
    micros = F.unix_micros(F.col("requested_at").cast("timestamp"))
    digest = F.unhex(F.sha2(key_of(), 256))
    slim = stored(log.select(digest.alias("digest"), micros.alias("at"), "request_id", "request_hash"), "requests")
    firsts = slim.groupBy("digest").agg(F.min(F.struct("at", "request_id", "request_hash")).alias("f"), (F.count("*") > 1).alias("again"))
    again = lambda c: F.when(F.col("again"), c)  # noqa: E731  a key's only request is acquired: its id is all that is written
    firsts = firsts.select("again", F.col("f.request_id").alias("id0"), *(again(F.col(c)).alias(to) for c, to in (("digest", "digest"), ("f.at", "at0"), ("f.request_hash", "held"))))
    firsts = stored(firsts.withColumn("key", again(F.monotonically_increasing_id())), "held")
    once, held = firsts.where("not again").select(F.col("id0").alias("request_id"), F.lit("Acquired").alias("outcome")), firsts.where("again")
    rows = slim.join(held.select("digest", "key", "at0", "held"), "digest").withColumn("matches", F.col("request_hash") == F.col("held"))
    rows = stored(rows.select("key", "at", "at0", "request_id", "matches"), "requests")
    ttl = ttl_seconds * 1_000_000
    # instants at which the key's own hash asks: the least request of an instant may renew
    each = rows.where("matches").groupBy("key", "at").agg(F.min("at0").alias("at0"))
    each = stored(each.withColumn("stretch", F.expr(f"(at - at0) div {ttl}")), "instants")
    span = each.agg(F.coalesce(F.max("stretch"), F.lit(0))).first()[0]
    # the next instant over at + ttl lies in the next stretch, or is the first of the next one that has any
    ahead = each.select("key", (F.col("stretch") + 1).alias("stretch"), (F.col("at") + ttl).alias("x"), F.col("at").alias("of"))
    points = each.select("key", "stretch", F.col("at").alias("x"), F.lit(None).cast("long").alias("of"))
    later = Window.partitionBy("key", "stretch").orderBy(F.desc("x"), F.col("of").isNull())  # an instant at x itself comes too late for x
    seen = ahead.unionByName(points).withColumn("next", F.last(F.when(F.col("of").isNull(), F.col("x")), ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1)))
    near = seen.where("of is not null").select("key", F.col("of").alias("at"), "next")
    firsts = each.groupBy("key", "stretch").agg(F.min("at").alias("first"))
    after = Window.partitionBy("key").orderBy("stretch")  # a row a stretch
    firsts = firsts.withColumns({"s1": F.lead("stretch").over(after), "f1": F.lead("first").over(after), "f2": F.lead("first", 2).over(after)})
    far = F.when(F.col("s1") == F.col("stretch") + 1, F.col("f2")).otherwise(F.col("f1"))  # the first beyond the next stretch
    jumps = each.join(firsts.select("key", "stretch", far.alias("far")), ["key", "stretch"]).join(near, ["key", "at"], "left")
    jumps = stored(jumps.select("key", "at", F.coalesce("next", "far").alias("next")), "jumps")
    got = stored(held.select("key", F.col("at0").alias("at")), "acquired")
    for _ in range(int(span).bit_length()):
        got = stored(got.union(got.join(jumps, ["key", "at"]).where("next is not null").select("key", "next")).distinct(), "acquired")
        beyond = jumps.select(F.col("key"), F.col("at").alias("next"), F.col("next").alias("beyond"))
        jumps = stored(jumps.where("next is not null").join(beyond, ["key", "next"], "left").select("key", "at", F.col("beyond").alias("next")), "jumps")
    least = rows.where("matches").groupBy("key", "at").agg(F.min("request_id").alias("request_id"))
    acquired = least.join(got, ["key", "at"], "left_semi").select(F.col("request_id").alias("__id"), F.lit(True).alias("__got"))
    out = rows.join(acquired, F.col("request_id") == F.col("__id"), "left")
    return once.unionByName(out.select("request_id", F.when(F.col("__got"), "Acquired").when(F.col("matches"), "InProgress").otherwise("Mismatch").alias("outcome")))


# --- sessions ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SessionRules:
    """Lifetimes and limits of sessions."""

    absolute: str = "7 days"
    idle: str = "12 hours"
    rotate_after: str = "4 hours"
    touch_after: str = "5 minutes"
    most: int = 5


def active_sessions(sessions: DataFrame, t: Column) -> DataFrame:
    """Active sessions of each principal, oldest first, with their position and how many there are."""
    w = Window.partitionBy("principal_id")
    rows = sessions.where(session_active(t) & (F.col("created_at") <= t))
    return rows.withColumn("position", F.row_number().over(w.orderBy("created_at", "session_id"))).withColumn("active", F.count("*").over(w))


def evicted_sessions(sessions: DataFrame, t: Column, most: int = SessionRules.most) -> DataFrame:
    """The oldest sessions that must go before each principal may open another."""
    return active_sessions(sessions, t).where(F.col("position") <= F.col("active") + 1 - most).select("principal_id", "session_id", "position")


def opened(sessions: DataFrame, new: DataFrame, t: Column, most: int = SessionRules.most) -> DataFrame:
    """The next snapshot after ``new`` were opened one after the other: by created_at, then session_id.

    Each opening first revokes the principal's oldest active sessions down to one less than ``most``, so of old and new ones
    together the newest ``most`` stay; one less if the last to open is not active at ``t`` itself.
    """
    rows = sessions.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    alive = F.coalesce(session_active(t) & (F.col("__new") | (F.col("created_at") <= t)), F.lit(False))
    rows = rows.withColumn("__alive", alive)
    order = F.struct("__new", "created_at", "session_id")
    last = rows.where("__new").groupBy("principal_id").agg(F.max_by("__alive", order).alias("__last")).withColumnRenamed("principal_id", "__p")
    place = F.row_number().over(Window.partitionBy("principal_id").orderBy(F.desc("__new"), F.desc("created_at"), F.desc("session_id")))
    ranked = rows.where("__alive").withColumn("__place", place).join(last, F.col("principal_id") == F.col("__p"))
    gone = ranked.where(F.col("__place") > most - 1 + F.col("__last").cast("int")).select(F.col("session_id").alias("__gone"), F.col("__new").alias("__n"))
    rows = rows.join(gone, (F.col("session_id") == F.col("__gone")) & (F.col("__new") == F.col("__n")), "left")
    return rows.withColumn("revoked_at", F.when(F.col("__gone").isNotNull(), t).otherwise(F.col("revoked_at"))).select(*sessions.columns)


def rotated(sessions: DataFrame, changes: DataFrame, t: Column, rules: SessionRules = SessionRules(), order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(sessions, rotation rows) after ``changes`` (session_id, new_hash, reason), several of a session in ``order``. created_at never moves.

    Each change's old hash is the one before's new hash. Changes that ``order`` leaves equal go by new_hash, then reason.
    """
    ranked = Window.partitionBy("session_id").orderBy(*order, "new_hash", "reason")
    steps = changes.withColumns({"__step": F.row_number().over(ranked), "__old": F.lag("new_hash").over(ranked)})
    own = sessions.select(F.col("session_id").alias("__id"), F.col("rotation_counter").alias("__n"), F.col("handle_hash").alias("__first"))
    steps = steps.join(own, F.col("session_id") == F.col("__id"))
    rotations = steps.select(
        "session_id", (F.col("__n") + F.col("__step")).cast(sessions.schema["rotation_counter"].dataType).alias("rotation_number"), F.coalesce("__old", "__first").alias("old_handle_hash"),
        F.col("new_hash").alias("new_handle_hash"), "reason",
    )
    after = updated(
        sessions.withColumn("__seen", F.lit(None).cast("boolean")), changes.select("session_id", *order, F.col("new_hash").alias("handle_hash"), F.lit(True).alias("__seen")),
        "session_id", ["handle_hash", "__seen"], bump="rotation_counter", order=order,
    )
    moved = F.coalesce("__seen", F.lit(False))
    after = after.withColumns({
        "last_seen_at": F.when(moved, t).otherwise(F.col("last_seen_at")), "idle_expires_at": F.when(moved, t + F.expr(f"interval {rules.idle}")).otherwise(F.col("idle_expires_at")),
    })
    return after.select(*sessions.columns), rotations


def revoked_sessions(sessions: DataFrame, ids: DataFrame, t: Column) -> DataFrame:
    """The next snapshot with the sessions of ``ids`` revoked; one that is revoked keeps its time."""
    going = ids.select(F.col("session_id").alias("__gone")).distinct()
    rows = sessions.join(going, F.col("session_id") == F.col("__gone"), "left")
    return rows.withColumn("revoked_at", F.when(F.col("__gone").isNotNull(), F.coalesce("revoked_at", t)).otherwise(F.col("revoked_at"))).drop("__gone")


def session_action(t: Column, by_previous_key: Column, rules: SessionRules = SessionRules()) -> Column:
    """What authenticating with a session does: reject, rotate (and why), touch, or nothing."""
    return (
        F.when(~session_active(t), "reject").when(by_previous_key, "rotate:manual_refresh").when(t - F.col("created_at") >= F.expr(f"interval {rules.rotate_after}"), "rotate:periodic")
        .when(t - F.col("last_seen_at") >= F.expr(f"interval {rules.touch_after}"), "touch").otherwise("none")
    )


def touched(sessions: DataFrame, t: Column, rules: SessionRules = SessionRules()) -> DataFrame:
    """The next snapshot with each active session seen at ``t``; others are refused and stay."""
    ok = session_active(t)
    return sessions.withColumns({
        "last_seen_at": F.when(ok, t).otherwise(F.col("last_seen_at")), "idle_expires_at": F.when(ok, t + F.expr(f"interval {rules.idle}")).otherwise(F.col("idle_expires_at"))
    })


def rotation_breaks(rotations: DataFrame) -> DataFrame:
    """Rotations whose old hash is not the one before's new hash, or whose number does not follow."""
    w = Window.partitionBy("session_id").orderBy("rotation_number")
    rows = rotations.withColumn("__hash", F.lag("new_handle_hash").over(w)).withColumn("__n", F.lag("rotation_number").over(w))
    broken = F.when(F.col("__n").isNull(), F.when(F.col("rotation_number") != 1, "gap")).when(F.col("rotation_number") != F.col("__n") + 1, "gap").when(F.col("old_handle_hash") != F.col("__hash"), "hash")
    return rows.withColumn("broken", broken).where("broken is not null").select("session_id", "rotation_number", "broken")


#: Rows of a key from which they are dealt out, over so many tasks; they are found on one row of so many, which steers where
#: rows meet only; most such keys.
HOT, SPREAD, HOT_SHARE, MOST_HOT = 1 << 15, 256, 16, 1024


def _looked_up(rows: DataFrame, key: str, side: DataFrame, side_key: str, hot: int = HOT, share: int = HOT_SHARE) -> DataFrame:
    """A left join whose rows of a hot key (null is one) lie in several tasks; the other side's rows of it stand once in each."""
    mark = F.xxhash64(*rows.columns)
    often = rows.where(F.pmod(mark, F.lit(share)) == 0).groupBy(F.col(key).alias("__hot")).count().where(F.col("count") >= max(1, hot // share))
    often = F.broadcast(often.orderBy(F.desc("count"), "__hot").limit(MOST_HOT).select("__hot", F.lit(True).alias("__is")))
    salt = F.when(F.col("__is"), F.pmod(mark, F.lit(SPREAD * share)) % SPREAD).otherwise(0).cast("int")
    left = rows.join(often, F.col(key).eqNullSafe(F.col("__hot")), "left").withColumn("__salt", salt).drop("__hot", "__is")
    each = F.sequence(F.lit(0), F.when(F.col("__is"), SPREAD - 1).otherwise(0))
    right = side.join(often, F.col(side_key) == F.col("__hot"), "left").withColumn("__at", F.explode(each)).drop("__hot", "__is")
    return left.join(right, (F.col(key) == F.col(side_key)) & (F.col("__salt") == F.col("__at")), "left").drop("__salt", "__at", side_key)


def found_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests (active_hash, previous_hash) with the session found by the active key's hash, else by the previous key's."""
    s = lambda p: sessions.select(F.col("handle_hash").alias(f"__{p}"), F.col("session_id").alias(f"{p}_session"))
    rows = _looked_up(_looked_up(requests, "active_hash", s("a"), "__a"), "previous_hash", s("p"), "__p")
    return rows.select(
        *requests.columns, F.coalesce("a_session", "p_session").alias("session_id"), (F.col("a_session").isNull() & F.col("p_session").isNotNull()).alias("by_previous_key")
    )


def found_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests (set_id, kid) with the key of their set: by its id, or, without one, the set's only key."""
    k = keys.withColumnRenamed("set_id", "__set").withColumnRenamed("kid", "__kid")
    only = k.groupBy("__set").agg(F.count("*").alias("__n"), F.first("key_id").alias("key_id")).where("__n = 1").drop("__n")
    named = requests.where("kid is not null").join(k, (F.col("set_id") == F.col("__set")) & (F.col("kid") == F.col("__kid")), "left").drop("__set", "__kid")
    rest = requests.where("kid is null").join(only, F.col("set_id") == F.col("__set"), "left").drop("__set")
    return named.unionByName(rest)


# --- identities -------------------------------------------------------------------------------------------------------


def resolved_identities(claims: DataFrame, identities: DataFrame) -> DataFrame:
    """Claims (issuer, subject, name, email) with the principal they belong to, or the name of a new one."""
    known = identities.select(F.col("issuer").alias("__i"), F.col("subject").alias("__s"), F.col("principal_id"))
    rows = claims.join(known, (F.col("issuer") == F.col("__i")) & (F.col("subject") == F.col("__s")), "left").drop("__i", "__s")
    return rows.withColumn("new_display_name", F.when(F.col("principal_id").isNull(), F.coalesce("name", "email", F.lit("OIDC User"))))


# --- mutations --------------------------------------------------------------------------------------------------------


def inserted(df: DataFrame, new: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot with ``new``; rows whose key exists are refused, and of new ones of one key all but the first in ``order``.

    Rows that ``order`` leaves equal go by their values.
    """
    row = F.struct(*df.columns)
    first = new.groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(F.struct(*(order or [key])).alias("at"), row.alias("row"))).alias("first"))
    return df.unionByName(first.join(df.select(key), F.col("__k") == F.col(key), "left_anti").select("first.row.*"))


def folded(changes: DataFrame, key: str, columns: list[str], order: tuple[str, ...] = (), keep_null: bool = False) -> DataFrame:
    """One row per key of a log of changes: (key, ``columns``, __n): each column's last value in ``order``, and how many changes.

    With ``keep_null`` a null sets nothing, so the last value that is not null counts. Changes that ``order`` leaves equal
    go by their values. Rows of a key are aggregated before they shuffle.
    """
    at = F.struct(*order, *columns)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)) if keep_null else F.max_by(c, at)
    return changes.groupBy(key).agg(*(last(c).alias(c) for c in columns), F.count("*").alias("__n"))


def updated(df: DataFrame, changes: DataFrame, key: str, columns: list[str], bump: str | None = None, keep_null: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot after a log of changes of ``columns`` by key, in ``order``; ``bump`` counts each change up.

    A key may have any number of changes: they are folded first, so no row is ever repeated. With ``keep_null`` a null in
    ``changes`` leaves the old value. Keys that do not exist change nothing.
    """
    new = folded(changes, key, columns, order, keep_null)
    new = new.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns), "__n")
    rows = df.join(new, F.col(key) == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    value = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)) if keep_null else F.col(f"__{c}")
    rows = rows.withColumns({c: F.when(hit, value(c)).otherwise(F.col(c)) for c in columns})
    if bump:
        rows = rows.withColumn(bump, F.col(bump) + F.coalesce("__n", F.lit(0)).cast(df.schema[bump].dataType))
    return rows.select(*df.columns)


def revoked_grants(grants: DataFrame, ids: DataFrame, t: Column) -> DataFrame:
    """The next snapshot with the grants of ``ids`` (capability_grant_id and, if wanted, revoked_by, reason) revoked, once.

    A grant that is revoked keeps its time, its reason and who revoked it. A null reason leaves the old one. Of repeated
    ids the first by reason and revoker counts.
    """
    extra = [c for c in ("revoked_by", "reason") if c in ids.columns]
    going = ids.groupBy(F.col("capability_grant_id").alias("__gone")).agg(F.min(F.struct(*([*extra[::-1]] or [F.lit(0).alias("none")]))).alias("__new"))
    rows = grants.join(going, F.col("capability_grant_id") == F.col("__gone"), "left")
    hit, after = F.col("__gone").isNotNull() & F.col("revoked_at").isNull(), {"revoked_at": t}
    if "revoked_by" in extra:
        after["revoked_by_principal_id"] = F.col("__new.revoked_by")
    if "reason" in extra:
        after["grant_reason"] = F.coalesce("__new.reason", "grant_reason")
    return rows.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in after.items()}).select(*grants.columns)


def revoked_by_principal(sessions: DataFrame, principals: DataFrame, t: Column) -> tuple[DataFrame, DataFrame]:
    """(the next snapshot with all unrevoked sessions of ``principals`` revoked, how many of each: principal_id, affected)."""
    own = principals.select(F.col("principal_id").alias("__p")).distinct()
    rows = sessions.join(own, F.col("principal_id") == F.col("__p"), "left")
    hit = F.col("__p").isNotNull() & F.col("revoked_at").isNull()
    affected = own.join(sessions.where("revoked_at is null"), F.col("principal_id") == F.col("__p"), "left").groupBy(F.col("__p").alias("principal_id")).agg(F.count("session_id").alias("affected"))
    return rows.withColumn("revoked_at", F.when(hit, t).otherwise(F.col("revoked_at"))).drop("__p"), affected


def renamed(df: DataFrame, changes: DataFrame, key: str, code: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot with name and ``code`` set, trimmed, and row_version counted up by each change that is not refused.

    ``changes``: the key, name and the code, several of a key in ``order``. A blank name or a code that is no slug refuses
    the change, and the others go on. Adds a column error: that of the key's last refused change.
    """
    bad = F.when(unicode_trim("name") == "", "empty_name").otherwise(slug_error(code))
    tried = changes.select(key, *order, unicode_trim("name").alias("name"), unicode_trim(code).alias(code), bad.alias("__error"))
    refused = tried.where("__error is not null").groupBy(F.col(key).alias("__k")).agg(F.max_by("__error", F.struct(*order, "__error")).alias("error"))
    rows = updated(df, tried.where("__error is null"), key, ["name", code], bump="row_version", order=order)
    return rows.join(refused, F.col(key) == F.col("__k"), "left").select(*df.columns, "error")


def consumed_transactions(transactions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts (attempt_id, oidc_transaction_id, at) with whether each consumes its transaction: valid, and the first."""
    rows = attempts.join(transactions.select("oidc_transaction_id", "expires_at", "consumed_at"), "oidc_transaction_id", "left")
    fits = F.coalesce(F.col("consumed_at").isNull() & (F.col("at") < F.col("expires_at")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("oidc_transaction_id").orderBy(fits.desc(), "at", "attempt_id"))
    return rows.withColumn("consumed", fits & (place == 1)).select("attempt_id", "oidc_transaction_id", "at", "consumed")


def deleted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")
