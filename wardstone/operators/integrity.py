"""Integrity rules as data-quality operators: each gives the rows that break it, as (rule, table_name, row_key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import unicode_trim
from ..sources.model import union_all
from ..sources.shared import stored

#: (rule, table, key, condition that a violating row meets). A null operand passes, as in a CHECK. Conditions, values and
#: bounds are fixed values of the model.
CHECKS = (
    ("C1_blank", "organizations", "organization_id", "length(trim(display_name)) = 0 or length(trim(slug)) = 0"),
    ("C1_blank", "principals", "principal_id", "length(trim(display_name)) = 0"),
    ("C1_blank", "programs", "program_id", "length(trim(name)) = 0 or length(trim(program_code)) = 0"),
    ("C1_blank", "workspaces", "workspace_id", "length(trim(name)) = 0 or length(trim(workspace_code)) = 0"),
    ("C1_blank", "capability_grants", "capability_grant_id", "length(trim(capability_code)) = 0"),
    ("C1_blank", "oidc_identities", "principal_id", "length(trim(issuer)) = 0 or length(trim(subject)) = 0"),
    ("C1_blank", "audit_events", "event_id", "length(trim(action_code)) = 0 or length(trim(entity_type)) = 0 or length(trim(entity_id)) = 0 or length(trim(actor_type)) = 0"),
    ("C1_blank", "idempotency_records", "record_id", "length(trim(route_code)) = 0"),
    ("C2_enum", "principals", "principal_id", "status not in ('active', 'suspended', 'deactivated')"),
    ("C2_enum", "memberships", "membership_id", "role_code not in ('admin', 'operator', 'reviewer', 'reader') or status not in ('active', 'suspended', 'revoked', 'expired')"),
    ("C2_enum", "session_rotations", "session_id", "reason not in ('periodic', 'privilege_change', 'manual_refresh', 'concurrent_limit', 'reuse_detected', 'inactivity_refresh')"),
    ("C3_version", "programs", "program_id", "row_version <= 0"),
    ("C3_version", "workspaces", "workspace_id", "row_version <= 0"),
    ("C3_version", "memberships", "membership_id", "row_version <= 0"),
    ("C4_interval", "memberships", "membership_id", "valid_until <= valid_from"),
    ("C4_interval", "capability_grants", "capability_grant_id", "expires_at <= granted_at or revoked_at < granted_at"),
    ("C4_interval", "oidc_transactions", "oidc_transaction_id", "expires_at <= created_at or consumed_at < created_at"),
    ("C4_interval", "sessions", "session_id", "idle_expires_at <= last_seen_at or absolute_expires_at <= created_at"),
    ("C4_interval", "idempotency_records", "record_id", "expires_at <= created_at"),
    ("C5_scope", "capability_grants", "capability_grant_id", "(workspace_id is null) = (program_id is null)"),
    ("C6_hash", "audit_events", "event_id", "length(event_hash) <> 64 or length(previous_event_hash) <> 64 or length(source_state_hash) <> 64"),
    ("C6_hash", "chain_heads", "workspace_id", "length(last_event_hash) <> 64"),
    ("C6_hash", "idempotency_records", "record_id", "length(key_hash) <> 64 or length(request_hash) <> 64"),
    ("C7_range", "sessions", "session_id", "rotation_counter < 0"),
    ("C7_range", "session_rotations", "session_id", "rotation_number <= 0"),
    ("C7_range", "audit_events", "event_id", "sequence <= 0"),
    ("C7_range", "chain_heads", "workspace_id", "last_sequence < 0"),
    ("C7_range", "idempotency_records", "record_id", "response_status not between 100 and 599"),
)
#: (rule, table, key columns, condition on the rows that count or None). Keys with a null part are all distinct.
UNIQUE = (
    ("C8_unique", "organizations", ("lower(slug)",), None),
    ("C8_unique", "programs", ("organization_id", "program_code"), None),
    ("C8_unique", "workspaces", ("program_id", "workspace_code"), None),
    ("C8_unique", "oidc_identities", ("issuer", "subject"), None),
    ("C8_unique", "sessions", ("handle_hash",), None),
    ("C8_unique", "session_rotations", ("session_id", "rotation_number"), None),
    ("C8_unique", "oidc_transactions", ("state_hash",), None),
    ("C8_unique", "audit_events", ("workspace_id", "sequence"), None),
    ("C8_unique", "audit_events", ("workspace_id", "event_hash"), None),
    ("C9_partial_unique", "memberships", ("workspace_id", "principal_id"), "status = 'active'"),
    ("C9_partial_unique", "capability_grants", ("workspace_id", "principal_id", "capability_code"), "revoked_at is null"),
    ("C9_partial_unique", "capability_grants", ("program_id", "principal_id", "capability_code"), "revoked_at is null"),
)
#: (rule, child table, child key, child columns, parent table, parent columns, what deleting the parent does). A null part
#: passes. All that follows a reference from a row to another one goes by this table.
FOREIGN = (
    ("C11_foreign", "programs", "program_id", ("organization_id",), "organizations", ("organization_id",), "cascade"),
    ("C11_foreign", "workspaces", "workspace_id", ("organization_id",), "organizations", ("organization_id",), "cascade"),
    ("C11_foreign", "workspaces", "workspace_id", ("program_id", "organization_id"), "programs", ("program_id", "organization_id"), "cascade"),
    ("C11_foreign", "memberships", "membership_id", ("workspace_id",), "workspaces", ("workspace_id",), "cascade"),
    ("C11_foreign", "memberships", "membership_id", ("principal_id",), "principals", ("principal_id",), "cascade"),
    ("C11_foreign", "capability_grants", "capability_grant_id", ("workspace_id",), "workspaces", ("workspace_id",), "cascade"),
    ("C11_foreign", "capability_grants", "capability_grant_id", ("program_id",), "programs", ("program_id",), "cascade"),
    ("C11_foreign", "capability_grants", "capability_grant_id", ("principal_id",), "principals", ("principal_id",), "cascade"),
    ("C11_foreign", "capability_grants", "capability_grant_id", ("granted_by_principal_id",), "principals", ("principal_id",), "set_null"),
    ("C11_foreign", "capability_grants", "capability_grant_id", ("revoked_by_principal_id",), "principals", ("principal_id",), "set_null"),
    ("C11_foreign", "oidc_identities", "principal_id", ("principal_id",), "principals", ("principal_id",), "cascade"),
    ("C11_foreign", "sessions", "session_id", ("principal_id",), "principals", ("principal_id",), "cascade"),
    ("C11_foreign", "session_rotations", "session_id", ("session_id",), "sessions", ("session_id",), "cascade"),
    ("C11_foreign", "chain_heads", "workspace_id", ("workspace_id",), "workspaces", ("workspace_id",), "restrict"),
    ("C11_foreign", "audit_events", "event_id", ("workspace_id",), "workspaces", ("workspace_id",), "restrict"),
    ("C11_foreign", "idempotency_records", "record_id", ("workspace_id",), "workspaces", ("workspace_id",), "cascade"),
    ("C11_foreign", "idempotency_records", "record_id", ("principal_id",), "principals", ("principal_id",), "cascade"),
)


#: Columns that tell a table's rows apart, where its key does not.
ROW = {"session_rotations": ("session_id", "rotation_number")}


def _rows(df: DataFrame, rule: str, table: str, key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), key.cast("string").alias("row_key"))


def check_violations(df: DataFrame, rule: str, table: str, key: str, broken: str) -> DataFrame:
    return _rows(df.where(F.expr(broken)), rule, table, F.col(key))


def unique_violations(df: DataFrame, rule: str, table: str, keys: tuple[str, ...], where: str | None = None, nulls_distinct: bool = True) -> DataFrame:
    """One row per key that occurs more than once; its row_key joins the key's parts by '|'."""
    return all_unique_violations(df, table, [(rule, keys, where)], nulls_distinct)


def all_unique_violations(df: DataFrame, table: str, rules: list[tuple[str, tuple[str, ...], str | None]], nulls_distinct: bool = True) -> DataFrame:
    """As ``unique_violations`` for several (rule, keys, where) in one scan and one exchange."""
    held = []
    for i, (rule, keys, where) in enumerate(rules):
        parts = [F.expr(k).cast("string") for k in keys]
        counts = F.expr(where) if where else F.lit(True)
        if nulls_distinct:
            for part in parts:
                counts = counts & part.isNotNull()
        held.append(F.when(counts, F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule"), F.array(*parts).alias("parts"))))
    rows = df.select(F.explode(F.array_compact(F.array(*held))).alias("key")).select("key.*")
    again = rows.groupBy("i", "rule", "parts").count().where("count > 1")
    text = F.array_join(F.transform("parts", lambda x: F.coalesce(x, F.lit("null"))), "|")
    return again.select("rule", F.lit(table).alias("table_name"), text.alias("row_key"))


def references(child: DataFrame, key: str, edges: list[tuple[int, int, tuple[str, ...]]], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row (edge, target, parts, row_key, ``keep``) for each reference of ``child`` to another row: for several (edge, target, columns) in one scan.

    ``parts`` are the reference's values as text; a reference with a null part is none.
    """
    held = []
    for edge, target, columns in edges:
        parts = [F.col(c).cast("string") for c in columns]
        whole = F.lit(True)
        for part in parts:
            whole = whole & part.isNotNull()
        held.append(F.when(whole, F.struct(F.lit(edge).alias("edge"), F.lit(target).alias("target"), F.array(*parts).alias("parts"))))
    rows = child.select(F.col(key).cast("string").alias("row_key"), *keep, F.explode(F.array_compact(F.array(*held))).alias("__ref"))
    return rows.select("__ref.*", "row_key", *keep)


def referred(parents: list[tuple[int, DataFrame, tuple[str, ...]]]) -> DataFrame:
    """(target, parts) of the rows that references may point to, once each."""
    each = [df.select(F.lit(target).alias("target"), F.array(*(F.col(c).cast("string") for c in columns)).alias("parts")) for target, df, columns in parents]
    return union_all(each).distinct()


#: Most parents, of all small tables together, that are broadcast, and among how many numbers what refers to them in vain is dealt.
FEW_PARENTS, DEALT = 100_000, 1024


def foreign_violations(tables, rule: str, foreign: tuple = FOREIGN, few: int = FEW_PARENTS) -> DataFrame:
    """Rows that refer to none: all tables' references, which are no nulls, meet all parents in two anti-joins.

    Tables of few rows, which many references share, are broadcast, so that no reference to them moves. What refers to them in
    vain moves with a number of its own, as one missing parent may be many rows'.
    """
    edges = [f for f in foreign if f[0] == rule]
    targets = list(dict.fromkeys((f[4], f[5]) for f in edges))
    found = []
    for table, key in dict.fromkeys((f[1], f[2]) for f in edges):
        own = [(0, targets.index((f[4], f[5])), f[3]) for f in edges if f[1] == table]
        found.append(references(getattr(tables, table), key, own).withColumn("table_name", F.lit(table)))
    parents = [(i, getattr(tables, t), columns) for i, (t, columns) in enumerate(targets)]
    counts = union_all([df.select(F.lit(i).alias("target")) for i, df, _ in parents]).groupBy("target").count().collect()  # a row a table
    sizes = {i: 0 for i, *_ in parents} | {r["target"]: r["count"] for r in counts}
    small, room = [], few
    for i in sorted(sizes, key=sizes.get):
        room -= sizes[i]
        if room >= 0:
            small.append(i)
    rows = union_all(found)
    if small:
        rows = rows.join(F.broadcast(referred([x for x in parents if x[0] in small])), ["target", "parts"], "left_anti")
    if len(small) < len(parents):
        dealt = F.when(F.col("target").isin(small), 1 + F.pmod(F.xxhash64("row_key"), F.lit(DEALT))).otherwise(0).alias("__dealt")
        large = referred([x for x in parents if x[0] not in small]).withColumn("__dealt", F.lit(0).cast("long"))
        rows = rows.select("*", dealt).join(large, ["target", "parts", "__dealt"], "left_anti")
    return rows.select(F.lit(rule).alias("rule"), "table_name", "row_key")


def violations(tables, rule: str) -> DataFrame:
    """All violations of one rule over the tables (attributes of ``tables``); each table is read once."""
    found = [check_violations(getattr(tables, t), r, t, k, b) for r, t, k, b in CHECKS if r == rule]
    for table in dict.fromkeys(t for r, t, *_ in UNIQUE if r == rule):
        found.append(all_unique_violations(getattr(tables, table), table, [(r, ks, w) for r, t, ks, w in UNIQUE if (r, t) == (rule, table)]))
    if any(r == rule for r, *_ in FOREIGN):
        found.append(foreign_violations(tables, rule))
    return union_all(found)


# --- changes between two snapshots ------------------------------------------------------------------------------------


def bucket_digests(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, digest) by a hash of the key: digests sum two hashes of each row, so they don't depend on the order of rows."""
    columns = [F.col(c) for c in sorted(df.columns)]
    sums = [F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    return df.groupBy(_bucket(key, buckets).alias("bucket")).agg(F.struct(F.count("*").alias("rows"), *sums).alias("digest"))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets))


def changed_buckets(before: DataFrame, after: DataFrame, key: str, buckets: int) -> DataFrame:
    """The buckets in which two snapshots differ; ``buckets`` rows at most."""
    old, new = (bucket_digests(df, key, buckets).withColumnRenamed("digest", name) for df, name in ((before, "old"), (after, "new")))
    return old.join(new, "bucket", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("bucket")


def append_only_violations(before: DataFrame, after: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """Rows of ``before`` that ``after`` has dropped or changed: (row_key, change).

    Only rows of buckets whose digests differ are joined: a snapshot that has only grown a little is read, not shuffled.
    """
    names = [c for c in before.columns if c != key]
    changed = F.broadcast(stored(changed_buckets(before, after.select(*before.columns), key, buckets), "buckets").withColumnRenamed("bucket", "__b"))
    held = lambda df: df.join(changed, _bucket(key, buckets) == F.col("__b"), "left_semi")
    new = held(after).select(F.col(key).alias("__k"), F.struct(*names).alias("__new"))
    rows = held(before).select(F.col(key), F.struct(*names).alias("__old")).join(new, F.col(key).eqNullSafe(F.col("__k")), "left")
    change = F.when(F.col("__new").isNull(), "deleted").when(~F.col("__old").eqNullSafe(F.col("__new")), "updated")
    return rows.select(F.col(key).cast("string").alias("row_key"), change.alias("change")).where("change is not null")


def head_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Chain heads that were deleted or went back: (row_key, change)."""
    new = after.select(F.col("workspace_id").alias("__k"), F.col("last_sequence").alias("__seq"))
    rows = before.join(new, F.col("workspace_id") == F.col("__k"), "left")
    change = F.when(F.col("__k").isNull(), "deleted").when(F.col("__seq") < F.col("last_sequence"), "decreased")
    return rows.select(F.col("workspace_id").cast("string").alias("row_key"), change.alias("change")).where("change is not null")


def delete_closure(tables, table: str, chosen: str | Column, foreign: tuple = FOREIGN) -> DataFrame:
    """What deleting the rows of ``table`` that ``chosen`` holds for does: (table_name, row_key, action).

    ``cascade``: the rows that go, those first chosen too; ``restrict``: rows that forbid it; ``set_null``: rows that stay
    and lose their reference. All of it follows ``foreign``. A table whose parents' fate is known is read once, for all of
    its references. Tables that refer to each other, or to themselves, are followed in rounds until a round finds nothing,
    each row being visited once.
    """
    cascades = [f for f in foreign if f[6] == "cascade"]
    keys = {f[1]: f[2] for f in foreign}
    reached = {table}
    while new := {f[1] for f in cascades if f[4] in reached} - reached:
        reached |= new
    targets = list(dict.fromkeys((f[4], f[5]) for f in foreign))
    wanted = {t: tuple(dict.fromkeys([*(c for p, columns in targets if p == t for c in columns), *ROW.get(t, ())])) for t in reached | {f[1] for f in foreign}}

    def hits(child: str, doomed: dict[str, DataFrame], action: str) -> DataFrame | None:
        """Rows of ``child`` that refer to doomed ones: row_key and the columns that others refer to, each row once."""
        edges = [f for f in foreign if f[1] == child and f[4] in doomed and f[6] == action]
        if not edges:
            return None
        own = [(0, targets.index((f[4], f[5])), f[3]) for f in edges]
        gone = referred([(targets.index(t), doomed[t[0]], t[1]) for t in dict.fromkeys((f[4], f[5]) for f in edges)])
        found = references(getattr(tables, child), keys[child], own, wanted[child]).join(gone, ["target", "parts"], "left_semi")
        return found.select("row_key", *wanted[child]).distinct()

    def first() -> DataFrame:
        key = keys.get(table) or next(f[5][0] for f in foreign if f[4] == table)
        return getattr(tables, table).where(chosen).select(F.col(key).cast("string").alias("row_key"), *wanted[table])

    doomed: dict[str, DataFrame] = {}
    pending = sorted(reached)
    while pending:
        ready = [t for t in pending if not {f[4] for f in cascades if f[1] == t} & set(pending)]
        for t in ready:
            parts = [x for x in (first() if t == table else None, hits(t, doomed, "cascade")) if x is not None]
            doomed[t] = union_all(parts).distinct() if len(parts) > 1 else parts[0]
        if not ready:  # what is left refers to itself
            doomed |= _rounds({t: [x for x in (first() if t == table else None, hits(t, doomed, "cascade")) if x is not None] for t in pending}, lambda t, new: hits(t, new, "cascade"))
            ready = pending
        pending = [t for t in pending if t not in ready]
    out = [(t, df, "cascade") for t, df in doomed.items()]
    for child in dict.fromkeys(f[1] for f in foreign):
        for action in ("restrict", "set_null"):
            rows = hits(child, doomed, action)
            if rows is not None:
                gone = doomed.get(child) if action == "set_null" else None  # the rest goes with the cascade
                out.append((child, rows if gone is None else rows.join(gone.select("row_key", *wanted[child]), ["row_key", *wanted[child]], "left_anti"), action))
    return union_all([df.select(F.lit(t).alias("table_name"), "row_key", F.lit(action).alias("action")) for t, df, action in out])


def _rounds(start: dict[str, list[DataFrame]], hits) -> dict[str, DataFrame]:
    """The fixpoint of tables that refer to each other: each round's new rows are written, and followed in the next one."""
    seen = {t: stored(union_all(parts).distinct(), "closure") for t, parts in start.items() if parts}
    new = dict(seen)
    while new:
        found = {}
        for t in start:
            rows = hits(t, new)
            if rows is not None:
                if t in seen:
                    same = F.lit(True)
                    for c in seen[t].columns:
                        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
                    rows = rows.alias("n").join(seen[t].alias("s"), same, "left_anti")
                rows = stored(rows, "closure")
                if not rows.isEmpty():
                    found[t] = rows
        seen |= {t: seen[t].union(rows) if t in seen else rows for t, rows in found.items()}
        new = found
    return seen


# --- rules for single rows --------------------------------------------------------------------------------------------


def rotation_error(old, new, reason) -> list[Column]:
    """error of a rotation's hashes (null if none), and its trimmed reason, a blank one made 'periodic'."""
    old, new, reason = (F.col(x) if isinstance(x, str) else x for x in (old, new, reason))
    error = F.when(F.coalesce(F.octet_length(old), F.lit(0)) == 0, "empty_old").when(F.coalesce(F.octet_length(new), F.lit(0)) == 0, "empty_new").when(old == new, "identical")
    reason = unicode_trim(reason)
    return [error.alias("error"), F.when(F.coalesce(reason, F.lit("")) == "", "periodic").otherwise(reason).alias("reason")]


def return_path(x) -> Column:
    """The trimmed path, "/" for a blank one."""
    return F.coalesce(F.nullif(unicode_trim(x), F.lit("")), F.lit("/"))


def blank_to_null(x) -> Column:
    """The trimmed text, null for a blank one."""
    return F.nullif(unicode_trim(x), F.lit(""))


def session_error(t: Column) -> Column:
    """Why a new session cannot be made: an empty hash, or a lifetime that does not end after ``t``; null if it can."""
    empty = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) == 0
    late = lambda c: F.coalesce(F.col(c) > t, F.lit(False))
    return (
        F.when(empty("handle_hash"), "empty_handle_hash").when(empty("csrf_secret_hash"), "empty_csrf_secret_hash").when(~late("idle_expires_at"), "idle_expires_at_not_in_future")
        .when(~late("absolute_expires_at"), "absolute_expires_at_not_in_future")
    )


def transaction_error(t: Column) -> Column:
    """Why a new sign-in transaction cannot be made, or null."""
    empty = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) == 0
    return F.when(empty("state_hash"), "empty_state_hash").when(empty("nonce_hash"), "empty_nonce_hash").when(~F.coalesce(F.col("expires_at") > t, F.lit(False)), "expires_at_not_in_future")


def identity_fields() -> list[Column]:
    """error of a new identity (a blank issuer or subject), and its trimmed issuer, subject and email, a blank one null."""
    blank = lambda c: F.coalesce(unicode_trim(c), F.lit("")) == ""
    error = F.when(blank("issuer"), "empty_issuer").when(blank("subject"), "empty_subject")
    return [error.alias("error"), unicode_trim("issuer").alias("issuer"), unicode_trim("subject").alias("subject"), F.nullif(unicode_trim("email"), F.lit("")).alias("email")]


def grant_error(t: Column, expires="expires_at") -> Column:
    """A new grant's expiry must lie ahead."""
    return F.when(F.col(expires).isNotNull() & (F.col(expires) <= t), "expiry_not_in_future")


def guarded(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, holds_rows): which tables hold rows, so that a migration must not run; one row of each is read at most."""
    return union_all([df.limit(1).agg((F.count("*") > 0).alias("holds_rows")).select(F.lit(name).alias("table_name"), "holds_rows") for name, df in frames.items()])
