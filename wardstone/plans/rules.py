"""Registered integrity rules, over tables in which each constraint is broken on purpose, with oracle SQL written by hand.

SPOILED has the model's tables with faults planted by the remainders of their ids. The statements below state each
constraint as it should hold and select the rows for which it is false; the operators hold the opposite conditions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, integrity
from ..sources.model import Model, ansi_text, portable
from .reads import query

SPOILED = {
    "organizations": (
        "select organization_id, case when organization_id = 0 then '  ' else display_name end as display_name, "
        "case organization_id when 1 then 'ASIA' when 4 then ' ' else slug end as slug from {organizations}"
    ),
    "principals": (
        "select principal_id, case when principal_id % 17 = 3 then ' ' else display_name end as display_name, "
        "case when principal_id % 13 = 5 then 'locked' else status end as status from {principals}"
    ),
    "programs": (
        "select program_id, case when program_id = 9 then 99 else organization_id end as organization_id, case when program_id = 5 then ' ' when program_id < 12 then 'dup' "
        "else program_code end as program_code, case when program_id = 6 then '' else name end as name, case when program_id = 7 then 0 else row_version end as row_version from {programs}"
    ),
    "workspaces": (
        "select workspace_id, program_id, case when workspace_id % 50 = 7 then 77 when workspace_id % 50 = 8 then (organization_id + 1) % 5 else organization_id end as organization_id, "
        "case when workspace_id % 40 = 3 then ' ' when workspace_id % 40 in (4, 5) then 'same' else workspace_code end as workspace_code, "
        "case when workspace_id % 60 = 5 then '' else name end as name, case when workspace_id % 70 = 6 then -1 else row_version end as row_version from {workspaces}"
    ),
    "memberships": (
        "select membership_id, case when membership_id % 199 = 1 then -5 when membership_id % 199 in (7, 8) then 1 else workspace_id end as workspace_id, "
        "case when membership_id % 199 = 2 then -6 when membership_id % 199 in (7, 8) then 1 else principal_id end as principal_id, "
        "case when membership_id % 199 = 3 then 'owner' else role_code end as role_code, case when membership_id % 199 = 4 then 'gone' else status end as status, valid_from, "
        "case when membership_id % 199 = 5 then valid_from else valid_until end as valid_until, case when membership_id % 199 = 6 then 0 else row_version end as row_version from {memberships}"
    ),
    "capability_grants": (
        "select capability_grant_id, case when k = 1 then null when k = 2 then 3 else workspace_id end as workspace_id, case when k = 3 then 4 when k = 4 then 999 else program_id end as program_id, "
        "case when k = 5 then -7 else principal_id end as principal_id, case when k = 6 then -8 else principal_id end as granted_by_principal_id, "
        "case when k = 7 then -9 when revoked_at is null then null else principal_id end as revoked_by_principal_id, case when k = 8 then ' ' else capability_code end as capability_code, "
        "granted_at, case when k = 9 then granted_at else expires_at end as expires_at, case when k = 10 then granted_at - interval 1 days else revoked_at end as revoked_at "
        "from (select *, capability_grant_id % 211 as k from {capability_grants}) g"
    ),
    "oidc_identities": (
        "select case when principal_id % 19 = 4 then -3 else principal_id end as principal_id, case when principal_id % 19 = 5 then ' ' when principal_id % 19 = 7 then 'idp' else issuer end as issuer, "
        "case when principal_id % 19 = 6 then '' when principal_id % 19 = 7 then 'same' else subject end as subject from {oidc_identities}"
    ),
    "sessions": (
        "select session_id, case when k = 1 then -2 else principal_id end as principal_id, case when k in (2, 3) then H('shared') else handle_hash end as handle_hash, created_at, last_seen_at, "
        "case when k = 4 then last_seen_at else idle_expires_at end as idle_expires_at, case when k = 5 then created_at else absolute_expires_at end as absolute_expires_at, "
        "case when k = 6 then -1 else rotation_counter end as rotation_counter from (select *, cast(substr(session_id, 3) as bigint) % 151 as k from {sessions}) s"
    ),
    "session_rotations": (
        "select 's-' || cast(case when session_id % 31 = 5 then -1 - session_id else session_id end as varchar(20)) as session_id, "
        "case when session_id % 31 = 1 then 0 when session_id % 31 = 2 then 1 else rotation_number end as rotation_number, "
        "case when session_id % 31 = 3 then 'whim' when session_id % 31 = 4 then 'privilege_change' else reason end as reason from {session_rotations}"
    ),
    "oidc_transactions": (
        "select oidc_transaction_id, case when oidc_transaction_id % 23 in (1, 2) then H('st') else state_hash end as state_hash, created_at, "
        "case when oidc_transaction_id % 23 = 3 then created_at else expires_at end as expires_at, "
        "case when oidc_transaction_id % 23 = 4 then created_at - interval 1 minutes when oidc_transaction_id % 23 = 5 then expires_at + interval 1 minutes else consumed_at end as consumed_at "
        "from {oidc_transactions}"
    ),
    "audit_events": (
        "select event_id, workspace_id, case when k = 9 then 0 when k in (12, 13) then 1 else sequence end as sequence, case when k = 1 then ' ' else action_code end as action_code, "
        "case when k = 2 then '' else 'event' end as entity_type, case when k = 3 then '  ' else cast(event_id as varchar(20)) end as entity_id, case when k = 4 then ' ' else 'system' end as actor_type, "
        "case when k = 5 then 'ab' when sequence = 1 then null else H(cast(event_id as varchar(20))) end as previous_event_hash, "
        "case when k = 6 then 'cd' when k in (10, 11) then H(cast(workspace_id as varchar(20))) else H('e' || cast(event_id as varchar(20))) end as event_hash, "
        "case when k = 7 then 'ef' when k = 8 then H('s') else null end as source_state_hash from (select *, event_id % 101 as k from {audit_source}) e"
    ),
    "chain_heads": (
        "select workspace_id, case when workspace_id % 7 = 1 then -1 else s end as last_sequence, "
        "case when workspace_id % 5 = 1 then 'x' when workspace_id % 3 = 1 then null else H(cast(workspace_id as varchar(20))) end as last_event_hash "
        "from (select workspace_id, max(sequence) as s from {audit_source} group by workspace_id) h"
    ),
    "idempotency_records": (
        "select request_id as record_id, case when k = 1 then -4 else workspace_id end as workspace_id, case when k = 2 then -5 else principal_id end as principal_id, "
        "case when k = 3 then ' ' else route_code end as route_code, case when k = 4 then 'short' else H(cast(request_id % 1000 as varchar(20))) end as key_hash, "
        "case when k = 5 then 'short' else H(request_body) end as request_hash, case when k = 6 then 99 when k = 7 then 600 when request_id % 2 = 0 then null else 200 end as response_status, "
        "requested_at as created_at, case when k = 8 then requested_at else requested_at + interval 1 days end as expires_at from (select *, request_id % 89 as k from {request_log}) r"
    ),
}
_TABLES = [(f"bad_{name}", ansi_text(sql)) for name, sql in SPOILED.items()]


class Spoiled:
    """The spoiled tables over one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.model = Model(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SPOILED:
            raise AttributeError(name)
        return portable(self.model.spark, SPOILED[name], lambda view: getattr(self.model, view))


def _held(rule: str, *constraints: tuple[str, str, str]) -> str:
    """Rows for which a constraint (table, key, what holds) is false."""
    return "\nunion all ".join(
        f"select '{rule}' as rule, '{table}' as table_name, cast({key} as varchar) as row_key from bad_{table} where not ({holds})" for table, key, holds in constraints
    )


def _rule(rule: str, sql: str) -> None:
    query(rule, sql, *(t for t in _TABLES if t[0] in sql))(lambda m: integrity.violations(Spoiled(m.spark, m.sf_dir), rule))


_rule("C1_blank", _held(
    "C1_blank", ("organizations", "organization_id", "length(trim(display_name)) > 0 and length(trim(slug)) > 0"), ("principals", "principal_id", "length(trim(display_name)) > 0"),
    ("programs", "program_id", "length(trim(name)) > 0 and length(trim(program_code)) > 0"), ("workspaces", "workspace_id", "length(trim(name)) > 0 and length(trim(workspace_code)) > 0"),
    ("capability_grants", "capability_grant_id", "length(trim(capability_code)) > 0"), ("oidc_identities", "principal_id", "length(trim(issuer)) > 0 and length(trim(subject)) > 0"),
    ("audit_events", "event_id", "length(trim(action_code)) > 0 and length(trim(entity_type)) > 0 and length(trim(entity_id)) > 0 and length(trim(actor_type)) > 0"),
    ("idempotency_records", "record_id", "length(trim(route_code)) > 0"),
))
_rule("C2_enum", _held(
    "C2_enum", ("principals", "principal_id", "status = 'active' or status = 'suspended' or status = 'deactivated'"),
    ("memberships", "membership_id", "role_code in ('admin', 'operator', 'reviewer', 'reader') and status in ('active', 'suspended', 'revoked', 'expired')"),
    ("session_rotations", "session_id", "reason in ('periodic', 'privilege_change', 'manual_refresh', 'concurrent_limit', 'reuse_detected', 'inactivity_refresh')"),
))
_rule("C3_version", _held("C3_version", *((t, k, "row_version > 0") for t, k in (("programs", "program_id"), ("workspaces", "workspace_id"), ("memberships", "membership_id")))))
_rule("C4_interval", _held(
    "C4_interval", ("memberships", "membership_id", "valid_until is null or valid_until > valid_from"),
    ("capability_grants", "capability_grant_id", "(expires_at is null or expires_at > granted_at) and (revoked_at is null or revoked_at >= granted_at)"),
    ("oidc_transactions", "oidc_transaction_id", "expires_at > created_at and (consumed_at is null or consumed_at >= created_at)"),
    ("sessions", "session_id", "idle_expires_at > last_seen_at and absolute_expires_at > created_at"), ("idempotency_records", "record_id", "expires_at > created_at"),
))
_rule("C5_scope", _held("C5_scope", ("capability_grants", "capability_grant_id", "(workspace_id is not null and program_id is null) or (workspace_id is null and program_id is not null)")))
_rule("C6_hash", _held(
    "C6_hash", ("audit_events", "event_id", "length(event_hash) = 64 and (previous_event_hash is null or length(previous_event_hash) = 64) and (source_state_hash is null or length(source_state_hash) = 64)"),
    ("chain_heads", "workspace_id", "last_event_hash is null or length(last_event_hash) = 64"), ("idempotency_records", "record_id", "length(key_hash) = 64 and length(request_hash) = 64"),
))
_rule("C7_range", _held(
    "C7_range", ("sessions", "session_id", "rotation_counter >= 0"), ("session_rotations", "session_id", "rotation_number > 0"), ("audit_events", "event_id", "sequence > 0"),
    ("chain_heads", "workspace_id", "last_sequence >= 0"), ("idempotency_records", "record_id", "response_status is null or (response_status >= 100 and response_status <= 599)"),
))


def _again(rule: str, table: str, key: str, where: str = "true") -> str:
    """Keys that occur more than once; a null makes the joined key null, and such rows do not count."""
    return f"select '{rule}' as rule, '{table}' as table_name, row_key from (select {key} as row_key from bad_{table} where {where}) k where row_key is not null group by row_key having count(*) > 1"


_rule("C8_unique", "\nunion all ".join([
    _again("C8_unique", "organizations", "lower(slug)"), _again("C8_unique", "programs", "organization_id || '|' || program_code"), _again("C8_unique", "workspaces", "program_id || '|' || workspace_code"),
    _again("C8_unique", "oidc_identities", "issuer || '|' || subject"), _again("C8_unique", "sessions", "handle_hash"), _again("C8_unique", "session_rotations", "session_id || '|' || rotation_number"),
    _again("C8_unique", "oidc_transactions", "state_hash"), _again("C8_unique", "audit_events", "workspace_id || '|' || sequence"), _again("C8_unique", "audit_events", "workspace_id || '|' || event_hash"),
]))
_rule("C9_partial_unique", "\nunion all ".join([
    _again("C9_partial_unique", "memberships", "workspace_id || '|' || principal_id", "status = 'active'"),
    _again("C9_partial_unique", "capability_grants", "workspace_id || '|' || principal_id || '|' || capability_code", "workspace_id is not null and revoked_at is null"),
    _again("C9_partial_unique", "capability_grants", "program_id || '|' || principal_id || '|' || capability_code", "program_id is not null and revoked_at is null"),
]))
_NULLS_EQUAL = """select 'C10' as rule, 'idempotency_records' as table_name, coalesce(cast(workspace_id as varchar), 'null') || '|' || principal_id || '|' || route_code || '|' || key_hash as row_key
  from bad_idempotency_records group by workspace_id, principal_id, route_code, key_hash having count(*) > 1"""
query("C10_unique_nulls_equal", _NULLS_EQUAL, _TABLES[-1])(
    lambda m: integrity.unique_violations(Spoiled(m.spark, m.sf_dir).idempotency_records, "C10", "idempotency_records", ("workspace_id", "principal_id", "route_code", "key_hash"), nulls_distinct=False)
)


def _orphans(table: str, key: str, column: str, parent: str, parent_column: str) -> str:
    return f"select 'C11_foreign' as rule, '{table}' as table_name, cast({key} as varchar) as row_key from bad_{table} where {column} not in (select {parent_column} from bad_{parent})"


_rule("C11_foreign", "\nunion all ".join([
    _orphans("programs", "program_id", "organization_id", "organizations", "organization_id"), _orphans("workspaces", "workspace_id", "organization_id", "organizations", "organization_id"),
    _orphans("workspaces", "workspace_id", "(program_id || '/' || organization_id)", "programs", "program_id || '/' || organization_id"),
    _orphans("memberships", "membership_id", "workspace_id", "workspaces", "workspace_id"), _orphans("memberships", "membership_id", "principal_id", "principals", "principal_id"),
    _orphans("capability_grants", "capability_grant_id", "workspace_id", "workspaces", "workspace_id"), _orphans("capability_grants", "capability_grant_id", "program_id", "programs", "program_id"),
    *(_orphans("capability_grants", "capability_grant_id", c, "principals", "principal_id") for c in ("principal_id", "granted_by_principal_id", "revoked_by_principal_id")),
    _orphans("oidc_identities", "principal_id", "principal_id", "principals", "principal_id"), _orphans("sessions", "session_id", "principal_id", "principals", "principal_id"),
    _orphans("session_rotations", "session_id", "session_id", "sessions", "session_id"), _orphans("chain_heads", "workspace_id", "workspace_id", "workspaces", "workspace_id"),
    _orphans("audit_events", "event_id", "workspace_id", "workspaces", "workspace_id"), _orphans("idempotency_records", "record_id", "workspace_id", "workspaces", "workspace_id"),
    _orphans("idempotency_records", "record_id", "principal_id", "principals", "principal_id"),
]))


def _taken(table: str, key: str, where: str, action: str = "cascade") -> str:
    return f"select '{table}' as table_name, cast({key} as varchar) as row_key, '{action}' as action from bad_{table} where {where}"


#: A workspace refers to its program by the program's and the organization's id: one of another organization is an orphan (C11), and stays.
_IN_PROGRAM = "(program_id, organization_id) in (select program_id, organization_id from bad_programs where program_id = 3)"
_OF_PROGRAM = f"workspace_id in (select workspace_id from bad_workspaces where {_IN_PROGRAM})"
_PROGRAM = "\nunion all ".join([
    _taken("programs", "program_id", "program_id = 3"), _taken("workspaces", "workspace_id", _IN_PROGRAM), _taken("memberships", "membership_id", _OF_PROGRAM),
    _taken("capability_grants", "capability_grant_id", _OF_PROGRAM), _taken("capability_grants", "capability_grant_id", "program_id = 3"), _taken("idempotency_records", "record_id", _OF_PROGRAM),
    _taken("audit_events", "event_id", _OF_PROGRAM, "restrict"), _taken("chain_heads", "workspace_id", _OF_PROGRAM, "restrict"),
])
query("C13_delete_closure", _PROGRAM, *(t for t in _TABLES if t[0] in _PROGRAM))(lambda m: integrity.delete_closure(Spoiled(m.spark, m.sf_dir), "programs", "program_id = 3"))
_PRINCIPAL = "\nunion all ".join([
    *(_taken(t, k, "principal_id = 4") for t, k in (("principals", "principal_id"), ("memberships", "membership_id"), ("capability_grants", "capability_grant_id"), ("oidc_identities", "principal_id"),
                                                    ("sessions", "session_id"), ("idempotency_records", "record_id"))),
    _taken("session_rotations", "session_id", "session_id in (select session_id from bad_sessions where principal_id = 4)"),
    _taken("capability_grants", "capability_grant_id", "principal_id <> 4 and (granted_by_principal_id = 4 or revoked_by_principal_id = 4)", "set_null"),
])
query("C13_delete_principal", _PRINCIPAL, *(t for t in _TABLES if t[0] in _PRINCIPAL))(lambda m: integrity.delete_closure(Spoiled(m.spark, m.sf_dir), "principals", "principal_id = 4"))
_ORGANIZATION = "organization_id = 2"
_PROGRAMS = f"select program_id from bad_programs where {_ORGANIZATION}"
_WORKSPACES = f"select workspace_id from bad_workspaces where {_ORGANIZATION} or (program_id, organization_id) in (select program_id, organization_id from bad_programs where {_ORGANIZATION})"
_OF_ORGANIZATION = "\nunion all ".join([
    _taken("organizations", "organization_id", _ORGANIZATION), _taken("programs", "program_id", _ORGANIZATION), _taken("workspaces", "workspace_id", f"workspace_id in ({_WORKSPACES})"),
    _taken("memberships", "membership_id", f"workspace_id in ({_WORKSPACES})"), _taken("capability_grants", "capability_grant_id", f"workspace_id in ({_WORKSPACES}) or program_id in ({_PROGRAMS})"),
    _taken("idempotency_records", "record_id", f"workspace_id in ({_WORKSPACES})"), _taken("audit_events", "event_id", f"workspace_id in ({_WORKSPACES})", "restrict"),
    _taken("chain_heads", "workspace_id", f"workspace_id in ({_WORKSPACES})", "restrict"),
])
query("C13_delete_organization", _OF_ORGANIZATION, *(t for t in _TABLES if t[0] in _OF_ORGANIZATION))(
    lambda m: integrity.delete_closure(Spoiled(m.spark, m.sf_dir), "organizations", "organization_id = 2")
)
_GUARD = ("principals", "memberships", "capability_grants", "oidc_transactions", "audit_events", "idempotency_records")
query("C18_legacy_guard", "\nunion all ".join(f"select '{t}' as table_name, count(*) > 0 as holds_rows from bad_{t} where {'1 = 0' if t == 'oidc_transactions' else '1 = 1'}" for t in _GUARD), *(t for t in _TABLES if t[0][4:] in _GUARD))(
    lambda m: (lambda tables: integrity.guarded({t: getattr(tables, t).where(F.lit(t != "oidc_transactions")) for t in _GUARD}))(Spoiled(m.spark, m.sf_dir))
)

# --- the catalog, and how the data keeps it ---------------------------------------------------------------------------

#: Every foreign key by hand: child, its columns, parent, its columns, what deleting the parent does.
_KEYS = """programs organization_id organizations organization_id cascade
workspaces organization_id organizations organization_id cascade
workspaces program_id,organization_id programs program_id,organization_id cascade
memberships workspace_id workspaces workspace_id cascade
memberships principal_id principals principal_id cascade
capability_grants workspace_id workspaces workspace_id cascade
capability_grants program_id programs program_id cascade
capability_grants principal_id principals principal_id cascade
capability_grants granted_by_principal_id principals principal_id set_null
capability_grants revoked_by_principal_id principals principal_id set_null
oidc_identities principal_id principals principal_id cascade
sessions principal_id principals principal_id cascade
session_rotations session_id sessions session_id cascade
chain_heads workspace_id workspaces workspace_id restrict
audit_events workspace_id workspaces workspace_id restrict
idempotency_records workspace_id workspaces workspace_id cascade
idempotency_records principal_id principals principal_id cascade"""


def _key_sql(line: str) -> str:
    child, own, parent, theirs, action = line.split()
    pairs = list(zip(own.split(","), theirs.split(",")))
    known, there = " and ".join(f"c.{a} is not null" for a, _ in pairs), " and ".join(f"p.{b} = c.{a}" for a, b in pairs)
    return "\nunion all ".join(
        f"select 'fk_{child}_{own.replace(',', '_')}' as constraint_name, '{child}' as table_name, '{a}' as column_name, {i + 1} as ordinal, '{parent}' as parent_table, '{b}' as parent_column, "
        f"'{action}' as delete_rule, true as in_data, (select count(*) from bad_{child} c where {known}) as held, "
        f"(select count(*) from bad_{child} c where {known} and not exists (select 1 from bad_{parent} p where {there})) as orphans" for i, (a, b) in enumerate(pairs)
    )


_FOREIGN_KEYS = "\nunion all ".join(map(_key_sql, _KEYS.split("\n")))
query("J14_foreign_keys", _FOREIGN_KEYS, *(t for t in _TABLES if t[0] in _FOREIGN_KEYS))(lambda m: catalog.foreign_keys(Spoiled(m.spark, m.sf_dir), m.spark))
_TENANT = ("workspaces", "memberships", "audit_events", "capability_grants", "idempotency_records", "principals", "sessions")
_SECURED = "\nunion all ".join(
    f"select '{t}' as table_name, {'true' if mode else 'false'} as row_security, {repr(t + '_by_workspace') if mode else 'null'} as policy_name, {repr(mode) if mode else 'null'} as mode, count(*) as held, "
    f"{'count(*) filter (workspace_id is null)' if mode == 'strict' else '0'} as shown_to_none, {'count(*) filter (workspace_id is null)' if mode == 'shared' else '0'} as shown_to_all from bad_{t}"
    for t, mode in zip(_TENANT, ("strict", "strict", "strict", "shared", "shared", None, None))
)
query("J14_policies", _SECURED, *(t for t in _TABLES if t[0][4:] in _TENANT))(
    lambda m: (lambda tables: catalog.secured_relations({t: getattr(tables, t) for t in _TENANT}, m.spark))(Spoiled(m.spark, m.sf_dir))
)


def _repeated(table: str, columns: str, where: str = "true") -> str:
    parts = columns.split(",")
    known = " and ".join(f"{c} is not null" for c in parts)
    return (f"select 'uq_{table}_{'_'.join(parts)}' as constraint_name, '{table}' as table_name, '{columns}' as columns, "
            f"(select count(*) from (select 1 from bad_{table} where {known} and {where} group by {columns} having count(*) > 1) k) as repeated")  # fmt: skip


_UNIQUE = "\nunion all ".join([
    _repeated("organizations", "lower(slug)"), _repeated("programs", "organization_id,program_code"), _repeated("workspaces", "program_id,workspace_code"), _repeated("oidc_identities", "issuer,subject"),
    _repeated("sessions", "handle_hash"), _repeated("session_rotations", "session_id,rotation_number"), _repeated("oidc_transactions", "state_hash"), _repeated("audit_events", "workspace_id,sequence"),
    _repeated("audit_events", "workspace_id,event_hash"), _repeated("memberships", "workspace_id,principal_id", "status = 'active'"),
    _repeated("capability_grants", "workspace_id,principal_id,capability_code", "revoked_at is null"), _repeated("capability_grants", "program_id,principal_id,capability_code", "revoked_at is null"),
])
query("M5_unique_keys", _UNIQUE, *(t for t in _TABLES if t[0] in _UNIQUE))(lambda m: catalog.unique_drift(Spoiled(m.spark, m.sf_dir), m.spark))
_VERSIONS = "\nunion all ".join(f"select 'C3_version' as rule, '{t}' as table_name, count(*) as held, count(*) filter (not row_version > 0) as broken from bad_{t}" for t in ("programs", "workspaces", "memberships"))
query("M5_version_checks", _VERSIONS, *(t for t in _TABLES if t[0] in _VERSIONS))(lambda m: catalog.check_drift(Spoiled(m.spark, m.sf_dir)).where("rule = 'C3_version'"))
query("M5_triggers", """select 'append_only' as trigger_name, 'audit_events' as table_name, 'DELETE' as event, count(*) filter (event_id % 40 = 0) as refused from audit_source
  union all select 'append_only', 'audit_events', 'UPDATE', count(*) filter (event_id % 40 = 1) from audit_source
  union all select 'kept_heads', 'chain_heads', 'DELETE', count(distinct workspace_id) filter (workspace_id % 8 = 0) from audit_source
  union all select 'rising_heads', 'chain_heads', 'UPDATE', count(distinct workspace_id) filter (workspace_id % 9 = 0 and workspace_id % 8 <> 0) from audit_source""")(
    lambda m: (lambda e, h: catalog.trigger_refusals({
        "audit_events": integrity.append_only_violations(e, e.where("event_id % 40 != 0").withColumn("action_code", F.when(F.col("event_id") % 40 == 1, "X").otherwise(F.col("action_code"))), "event_id"),
        "chain_heads": integrity.head_violations(h, h.where("workspace_id % 8 != 0").withColumn("last_sequence", F.when(F.col("workspace_id") % 9 == 0, F.col("last_sequence") - 1).otherwise(F.col("last_sequence")))),
    }, m.spark))(m.audit_source, m.audit_source.groupBy("workspace_id").agg(F.max("sequence").cast("long").alias("last_sequence")))
)
_ROLES = """select r.role, t.table_name, case when r.role = 'ops_readonly' then 'SELECT' when t.table_name = 'audit_events' then 'INSERT,SELECT'
  when t.table_name = 'idempotency_records' then 'INSERT,SELECT,UPDATE' else 'DELETE,INSERT,SELECT,UPDATE' end as privileges, t.held
  from (select unnest(['app', 'worker', 'ops_readonly', 'audit_append']) as role) r cross join (""" + "\nunion all ".join(f"select '{t}' as table_name, count(*) as held from bad_{t}" for t in _TENANT) + """) t
  where r.role <> 'audit_append' or t.table_name = 'audit_events'"""
query("M5_roles", _ROLES, *(t for t in _TABLES if t[0][4:] in _TENANT))(
    lambda m: (lambda tables: catalog.role_reach({t: getattr(tables, t) for t in _TENANT}, m.spark))(Spoiled(m.spark, m.sf_dir))
)
