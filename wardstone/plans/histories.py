"""Registered audit-chain, idempotency, session, integrity, mutation, scalar and catalog queries, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..functions.temporal import instant, session_status
from ..operators import access, audit, catalog, integrity, lifecycle, reads
from ..sources.model import AS_OF, SESSION_AT
from .reads import SQL, query

SECRET = b"registered-queries"  # a constant of the queries, not a credential
_AT, _SAT = f"timestamp '{AS_OF}'", f"timestamp '{SESSION_AT}'"


def _hmac_sql(message: str, key: bytes = SECRET) -> str:
    inner, outer = ("".join(f"\\x{b ^ pad:02x}" for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::blob || unhex(sha256('{inner}'::blob || encode({message}))))"


# --- audit chains -----------------------------------------------------------------------------------------------------


def chain_events(m) -> DataFrame:
    return audit.canonicalised(m.audit_source, "metadata").select(
        "workspace_id", F.col("event_id").alias("audit_event_id"), "occurred_at", "action_code", F.lit("system").alias("actor_type"), F.lit("event").alias("entity_type"),
        F.col("event_id").cast("string").alias("entity_id"), F.lit("{}").alias("authority_snapshot"), "metadata",
    )


def chain(m) -> DataFrame:
    return audit.chained(chain_events(m), order=("occurred_at", "audit_event_id"))


_TIME = "replace(strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '')"
_TIME = f"(case when {_TIME} like '%000' and {_TIME} like '%.%' then left({_TIME}, length({_TIME}) - 3) else {_TIME} end) || '+00:00'"
_BODY = f"""'{{"action_code":"' || action_code || '","actor_id":null,"actor_type":"system","after_ref":null,"audit_event_id":"' || event_id || '","authority_snapshot":{{}},"before_ref":null,"correlation_id":null,"entity_id":"'
  || event_id || '","entity_type":"event","entity_version":null,"job_id":null,"metadata":' || replace(metadata, ' ', '') || ',"occurred_at":"' || {_TIME} || '","request_id":null,"sequence":' || sequence
  || ',"source_state_hash":null,"workspace_id":"' || workspace_id || '"}}'"""
_CHAIN = [
    ("bodies", f"select workspace_id, event_id, sequence, {_BODY} as body from audit_source"),
    ("chain", """select workspace_id, event_id, sequence, body, cast(null as varchar) as prev, sha256('\\x00'::blob || encode(body)) as hash from bodies where sequence = 1 union all
      select b.workspace_id, b.event_id, b.sequence, b.body, c.hash, sha256(unhex(c.hash) || '\\x00'::blob || encode(b.body)) from chain c join bodies b
      on b.workspace_id = c.workspace_id and b.sequence = c.sequence + 1"""),
]


def _recursive(key: str, sql: str, *more):
    """As ``query``, for statements that name the chain."""
    def add(build):
        query(key, sql, *_CHAIN, *more)(build)
        SQL[key] = "with recursive" + SQL[key][len("with") :]
        return build

    return add


query("H1_canonical_metadata", "select event_id, replace(metadata, ' ', '') as canonical from audit_source")(
    lambda m: audit.canonicalised(m.audit_source, "metadata").select("event_id", F.col("metadata").alias("canonical"))
)
query("H2_envelopes", "select event_id, body from bodies", _CHAIN[0])(
    lambda m: (lambda e: e.select(F.col("audit_event_id").alias("event_id"), audit.envelope(e).alias("body")))(
        chain_events(m).join(m.audit_source.select(F.col("event_id").alias("audit_event_id"), "sequence"), "audit_event_id"))
)
query("H3_first_hashes", "select event_id, sha256('\\x00'::blob || encode(body)) as hash from bodies", _CHAIN[0])(
    lambda m: (lambda e: e.select(F.col("audit_event_id").alias("event_id"), audit.event_hash(F.lit(None).cast("string"), audit.envelope(e)).alias("hash")))(
        chain_events(m).join(m.audit_source.select(F.col("event_id").alias("audit_event_id"), "sequence"), "audit_event_id"))
)
_recursive("H6_appended_chain", "select workspace_id, event_id, sequence, prev as previous_event_hash, hash as event_hash from chain")(
    lambda m: chain(m).select("workspace_id", F.col("audit_event_id").alias("event_id"), "sequence", "previous_event_hash", "event_hash")
)
_recursive("H7_initialised_heads", """select w.workspace_id, coalesce(h.s, 0) as last_sequence, h.hash as last_event_hash from (select workspace_id from workspaces union select workspace_id from audit_source) w
  left join (select workspace_id, max(sequence) as s, arg_max(hash, sequence) as hash from chain group by 1) h on w.workspace_id = h.workspace_id""")(
    lambda m: audit.initialised_heads(audit.chain_heads(chain(m)), m.workspaces)
)
_recursive("S16_chain_head", "select workspace_id, max(sequence) as last_sequence, arg_max(hash, sequence) as last_event_hash from chain where workspace_id = 5 group by workspace_id")(
    lambda m: audit.chain_heads(audit.chained(chain_events(m).where("workspace_id = 5"), order=("occurred_at", "audit_event_id")))
)
_recursive("H8_head_mismatches", "select distinct workspace_id from audit_source where workspace_id % 9 = 0")(
    lambda m: (lambda c: audit.head_mismatches(audit.chain_heads(c.where("workspace_id % 9 != 0 or sequence > 1")).withColumn("last_sequence", F.when(F.col("workspace_id") % 9 == 0, 0).otherwise(F.col("last_sequence"))), c))(chain(m))
)
_ERRORS = """select workspace_id, sequence, i, case when sequence < i + 1 then 'SequenceDisorder' when sequence > i + 1 then 'SequenceGap' when prev is distinct from prior then 'PreviousHashMismatch'
  when own <> hash then 'HashTamperDetected' end as kind from (select *, sha256(coalesce(unhex(prior), ''::blob) || '\\x00'::blob || encode(body)) as own from
  (select *, row_number() over w - 1 as i, lag(hash) over w as prior from changed window w as (partition by workspace_id order by sequence, event_id)) a) b"""
_VERIFIED = f"""select workspace_id, count(*) as events, count(kind) = 0 as intact, arg_min(kind, i) filter (where kind is not null) as kind, min(i) filter (where kind is not null) as index,
  arg_min(sequence, i) filter (where kind is not null) as sequence from ({_ERRORS}) e group by workspace_id"""


def _verified(df: DataFrame) -> DataFrame:
    return audit.verified(df).select("workspace_id", "events", "intact", "kind", "index", "sequence")


_recursive("H4_event_hash_matches", f"select workspace_id, sequence, i as index, kind from ({_ERRORS}) e", ("changed", "select * replace (case when event_id % 50 = 1 then sequence + 1000 else sequence end as sequence) from chain"))(
    lambda m: audit.event_errors(chain(m).withColumn("sequence", F.when(F.col("audit_event_id") % 50 == 1, F.col("sequence") + 1000).otherwise(F.col("sequence")))).select("workspace_id", "sequence", "index", "kind")
)
_recursive("H5_chain_verify", _VERIFIED, ("changed", "select * from chain"))(lambda m: _verified(chain(m)))
_recursive("H5_chain_verify_tampered", _VERIFIED, ("changed", "select * replace (case when event_id % 97 = 0 then replace(body, 'CLICK', 'CLICKED') else body end as body) from chain"))(
    lambda m: _verified(chain(m).withColumn("body", F.when(F.col("audit_event_id") % 97 == 0, F.replace("body", F.lit("CLICK"), F.lit("CLICKED"))).otherwise(F.col("body"))))
)
_recursive("H5_chain_verify_gap", _VERIFIED, ("changed", "select * replace (case when sequence >= 50 then sequence + 1 else sequence end as sequence) from chain"))(
    lambda m: _verified(chain(m).withColumn("sequence", F.when(F.col("sequence") >= 50, F.col("sequence") + 1).otherwise(F.col("sequence"))))
)
_recursive("H5_chain_verify_disorder", _VERIFIED, ("changed", "select * from chain union all select * from chain where sequence % 61 = 0"))(
    lambda m: (lambda c: _verified(c.unionByName(c.where("sequence % 61 = 0"))))(chain(m))
)
_LIST = """select workspace_id, sequence, i as index, case when workspace_id <> 5 then 'WorkspaceMismatch' when sequence < i + 1 then 'SequenceDisorder' when sequence > i + 1 then 'SequenceGap'
  when prev is distinct from prior then 'PreviousHashMismatch' when own <> hash then 'HashTamperDetected' end as kind from (select *, sha256(coalesce(unhex(prior), ''::blob) || '\\x00'::blob || encode(body)) as own from
  (select *, row_number() over w - 1 as i, lag(hash) over w as prior from chain where workspace_id in (5, 6) window w as (order by sequence, event_id)) a) b"""
_recursive("H5_list_of_two_workspaces", _LIST)(
    lambda m: audit.event_errors(audit.chained(chain_events(m).where("workspace_id in (5, 6)"), order=("occurred_at", "audit_event_id")), partitioned=False, expected_workspace=5)
    .select("workspace_id", "sequence", "index", "kind")
)
_stamp = lambda c: _TIME.replace("occurred_at", c)
query("H9_grant_audit_payloads", f"""select workspace_id, 'CAPABILITY_GRANT' as action_code, cast(capability_grant_id as varchar) as entity_id, 1 as entity_version, '{{"capability":"' || capability_code || '","expires_at":'
  || case when expires_at is null then 'null' else '"' || {_stamp('expires_at')} || '"' end || ',"grant_id":"' || capability_grant_id || '","granted_by":null,"principal_id":"' || principal_id || '","workspace_id":"' || workspace_id
  || '"}}' as after_ref from capability_grants where workspace_id is not null""")(
    lambda m: audit.audited(m.capability_grants.where("workspace_id is not null"), "CAPABILITY_GRANT", "capability_grant", "capability_grant_id", F.lit(1), audit.grant_payload(F.lit(None)))
    .select("workspace_id", "action_code", "entity_id", "entity_version", "after_ref")
)

_event = lambda action, entity, key, version, pairs, before="null": (  # noqa: E731  pairs: (key, SQL of its JSON), sorted
    f"select workspace_id, '{action}' as action_code, '{entity}' as entity_type, cast({key} as varchar) as entity_id, {version} as entity_version, {before} as before_ref, '{{' || "
    + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in pairs) + " || '}' as after_ref"
)
_str = lambda c: f"""'"' || {c} || '"'"""
_COLUMNS = ("workspace_id", "action_code", "entity_type", "entity_id", "entity_version", "before_ref", "after_ref")
query("H9_workspace_audit_payloads", _event("WORKSPACE_CREATE", "workspace", "workspace_id", "row_version", [(c, _str(c)) for c in ("name", "organization_id", "program_id", "workspace_code", "workspace_id")]) + " from workspaces")(
    lambda m: audit.audited(m.workspaces, "WORKSPACE_CREATE", "workspace", "workspace_id", F.col("row_version"), audit.workspace_payload()).select(*_COLUMNS)
)
query("H9_membership_audit_payloads", _event("MEMBERSHIP_CREATE", "membership", "membership_id", "row_version", [("membership_id", _str("membership_id")), ("principal_id", _str("principal_id")), ("role", _str("role_code")), ("workspace_id", _str("workspace_id"))]) + " from memberships where role_code = 'admin'")(
    lambda m: audit.audited(m.memberships.where("role_code = 'admin'"), "MEMBERSHIP_CREATE", "membership", "membership_id", F.col("row_version"), audit.membership_payload()).select(*_COLUMNS)
)
query("H9_role_audit_payloads", _event("MEMBERSHIP_UPDATE_ROLE", "membership", "membership_id", "row_version + 1", [
    ("membership_id", _str("membership_id")), ("new_role", "'\"reviewer\"'"), ("old_role", _str("role_code")), ("principal_id", _str("principal_id")), ("workspace_id", _str("workspace_id"))],
    "'{\"role\":\"' || role_code || '\"}'") + ", case when principal_id % 2 = 0 then 'principal' else 'system' end as actor_type from memberships")(
    lambda m: audit.audited(
        m.memberships.withColumns({"new_role": F.lit("reviewer"), "actor": F.when(F.col("principal_id") % 2 == 0, F.col("principal_id"))}), "MEMBERSHIP_UPDATE_ROLE", "membership", "membership_id",
        F.col("row_version") + 1, audit.role_payload("role_code", "new_role"), before=audit.role_before("role_code"), actor="actor").select(*_COLUMNS, "actor_type")
)
query("H9_revoke_audit_payloads", _event("CAPABILITY_REVOKE", "capability_grant", "capability_grant_id", "2", [
    ("capability", _str("capability_code")), ("grant_id", _str("capability_grant_id")), ("principal_id", _str("principal_id")), ("revoked_at", _str(_stamp("revoked_at"))), ("workspace_id", _str("workspace_id"))])
    + " from capability_grants where workspace_id is not null and revoked_at is not null")(
    lambda m: audit.audited(m.capability_grants.where("workspace_id is not null and revoked_at is not null"), "CAPABILITY_REVOKE", "capability_grant", "capability_grant_id", F.lit(2), audit.revoke_payload(F.col("revoked_at")))
    .select(*_COLUMNS)
)

# --- idempotency ------------------------------------------------------------------------------------------------------


def log(m) -> DataFrame:
    return m.request_log.withColumn("key_hash", x.hmac_sha256_hex(SECRET, "raw_key")).withColumn("request_hash", x.sha256_hex("request_body"))


_LOG = [("log", f"select *, {_hmac_sql('raw_key')} as key_hash, sha256(request_body) as request_hash from request_log")]
_KEYED = "partition by workspace_id, principal_id, route_code, key_hash order by requested_at, request_id"
query("I1_key_hashes", "select request_id, key_hash from log", *_LOG)(lambda m: log(m).select("request_id", "key_hash"))
query("I2_request_hashes", "select request_id, request_hash from log", *_LOG)(lambda m: log(m).select("request_id", "request_hash"))
query("I6_replayed_log", f"""select request_id, case when row_number() over ({_KEYED}) = 1 then 'Acquired' when request_hash = first(request_hash) over ({_KEYED}) then 'Replay' else 'Mismatch' end as outcome from log""", *_LOG)(
    lambda m: lifecycle.replayed_log(log(m)).select("request_id", "outcome")
)
_RECORDS = ("records", f"""select request_id as record_id, workspace_id, principal_id, route_code, key_hash, request_hash, case when request_id % 3 = 0 then 200 + request_id % 5 end as response_status,
  case when request_id % 3 = 0 then 'done' end as response_body, requested_at + interval 1 days as expires_at from (select *, row_number() over ({_KEYED}) as rn from log) q where rn = 1""")  # fmt: skip


def records(m) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*lifecycle.KEY).orderBy("requested_at", "request_id"))
    rows, done = log(m).withColumn("__n", place).where("__n = 1"), F.col("request_id") % 3 == 0
    return rows.select(
        F.col("request_id").alias("record_id"), *lifecycle.KEY, "request_hash", F.when(done, 200 + F.col("request_id") % 5).alias("response_status"), F.when(done, "done").alias("response_body"),
        (F.col("requested_at") + F.expr("interval 1 days")).alias("expires_at"),
    )


query("I3_arbitration", f"""select q.request_id, case when r.record_id is null then 'Acquired' when q.request_hash <> r.request_hash then 'Mismatch' when r.response_status is not null then 'Replay'
  when r.expires_at < {_SAT} then 'Acquired' else 'InProgress' end as outcome from log q left join records r on q.workspace_id is not distinct from r.workspace_id and q.principal_id = r.principal_id
  and q.route_code = r.route_code and q.key_hash = r.key_hash and r.record_id % 2 = 0""", *_LOG, _RECORDS)(
    lambda m: lifecycle.arbitrated(log(m), records(m).where("record_id % 2 = 0"), instant(SESSION_AT)).select("request_id", "outcome")
)
query("I4_completed_once", "select record_id, case when response_status is null and record_id % 2 = 0 then 201 else response_status end as response_status from records", *_LOG, _RECORDS)(
    lambda m: lifecycle.completed(records(m), records(m).where("record_id % 2 = 0").select("record_id", F.lit(201).cast("long").alias("status"), F.lit("late").alias("body"))).select("record_id", "response_status")
)
query("I5_failed_removed", "select record_id from records where not (record_id % 2 = 0 and response_status is null)", *_LOG, _RECORDS)(
    lambda m: lifecycle.failed(records(m), records(m).where("record_id % 2 = 0").select("record_id")).select("record_id")
)
query("S17_record_by_id", "select * from records where record_id = 11", *_LOG, _RECORDS)(lambda m: reads.lookup(records(m), record_id=11))
_STEPS = [
    *_LOG, ("placed", "select request_id, request_hash, requested_at, dense_rank() over (order by workspace_id, principal_id, route_code, key_hash) as k from log"),
    ("steps", "select *, row_number() over (partition by k order by requested_at, request_id) as n from placed"),
    ("arbitrated", """select k, n, request_id, request_hash as held, requested_at + interval 1 days as until, 'Acquired' as outcome from steps where n = 1 union all
      select s.k, s.n, s.request_id, a.held, case when a.held = s.request_hash and a.until < s.requested_at then s.requested_at + interval 1 days else a.until end,
      case when a.held <> s.request_hash then 'Mismatch' when a.until < s.requested_at then 'Acquired' else 'InProgress' end from arbitrated a join steps s on s.k = a.k and s.n = a.n + 1"""),
]
query("I6_replayed_log_ttl", "select request_id, outcome from arbitrated", *_STEPS)(lambda m: lifecycle.replayed_log_ttl(log(m), 86_400))
SQL["I6_replayed_log_ttl"] = "with recursive" + SQL["I6_replayed_log_ttl"][len("with") :]

# --- sessions ---------------------------------------------------------------------------------------------------------

_ACT = ("act", f"""select session_id, principal_id, row_number() over (partition by principal_id order by created_at, session_id) as position, count(*) over (partition by principal_id) as n from sessions
  where revoked_at is null and created_at <= {_SAT} and {_SAT} < idle_expires_at and {_SAT} < absolute_expires_at""")  # fmt: skip
query("L1_evicted_sessions", "select principal_id, session_id, position from act where position <= n + 1 - 2", _ACT)(lambda m: lifecycle.evicted_sessions(m.sessions, instant(SESSION_AT), 2))
query("L2_opened_sessions", f"""select session_id, principal_id, case when session_id in (select session_id from act where position <= n + 1 - 2 and principal_id % 2 = 0) then {_SAT} else revoked_at end as revoked_at from sessions
  union all select 'new-' || cast(principal_id as varchar), principal_id, null from principals where principal_id % 2 = 0""", _ACT)(
    lambda m: lifecycle.opened(m.sessions.select("session_id", "principal_id", "created_at", "idle_expires_at", "absolute_expires_at", "revoked_at"), m.principals.where("principal_id % 2 = 0").select(
        F.concat(F.lit("new-"), F.col("principal_id").cast("string")).alias("session_id"), "principal_id", instant(SESSION_AT).alias("created_at"), instant(SESSION_AT).alias("idle_expires_at"),
        instant(SESSION_AT).alias("absolute_expires_at"), F.lit(None).cast("timestamp_ntz").alias("revoked_at")), instant(SESSION_AT), 2).select("session_id", "principal_id", "revoked_at")
)


def _changes(m) -> DataFrame:
    return m.sessions.where("rotation_counter = 1").select("session_id", x.sha256_hex("session_id").alias("new_hash"), F.lit("periodic").alias("reason"))


query("L3_rotated_sessions", f"""select session_id, case when rotation_counter = 1 then H(session_id) else handle_hash end as handle_hash, case when rotation_counter = 1 then 2 else rotation_counter end as rotation_counter,
  case when rotation_counter = 1 then {_SAT} + interval 12 hours else idle_expires_at end as idle_expires_at from sessions""")(
    lambda m: lifecycle.rotated(m.sessions, _changes(m), instant(SESSION_AT))[0].select("session_id", "handle_hash", "rotation_counter", "idle_expires_at")
)
query("L3_rotation_rows", "select session_id, 2 as rotation_number, handle_hash as old_handle_hash, H(session_id) as new_handle_hash, 'periodic' as reason from sessions where rotation_counter = 1")(
    lambda m: lifecycle.rotated(m.sessions, _changes(m), instant(SESSION_AT))[1]
)
query("L4_revoked_sessions", f"select session_id, case when rotation_counter = 2 then coalesce(revoked_at, {_SAT}) else revoked_at end as revoked_at from sessions")(
    lambda m: lifecycle.revoked_sessions(m.sessions, m.sessions.where("rotation_counter = 2"), instant(SESSION_AT)).select("session_id", "revoked_at")
)
_ALIVE = f"revoked_at is null and {_SAT} < idle_expires_at and {_SAT} < absolute_expires_at"
query("L5_session_actions", f"""select session_id, case when not ({_ALIVE}) then 'reject' when rotation_counter = 3 then 'rotate:manual_refresh' when {_SAT} - created_at >= interval 4 hours then 'rotate:periodic'
  when {_SAT} - last_seen_at >= interval 5 minutes then 'touch' else 'none' end as action from sessions""")(
    lambda m: m.sessions.select("session_id", lifecycle.session_action(instant(SESSION_AT), F.col("rotation_counter") == 3).alias("action"))
)
query("L6_touched_sessions", f"select session_id, case when {_ALIVE} then {_SAT} else last_seen_at end as last_seen_at, case when {_ALIVE} then {_SAT} + interval 12 hours else idle_expires_at end as idle_expires_at from sessions")(
    lambda m: lifecycle.touched(m.sessions, instant(SESSION_AT)).select("session_id", "last_seen_at", "idle_expires_at")
)
query("L7_rotation_breaks", """select session_id, rotation_number, broken from (select *, case when n is null then case when rotation_number <> 1 then 'gap' end when rotation_number <> n + 1 then 'gap'
  when old_handle_hash <> h then 'hash' end as broken from (select *, lag(rotation_number) over w as n, lag(new_handle_hash) over w as h from (select * replace (case when (session_id + rotation_number) % 7 = 0 then rotation_number + 1000 else rotation_number end
  as rotation_number) from session_rotations) r window w as (partition by session_id order by rotation_number)) a) b where broken is not null""")(
    lambda m: lifecycle.rotation_breaks(m.session_rotations.withColumn("rotation_number", F.expr("case when (session_id + rotation_number) % 7 = 0 then rotation_number + 1000 else rotation_number end")))
)

query("P5_session_view", f"""select session_id as id, principal_id, case when revoked_at is not null then 'revoked' when {_SAT} >= idle_expires_at or {_SAT} >= absolute_expires_at then 'expired' else 'active' end as status,
  created_at, {_hmac_sql("'csrf-v1:' || session_id || ':https://a.example'")} as csrf_token from sessions""")(
    lambda m: m.sessions.select(F.col("session_id").alias("id"), "principal_id", session_status(instant(SESSION_AT)).alias("status"), "created_at", x.csrf_token(SECRET, "session_id", F.lit("https://a.example")).alias("csrf_token"))
)

# --- integrity --------------------------------------------------------------------------------------------------------

query("C12_append_only", "select cast(event_id as varchar) as row_key, case when event_id % 50 = 0 then 'deleted' else 'updated' end as change from audit_source where event_id % 50 = 0 or event_id % 97 = 0")(
    lambda m: integrity.append_only_violations(
        m.audit_source, m.audit_source.where("event_id % 50 != 0").withColumn("metadata", F.when(F.col("event_id") % 97 == 0, "{}").otherwise(F.col("metadata"))), "event_id")
)
query("C12_heads", "select cast(workspace_id as varchar) as row_key, case when workspace_id % 8 = 0 then 'deleted' else 'decreased' end as change from audit_source where workspace_id % 8 = 0 or workspace_id % 9 = 0 group by workspace_id")(
    lambda m: (lambda h: integrity.head_violations(h, h.where("workspace_id % 8 != 0").withColumn("last_sequence", F.when(F.col("workspace_id") % 9 == 0, F.col("last_sequence") - 1).otherwise(F.col("last_sequence")))))(
        m.audit_source.groupBy("workspace_id").agg(F.max("sequence").cast("long").alias("last_sequence")))
)
_NAMES = ("names", """select workspace_id, case workspace_id % 5 when 0 then workspace_code when 1 then name when 2 then '  ' when 3 then ' ' || workspace_code || ' ' else 'a_b-' || cast(workspace_id as varchar(20)) end as raw from workspaces""")


def names(m) -> DataFrame:
    return m.workspaces.select("workspace_id", F.expr(_NAMES[1].split("select workspace_id, ")[1].split(" as raw")[0].replace("varchar(20)", "string")).alias("raw"))


query("C14_slug_errors", "select workspace_id, case when trim(raw) = '' then 'empty' when not regexp_full_match(trim(raw), '[a-z0-9_-]+') then 'bad_character' end as error from names", _NAMES)(
    lambda m: names(m).select("workspace_id", x.slug_error("raw").alias("error"))
)
query("C15_trimmed", "select workspace_id, trim(raw) as trimmed from names", _NAMES)(lambda m: names(m).select("workspace_id", x.unicode_trim("raw").alias("trimmed")))
query("C16_rotation_errors", """select session_id, rotation_number, case when rotation_number % 5 = 0 then 'identical' end as error, case when rotation_number % 3 = 0 then 'periodic' else reason end as reason from session_rotations""")(
    lambda m: m.session_rotations.select("session_id", "rotation_number", *integrity.rotation_error(
        "old_handle_hash", F.when(F.col("rotation_number") % 5 == 0, F.col("old_handle_hash")).otherwise(F.col("new_handle_hash")), F.when(F.col("rotation_number") % 3 == 0, " ").otherwise(F.col("reason"))))
)
query("C17_blank_defaults", "select workspace_id, case when trim(raw) = '' then '/' else trim(raw) end as return_path, case when trim(raw) <> '' then trim(raw) end as email from names", _NAMES)(
    lambda m: names(m).select("workspace_id", integrity.return_path("raw").alias("return_path"), integrity.blank_to_null("raw").alias("email"))
)

_NEW = "timestamp '2024-01-20 00:00:00'"
query("C17_new_sessions", f"""select session_id, case when k = 1 then 'empty_handle_hash' when k = 2 then 'empty_csrf_secret_hash' when not idle_expires_at > {_NEW} then 'idle_expires_at_not_in_future'
  when not absolute_expires_at > {_NEW} then 'absolute_expires_at_not_in_future' end as error from (select *, rotation_counter as k from sessions) s""")(
    lambda m: m.sessions.withColumns({"csrf_secret_hash": F.when(F.col("rotation_counter") == 2, "").otherwise("c"), "handle_hash": F.when(F.col("rotation_counter") != 1, F.col("handle_hash"))})
    .select("session_id", integrity.session_error(instant("2024-01-20 00:00:00")).alias("error"))
)
query("C17_new_transactions", f"""select oidc_transaction_id, case oidc_transaction_id % 5 when 1 then 'empty_state_hash' when 2 then 'empty_nonce_hash' else case when not expires_at > {_NEW} then 'expires_at_not_in_future' end end as error
  from oidc_transactions""")(
    lambda m: m.oidc_transactions.withColumns({"state_hash": F.when(F.col("oidc_transaction_id") % 5 != 1, F.col("state_hash")).otherwise(""), "nonce_hash": F.when(F.col("oidc_transaction_id") % 5 != 2, "n")})
    .select("oidc_transaction_id", integrity.transaction_error(instant("2024-01-20 00:00:00")).alias("error"))
)
query("C17_new_identities", """select principal_id, case principal_id % 4 when 1 then 'empty_issuer' when 2 then 'empty_subject' end as error, case when principal_id % 4 = 1 then '' else issuer end as issuer,
  case when principal_id % 4 = 2 then '' else subject end as subject, case when principal_id % 3 = 0 then 'a@b' end as email from oidc_identities""")(
    lambda m: m.oidc_identities.select(
        "principal_id", F.expr("case when principal_id % 4 = 1 then '\\t ' else concat(' ', issuer, '\\n') end").alias("issuer"), F.expr("case when principal_id % 4 = 2 then ' ' else concat(subject, ' ') end").alias("subject"),
        F.expr("case principal_id % 3 when 0 then ' a@b' when 1 then '  ' end").alias("email")).select("principal_id", *integrity.identity_fields())
)

# --- mutations --------------------------------------------------------------------------------------------------------

query("U1_inserted_programs", "select program_id, name from programs union all select 100, 'NEW'")(
    lambda m: lifecycle.inserted(m.programs.select("program_id", "name"), m.spark.createDataFrame([(3, "TAKEN"), (100, "NEW")], "program_id int, name string"), "program_id")
)
query("U2_updated_principals", "select principal_id, case when principal_id % 4 = 0 then 'renamed' else display_name end as display_name, case when principal_id % 4 = 0 then 'suspended' else status end as status from principals")(
    lambda m: lifecycle.updated(m.principals, m.principals.where("principal_id % 4 = 0").select("principal_id", F.lit("renamed").alias("display_name"), F.lit("suspended").alias("status")), "principal_id", ["display_name", "status"])
    .select("principal_id", "display_name", "status")
)
query("U3_changed_roles", "select membership_id, case when membership_id % 10 = 0 then 'reviewer' else role_code end as role_code, case when membership_id % 10 = 0 then 2 else 1 end as row_version from memberships")(
    lambda m: lifecycle.updated(m.memberships, m.memberships.where("membership_id % 10 = 0").select("membership_id", F.lit("reviewer").alias("role_code")), "membership_id", ["role_code"], bump="row_version")
    .select("membership_id", "role_code", "row_version")
)
query("U4_revoked_grants", f"""select capability_grant_id, case when hit then {_AT} else revoked_at end as revoked_at, case when hit then principal_id end as revoked_by_principal_id,
  case when hit and capability_grant_id % 2 = 0 then 'left' else old end as grant_reason from (select *, capability_grant_id % 3 = 0 and revoked_at is null as hit, case when capability_grant_id % 5 = 0 then 'seed' end as old
  from capability_grants) g""")(
    lambda m: (lambda g: lifecycle.revoked_grants(
        g, g.where("capability_grant_id % 3 = 0").select("capability_grant_id", F.col("principal_id").alias("revoked_by"), F.when(F.col("capability_grant_id") % 2 == 0, "left").alias("reason")), instant(AS_OF)))(
        m.capability_grants.withColumns({"revoked_by_principal_id": F.lit(None).cast("long"), "grant_reason": F.when(F.col("capability_grant_id") % 5 == 0, "seed")}))
    .select("capability_grant_id", "revoked_at", "revoked_by_principal_id", "grant_reason")
)
query("U5_extended_grants", f"select capability_grant_id, case when capability_grant_id % 5 = 0 then {_AT} else expires_at end as expires_at from capability_grants")(
    lambda m: lifecycle.updated(m.capability_grants, m.capability_grants.where("capability_grant_id % 5 = 0").select("capability_grant_id", instant(AS_OF).alias("expires_at")), "capability_grant_id", ["expires_at"])
    .select("capability_grant_id", "expires_at")
)
_U6 = ("handle_hash", "csrf_secret_hash", "last_seen_at", "idle_expires_at", "absolute_expires_at", "revoked_at", "rotation_counter")
query("U6_updated_sessions", f"""select session_id, case when hit then H('n' || session_id) else handle_hash end as handle_hash, case when hit then H('d' || session_id) else H('c' || session_id) end as csrf_secret_hash,
  case when hit then {_SAT} else last_seen_at end as last_seen_at, case when hit then {_SAT} + interval 12 hours else idle_expires_at end as idle_expires_at, case when hit then {_SAT} + interval 7 days else absolute_expires_at end
  as absolute_expires_at, case when hit then null else revoked_at end as revoked_at, case when hit then 9 else rotation_counter end as rotation_counter from (select *, rotation_counter = 0 as hit from sessions) s""")(
    lambda m: (lambda s: lifecycle.updated(s, s.where("rotation_counter = 0").select(
        "session_id", x.sha256_hex(F.concat(F.lit("n"), "session_id")).alias("handle_hash"), x.sha256_hex(F.concat(F.lit("d"), "session_id")).alias("csrf_secret_hash"), instant(SESSION_AT).alias("last_seen_at"),
        (instant(SESSION_AT) + F.expr("interval 12 hours")).alias("idle_expires_at"), (instant(SESSION_AT) + F.expr("interval 7 days")).alias("absolute_expires_at"),
        F.lit(None).cast("timestamp_ntz").alias("revoked_at"), F.lit(9).alias("rotation_counter")), "session_id", list(_U6)))(m.sessions.withColumn("csrf_secret_hash", x.sha256_hex(F.concat(F.lit("c"), "session_id"))))
    .select("session_id", *_U6)
)
query("U7_revoked_by_principal", f"select session_id, case when principal_id in (4, 5) then coalesce(revoked_at, {_SAT}) else revoked_at end as revoked_at from sessions")(
    lambda m: lifecycle.revoked_by_principal(m.sessions, m.principals.where("principal_id in (4, 5)"), instant(SESSION_AT))[0].select("session_id", "revoked_at")
)
query("U7_revoked_counts", "select p.principal_id, count(s.session_id) as affected from principals p left join sessions s on s.principal_id = p.principal_id and s.revoked_at is null group by p.principal_id")(
    lambda m: lifecycle.revoked_by_principal(m.sessions, m.principals, instant(SESSION_AT))[1]
)
query("U8_last_logins", f"select principal_id, case when principal_id % 2 = 0 then {_SAT} end as last_login_at from oidc_identities")(
    lambda m: lifecycle.updated(m.oidc_identities.withColumn("last_login_at", F.lit(None).cast("timestamp_ntz")), m.oidc_identities.where("principal_id % 2 = 0").select("principal_id", instant(SESSION_AT).alias("last_login_at")), "principal_id", ["last_login_at"])
    .select("principal_id", "last_login_at")
)
query("U9_consumed_transactions", """select attempt_id, oidc_transaction_id, fits and row_number() over (partition by oidc_transaction_id order by case when fits then 0 else 1 end, tried, attempt_id) = 1 as consumed from
  (select a.*, coalesce(consumed_at is null and tried < expires_at, false) as fits from (select oidc_transaction_id * 2 + k as attempt_id, oidc_transaction_id, created_at + interval '1' minute * (oidc_transaction_id % 14 + k) as tried
  from oidc_transactions, (select 0 as k union all select 1) z) a join oidc_transactions t on a.oidc_transaction_id = t.oidc_transaction_id) q""")(
    lambda m: lifecycle.consumed_transactions(m.oidc_transactions, m.oidc_transactions.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.col("oidc_transaction_id") * 2 + F.col("k")).alias("attempt_id"), "oidc_transaction_id", (F.col("created_at") + F.make_dt_interval(mins=(F.col("oidc_transaction_id") % 14 + F.col("k")).cast("int"))).alias("at")))
    .select("attempt_id", "oidc_transaction_id", "consumed")
)
query("U10_deleted_transactions", "select oidc_transaction_id from oidc_transactions where oidc_transaction_id % 3 <> 0")(
    lambda m: lifecycle.deleted(m.oidc_transactions, m.oidc_transactions.where("oidc_transaction_id % 3 = 0"), "oidc_transaction_id").select("oidc_transaction_id")
)
query("U11_revoked_memberships", "select membership_id, case when principal_id = 5 then 'revoked' else status end as status, case when principal_id = 5 then 2 else 1 end as row_version from memberships")(
    lambda m: lifecycle.updated(m.memberships, m.memberships.where("principal_id = 5").select("membership_id", F.lit("revoked").alias("status")), "membership_id", ["status"], bump="row_version")
    .select("membership_id", "status", "row_version")
)

_MOVES = "case principal_id % 4 when 0 then 'active' when 1 then 'suspended' else 'deactivated' end"
query("U11_principal_states", f"select principal_id, case when principal_id % 4 < 3 then {_MOVES} else status end as status from principals")(
    lambda m: lifecycle.updated(m.principals, m.principals.where("principal_id % 4 < 3").select("principal_id", F.expr(_MOVES).alias("status")), "principal_id", ["status"]).select("principal_id", "status")
)
query("U11_suspended_memberships", "select membership_id, case when principal_id = 6 then 'suspended' else status end as status, case when principal_id = 6 then 2 else 1 end as row_version from memberships")(
    lambda m: lifecycle.updated(m.memberships, m.memberships.where("principal_id = 6").select("membership_id", F.lit("suspended").alias("status")), "membership_id", ["status"], bump="row_version")
    .select("membership_id", "status", "row_version")
)
for _t, _key, _code in (("programs", "program_id", "program_code"), ("workspaces", "workspace_id", "workspace_code")):
    query(f"U11_renamed_{_t}", f"""select {_key}, case when {_key} % 4 = 0 then 'New ' || name else name end as name, case when {_key} % 4 = 0 then 'new-' || cast({_key} as varchar) else {_code} end as {_code},
      case when {_key} % 4 = 0 then 2 else 1 end as row_version, case {_key} % 4 when 1 then 'empty_name' when 2 then 'bad_character' end as error from {_t}""")(
        lambda m, t=_t, key=_key, code=_code: (lambda df: lifecycle.renamed(df, df.where(f"{key} % 4 < 3").select(
            key, F.expr(f"case {key} % 4 when 1 then ' ' else concat(' New ', name) end").alias("name"), F.expr(f"concat(case {key} % 4 when 2 then 'New ' else 'new-' end, {key})").alias(code)), key, code))(getattr(m, t))
        .select(key, "name", code, "row_version", "error")
    )

# --- scalars ----------------------------------------------------------------------------------------------------------

query("X1_handle_hashes", f"select event_id, {_hmac_sql('trim(action_code)')} as hash from audit_source")(
    lambda m: m.audit_source.select("event_id", x.handle_hash(SECRET, F.concat(F.lit(" "), F.col("action_code"), F.lit(" "))).alias("hash"))
)
_csrf = "'csrf-v1:' || cast(event_id as varchar) || ':https://a.example'"
query("X2_csrf_tokens", f"select event_id, {_hmac_sql(_csrf)} as token from audit_source")(
    lambda m: m.audit_source.select("event_id", x.csrf_token(SECRET, F.col("event_id").cast("string"), F.lit("https://a.example")).alias("token"))
)
_URLS = ("urls", "select page_id, case page_id % 6 when 0 then upper(url) when 1 then 'null' when 2 then '' when 3 then 'https://Host.example:443/x' when 4 then 'http://[::1]:8080/x' else url end as raw from pages")
_SCHEME, _HOST, _PORT = ("regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)", "regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^]]*\\]|[^/?#:@]+)', 1)",
                         "regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\\[[^]]*\\]|[^/?#:@]+):([0-9]+)', 1)")


def urls(m) -> DataFrame:
    pages = m.spark.read.parquet(f"{m.sf_dir}/pages.parquet")
    return pages.select("page_id", F.expr(_URLS[1].split("select page_id, ")[1].split(" as raw")[0]).alias("raw"))


query("X3_origins", f"""select page_id, case when {_SCHEME} <> '' and {_HOST} <> '' then lower({_SCHEME}) || '://' || lower({_HOST}) || case when {_PORT} = '' or lower({_SCHEME}) || ':' || {_PORT} in
  ('http:80', 'https:443') then '' else ':' || {_PORT} end end as origin from urls""", _URLS)(lambda m: urls(m).select("page_id", x.canonical_origin("raw").alias("origin")))  # fmt: skip
query("X4_csrf_decisions", """select event_id, case when event_id % 5 = 0 then 'safe_method' when event_id % 3 = 0 then 'no_cookie' when event_id % 7 = 0 then 'origin_missing' when event_id % 4 = 0 then 'origin_mismatch'
  when event_id % 11 = 0 then 'header_missing' when event_id % 13 = 0 then 'token_mismatch' else 'ok' end as outcome from audit_source""")(
    lambda m: m.audit_source.select("event_id", x.csrf_decision(
        F.when(F.col("event_id") % 5 == 0, "get").otherwise("post"), F.col("event_id") % 3 != 0, F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 4 == 0, "https://b.example").otherwise("https://A.example:443/")),
        F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.when(F.col("event_id") % 13 == 0, "t2").otherwise("t1")), ("HTTPS://a.example:443/", "null"), F.lit("t1")).alias("outcome"))
)
query("X5_pkce", "select event_id, replace(replace(rtrim(to_base64(unhex(sha256(v))), '='), '+', '-'), '/', '_') as challenge from (select event_id, sha256(cast(event_id as varchar)) as v from audit_source) q")(
    lambda m: m.audit_source.select("event_id", x.pkce_challenge(x.sha256_hex(F.col("event_id").cast("string"))).alias("challenge"))
)
query("X6_state_hashes", "select event_id, sha256('st' || cast(event_id as varchar)) as hash from audit_source")(lambda m: m.audit_source.select("event_id", x.sha256_hex(F.concat(F.lit("st"), F.col("event_id").cast("string"))).alias("hash")))
_FIELDS = ("fields", "select event_id, case event_id % 6 when 0 then 'Authorization' when 1 then 'X-API-KEY' when 2 then 'cui_content' when 3 then 'content-type' when 4 then 'user_password' else 'accept' end as k, action_code as v from audit_source")


def fields(m) -> DataFrame:
    return m.audit_source.select("event_id", F.expr(_FIELDS[1].split("select event_id, ")[1].split(" as k")[0]).alias("k"), F.col("action_code").alias("v"))


query("X7_sensitive_keys", "select event_id, event_id % 6 not in (3, 5) as sensitive from fields", _FIELDS)(lambda m: fields(m).select("event_id", x.sensitive_key("k").alias("sensitive")))
query("X8_redacted", "select event_id, case when event_id % 6 not in (3, 5) then '[REDACTED]' else v end as shown from fields", _FIELDS)(
    lambda m: fields(m).select("event_id", F.element_at(x.redacted_map(F.create_map("k", "v")), F.col("k")).alias("shown"))
)
query("X9_correlation_ids", "select event_id, case when event_id % 3 = 0 then 'c-' || cast(event_id as varchar) when event_id % 3 = 1 then 'r.' || cast(event_id as varchar) else 'gen' end as id from audit_source")(
    lambda m: m.audit_source.select("event_id", x.pick_correlation_id(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" c-"), F.col("event_id"))).otherwise("bad id"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("r."), F.col("event_id"))).otherwise(F.repeat(F.lit("x"), F.lit(200))), F.lit("gen")).alias("id"))
)
_DSN = ("dsn", """select event_id, case event_id % 6 when 0 then 'postgres://user' || event_id || ':secret@host/db' when 1 then 'redis://:secret@host/' || event_id when 2 then 'POSTGRES://u:secret@h/' || event_id
  when 3 then 'postgres://user@host/' || event_id when 4 then 'postgres://u:p@ss@host:5432/d?x=a@b' else 'no url ' || event_id end as raw from audit_source""")
query("X10_masked_urls", """select event_id, case event_id % 6 when 0 then 'postgres://user' || event_id || ':***@host/db' when 1 then 'redis://:***@host/' || event_id when 2 then 'postgres://u:***@h/' || event_id
  when 3 then raw when 4 then 'postgres://u:***@host:5432/d?x=a@b' else raw end as url from dsn""", _DSN)(
    lambda m: m.audit_source.select("event_id", x.masked_url(F.expr(_DSN[1].split("select event_id, ")[1].split(" as raw")[0])).alias("url"))
)
query("X12_cookies", "select event_id, case when event_id % 2 = 0 then 'v' || cast(event_id as varchar) end as value from audit_source")(
    lambda m: m.audit_source.select("event_id", x.cookie_value(F.concat(F.lit("a=1; sid= ; "), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sid=v"), F.col("event_id"))).otherwise("sidx=9")), "sid").alias("value"))
)
query("X13_token_nonces", "select event_id, 'n' || cast(event_id as varchar) as nonce from audit_source")(
    lambda m: m.audit_source.select("event_id", x.jwt_claim(F.concat(F.lit("e30."), x.base64url(F.concat(F.lit('{"nonce":"n'), F.col("event_id"), F.lit('","é":"?>"}')).cast("binary")), F.lit(".sig")), "nonce").alias("nonce"))
)
query("X14_algorithms", "select event_id, case event_id % 4 when 0 then 'ok' when 1 then 'symmetric_rejected' when 2 then 'not_allowed' else 'ok' end as outcome from audit_source")(
    lambda m: m.audit_source.select("event_id", x.algorithm_decision(F.expr("case event_id % 4 when 0 then 'RS256' when 1 then 'HS384' when 2 then 'PS256' else 'EdDSA' end")).alias("outcome"))
)
query("X16_enum_parsers", """select event_id, case event_id % 3 when 0 then 'admin' when 1 then 'reader' end as role, case event_id % 4 when 0 then 'active' when 1 then 'revoked' when 2 then 'expired' end as status,
  case event_id % 5 when 0 then 'user' when 1 then 'service' when 2 then 'system' end as kind from audit_source""")(
    lambda m: m.audit_source.select(
        "event_id", x.one_of(F.expr("case event_id % 3 when 0 then 'Admin' when 1 then 'READER' else ' admin' end"), ("admin", "operator", "reviewer", "reader")).alias("role"),
        x.one_of(F.expr("case event_id % 4 when 0 then 'ACTIVE' when 1 then 'Revoked' when 2 then 'expired' else 'suspended' end"), ("active", "revoked", "expired")).alias("status"),
        x.one_of(F.expr("case event_id % 5 when 0 then 'User' when 1 then 'SERVICE' when 2 then 'system' when 3 then 'robot' end"), ("user", "service", "system")).alias("kind"))
)
query("X17_hex", "select event_id, lower(hex(encode(action_code))) as hexed from audit_source")(lambda m: m.audit_source.select("event_id", F.lower(F.hex(F.col("action_code").cast("binary"))).alias("hexed")))
query("X19_slugs", """select workspace_id, regexp_replace(regexp_replace(trim(lower(raw)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, regexp_replace(lower(raw), '[^a-z0-9-]', '', 'g') as typed from names""", _NAMES)(
    lambda m: names(m).select("workspace_id", x.slugify("raw").alias("slug"), x.typed_slug("raw").alias("typed"))
)
query("X20_strict_slugs", "select workspace_id, regexp_full_match(raw, '[a-z0-9]+(-[a-z0-9]+)*') as ok from names", _NAMES)(lambda m: names(m).select("workspace_id", x.strict_slug("raw").alias("ok")))
query("X20_required_names", "select workspace_id, case when trim(raw) = '' then 'required' end as error from names", _NAMES)(lambda m: names(m).select("workspace_id", x.name_error("raw").alias("error")))
query("X21_keys", "select event_id, case event_id % 5 when 0 then 'ok' when 1 then 'member_missing' when 2 then 'ok' when 3 then 'symmetric_rejected' else 'not_allowed' end as outcome from audit_source")(
    lambda m: m.audit_source.select("event_id", x.jwk_decision(F.expr("case event_id % 5 when 0 then 'RSA' when 1 then 'EC' when 2 then 'OKP' when 3 then 'oct' else 'PQ' end"), F.lit("n"), F.lit("e"), F.lit("x"), F.lit(None).cast("string")).alias("outcome"))
)
query("X22_authorization_urls", """select event_id, 'https://idp/authorize?response_type=code&client_id=app+1&redirect_uri=https%3A%2F%2Fapp%2Fback%3Fa%3D1&scope=openid+email&state=s%2F' || event_id || '&nonce=n%3D' || event_id
  || '&code_challenge=c-_' || event_id || '&code_challenge_method=S256' as url from audit_source""")(
    lambda m: (lambda i: m.audit_source.select("event_id", x.authorization_url(F.lit("https://idp/authorize"), [
        ("response_type", F.lit("code")), ("client_id", F.lit("app 1")), ("redirect_uri", F.lit("https://app/back?a=1")), ("scope", F.array_join(F.array(F.lit("openid"), F.lit("email")), " ")),
        ("state", F.concat(F.lit("s/"), i)), ("nonce", F.concat(F.lit("n="), i)), ("code_challenge", F.concat(F.lit("c-_"), i)), ("code_challenge_method", F.lit("S256"))]).alias("url")))(F.col("event_id").cast("string"))
)
query("X23_key_cache", """select event_id, case when event_id % 4 < 2 and event_id % 3 = 0 then 'use' when event_id % 5 = 0 then case when event_id % 3 = 0 then 'use_stale' else 'not_found' end else 'refresh' end as action from audit_source""")(
    lambda m: m.audit_source.select("event_id", x.key_cache_decision(F.lit(10_000), F.when(F.col("event_id") % 4 < 2, 9_000).otherwise(1_000), F.when(F.col("event_id") % 5 == 0, 9_995).otherwise(9_000), F.col("event_id") % 3 == 0).alias("action"))
)
query("X24_environments", "select event_id, case event_id % 4 when 0 then 'development' when 1 then 'production' when 2 then 'test' end as environment from audit_source")(
    lambda m: m.audit_source.select("event_id", x.environment(F.expr("case event_id % 4 when 0 then ' Local' when 1 then 'prod' when 2 then 'testing' else 'moon' end")).alias("environment"))
)
_WEB = "case event_id % 5 when 0 then ' Staging ' when 1 then 'PRODUCTION' when 2 then '' when 3 then 'public-demo' else 'moon' end"
query("X24_web_environments", """select event_id, case event_id % 5 when 0 then 'staging' when 1 then 'production' when 3 then 'public-demo' else 'local' end as name, case event_id % 5 when 0 then 'STAGING [NON-PROD]' when 1 then 'PRODUCTION'
  when 3 then 'PUBLIC DEMO [NON-PROD]' else 'LOCAL [NON-PROD]' end as label, event_id % 5 = 1 as is_production from audit_source""")(lambda m: m.audit_source.select("event_id", *x.web_environment(F.expr(_WEB))))  # fmt: skip
_STATUS = "case event_id % 7 when 0 then 401 when 1 then 403 when 2 then 404 when 3 then 409 when 4 then 422 when 5 then 500 else 503 end"
query("X25_severities", f"select event_id, case when s in (401, 403, 409) then 'warning' when s = 404 then 'info' else 'error' end as severity, case s when 401 then 'UNAUTHORIZED' when 403 then 'FORBIDDEN' when 404 then 'NOT_FOUND' when 409 then 'CONFLICT' when 422 then 'BAD_REQUEST' else 'INTERNAL_SERVER_ERROR' end as code from (select event_id, {_STATUS} as s from audit_source) q")(
    lambda m: m.audit_source.withColumn("s", F.expr(_STATUS)).select("event_id", x.severity("s").alias("severity"), x.problem_code("s").alias("code"))
)
query("X25_problems", f"""select event_id, case s when 401 then 'unauthorized' when 403 then 'forbidden' when 404 then 'not-found' when 409 then 'conflict' when 422 then 'bad-request' else 'internal-error' end as kind,
  case s when 401 then 'Unauthorized' when 403 then 'Forbidden' when 404 then 'Not Found' when 409 then 'Conflict' when 422 then case when event_id % 2 = 0 then 'Odd' else 'Bad Request' end else 'Internal Server Error' end as title
  from (select event_id, {_STATUS} as s from audit_source) q""")(
    lambda m: m.audit_source.withColumn("p", x.problem(F.expr(_STATUS), F.when(F.col("event_id") % 2 == 0, "Odd").otherwise(""))).select("event_id", "p.kind", "p.title")
)

_BY_STATUS = {
    401: "unauthenticated session_not_found session_expired session_revoked unauthorized", 403: "csrf_origin_mismatch csrf_missing_origin csrf_missing_header csrf_token_mismatch authorization security_violation",
    400: "state_mismatch transaction_expired nonce_mismatch invalid_token domain idempotency_mismatch idempotency_in_progress", 404: "not_found", 409: "conflict",
    500: "idp_communication jwks_fetch context_verification persistence internal unheard_of",
}
_KINDS = [(kind, status) for status, kinds in _BY_STATUS.items() for kind in kinds.split()]
_KIND = f"case event_id % {len(_KINDS)} " + " ".join(f"when {i} then '{kind}'" for i, (kind, _) in enumerate(_KINDS)) + " end"
query("A18_error_status", f"select event_id, case event_id % {len(_KINDS)} " + " ".join(f"when {i} then {status}" for i, (_, status) in enumerate(_KINDS)) + " end as status from audit_source")(
    lambda m: m.audit_source.withColumn("kind", F.expr(_KIND)).select("event_id", access.error_status("kind").alias("status"))
)
query("X11_constant_time_equality", "select event_id, action_code = 'CLICK' as same from audit_source")(lambda m: m.audit_source.select("event_id", (F.col("action_code") == "CLICK").alias("same")))
_KEYSET = ("keyset", "select n_regionkey as set_id, n_nationkey as key_id, 'k' || cast(n_nationkey as varchar(20)) as kid from nation where n_regionkey < 3 or n_nationkey = 3")
query("X15_found_keys", """select q.event_id, k.key_id from (select event_id, event_id % 4 as set_id, case when event_id % 5 < 3 then 'k' || cast(event_id % 25 as varchar(20)) end as kid from audit_source) q
  left join (select *, count(*) over (partition by set_id) as n from keyset) k on k.set_id = q.set_id and (k.kid = q.kid or q.kid is null and k.n = 1)""", _KEYSET)(
    lambda m: lifecycle.found_keys(
        m.audit_source.select("event_id", (F.col("event_id") % 4).alias("set_id"), F.when(F.col("event_id") % 5 < 3, F.concat(F.lit("k"), (F.col("event_id") % 25).cast("string"))).alias("kid")),
        m.spark.read.parquet(f"{m.sf_dir}/nation.parquet").where("n_regionkey < 3 or n_nationkey = 3").select(
            F.col("n_regionkey").cast("long").alias("set_id"), F.col("n_nationkey").alias("key_id"), F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("kid")))
    .select("event_id", "key_id")
)
query("X26_identity_keys", "select principal_id, issuer || '|' || subject as identity_key, timestamp '1970-01-01 00:00:00' + interval '1' second * principal_id as issued_at from oidc_identities")(
    lambda m: m.oidc_identities.select("principal_id", F.concat_ws("|", "issuer", "subject").alias("identity_key"), F.timestamp_seconds("principal_id").cast("timestamp_ntz").alias("issued_at"))
)

# --- migrations -------------------------------------------------------------------------------------------------------

_BUNDLE, _APPLIED = "select r_regionkey as version, r_name as description, H(r_name) as checksum from region", "select r_regionkey as version, r_name <> 'EUROPE' or true as success, case when r_regionkey = 1 then 'x' else H(r_name) end as checksum from region where r_regionkey < 4"


def _bundle(m) -> DataFrame:
    return m.spark.read.parquet(f"{m.sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("version"), F.col("r_name").alias("description"), x.sha256_hex("r_name").alias("checksum"))


def _applied(m) -> DataFrame:
    return _bundle(m).where("version < 4").withColumn("success", F.lit(True)).withColumn("checksum", F.when(F.col("version") == 1, "x").otherwise(F.col("checksum")))


query("G1_current_version", f"select max(version) as version from ({_APPLIED}) a")(lambda m: _applied(m).agg(F.max("version").alias("version")))
query("G2_up_to_date", f"select bool_and(success) and not exists (select 1 from ({_BUNDLE}) b where version not in (select version from ({_APPLIED}) a)) as up_to_date from ({_APPLIED}) a")(
    lambda m: catalog.migration_status(_bundle(m), _applied(m)).select("up_to_date")
)
query("M1_migration_status", f"""select (select count(*) from ({_APPLIED}) a) as applied, (select count(*) from ({_BUNDLE}) b where version not in (select version from ({_APPLIED}) a)) as pending,
  (select max(version) from ({_APPLIED}) a) as current_version, (select bool_and(success) from ({_APPLIED}) a) and not exists (select version from ({_BUNDLE}) b except select version from ({_APPLIED}) a) as up_to_date""")(lambda m: catalog.migration_status(_bundle(m), _applied(m)))
query("M2_newly_applied", f"select version from ({_BUNDLE}) b where version not in (select version from ({_APPLIED}) a)")(lambda m: catalog.newly_applied(_applied(m), _bundle(m)).select("version"))
query("M3_checksum_drift", f"select b.version, b.checksum, a.checksum as applied_checksum from ({_BUNDLE}) b join ({_APPLIED}) a on a.version = b.version where a.checksum <> b.checksum")(
    lambda m: catalog.checksum_drift(_bundle(m), _applied(m))
)
query("S19_applied_migrations", f"select version from ({_APPLIED}) a order by version")(lambda m: _applied(m).orderBy("version").select("version"))
query("M4_missing_services", "select r_name as service from region where r_regionkey not in (select r_regionkey from region where r_regionkey % 2 = 0)")(
    lambda m: (lambda r: catalog.missing_services(r.select("service"), r.where("r_regionkey % 2 = 0").select("service")))(m.spark.read.parquet(f"{m.sf_dir}/region.parquet").withColumnRenamed("r_name", "service"))
)
_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
query("M5_columns", f"select table_name, column_name, ordinal_position as ordinal from information_schema.columns where table_name in ({', '.join(map(repr, _ALL))})")(
    lambda m: catalog.columns_of({t: m.spark.read.parquet(f"{m.sf_dir}/{t}.parquet") for t in _ALL}, m.spark).select("table_name", "column_name", "ordinal")
)
query("L8_default_lifetimes", "select session_id, created_at + interval 7 days as absolute_expires_at, last_seen_at + interval 12 hours as idle_expires_at, created_at + interval 4 hours as rotates_at, last_seen_at + interval 5 minutes as touches_at, 5 as most from sessions")(
    lambda m: (lambda r: m.sessions.select(
        "session_id", (F.col("created_at") + F.expr(f"interval {r.absolute}")).alias("absolute_expires_at"), (F.col("last_seen_at") + F.expr(f"interval {r.idle}")).alias("idle_expires_at"),
        (F.col("created_at") + F.expr(f"interval {r.rotate_after}")).alias("rotates_at"), (F.col("last_seen_at") + F.expr(f"interval {r.touch_after}")).alias("touches_at"), F.lit(r.most).alias("most")))(lifecycle.SessionRules())
)
