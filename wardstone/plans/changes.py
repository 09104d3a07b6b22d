"""Registered queries over logs of changes, several of a key and in any order, and over texts with all kinds of white space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..functions.temporal import instant
from ..operators import integrity, lifecycle
from ..sources.model import AS_OF, SESSION_AT
from .histories import _SAT, SECRET, _hmac_sql
from .reads import query

_AT = f"timestamp '{AS_OF}'"


def _log(df: DataFrame, times: str) -> DataFrame:
    """A row for each change of each row: ``at`` counts a row's changes from 0; the last comes first in the table."""
    return df.withColumn("at", F.explode(F.expr(f"case when {times} > 0 then reverse(sequence(0, cast({times} as int) - 1)) else array() end")))


# --- change logs ------------------------------------------------------------------------------------------------------

query("U2_principal_change_log", """select principal_id, case when principal_id % 4 = 1 then 'n0' when principal_id % 4 > 1 then 'n1' else display_name end as display_name,
  case principal_id % 4 when 0 then status when 1 then 'suspended' else 'active' end as status from principals""")(
    lambda m: lifecycle.updated(
        m.principals, _log(m.principals, "principal_id % 4").select("principal_id", "at", F.expr("case when at < 2 then concat('n', at) end").alias("display_name"), F.expr("case at when 0 then 'suspended' when 1 then 'active' end").alias("status")),
        "principal_id", ["display_name", "status"], keep_null=True, order=("at",)).select("principal_id", "display_name", "status")
)
query("U3_role_change_log", """select membership_id, case membership_id % 4 when 0 then role_code when 1 then 'reader' when 2 then 'operator' else 'admin' end as role_code,
  1 + membership_id % 4 as row_version from memberships""")(
    lambda m: lifecycle.updated(m.memberships, _log(m.memberships, "membership_id % 4").select("membership_id", "at", F.expr("element_at(array('reader', 'operator', 'admin'), at + 1)").alias("role_code")), "membership_id", ["role_code"], bump="row_version", order=("at",))
    .select("membership_id", "role_code", "row_version")
)
query("U5_expiry_change_log", f"select capability_grant_id, case capability_grant_id % 3 when 0 then expires_at else {_AT} + interval '1' day * (capability_grant_id % 3) end as expires_at from capability_grants")(
    lambda m: lifecycle.updated(
        m.capability_grants, _log(m.capability_grants, "capability_grant_id % 3").select("capability_grant_id", "at", (instant(AS_OF) + F.make_dt_interval(days=F.col("at") + 1)).alias("expires_at")), "capability_grant_id", ["expires_at"], order=("at",))
    .select("capability_grant_id", "expires_at")
)
query("U6_session_change_log", """select session_id, case rotation_counter when 0 then handle_hash else H('n' || cast(rotation_counter - 1 as varchar(20))) end as handle_hash,
  case rotation_counter when 0 then 0 else 10 * (rotation_counter - 1) end as rotation_counter from sessions""")(
    lambda m: lifecycle.updated(
        m.sessions, _log(m.sessions, "rotation_counter").select("session_id", "at", x.sha256_hex(F.concat(F.lit("n"), F.col("at").cast("string"))).alias("handle_hash"), (F.col("at") * 10).alias("rotation_counter")), "session_id",
        ["handle_hash", "rotation_counter"], order=("at",)).select("session_id", "handle_hash", "rotation_counter")
)
query("U8_login_log", f"select principal_id, case when principal_id % 5 > 0 then {_SAT} + interval '1' hour * (principal_id % 5) end as last_login_at from oidc_identities")(
    lambda m: lifecycle.updated(
        m.oidc_identities.withColumn("last_login_at", F.lit(None).cast("timestamp_ntz")), _log(m.oidc_identities, "principal_id % 5").select("principal_id", (instant(SESSION_AT) + F.make_dt_interval(hours=F.col("at") + 1)).alias("last_login_at")),
        "principal_id", ["last_login_at"], order=("last_login_at",)).select("principal_id", "last_login_at")
)
query("U11_state_log", """select membership_id, case membership_id % 3 when 0 then status when 1 then 'suspended' else 'revoked' end as status, 1 + membership_id % 3 as row_version from memberships""")(
    lambda m: lifecycle.updated(m.memberships, _log(m.memberships, "membership_id % 3").select("membership_id", "at", F.expr("case at when 0 then 'suspended' else 'revoked' end").alias("status")), "membership_id", ["status"], bump="row_version", order=("at",))
    .select("membership_id", "status", "row_version")
)
query("U11_rename_log", """select workspace_id, case workspace_id % 4 when 0 then name when 1 then 'name 0' when 2 then 'name 0' else 'name 2' end as name,
  case workspace_id % 4 when 0 then workspace_code when 1 then 'code-0' when 2 then 'code-0' else 'code-2' end as workspace_code,
  case workspace_id % 4 when 0 then 1 when 1 then 2 when 2 then 2 else 3 end as row_version, case when workspace_id % 4 >= 2 then case when workspace_id % 8 < 4 then 'empty_name' else 'bad_character' end end as error from workspaces""")(
    lambda m: lifecycle.renamed(
        m.workspaces, _log(m.workspaces, "workspace_id % 4").select(
            "workspace_id", "at", F.expr("case when at = 1 and workspace_id % 8 < 4 then '\\t' else concat(' name ', at, '\\n') end").alias("name"),
            F.expr("case when at = 1 and workspace_id % 8 >= 4 then 'Code 1' else concat('code-', at, ' ') end").alias("workspace_code")), "workspace_id", "workspace_code", order=("at",))
    .select("workspace_id", "name", "workspace_code", "row_version", "error")
)


def _rotations(m) -> DataFrame:
    new = x.sha256_hex(F.concat("session_id", F.lit("/"), F.col("at").cast("string")))
    return _log(m.sessions, "rotation_counter").select("session_id", "at", new.alias("new_hash"), F.expr("case at when 0 then 'periodic' else 'manual_refresh' end").alias("reason"))


query("L3_rotation_log", f"""select session_id, case rotation_counter when 0 then handle_hash else H(session_id || '/' || cast(rotation_counter - 1 as varchar(20))) end as handle_hash, 2 * rotation_counter as rotation_counter,
  case rotation_counter when 0 then idle_expires_at else {_SAT} + interval 12 hours end as idle_expires_at from sessions""")(
    lambda m: lifecycle.rotated(m.sessions, _rotations(m), instant(SESSION_AT), order=("at",))[0].select("session_id", "handle_hash", "rotation_counter", "idle_expires_at")
)
query("L3_rotation_log_rows", """select session_id, rotation_counter + k + 1 as rotation_number, case k when 0 then handle_hash else H(session_id || '/' || cast(k - 1 as varchar(20))) end as old_handle_hash,
  H(session_id || '/' || cast(k as varchar(20))) as new_handle_hash, case k when 0 then 'periodic' else 'manual_refresh' end as reason from sessions, (select unnest(range(3)) as k) z where k < rotation_counter""")(
    lambda m: lifecycle.rotated(m.sessions, _rotations(m), instant(SESSION_AT), order=("at",))[1]
)

# --- inserts: one new row of each key, in every table -----------------------------------------------------------------


def _insert(table: str, key: str, columns: str, fresh: str) -> None:
    """New rows made of the table's own: of each, one that exists, and two of one new key, of which the first by ``at`` comes in."""
    names = [key, *columns.split(",")]
    query(f"U1_inserted_{table}", f"select {', '.join(names)} from {table} union all select {fresh}, {', '.join(names[1:])} from {table}")(
        lambda m: (lambda df: lifecycle.inserted(df, df.withColumn("at", F.explode(F.array(F.lit(2), F.lit(1), F.lit(0)))).withColumns(
            {key: F.expr(f"case at when 0 then {key} else {fresh} end").cast(df.schema[key].dataType), names[1]: F.expr(f"case at when 2 then null else {names[1]} end")}), key, ("at",)))(getattr(m, table).select(*names))
    )


_insert("organizations", "organization_id", "display_name,slug", "organization_id + 1000")
_insert("principals", "principal_id", "display_name,email,status", "principal_id + 1000000000")
_insert("workspaces", "workspace_id", "workspace_code,program_id,organization_id,name", "workspace_id + 1000000000")
_insert("memberships", "membership_id", "role_code,workspace_id,principal_id,status", "membership_id + 1000000000000")
_insert("capability_grants", "capability_grant_id", "capability_code,workspace_id,program_id,principal_id", "capability_grant_id + 1000000000000000")

# --- several openings at once -----------------------------------------------------------------------------------------

_SESSION = ("session_id", "principal_id", "created_at", "idle_expires_at", "absolute_expires_at", "revoked_at")


def _opening(m) -> DataFrame:
    """principal_id mod 8 new sessions of each principal, one second after the other."""
    late = instant(SESSION_AT) + F.expr("interval 7 days")
    return _log(m.principals, "principal_id % 8").select(
        F.concat(F.lit("new-"), F.col("principal_id").cast("string"), F.lit("-"), F.col("at").cast("string")).alias("session_id"), "principal_id",
        (instant(SESSION_AT) + F.make_dt_interval(secs=F.col("at"))).alias("created_at"), late.alias("idle_expires_at"), late.alias("absolute_expires_at"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"),
    )


_OPENING = ("both_kinds", f"""select session_id, principal_id, created_at, revoked_at, revoked_at is null and created_at <= {_SAT} and {_SAT} < idle_expires_at and {_SAT} < absolute_expires_at as alive, principal_id % 8 as n from sessions
  union all select 'new-' || principal_id || '-' || k, principal_id, {_SAT} + interval '1' second * k, null, true, principal_id % 8 from principals, (select unnest(range(8)) as k) z where k < principal_id % 8""")
query("L2_opened_several", f"""select session_id, principal_id, case when alive and n > 0 and place > 5 then {_SAT} else revoked_at end as revoked_at from
  (select *, row_number() over (partition by principal_id, alive order by created_at desc, session_id desc) as place from both_kinds) b""", _OPENING)(
    lambda m: lifecycle.opened(m.sessions.select(*_SESSION), _opening(m), instant(SESSION_AT)).select("session_id", "principal_id", "revoked_at")
)

# --- white space ------------------------------------------------------------------------------------------------------

_SPACE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_trim = lambda c: f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_RAW = "case event_id % 5 when 0 then chr(9) || action_code || chr(10) when 1 then chr(160) || action_code || ' ' when 2 then chr(13) || chr(160) || chr(9) when 3 then ' ' || action_code || ' x' else action_code end"
_TEXTS = ("texts", f"select event_id, {_RAW} as raw from audit_source")


def _texts(m) -> DataFrame:
    return m.audit_source.select("event_id", F.expr(_RAW).alias("raw"))


query("X1_trimmed_handles", f"select event_id, {_hmac_sql(_trim('raw'))} as hash from texts", _TEXTS)(lambda m: _texts(m).select("event_id", x.handle_hash(SECRET, "raw").alias("hash")))
_token = f"'csrf-v1:' || {_trim('raw')} || ':https://a.example'"
query("X2_trimmed_tokens", f"select event_id, {_hmac_sql(_token)} as token from texts", _TEXTS)(
    lambda m: _texts(m).select("event_id", x.csrf_token(SECRET, "raw", F.when(F.col("event_id") % 2 == 0, "\t https://a.example// ").otherwise("https://a.example")).alias("token"))
)
query("C16_trimmed_reasons", f"select event_id, case when event_id % 7 = 0 then 'identical' end as error, case when {_trim('raw')} = '' then 'periodic' else {_trim('raw')} end as reason from texts", _TEXTS)(
    lambda m: _texts(m).select("event_id", *integrity.rotation_error(F.lit("a"), F.when(F.col("event_id") % 7 == 0, "a").otherwise("b"), "raw"))
)
query("C17_trimmed_defaults", f"select event_id, case when {_trim('raw')} = '' then '/' else {_trim('raw')} end as return_path, nullif({_trim('raw')}, '') as email from texts", _TEXTS)(
    lambda m: _texts(m).select("event_id", integrity.return_path("raw").alias("return_path"), integrity.blank_to_null("raw").alias("email"))
)
query("X11_equal_secrets", "select event_id, sha256(raw) = sha256(action_code) as same from (select t.*, action_code from texts t join audit_source a on a.event_id = t.event_id) q", _TEXTS)(
    lambda m: m.audit_source.select("event_id", x.same_secret(F.expr(_RAW), "action_code").alias("same"))
)
