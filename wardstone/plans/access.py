"""Registered joins, authorization, temporal and isolation queries, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal as t
from ..functions.scalars import capability
from ..operators import access, lifecycle
from ..operators.integrity import grant_error
from ..sources.model import AS_OF, SESSION_AT, union_all
from .reads import query

_AT, _SAT = f"timestamp '{AS_OF}'", f"timestamp '{SESSION_AT}'"
_MEMBER = f"status = 'active' and valid_from <= {_AT} and (valid_until is null or valid_until > {_AT})"
_GRANT = f"not (revoked_at is not null and {_AT} >= revoked_at) and (expires_at is null or {_AT} < expires_at)"
_STORED = f"revoked_at is null and (expires_at is null or expires_at > {_AT})"

# --- joins ------------------------------------------------------------------------------------------------------------

query("J1_program_has_workspaces", "select program_id, exists (select 1 from workspaces w where w.program_id = p.program_id) as used from programs p")(
    lambda m: m.programs.join(m.workspaces.select("program_id").distinct().withColumn("used", F.lit(True)), "program_id", "left")
    .select("program_id", F.coalesce("used", F.lit(False)).alias("used"))
)
_J2 = "select distinct w.program_id, m.principal_id from workspaces w join memberships m on w.workspace_id = m.workspace_id"
_J3 = """select program_id, principal_id from capability_grants where program_id is not null union select w.program_id, g.principal_id from capability_grants g
  join workspaces w on g.workspace_id = w.workspace_id"""
query("J2_programs_by_membership", _J2)(lambda m: access.programs_by_membership(m.workspaces, m.memberships))
query("J3_programs_by_grant", _J3)(lambda m: access.programs_by_grant(m.workspaces, m.capability_grants))
query("J4_program_visibility", f"{_J2} union {_J3}")(lambda m: access.visible_pairs(m.workspaces, m.memberships, m.capability_grants))
query("J5_visible_programs", f"""select program_id, name from programs p where not exists (select 1 from workspaces w where w.program_id = p.program_id)
  or p.program_id in (select program_id from j where principal_id = 3)""", ("j", f"{_J2} union {_J3}"))(
    lambda m: access.visible_programs(m.programs, m.workspaces, m.memberships, m.capability_grants, 3).select("program_id", "name")
)
query("J6_hierarchy", """select w.workspace_id, p.program_id, o.organization_id, o.slug, p.organization_id <> w.organization_id as mismatch from workspaces w
  join programs p on w.program_id = p.program_id join organizations o on p.organization_id = o.organization_id""")(
    lambda m: m.workspaces.withColumnRenamed("organization_id", "w_org").join(m.programs.select("program_id", "organization_id"), "program_id")
    .join(m.organizations.select("organization_id", "slug"), "organization_id")
    .select("workspace_id", "program_id", "organization_id", "slug", (F.col("organization_id") != F.col("w_org")).alias("mismatch"))
)
_RESOLVED = f"""select m.membership_id, m.workspace_id, m.principal_id, w.program_id, p.organization_id, case when w.organization_id is null then 'workspace_not_found'
  when p.organization_id is null then 'program_not_found' when p.organization_id <> w.organization_id then 'hierarchy_mismatch' when o.organization_id is null then
  'organization_not_found' when x.status is null then 'principal_not_found' when x.status <> 'active' then 'principal_inactive'
  when not (m.status = 'active' and valid_from <= {_AT} and (valid_until is null or valid_until > {_AT})) then 'membership_inactive' else 'ok' end as resolution
  from memberships m left join workspaces w on m.workspace_id = w.workspace_id left join programs p on w.program_id = p.program_id
  left join organizations o on p.organization_id = o.organization_id left join principals x on m.principal_id = x.principal_id"""


def resolved(m):
    return access.resolved_contexts(m.memberships, m.workspaces, m.programs, m.organizations, m.principals, t.instant(AS_OF))


query("J7_resolved_contexts", _RESOLVED)(resolved)
_SCOPED = """select distinct a.workspace_id, a.principal_id, a.program_id, g.capability_grant_id, g.capability_code from a join capability_grants g
  on g.principal_id = a.principal_id and (g.workspace_id = a.workspace_id or g.program_id = a.program_id)"""
query("J8_grants_in_scope", f"{_SCOPED} where {_STORED}", ("a", "select distinct m.workspace_id, principal_id, w.program_id from memberships m join workspaces w on m.workspace_id = w.workspace_id"))(
    lambda m: access.grants_in_scope(
        m.memberships.select("workspace_id", "principal_id").distinct().join(m.workspaces.select("workspace_id", "program_id"), "workspace_id"),
        m.capability_grants.where(t.grant_active_stored(t.instant(AS_OF))).select("workspace_id", "program_id", "principal_id", "capability_grant_id", "capability_code"),
    )
)
query("J9_grants_to_members", "select capability_grant_id from capability_grants g where exists (select 1 from memberships m where m.workspace_id = g.workspace_id and m.principal_id = g.principal_id)")(
    lambda m: m.capability_grants.join(m.memberships.select("workspace_id", "principal_id"), ["workspace_id", "principal_id"], "left_semi").select("capability_grant_id")
)
query("J10_active_targets", "select m.membership_id, x.status is not null and x.status = 'active' as target_ok from memberships m left join principals x on m.principal_id = x.principal_id")(
    lambda m: m.memberships.join(m.principals.select("principal_id", F.col("status").alias("s")), "principal_id", "left")
    .select("membership_id", F.coalesce(t.principal_active("s"), F.lit(False)).alias("target_ok"))
)
query("J11_null_safe_match", """select a.request_id, b.request_id as first_id from request_log a join f b on (a.workspace_id = b.workspace_id or a.workspace_id is null and b.workspace_id is null)
  and a.principal_id = b.principal_id and a.route_code = b.route_code and a.raw_key = b.raw_key""",
  ("f", "select workspace_id, principal_id, route_code, raw_key, min(request_id) as request_id from request_log group by 1, 2, 3, 4"))(
    lambda m: (lambda log, f: log.join(f, F.col("workspace_id").eqNullSafe(F.col("w")) & (F.col("principal_id") == F.col("p")) & (F.col("route_code") == F.col("r")) & (F.col("raw_key") == F.col("k")))
    .select("request_id", "first_id"))(m.request_log, m.request_log.groupBy(F.col("workspace_id").alias("w"), F.col("principal_id").alias("p"), F.col("route_code").alias("r"), F.col("raw_key").alias("k"))
    .agg(F.min("request_id").alias("first_id")))
)
_CLAIMS = """select 'https://idp-' || cast(p.principal_id % 25 as varchar(20)) as issuer, p.display_name as subject, case when p.principal_id % 3 = 0 then null else p.display_name end as name,
  p.email from principals p"""
query("J12_resolved_identities", """select c.issuer, c.subject, i.principal_id, case when i.principal_id is null then coalesce(c.name, c.email, 'OIDC User') end as new_display_name
  from claims c left join oidc_identities i on c.issuer = i.issuer and c.subject = i.subject""", ("claims", _CLAIMS))(
    lambda m: lifecycle.resolved_identities(
        m.principals.select(
            F.concat(F.lit("https://idp-"), (F.col("principal_id") % 25).cast("string")).alias("issuer"), F.col("display_name").alias("subject"),
            F.when(F.col("principal_id") % 3 != 0, F.col("display_name")).alias("name"), "email",
        ), m.oidc_identities).select("issuer", "subject", "principal_id", "new_display_name")
)
query("J13_sessions_by_either_key", """select r.request_id, coalesce(a.session_id, p.session_id) as session_id, a.session_id is null and p.session_id is not null as by_previous_key
  from (select request_id, case when request_id % 2 = 0 then H('h' || cast(request_id as varchar(20))) else H('x') end as active_hash, H('h' || cast(request_id + 1 as varchar(20))) as previous_hash
  from request_log) r left join sessions a on r.active_hash = a.handle_hash left join sessions p on r.previous_hash = p.handle_hash""")(
    lambda m: lifecycle.found_sessions(
        m.request_log.select(
            "request_id", F.when(F.col("request_id") % 2 == 0, F.sha2(F.concat(F.lit("h"), F.col("request_id").cast("string")).cast("binary"), 256)).otherwise(F.sha2(F.lit("x").cast("binary"), 256))
            .alias("active_hash"), F.sha2(F.concat(F.lit("h"), (F.col("request_id") + 1).cast("string")).cast("binary"), 256).alias("previous_hash"),
        ), m.sessions).select("request_id", "session_id", "by_previous_key")
)

# --- capabilities -----------------------------------------------------------------------------------------------------

_ROLE_SETS = "case role_code when 'admin' then 'AUDIT_READ,WORKSPACE_ADMIN,WORKSPACE_READ,WORKSPACE_WRITE' when 'operator' then 'WORKSPACE_READ,WORKSPACE_WRITE' when 'reviewer' then 'AUDIT_READ,WORKSPACE_READ' else 'WORKSPACE_READ' end"
_EFFECTIVE = [
    ("act", f"select distinct m.workspace_id, m.principal_id, m.role_code, w.program_id from memberships m join workspaces w on m.workspace_id = w.workspace_id where {_MEMBER.replace('status', 'm.status')}"),
    ("given", f"""select distinct a.workspace_id, a.principal_id, a.role_code, g.capability_grant_id, g.capability_code from act a join capability_grants g on g.principal_id = a.principal_id
      and (g.workspace_id = a.workspace_id or g.program_id = a.program_id) where {_STORED} and {_GRANT}"""),
    ("base", f"select workspace_id, principal_id, role_code, unnest(string_split({_ROLE_SETS}, ',')) as c from act"),
    ("caps", """select workspace_id, principal_id, role_code, string_agg(c, ',' order by c) as capabilities from
      (select * from base union select workspace_id, principal_id, role_code, capability_code from given) u group by 1, 2, 3"""),
    ("eff", """select caps.*, coalesce(n, 0) as active_grants from caps left join (select workspace_id, principal_id, role_code, count(*) as n from given group by 1, 2, 3) g
      using (workspace_id, principal_id, role_code)"""),
]


def effective(m):
    return access.effective_capabilities(m.memberships, m.workspaces, m.capability_grants, t.instant(AS_OF))


KEYS = ["workspace_id", "principal_id", "role_code"]
query("A10_effective_capabilities", "select * from eff", *_EFFECTIVE)(lambda m: effective(m).select(*KEYS, F.array_join("capabilities", ",").alias("capabilities"), "active_grants"))
_has = lambda c: f"list_contains(string_split(capabilities, ','), '{c}')"
query("A1_parsed_capabilities", """select request_id, case when regexp_matches(upper(trim(raw)), '^[A-Z0-9_:-]+$') then upper(trim(raw)) end as capability from
  (select request_id, case when request_id % 4 = 0 then ' ' || route_code || ':run ' when request_id % 4 = 1 then route_code when request_id % 4 = 2 then route_code || '!' else '  ' end as raw
  from request_log) x""")(
    lambda m: m.request_log.select("request_id", capability(
        F.expr("case when request_id % 4 = 0 then concat(' ', route_code, ':run ') when request_id % 4 = 1 then route_code when request_id % 4 = 2 then concat(route_code, '!') else '  ' end")).alias("capability"))
)
query("A2_special_grants", "select capability_grant_id, capability_code in ('OVERRIDE_BLOCK', 'RIGHTS_REVIEW', 'RULE_ACTIVATION', 'GRANT_AUTHORITY') as special from capability_grants")(
    lambda m: m.capability_grants.select("capability_grant_id", access.is_special("capability_code").alias("special"))
)
query("A3_role_capabilities", f"select membership_id, {_ROLE_SETS} as capabilities from memberships")(
    lambda m: m.memberships.select("membership_id", F.array_join(access.role_capabilities("role_code"), ",").alias("capabilities"))
)
query("A4_special_in_roles", f"select role_code, len(list_filter(string_split(c, ','), lambda x: list_contains(['OVERRIDE_BLOCK', 'RIGHTS_REVIEW', 'RULE_ACTIVATION', 'GRANT_AUTHORITY'], x))) as special from (select distinct role_code, {_ROLE_SETS} as c from memberships) r")(
    lambda m: m.memberships.select("role_code").distinct().select("role_code", F.size(access.special_part(access.role_capabilities("role_code"))).alias("special"))
)
_TWO = "('WORKSPACE_WRITE', 'GRANT_AUTHORITY')"
query("A5_contains", f"""select workspace_id, principal_id, role_code, {_has('WORKSPACE_WRITE')} as has_write, {_has('WORKSPACE_WRITE')} and {_has('GRANT_AUTHORITY')} as has_both,
  {_has('WORKSPACE_WRITE')} or {_has('GRANT_AUTHORITY')} as has_either, true as all_of_none, false as any_of_none from eff""", *_EFFECTIVE)(
    lambda m: (lambda two, none: effective(m).select(
        *KEYS, F.array_contains("capabilities", "WORKSPACE_WRITE").alias("has_write"), access.has_all(F.col("capabilities"), two).alias("has_both"),
        access.has_any(F.col("capabilities"), two).alias("has_either"), access.has_all(F.col("capabilities"), none).alias("all_of_none"), access.has_any(F.col("capabilities"), none).alias("any_of_none"),
    ))(access.array_of(("WORKSPACE_WRITE", "GRANT_AUTHORITY")), access.array_of(()))
)
query("A6_contains_named", f"select workspace_id, principal_id, role_code, {_has('MEMBERSHIP_MANAGE')} as found from eff", *_EFFECTIVE)(
    lambda m: effective(m).select(*KEYS, access.has_named(F.col("capabilities"), "membership_manage").alias("found"))
)
_SETS = [*_EFFECTIVE, ("el", "select workspace_id, principal_id, role_code, string_split(capabilities, ',') as h from eff")]
_OTHER = "['AUDIT_READ', 'RULE_ACTIVATION']"
query("A7_set_algebra", f"""select workspace_id, principal_id, role_code, array_to_string(list_sort(list_distinct(list_concat(h, {_OTHER}))), ',') as u,
  array_to_string(list_sort(list_intersect(h, {_OTHER})), ',') as i, array_to_string(list_sort(list_filter(h, lambda x: not list_contains({_OTHER}, x))), ',') as d from el""", *_SETS)(
    lambda m: (lambda h, o: effective(m).select(*KEYS, *(F.array_join(f(h, o), ",").alias(n) for n, f in (("u", access.union), ("i", access.intersection), ("d", access.difference)))))(
        F.col("capabilities"), access.array_of(("AUDIT_READ", "RULE_ACTIVATION")))
)
query("A8_subsets", f"""select workspace_id, principal_id, role_code, len(list_filter(h, lambda x: not list_contains(['WORKSPACE_READ', 'WORKSPACE_WRITE'], x))) = 0 as subset,
  list_has_all(h, ['WORKSPACE_READ', 'WORKSPACE_WRITE']) as superset, len(h) as n, len(h) = 0 as empty from el""", *_SETS)(
    lambda m: (lambda h, o: effective(m).select(*KEYS, access.is_subset(h, o).alias("subset"), access.is_subset(o, h).alias("superset"), F.size(h).cast("long").alias("n"), (F.size(h) == 0).alias("empty")))(
        F.col("capabilities"), access.array_of(("WORKSPACE_READ", "WORKSPACE_WRITE")))
)
query("A9_named_predicates", "select workspace_id, principal_id, role_code, " + ", ".join(f"{_has(c)} as can_{c.lower()}" for c in (*access.STANDARD, *access.SPECIAL)) + " from eff", *_EFFECTIVE)(
    lambda m: effective(m).select(*KEYS, *(c.alias(n) for n, c in access.named_predicates(F.col("capabilities")).items()))
)
query("G6_special_and_standard", "select workspace_id, principal_id, role_code, " + ", ".join(
    f"array_to_string(list_filter(h, lambda x: {no}list_contains(['OVERRIDE_BLOCK', 'RIGHTS_REVIEW', 'RULE_ACTIVATION', 'GRANT_AUTHORITY'], x)), ',') as {n}" for n, no in (("special", ""), ("standard", "not "))
) + " from el", *_SETS)(
    lambda m: effective(m).select(*KEYS, F.array_join(access.special_part("capabilities"), ",").alias("special"), F.array_join(access.standard_part("capabilities"), ",").alias("standard"))
)
query("G5_capabilities_by_principal", "select principal_id, string_agg(c, ',' order by c) as capabilities from (select distinct principal_id, capability_code as c from capability_grants) x group by principal_id")(
    lambda m: m.capability_grants.groupBy("principal_id").agg(F.array_join(F.array_sort(F.collect_set("capability_code")), ",").alias("capabilities"))
)
query("A20_insert_remove", """select workspace_id, principal_id, role_code, array_to_string(list_sort(list_distinct(list_append(h, 'OVERRIDE_BLOCK'))), ',') as inserted,
  array_to_string(list_filter(h, lambda x: x <> 'WORKSPACE_READ'), ',') as removed from el""", *_SETS)(
    lambda m: effective(m).select(*KEYS, F.array_join(access.inserted("capabilities", "OVERRIDE_BLOCK"), ",").alias("inserted"), F.array_join(access.removed("capabilities", "WORKSPACE_READ"), ",").alias("removed"))
)
_RULES = (("A11_require", "require", ["WORKSPACE_WRITE"]), ("A12_require_all", "all", ["RIGHTS_REVIEW", "WORKSPACE_WRITE", "AUDIT_READ"]), ("A13_require_any", "any", ["AUDIT_READ", "OVERRIDE_BLOCK"]), ("A14_require_special", "special", ["OVERRIDE_BLOCK"]))
_REASON = {"require": "MissingCapability", "all": "MissingAll", "any": "MissingAny", "special": "MissingSpecialAuthority"}
for _key, _kind, _asked in _RULES:
    _ok = (" or " if _kind == "any" else " and ").join(_has(c) for c in _asked)
    _list = "[" + ", ".join(f"'{c}'" for c in _asked) + "]"
    _missing = f"array_to_string(list_filter({_list}, lambda x: not list_contains(string_split(capabilities, ','), x)), ',')" if _kind == "all" else "'" + ",".join(_asked) + "'"
    query(_key, f"""select workspace_id, principal_id, role_code, ({_ok}) as allowed, case when not ({_ok}) then '{_REASON[_kind]}' end as reason,
      case when ({_ok}) then '' else {_missing} end as missing from eff""", *_EFFECTIVE)(
        lambda m, kind=_kind, asked=_asked: effective(m).withColumn("d", access.evaluate(kind, F.col("capabilities"), asked)).select(*KEYS, "d.allowed", "d.reason", F.array_join("d.missing", ",").alias("missing"))
    )
query("A15_denials", f"select workspace_id, principal_id, role_code, case when not {_has('OVERRIDE_BLOCK')} then 'MissingSpecialAuthority: OVERRIDE_BLOCK' end as denial from eff", *_EFFECTIVE)(
    lambda m: effective(m).withColumn("d", access.evaluate("require", F.col("capabilities"), ["OVERRIDE_BLOCK"])).select(*KEYS, access.denial_text("d").alias("denial"))
)
query("A16_transaction_gate", f"""select workspace_id, principal_id, role_code, case when workspace_id % 10 = 0 then 'TenantBoundaryMismatch' when not {_has('WORKSPACE_WRITE')} then 'MissingCapability'
  when not {_has('RIGHTS_REVIEW')} then 'MissingSpecialAuthority' else 'ok' end as gate from eff""", *_EFFECTIVE)(
    lambda m: effective(m).withColumn("selected", F.when(F.col("workspace_id") % 10 != 0, F.col("workspace_id")))
    .select(*KEYS, access.transaction_gate("selected", "workspace_id", F.col("capabilities"), ["WORKSPACE_WRITE"], ["RIGHTS_REVIEW"]).alias("gate"))
)
_FIRST = f"({_has('WORKSPACE_ADMIN')} or {_has('MEMBERSHIP_MANAGE')})"
query("A17_endpoint_gates", f"""select workspace_id, principal_id, role_code, {_has('GRANT_AUTHORITY')} as may_grant, {_has('GRANT_AUTHORITY')} as may_revoke, {_FIRST} as membership_first_gate,
  {_FIRST} and {_has('WORKSPACE_ADMIN')} as may_create_membership, {_has('WORKSPACE_READ')} as may_read from eff""", *_EFFECTIVE)(
    lambda m: effective(m).select(*KEYS, *(c.alias(n) for n, c in access.endpoint_gates(F.col("capabilities")).items()))
)
_WRAPPED = (("can", "WORKSPACE_WRITE"), ("has_special_authority", "OVERRIDE_BLOCK"))
query("A21_context_checks", f"""select workspace_id, principal_id, role_code, {_has('WORKSPACE_WRITE')} as can, {_has('WORKSPACE_READ')} and {_has('AUDIT_READ')} as can_all, {_has('AUDIT_READ')} or {_has('OVERRIDE_BLOCK')} as can_any,
  {_has('OVERRIDE_BLOCK')} as has_special_authority, case when not {_has('WORKSPACE_WRITE')} then 'MissingCapability' end as required, case when not {_has('OVERRIDE_BLOCK')} then 'MissingSpecialAuthority' end as required_special, """
  + ", ".join(f"{_has(c)} as can_{c.lower()}" for c in ("WORKSPACE_READ", "WORKSPACE_WRITE", "WORKSPACE_ADMIN", "AUDIT_READ", "OVERRIDE_BLOCK", "RIGHTS_REVIEW", "RULE_ACTIVATION", "GRANT_AUTHORITY")) + " from eff", *_EFFECTIVE)(
    lambda m: (lambda h: effective(m).select(
        *KEYS, *(F.array_contains(h, c).alias(n) for n, c in _WRAPPED), access.has_all(h, access.array_of(("WORKSPACE_READ", "AUDIT_READ"))).alias("can_all"),
        access.has_any(h, access.array_of(("AUDIT_READ", "OVERRIDE_BLOCK"))).alias("can_any"), access.evaluate("require", h, ["WORKSPACE_WRITE"])["reason"].alias("required"),
        access.evaluate("special", h, ["OVERRIDE_BLOCK"])["reason"].alias("required_special"), *(c.alias(n) for n, c in access.named_predicates(h).items())))(F.col("capabilities"))
)
query("A19_grant_expiry_errors", "select capability_grant_id, case when expires_at is not null and expires_at <= granted_at + interval 365 days then 'expiry_not_in_future' end as error from capability_grants")(
    lambda m: m.capability_grants.select("capability_grant_id", grant_error(F.col("granted_at") + F.expr("interval 365 days")).alias("error"))
)

# --- validity at an instant -------------------------------------------------------------------------------------------

_flag = lambda key, table, id_, sql, column: query(key, f"select {id_}, {sql} as flag from {table}")(lambda m: getattr(m, table).select(id_, column().alias("flag")))
_flag("T1_membership_active", "memberships", "membership_id", f"({_MEMBER})", lambda: t.membership_active(t.instant(AS_OF)))
_flag("T2_grant_active", "capability_grants", "capability_grant_id", f"({_GRANT})", lambda: t.grant_active(t.instant(AS_OF)))
_flag("T3_grant_expired", "capability_grants", "capability_grant_id", f"not ({_GRANT})", lambda: ~t.grant_active(t.instant(AS_OF)))
_flag("T4_grant_active_stored", "capability_grants", "capability_grant_id", f"({_STORED})", lambda: t.grant_active_stored(t.instant(AS_OF)))
_EXPIRED = f"({_SAT} >= idle_expires_at or {_SAT} >= absolute_expires_at)"
_flag("T5_session_active", "sessions", "session_id", f"revoked_at is null and not {_EXPIRED}", lambda: t.session_active(t.instant(SESSION_AT)))
_flag("T6_session_expired", "sessions", "session_id", _EXPIRED, lambda: t.session_expired(t.instant(SESSION_AT)))
_STATUS = f"case when revoked_at is not null then 'revoked' when {_EXPIRED} then 'expired' else 'active' end"
_flag("T7_session_status", "sessions", "session_id", _STATUS, lambda: t.session_status(t.instant(SESSION_AT)))
_flag("T8_session_evaluated", "sessions", "session_id", f"case when revoked_at is not null then 'revoked' when {_EXPIRED} or {_SAT} - last_seen_at > interval 6 hours then 'expired' else 'active' end",
      lambda: t.session_evaluated(t.instant(SESSION_AT), "6 hours"))
_flag("T9_transaction_valid", "oidc_transactions", "oidc_transaction_id", f"consumed_at is null and {_SAT} < expires_at", lambda: t.transaction_valid(t.instant(SESSION_AT)))
_flag("T11_principal_active", "principals", "principal_id", "status = 'active'", lambda: t.principal_active())
query("T10_token_times", """select request_id, case when 1000 >= exp + 60 then 'expired' when nbf is not null and nbf > 1060 then 'not_yet_valid' when iat > 1060 then 'bad_issued_at' else 'ok' end as outcome from
  (select request_id, 900 + request_id % 200 as iat, case when request_id % 3 = 0 then null else 1000 + request_id % 90 end as nbf, 850 + request_id % 400 as exp from request_log) x""")(
    lambda m: m.request_log.select("request_id", t.token_times(F.lit(1000), 900 + F.col("request_id") % 200, F.when(F.col("request_id") % 3 != 0, 1000 + F.col("request_id") % 90), 850 + F.col("request_id") % 400).alias("outcome"))
)
query("T12_audience", """select request_id, case when not list_contains(aud, 'me') then 'bad_audience' when len(aud) > 1 and azp is null then 'azp_missing' when azp is not null and azp <> 'me' then 'azp_mismatch'
  else 'ok' end as outcome from (select request_id, case when request_id % 4 = 0 then ['me'] when request_id % 4 = 1 then ['me', 'other'] else ['other'] end as aud,
  case when request_id % 3 = 0 then 'me' when request_id % 3 = 1 then 'other' end as azp from request_log) x""")(
    lambda m: m.request_log.select("request_id", t.audience(
        F.expr("case when request_id % 4 = 0 then array('me') when request_id % 4 = 1 then array('me', 'other') else array('other') end"),
        F.expr("case when request_id % 3 = 0 then 'me' when request_id % 3 = 1 then 'other' end"), F.lit("me")).alias("outcome"))
)
_STATES = "case action_code when 'CLICK' then 'Starting' when 'VIEW' then 'Ready' when 'SIGNUP' then 'ShuttingDown' when 'PURCHASE' then 'Stopped' else 'Failed' end"
query("T13_lifecycle_moves", f"""select event_id, before is null or before = after or before || '>' || after in ({', '.join(f"'{a}>{b}'" for a, b in t.MOVES)}) as legal from
  (select event_id, {_STATES} as after, lag({_STATES}) over (partition by workspace_id order by sequence) as before from audit_source) x""")(
    lambda m: (lambda rows: rows.select("event_id", t.move_legal(F.lag("after").over(Window.partitionBy("workspace_id").orderBy("sequence")), F.col("after")).alias("legal")))(
        m.audit_source.withColumn("after", F.expr(_STATES)))
)

# --- isolation --------------------------------------------------------------------------------------------------------

_ctx = access.TenantContext(3)
query("R1_strict_rows", "select membership_id, workspace_id from memberships where workspace_id = 3")(lambda m: access.scoped(m.memberships, "memberships", _ctx).select("membership_id", "workspace_id"))
query("R2_shared_rows", "select capability_grant_id, workspace_id from capability_grants where workspace_id is null or workspace_id = 3")(
    lambda m: access.scoped(m.capability_grants, "capability_grants", _ctx).select("capability_grant_id", "workspace_id")
)
query("R3_no_context", "select 'capability_grants' as table_name, count(*) as n from capability_grants where workspace_id is null union all select 'memberships', 0")(
    lambda m: union_all([
        access.scoped(getattr(m, x), x, access.TenantContext()).agg(F.count("*").alias("n")).select(F.lit(x).alias("table_name"), "n") for x in ("capability_grants", "memberships")])
)
query("R4_refused_writes", "select membership_id from memberships where workspace_id <> 3")(
    lambda m: access.check_rows(m.memberships, "memberships", _ctx).select("membership_id")
)
query("R5_blind_updates", "select count(*) as affected from memberships where workspace_id = 3 and role_code = 'reader'")(
    lambda m: access.scoped(m.memberships, "memberships", _ctx).where("role_code = 'reader'").agg(F.count("*").alias("affected"))
)
_CONTEXTS = "case membership_id % 3 when 0 then null when 1 then workspace_id else 3 end"
query("R6_contexts", f"select membership_id, c is not null as is_set from (select membership_id, {_CONTEXTS} as c from memberships) x")(
    lambda m: m.memberships.withColumn("context", F.expr(_CONTEXTS)).select("membership_id", F.coalesce(access.context_error("context", "context") != "unset", F.lit(True)).alias("is_set"))
)
def _in_turn(m, steps) -> DataFrame:
    """Rows that the session's context shows after each step: (step, table_name, shown)."""
    shown = []
    for i, workspace in enumerate(steps):
        access.set_context(m.spark, workspace)
        for name, df in (("memberships", m.memberships), ("capability_grants", m.capability_grants), ("principals", m.principals)):
            shown.append(df.where(access.session_policy(name)).agg(F.count("*").alias("shown")).select(F.lit(i).alias("step"), F.lit(name).alias("table_name"), "shown"))
    access.clear_context(m.spark)
    return union_all(shown)


_STEPS = "\nunion all ".join(
    f"select {i} as step, 'memberships' as table_name, count(*) as shown from memberships where workspace_id = {w} union all select {i}, 'capability_grants', count(*) from capability_grants where workspace_id is null or workspace_id = {w} "
    f"union all select {i}, 'principals', count(*) from principals" for i, w in enumerate((3, "null", 5, "null"))
)
query("R6_context_set_and_cleared", _STEPS)(lambda m: _in_turn(m, (3, None, 5, None)))
def _setting(m) -> DataFrame:
    access.set_context(m.spark, 7)
    rows = m.request_log.where(access.session_policy("idempotency_records")).select("request_id", access.current_context().alias("scope"))
    access.clear_context(m.spark)
    return rows


query("S20_session_setting", "select request_id, '7' as scope from request_log where workspace_id is null or workspace_id = 7")(_setting)
query("R7_verified_contexts", f"select membership_id, case when c is null then 'unset' when c <> workspace_id then 'mismatch' end as error from (select *, {_CONTEXTS} as c from memberships) x")(
    lambda m: m.memberships.withColumn("context", F.expr(_CONTEXTS)).select("membership_id", access.context_error("context", "workspace_id").alias("error"))
)
query("R8_unscoped_rows", "select principal_id from principals")(lambda m: access.scoped(m.principals, "principals", _ctx).select("principal_id"))
_PLAIN = "'organizations', 'programs', 'principals', 'workspaces', 'memberships', 'capability_grants', 'oidc_identities', 'sessions', 'session_rotations', 'oidc_transactions'"
query("R9_privileges", f"""select role, t as table_name, p as privilege from (select unnest(['app', 'worker']) as role) r, (select unnest([{_PLAIN}]) as t) a, (select unnest(['SELECT', 'INSERT', 'UPDATE', 'DELETE']) as p) b
  union all select role, t, p from (select unnest(['app', 'worker', 'audit_append']) as role) r, (values ('audit_chain_heads', 'SELECT'), ('audit_chain_heads', 'INSERT'), ('audit_chain_heads', 'UPDATE'),
  ('audit_events', 'SELECT'), ('audit_events', 'INSERT')) v(t, p) union all select role, 'idempotency_records', p from (select unnest(['app', 'worker']) as role) r, (select unnest(['SELECT', 'INSERT', 'UPDATE']) as p) b
  union all select 'ops_readonly', unnest([{_PLAIN}, 'idempotency_records', 'audit_chain_heads', 'audit_events']), 'SELECT'""")(lambda m: access.privileges(m.spark))  # fmt: skip
query("R10_private_status", "select membership_id, case when resolution = 'ok' then 200 when resolution in ('principal_not_found', 'principal_inactive') then 403 else 404 end as status from x", ("x", _RESOLVED))(
    lambda m: resolved(m).select("membership_id", access.private_status("resolution").alias("status"))
)
