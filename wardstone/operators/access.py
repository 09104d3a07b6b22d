"""Who may do what: capability sets, resolution over all memberships, policy decisions, visibility and tenant isolation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import grant_active, grant_active_stored, membership_active, principal_active

#: Standard and special capabilities, and what a role gives; fixed values.
STANDARD = ("WORKSPACE_ADMIN", "WORKSPACE_READ", "WORKSPACE_WRITE", "AUDIT_READ")
SPECIAL = ("OVERRIDE_BLOCK", "RIGHTS_REVIEW", "RULE_ACTIVATION", "GRANT_AUTHORITY")
ROLES = {
    "admin": ("WORKSPACE_ADMIN", "WORKSPACE_READ", "WORKSPACE_WRITE", "AUDIT_READ"), "operator": ("WORKSPACE_READ", "WORKSPACE_WRITE"),
    "reviewer": ("WORKSPACE_READ", "AUDIT_READ"), "reader": ("WORKSPACE_READ",),
}


def array_of(names) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def role_capabilities(role: str | Column) -> Column:
    """The sorted capabilities of a role; none for an unknown one."""
    out = F.when(F.lit(False), array_of(()))
    for name, held in ROLES.items():
        out = out.when(F.lower(role) == name, array_of(sorted(held)))
    return out.otherwise(array_of(()))


def is_special(capability: str | Column) -> Column:
    return F.upper(capability).isin(*SPECIAL)


# --- sets: sorted arrays without repeats ------------------------------------------------------------------------------


def as_set(x) -> Column:
    return F.array_sort(F.array_distinct(x))


def union(a, b) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a, b) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a, b) -> Column:
    return F.array_sort(F.array_except(a, b))


def has_all(held, asked) -> Column:
    """True for an empty request."""
    return F.size(F.array_except(asked, held)) == 0


def has_any(held, asked) -> Column:
    """False for an empty request."""
    return F.size(F.array_intersect(held, asked)) > 0


def has_named(held, name: str) -> Column:
    return F.exists(held, lambda x: F.upper(x) == name.upper())


def is_subset(a, b) -> Column:
    return F.size(F.array_except(a, b)) == 0


def inserted(held, name) -> Column:
    return as_set(F.array_append(held, name))


def removed(held, name) -> Column:
    return F.array_remove(held, name)


def special_part(held) -> Column:
    return F.filter(held, lambda x: x.isin(*SPECIAL))


def standard_part(held) -> Column:
    return F.filter(held, lambda x: ~x.isin(*SPECIAL))


def named_predicates(held) -> dict[str, Column]:
    """can_<capability> columns for the standard and the special capabilities."""
    return {f"can_{c.lower()}": F.array_contains(held, c) for c in (*STANDARD, *SPECIAL)}


# --- resolution -------------------------------------------------------------------------------------------------------


def grants_in_scope(pairs: DataFrame, grants: DataFrame) -> DataFrame:
    """Grants of each (workspace_id, program_id, principal_id): those of the workspace and those of its program.

    The OR of the two scopes is one equi-join on (kind of scope, its id, principal), for which each side is read once; a
    grant that both scopes find counts once.
    """

    def by_scope(df: DataFrame) -> DataFrame:
        kinds = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id"))) for c in ("workspace_id", "program_id")]
        return df.withColumn("scope", F.explode(F.array_compact(F.array(*kinds))))

    g = by_scope(grants).withColumnsRenamed({c: f"g_{c}" for c in ("workspace_id", "program_id", "principal_id", "scope")})
    found = by_scope(pairs).join(g, (F.col("scope") == F.col("g_scope")) & (F.col("principal_id") == F.col("g_principal_id")))
    twice = (F.col("scope.kind") == "program_id") & F.col("g_workspace_id").eqNullSafe(F.col("workspace_id"))
    return found.where(~twice).drop("scope", "g_scope", "g_workspace_id", "g_program_id", "g_principal_id")


def effective_capabilities(memberships: DataFrame, workspaces: DataFrame, grants: DataFrame, t: Column) -> DataFrame:
    """For each active (workspace, principal, role): role capabilities with those of active grants, and the active grants.

    A grant counts if the store's filter and the in-memory check both hold at ``t``. Only memberships are resolved,
    never all principals with all workspaces.
    """
    active = memberships.where(membership_active(t)).select("workspace_id", "principal_id", "role_code").distinct()
    active = active.join(workspaces.select("workspace_id", "program_id"), "workspace_id")
    live = grants.where(grant_active_stored(t) & grant_active(t)).select("workspace_id", "program_id", "principal_id", "capability_grant_id", "capability_code")
    keys = ["workspace_id", "principal_id", "role_code"]
    given = grants_in_scope(active, live).groupBy(*keys).agg(F.collect_set("capability_code").alias("granted"), F.count("*").alias("active_grants"))
    out = active.join(given, keys, "left")
    none = array_of(())
    return out.select(
        *keys, "program_id", union(role_capabilities("role_code"), F.coalesce("granted", none)).alias("capabilities"),
        F.coalesce("active_grants", F.lit(0).cast("long")).alias("active_grants"),
    )


def resolved_contexts(m: DataFrame, workspaces: DataFrame, programs: DataFrame, organizations: DataFrame, principals: DataFrame, t: Column) -> DataFrame:
    """Each membership with the first stage at which its resolution fails, or 'ok'."""
    w = workspaces.select("workspace_id", "program_id", F.col("organization_id").alias("w_organization_id"))
    p = programs.select("program_id", F.col("organization_id").alias("p_organization_id"))
    o = organizations.select(F.col("organization_id").alias("o_organization_id"))
    x = principals.select("principal_id", F.col("status").alias("principal_status"))
    rows = m.join(w, "workspace_id", "left").join(p, "program_id", "left").join(o, F.col("p_organization_id") == F.col("o_organization_id"), "left").join(x, "principal_id", "left")
    reason = (
        F.when(F.col("w_organization_id").isNull(), "workspace_not_found").when(F.col("p_organization_id").isNull(), "program_not_found")
        .when(F.col("p_organization_id") != F.col("w_organization_id"), "hierarchy_mismatch").when(F.col("o_organization_id").isNull(), "organization_not_found")
        .when(F.col("principal_status").isNull(), "principal_not_found").when(~principal_active("principal_status"), "principal_inactive")
        .when(~membership_active(t), "membership_inactive").otherwise("ok")
    )
    return rows.select("membership_id", "workspace_id", "principal_id", "program_id", F.col("p_organization_id").alias("organization_id"), reason.alias("resolution"))


#: Failures that look like a missing page, so that nobody learns what exists; fixed values.
PRIVATE = ("workspace_not_found", "program_not_found", "organization_not_found", "hierarchy_mismatch", "membership_inactive")


def private_status(resolution: str | Column) -> Column:
    r = F.col(resolution) if isinstance(resolution, str) else resolution
    return F.when(r == "ok", 200).when(r.isin(*PRIVATE), 404).otherwise(403)


# --- policy -----------------------------------------------------------------------------------------------------------


def _decision(allowed: Column, reason: Column, missing: Column) -> Column:
    none = array_of(())
    return F.struct(
        F.coalesce(allowed, F.lit(False)).alias("allowed"), F.when(~allowed, reason).alias("reason"), F.when(allowed, none).otherwise(missing).alias("missing")
    )


def require(held, name: str) -> Column:
    reason = "MissingSpecialAuthority" if name in SPECIAL else "MissingCapability"
    return _decision(F.array_contains(held, name), F.lit(reason), array_of((name,)))


def require_all(held, asked: list[str]) -> Column:
    """A denial lists what is missing, in the order asked, repeats included."""
    missing = F.filter(array_of(asked), lambda x: ~F.array_contains(held, x))
    return _decision(F.size(missing) == 0, F.lit("MissingAll"), missing)


def require_any(held, asked: list[str]) -> Column:
    """An empty request is denied; a denial lists all that was asked."""
    return _decision(has_any(held, array_of(asked)) if asked else F.lit(False), F.lit("MissingAny"), array_of(asked))


def require_special(held, name: str) -> Column:
    return _decision(F.array_contains(held, name), F.lit("MissingSpecialAuthority"), array_of((name,)))


def evaluate(kind: str, held, asked: list[str]) -> Column:
    """The rule of a kind: require, all, any or special."""
    rules = {"require": lambda: require(held, asked[0]), "all": lambda: require_all(held, asked), "any": lambda: require_any(held, asked), "special": lambda: require_special(held, asked[0])}
    return rules[kind]()


def denial_text(decision: str) -> Column:
    d = F.col(decision)
    return F.when(~d["allowed"], F.concat(d["reason"], F.lit(": "), F.array_join(d["missing"], ", ")))


def transaction_gate(selected, context, held, capabilities: list[str], authorities: list[str]) -> Column:
    """The first failure of a scoped transaction: another workspace, then capabilities, then authorities; else 'ok'."""
    return (
        F.when(~F.col(selected).eqNullSafe(F.col(context)), "TenantBoundaryMismatch").when(~has_all(held, array_of(capabilities)), "MissingCapability")
        .when(~has_all(held, array_of(authorities)), "MissingSpecialAuthority").otherwise("ok")
    )


def endpoint_gates(held) -> dict[str, Column]:
    """Who may call what. Creating a membership passes a loose gate first and then needs an administrator anyway."""
    can = lambda name: F.array_contains(held, name)
    first = can("WORKSPACE_ADMIN") | has_named(held, "MEMBERSHIP_MANAGE")
    return {
        "may_grant": can("GRANT_AUTHORITY"), "may_revoke": can("GRANT_AUTHORITY"), "membership_first_gate": first,
        "may_create_membership": first & can("WORKSPACE_ADMIN"), "may_read": can("WORKSPACE_READ"),
    }


#: HTTP status by kind of error; fixed values.
STATUS = {
    "unauthenticated": 401, "session_not_found": 401, "session_expired": 401, "session_revoked": 401, "csrf_origin_mismatch": 403, "csrf_missing_origin": 403,
    "csrf_missing_header": 403, "csrf_token_mismatch": 403, "state_mismatch": 400, "transaction_expired": 400, "nonce_mismatch": 400, "invalid_token": 400,
    "idp_communication": 500, "jwks_fetch": 500, "unauthorized": 401, "authorization": 403, "not_found": 404, "domain": 400, "conflict": 409,
    "idempotency_mismatch": 400, "idempotency_in_progress": 400, "security_violation": 403, "context_verification": 500, "persistence": 500, "internal": 500,
}


def error_status(kind: str | Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, status in STATUS.items():
        out = out.when((F.col(kind) if isinstance(kind, str) else kind) == name, status)
    return out.otherwise(500)


# --- visibility of programs -------------------------------------------------------------------------------------------


def programs_by_membership(workspaces: DataFrame, memberships: DataFrame) -> DataFrame:
    """(program_id, principal_id): any membership in any workspace of the program, whatever its status."""
    pairs = memberships.select("workspace_id", "principal_id").distinct()
    return workspaces.select("workspace_id", "program_id").join(pairs, "workspace_id").select("program_id", "principal_id").distinct()


def programs_by_grant(workspaces: DataFrame, grants: DataFrame) -> DataFrame:
    """(program_id, principal_id): a grant for the program or for one of its workspaces; revoked and expired ones count. Grants are read once."""
    scopes = grants.select("principal_id", "program_id", "workspace_id").distinct()
    own = workspaces.select(F.col("workspace_id").alias("__w"), F.col("program_id").alias("__p"))
    both = scopes.join(own, F.col("workspace_id") == F.col("__w"), "left").select("principal_id", F.explode(F.array_compact(F.array("program_id", "__p"))).alias("program_id"))
    return both.select("program_id", "principal_id").distinct()


def visible_pairs(workspaces: DataFrame, memberships: DataFrame, grants: DataFrame) -> DataFrame:
    """(program_id, principal_id) by membership or grant."""
    return programs_by_membership(workspaces, memberships).unionByName(programs_by_grant(workspaces, grants)).distinct()


def visible_programs(programs: DataFrame, workspaces: DataFrame, memberships: DataFrame, grants: DataFrame, principal) -> DataFrame:
    """Programs that a principal sees: those without workspaces, and those of ``visible_pairs``."""
    mine = lambda df: df.where(F.col("principal_id") == F.lit(principal))
    seen = visible_pairs(workspaces, mine(memberships), mine(grants)).select("program_id")
    open_ = programs.join(workspaces.select("program_id"), "program_id", "left_anti")
    return open_.unionByName(programs.join(seen, "program_id", "left_semi")).distinct()


# --- tenant isolation -------------------------------------------------------------------------------------------------

#: How each table is scoped; tables that are not named are not scoped.
STRICT = ("workspaces", "memberships", "audit_chain_heads", "audit_events")
SHARED = ("capability_grants", "idempotency_records")


@dataclass(frozen=True)
class TenantContext:
    """The workspace that reads and writes are scoped to; None is no context."""

    workspace_id: object = None

    def verify(self, authorised) -> None:
        if self.workspace_id is None or self.workspace_id != authorised:
            raise PermissionError("the tenant context is not the authorised workspace")


#: The session's variable that holds the workspace of the current context, '' for none.
VARIABLE = "app_workspace_id"


def set_context(spark: SparkSession, workspace_id) -> None:
    """Set the session's context; plans made from now on read it, those made before keep theirs."""
    spark.sql(f"declare or replace variable {VARIABLE} string default ''")
    spark.sql(f"set variable {VARIABLE} = :id", args={"id": "" if workspace_id is None else str(workspace_id)})


def clear_context(spark: SparkSession) -> None:
    """No context: strict tables give no rows."""
    set_context(spark, None)


def current_context() -> Column:
    """The session's context as text, null where it is cleared; it must have been set or cleared once."""
    return F.nullif(F.expr(f"system.session.{VARIABLE}"), F.lit(""))


def session_policy(table: str) -> Column:
    """``policy`` by the session's context."""
    if table not in STRICT + SHARED:
        return F.lit(True)
    own = F.col("workspace_id").cast("string") == current_context()
    return own if table in STRICT else F.col("workspace_id").isNull() | F.coalesce(own, F.lit(False))


def context_error(context: str, authorised: str) -> Column:
    """Why a request's context is refused, as ``TenantContext.verify`` does for one: unset, or another workspace; null if it fits."""
    return F.when(F.col(context).isNull(), "unset").when(~F.col(context).eqNullSafe(F.col(authorised)), "mismatch")


def policy(table: str, ctx: TenantContext) -> Column:
    """The predicate for a table's rows. Without a context it is null for strict tables, so they give no rows."""
    if table not in STRICT + SHARED:
        return F.lit(True)
    own = F.col("workspace_id") == F.lit(ctx.workspace_id) if ctx.workspace_id is not None else F.lit(None).cast("boolean")
    return own if table in STRICT else F.col("workspace_id").isNull() | F.coalesce(own, F.lit(False))


def scoped(df: DataFrame, table: str, ctx: TenantContext) -> DataFrame:
    """The rows of a table that a context may read; the predicate is pushed to the scan."""
    return df.where(policy(table, ctx))


def check_rows(df: DataFrame, table: str, ctx: TenantContext) -> DataFrame:
    """New or changed rows that the context may not write."""
    return df.where(~F.coalesce(policy(table, ctx), F.lit(False)))


def privileges(spark: SparkSession) -> DataFrame:
    """(role, table_name, privilege) of the store's roles; fixed values."""
    crud, plain = ("SELECT", "INSERT", "UPDATE", "DELETE"), (
        "organizations", "principals", "programs", "workspaces", "memberships", "capability_grants", "oidc_identities", "sessions", "session_rotations", "oidc_transactions",
    )
    guarded = {"idempotency_records": crud[:3], "audit_chain_heads": crud[:3], "audit_events": crud[:2]}
    rows = [(role, t, p) for role in ("app", "worker") for t, ps in {**dict.fromkeys(plain, crud), **guarded}.items() for p in ps]
    rows += [("audit_append", t, p) for t in ("audit_chain_heads", "audit_events") for p in guarded[t]]
    rows += [("ops_readonly", t, "SELECT") for t in (*plain, *guarded)]
    return spark.createDataFrame(rows, "role string, table_name string, privilege string")
