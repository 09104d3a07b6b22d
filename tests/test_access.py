"""Literal fixtures: role matrix, grants, policies, set algebra, isolation."""

import pytest
from pyspark.sql import functions as F

from wardstone.functions.temporal import audience, grant_active, instant, token_times, transaction_valid
from wardstone.operators import access

TIME = "2024-01-01 12:00:00"


def held(spark, *names):
    return spark.createDataFrame([(list(names),)], "caps array<string>")


@pytest.mark.parametrize("role,want", [
    ("admin", {"WORKSPACE_ADMIN", "WORKSPACE_READ", "WORKSPACE_WRITE", "AUDIT_READ"}), ("operator", {"WORKSPACE_READ", "WORKSPACE_WRITE"}),
    ("reviewer", {"WORKSPACE_READ", "AUDIT_READ"}), ("reader", {"WORKSPACE_READ"}), ("nobody", set()),
])
def test_role_matrix(spark, role, want):
    got = spark.range(1).select(access.role_capabilities(F.lit(role)).alias("c")).first()["c"]
    assert set(got) == want and not want & set(access.SPECIAL)


def test_policies(spark):
    df = held(spark, "WORKSPACE_READ", "WORKSPACE_WRITE")
    c = F.col("caps")
    ask = [
        access.require_all(c, ["WORKSPACE_READ", "WORKSPACE_WRITE"]), access.require_all(c, ["WORKSPACE_READ", "WORKSPACE_ADMIN", "AUDIT_READ"]),
        access.require_any(c, ["WORKSPACE_ADMIN", "WORKSPACE_READ"]), access.require_any(c, ["WORKSPACE_ADMIN", "AUDIT_READ"]), access.require_special(c, "OVERRIDE_BLOCK"), access.require_any(c, []),
    ]
    got = df.select(*(x.alias(f"d{i}") for i, x in enumerate(ask))).first()
    assert [d["allowed"] for d in got] == [True, False, True, False, False, False]
    assert got[1]["missing"] == ["WORKSPACE_ADMIN", "AUDIT_READ"] and got[4]["reason"] == "MissingSpecialAuthority"


def test_set_algebra(spark):
    a, b = (access.array_of(x) for x in (("WORKSPACE_READ", "WORKSPACE_WRITE"), ("WORKSPACE_WRITE", "WORKSPACE_ADMIN")))
    u, i, d = spark.range(1).select(access.union(a, b), access.intersection(a, b), access.difference(a, b)).first()
    assert len(u) == 3 and i == ["WORKSPACE_WRITE"] and d == ["WORKSPACE_READ"]


def test_grants_resolve(spark):
    ts = "timestamp_ntz"
    memberships = spark.sql(f"select 1 membership_id, 1 workspace_id, 9 principal_id, 'operator' role_code, 'active' status, {ts} '2023-01-01 00:00:00' valid_from, cast(null as {ts}) valid_until")
    workspaces = spark.sql("select 1 workspace_id, 5 program_id")
    grants = spark.sql(f"""select * from values (1, 1, null, 9, 'OVERRIDE_BLOCK', null, null), (2, 1, null, 9, 'RIGHTS_REVIEW', {ts} '2023-06-01 00:00:00', null), (3, 2, null, 9, 'RULE_ACTIVATION', null, null),
      (4, null, 5, 9, 'RULE_ACTIVATION', null, null), (5, 1, null, 8, 'GRANT_AUTHORITY', null, null), (6, 1, null, 9, 'AUDIT_READ', null, {ts} '2024-01-01 11:55:00')
      as t(capability_grant_id, workspace_id, program_id, principal_id, capability_code, expires_at, revoked_at)""")  # fmt: skip
    (row,) = access.effective_capabilities(memberships, workspaces, grants, instant(TIME)).collect()
    assert row["active_grants"] == 2 and row["capabilities"] == ["OVERRIDE_BLOCK", "RULE_ACTIVATION", "WORKSPACE_READ", "WORKSPACE_WRITE"]


def test_isolation(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, workspace_id int")
    ids = lambda t, c: sorted(r["id"] for r in access.scoped(df, t, c).collect())
    assert ids("memberships", access.TenantContext(1)) == [1] and ids("memberships", access.TenantContext()) == []
    assert ids("capability_grants", access.TenantContext(1)) == [1, 3] and ids("capability_grants", access.TenantContext()) == [3]
    assert ids("principals", access.TenantContext(1)) == [1, 2, 3]
    assert sorted(r["id"] for r in access.check_rows(df, "memberships", access.TenantContext(1)).collect()) == [2, 3]
    with pytest.raises(PermissionError):
        access.TenantContext(1).verify(2)
    access.TenantContext(1).verify(1)


def test_times(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(transaction_valid(at("2024-01-01 00:00:00"), at("2024-01-01 00:10:00"), at(None)))
    assert not one(transaction_valid(at("2024-01-01 00:10:00"), at("2024-01-01 00:10:00"), at(None)))
    assert not one(grant_active(instant(TIME), at("2024-01-01 12:00:00"), at(None))) and one(grant_active(instant(TIME), at(None), at("2024-01-01 12:00:01")))
    assert [one(token_times(F.lit(1000), F.lit(i), F.lit(n), F.lit(e))) for i, n, e in ((900, None, 940), (900, None, 941), (900, 1061, 2000), (1061, None, 2000))] == ["expired", "ok", "not_yet_valid", "bad_issued_at"]
    aud = lambda names, azp: one(audience(access.array_of(names), F.lit(azp).cast("string"), F.lit("me")))
    assert [aud(("me",), None), aud(("x",), None), aud(("me", "x"), None), aud(("me", "x"), "me"), aud(("me",), "x")] == ["ok", "bad_audience", "azp_missing", "ok", "azp_mismatch"]
