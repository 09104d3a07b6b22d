"""Audit chains, idempotency, sessions, scalars and paging on literal fixtures."""

import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardstone.functions import scalars as x
from wardstone.functions.temporal import instant
from wardstone.operators import audit, integrity, lifecycle, reads
from wardstone.plans import rules


def chain(spark):
    events = spark.sql("""select * from values (1, 'e1', timestamp_ntz '2024-01-01 00:00:00', '{"a":1}'), (1, 'e2', timestamp_ntz '2024-01-01 00:00:01.5', '{}'), (1, 'e3', timestamp_ntz '2024-01-01 00:00:02.000007', '{}'),
      (2, 'e4', timestamp_ntz '2024-01-01 00:00:00', '{}') as t(workspace_id, audit_event_id, occurred_at, metadata)""")  # fmt: skip
    return audit.chained(events, order=("occurred_at",))


def test_chain_verifies_and_finds_tampering(spark):
    c = chain(spark).cache()
    assert all(r["intact"] for r in audit.verified(c).collect()) and audit.head_mismatches(audit.chain_heads(c), c).count() == 0
    tampered = c.withColumn("body", F.when(F.col("audit_event_id") == "e2", "{}").otherwise(F.col("body")))
    bad = {r["workspace_id"]: r for r in audit.verified(tampered).collect()}
    assert (bad[1]["kind"], bad[1]["sequence"]) == ("HashTamperDetected", 2) and bad[2]["intact"]
    assert audit.verified(c.where("sequence != 2")).where("workspace_id = 1").first()["kind"] == "SequenceGap"
    twice = audit.verified(c.unionByName(c.where("audit_event_id = 'e1'"))).where("workspace_id = 1").first()
    assert twice["kind"] == "SequenceDisorder" and twice["index"] == 1
    mixed = audit.event_errors(c, partitioned=False, expected_workspace=1).where("workspace_id = 2").first()
    assert mixed["kind"] == "WorkspaceMismatch"


def test_append_continues_a_chain(spark):
    c = chain(spark).cache()
    more = spark.sql("select 1 workspace_id, 'e9' audit_event_id, timestamp_ntz '2024-02-01 00:00:00' occurred_at, '{}' metadata")
    added = audit.chained(more, audit.chain_heads(c), order=("occurred_at",))
    assert added.first()["sequence"] == 4
    assert all(r["intact"] for r in audit.verified(c.unionByName(added)).collect())


def test_canonical_json(spark):
    texts = ['{"b":1,"a":2,"c":3}', ' [1.0, 1e2, -0.5, 1e-7, true, null, "é\\u001f\\n\\"" ] ', "not json", None, '{"\\ud83d\\ude00":1,"\\ufb33":2}']
    got = [r["c"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", audit.canonical_json("t").alias("c")).orderBy("i").collect()]
    assert got == ['{"a":2,"b":1,"c":3}', '[1.0,100.0,-0.5,1e-7,true,null,"é\\u001f\\n\\""]', None, None, '{"😀":1,"\ufb33":2}']


def test_idempotency_script(spark):
    key = dict(workspace_id=None, principal_id=1, route_code="R", key_hash="k")
    req = lambda h: spark.createDataFrame([(None, 1, "R", "k", h)], "workspace_id int, principal_id int, route_code string, key_hash string, request_hash string")
    rec = lambda status, until: spark.createDataFrame([(7, None, 1, "R", "k", "h", status, None)], "record_id int, workspace_id int, principal_id int, route_code string, key_hash string, request_hash string, response_status int, response_body string").withColumn("expires_at", instant(until))
    out = lambda h, r: lifecycle.arbitrated(req(h), r, instant("2024-01-02 00:00:00")).first()
    live, old = "2024-01-03 00:00:00", "2024-01-01 00:00:00"
    assert out("h", rec(None, live).limit(0))["outcome"] == "Acquired" and out("h", rec(None, live))["outcome"] == "InProgress"
    done = lifecycle.completed(rec(None, live), spark.createDataFrame([(7, 201, "b")], "record_id int, status int, body string"))
    assert lifecycle.completed(done, spark.createDataFrame([(7, 500, "x")], "record_id int, status int, body string")).first()["response_status"] == 201
    assert (out("h", done)["outcome"], out("h", done)["status_code"]) == ("Replay", 201)
    assert out("other", done)["outcome"] == "Mismatch" and out("other", done)["expected_hash"] == "h"
    assert out("h", rec(None, old))["outcome"] == "Acquired" and out("h", rec(201, old))["outcome"] == "Replay"
    assert lifecycle.failed(rec(None, live), rec(None, live).select("record_id")).count() == 0 and key


def test_log_with_expiry(spark):
    log = spark.sql("""select * from values (1, timestamp_ntz '2024-01-01 00:00:00', 'h'), (2, timestamp_ntz '2024-01-01 00:00:09', 'h'), (3, timestamp_ntz '2024-01-01 00:00:10', 'g'), (4, timestamp_ntz '2024-01-01 00:00:11', 'h')
      as t(request_id, requested_at, request_hash)""").select(F.lit(1).alias("workspace_id"), F.lit(1).alias("principal_id"), F.lit("r").alias("route_code"), F.lit("k").alias("key_hash"), "*")
    got = {r["request_id"]: r["outcome"] for r in lifecycle.replayed_log_ttl(log, 10).collect()}
    assert got == {1: "Acquired", 2: "InProgress", 3: "Mismatch", 4: "Acquired"}


def test_sixth_session_evicts_the_oldest(spark):
    rows = [(f"s{i}", 1, f"2024-01-01 00:00:0{i}") for i in range(5)]
    s = spark.createDataFrame(rows, "session_id string, principal_id int, c string").select("session_id", "principal_id", F.col("c").cast("timestamp_ntz").alias("created_at"),
        instant("2024-01-02 00:00:00").alias("idle_expires_at"), instant("2024-01-09 00:00:00").alias("absolute_expires_at"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    t = instant("2024-01-01 01:00:00")
    assert [r["session_id"] for r in lifecycle.evicted_sessions(s, t).collect()] == ["s0"]
    assert lifecycle.evicted_sessions(s.where("session_id != 's4'"), t).count() == 0
    new = s.where("session_id = 's4'").withColumn("session_id", F.lit("s5"))
    assert {r["session_id"] for r in lifecycle.opened(s, new, t).where("revoked_at is not null").collect()} == {"s0"}


def test_identical_rotation_is_an_error(spark):
    got = spark.range(1).select(*integrity.rotation_error(F.lit("a"), F.lit("a"), F.lit(" "))).first()
    assert (got["error"], got["reason"]) == ("identical", "periodic")


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(x.hmac_sha256_hex(b"k" * 70, F.lit("m"))) == hmac.new(b"k" * 70, b"m", hashlib.sha256).hexdigest()
    assert [one(x.slug_error(F.lit(s))) for s in ("org-123_abc", "Org-123", "org 123", " ", None)] == [None, "bad_character", "bad_character", "empty", "empty"]
    assert [one(x.sensitive_key(F.lit(s))) for s in ("Authorization", "X-API-KEY", "cui_content", "user_password", "content-type", "accept")] == [True] * 4 + [False] * 2
    assert one(x.capability(F.lit(" custom_tool:execute "))) == "CUSTOM_TOOL:EXECUTE" and one(x.capability(F.lit("a b"))) is None
    assert one(x.pkce_challenge(F.lit("dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"))) == "E9Melhoa2OwvFrEMTJguCHaoeK1t8URWbuGJSstw-cM"
    assert one(x.pkce_challenge(F.lit("short"))) is None and one(x.canonical_origin(F.lit("null"))) is None
    assert one(x.canonical_origin(F.lit("HTTPS://A.example:443/x"))) == "https://a.example"
    origins = {"http://[::1]:8080/x": "http://[::1]:8080", "https://[2001:DB8::1]": "https://[2001:db8::1]", "http://h:70000": None, "http://h:0080/": "http://h", "http://h:": "http://h", "http://[::1": None}
    assert {o: one(x.canonical_origin(F.lit(o))) for o in origins} == origins
    urls = {"redis://:secret@host/0": "redis://:***@host/0", "POSTGRES://u:secret@h/d": "postgres://u:***@h/d", "postgres://u@h:5432/d": "postgres://u@h:5432/d", "postgres://u:p@ss@h/d": "postgres://u:***@h/d", "none": "none"}
    assert {u: one(x.masked_url(F.lit(u))) for u in urls} == urls
    decide = lambda origin, allowed: one(x.csrf_decision(F.lit("POST"), F.lit(True), F.lit(origin), F.lit("t"), allowed, F.lit("t")))
    assert [decide("https://a.example", ("HTTPS://A.example:443/",)), decide("https://a.example", ()), decide("http://[::1]", ("http://[::1]:80",))] == ["ok", "origin_mismatch", "ok"]


def test_keys_are_not_mixed_up(spark):
    """A null workspace, an empty one and parts with the separator are different keys."""
    rows = [(1, None, 1, "a|b", "h"), (2, "", 1, "a|b", "h"), (3, "x", 1, "a", "b|h"), (4, "x", 1, "a|b", "h"), (5, None, 1, "a|b", "h")]
    log = spark.createDataFrame(rows, "request_id long, workspace_id string, principal_id long, route_code string, key_hash string")
    log = log.withColumns({"requested_at": instant("2024-01-01 00:00:00"), "request_hash": F.lit("r")})
    got = {r["request_id"]: r["outcome"] for r in lifecycle.replayed_log_ttl(log, 60).collect()}
    assert got == {1: "Acquired", 2: "Acquired", 3: "Acquired", 4: "Acquired", 5: "InProgress"}


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=40))
def test_base64url_round_trip(spark, data):
    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(x.base64url("b").alias("t"), x.unbase64url(x.base64url("b")).alias("b")).first()
    assert bytes(got["b"]) == data and "=" not in got["t"]


def test_pages(spark):
    df = spark.createDataFrame([(i,) for i in (3, 1, 2)], "program_id int")
    first = reads.keyset_page(df, "program_id", 2).orderBy("program_id").collect()
    assert [(r["program_id"], r["has_more"], r["next_cursor"]) for r in first] == [(1, True, 2), (2, True, 2)]
    second = reads.keyset_page(df, "program_id", 2, 2).collect()
    assert [(r["program_id"], r["has_more"], r["next_cursor"]) for r in second] == [(3, False, None)]
    assert reads.keyset_page(df.limit(0), "program_id", 2).count() == 0
    assert reads.text_filter(df.select(F.lit("Ab c").alias("n")), "B C", ["n"]).count() == 3 and reads.text_filter(df.select(F.lit("Ab").alias("n")), " b", ["n"]).count() == 0
    history = reads.CursorHistory()
    history.next(None), history.next(2)
    assert (history.previous(), history.previous(), history.previous()) == (2, None, None)


def test_integrity_finds_injected_rows(spark):
    class Tables:
        organizations = spark.createDataFrame([(1, "Org", "a"), (2, "  ", "A")], "organization_id int, display_name string, slug string")
        programs = spark.createDataFrame([(1, 1, "p", "P", 1), (2, 9, "q", "Q", 0)], "program_id int, organization_id int, program_code string, name string, row_version int")

    blank = integrity.check_violations(Tables.organizations, *integrity.CHECKS[0][:1], "organizations", "organization_id", integrity.CHECKS[0][3])
    assert [r["row_key"] for r in blank.collect()] == ["2"]
    assert integrity.unique_violations(Tables.organizations, "C8", "organizations", ("lower(slug)",)).first()["row_key"] == "a"
    gone = integrity.foreign_violations(Tables, "C11", (("C11", "programs", "program_id", ("organization_id",), "organizations", ("organization_id",), "cascade"),))
    assert [r["row_key"] for r in gone.collect()] == ["2"]
    assert dict(integrity.guarded({"programs": Tables.programs, "none": Tables.programs.limit(0)}).collect()) == {"programs": True, "none": False}


@pytest.mark.parametrize("rule", sorted({x[0] for x in (*integrity.CHECKS, *integrity.UNIQUE, *integrity.FOREIGN)}))
def test_each_constraint_finds_what_was_planted(spark, rule):
    got = {r["table_name"] for r in integrity.violations(rules.Spoiled(spark, "/root/testdata/sf0.01"), rule).select("table_name").distinct().collect()}
    assert got == {x[1] for x in (*integrity.CHECKS, *integrity.UNIQUE, *integrity.FOREIGN) if x[0] == rule}


@pytest.mark.parametrize("status,want", [("ok", 200), ("workspace_not_found", 404), ("principal_inactive", 403)])
def test_private_status(spark, status, want):
    from wardstone.operators.access import private_status

    assert spark.range(1).select(private_status(F.lit(status))).first()[0] == want
