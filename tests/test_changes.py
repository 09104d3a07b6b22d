"""Logs of changes, openings, closures, replays, ranges and snapshots against plain Python."""

import json
import random
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wardstone.functions import scalars as x
from wardstone.functions.temporal import instant
from wardstone.operators import access, audit, integrity, lifecycle
from wardstone.operators.ranges import numbered

T = "2024-01-15 12:00:00"


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("keep_null", [False, True])
def test_a_log_of_changes_is_what_one_after_the_other_gives(spark, keep_null):
    rng = random.Random(4)
    rows = [(k, f"a{k}", k, 1) for k in range(20)]
    log = [(rng.randrange(24), at, rng.choice([None, f"b{at}"]), rng.choice([None, at])) for at in range(200)]
    state = {r[0]: list(r) for r in rows}
    for k, _, a, b in log:
        if k in state:
            for i, v in ((1, a), (2, b)):
                if v is not None or not keep_null:
                    state[k][i] = v
            state[k][3] += 1
    rng.shuffle(log)
    df, changes = spark.createDataFrame(rows, "k int, a string, b int, v int"), spark.createDataFrame(log, "k int, at int, a string, b int").repartition(5)
    got = lifecycle.updated(df, changes, "k", ["a", "b"], bump="v", keep_null=keep_null, order=("at",)).collect()
    assert sorted(map(list, got)) == sorted(state.values())


def test_two_changes_of_one_key_without_an_order(spark):
    df, twice = spark.createDataFrame([(1, "a", 1)], "k int, a string, v int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    assert [tuple(r) for r in lifecycle.updated(df, twice, "k", ["a"], bump="v").collect()] == [(1, "y", 3)]
    new = spark.createDataFrame([(1, "z", 1), (2, "q", 1), (2, "p", 1)], df.schema)
    assert sorted(map(tuple, lifecycle.inserted(df, new, "k").collect())) == [(1, "a", 1), (2, "p", 1)]


SESSION = "session_id string, principal_id int, created_at timestamp_ntz, idle_expires_at timestamp_ntz, absolute_expires_at timestamp_ntz, revoked_at timestamp_ntz"


@pytest.mark.parametrize("old, opened, most, last_alive", [(5, 4, 5, True), (8, 1, 5, True), (2, 9, 5, True), (3, 1, 5, True), (6, 0, 5, True), (5, 3, 5, False), (0, 7, 1, True)])
def test_openings_one_after_the_other(spark, old, opened, most, last_alive):
    at = lambda s: f"timestamp_ntz '2024-01-15 {s}'"
    row = lambda i, s, d, until: f"('{i}', 1, {at(s)}, {until}, {at('23:00:00')}, cast(null as timestamp_ntz))"
    rows = [row(f"o{i}", f"10:00:{i:02}", 1, at("23:00:00")) for i in range(old)]
    new = [row(f"n{i}", f"12:00:{i:02}", 1, at("23:00:00" if last_alive or i < opened - 1 else "12:00:00")) for i in range(opened)]
    table = lambda rows: spark.sql(f"select * from values {', '.join(rows)} as t(session_id, principal_id, created_at, idle_expires_at, absolute_expires_at, revoked_at)") if rows else spark.createDataFrame([], SESSION)
    active = [f"o{i}" for i in range(old)]
    for i in range(opened):
        active = active[max(0, len(active) - most + 1) :]
        if last_alive or i < opened - 1:
            active.append(f"n{i}")
    got = lifecycle.opened(table(rows), table(new), instant(T), most).where("revoked_at is null").collect()
    idle = {f"n{opened - 1}"} if opened and not last_alive else set()
    assert {r["session_id"] for r in got} == set(active) | idle


def test_rotations_of_one_session_follow_each_other(spark):
    sessions = spark.sql(f"select 's' session_id, 'h0' handle_hash, 4 rotation_counter, timestamp_ntz '{T}' last_seen_at, timestamp_ntz '{T}' idle_expires_at")
    changes = spark.createDataFrame([("s", "h2", "b", 2), ("s", "h1", "a", 1), ("s", "h3", "c", 3), ("gone", "h9", "a", 1)], "session_id string, new_hash string, reason string, at int")
    after, rows = lifecycle.rotated(sessions, changes, instant(T), order=("at",))
    assert [(r["handle_hash"], r["rotation_counter"]) for r in after.collect()] == [("h3", 7)]
    assert sorted(map(tuple, rows.collect())) == [("s", 5, "h0", "h1", "a"), ("s", 6, "h1", "h2", "b"), ("s", 7, "h2", "h3", "c")]


def test_a_closure_over_tables_that_refer_to_each_other(spark):
    rng = random.Random(7)
    people = [(i, rng.choice([None, *range(i)]) if i else None, rng.choice([None, 1, 2, 3])) for i in range(60)]
    teams = [(i, rng.choice([None, *range(60)])) for i in range(1, 5)]
    notes = [(i, rng.randrange(60), rng.randrange(60)) for i in range(100)]

    tables = SimpleNamespace(
        people=spark.createDataFrame(people, "id int, boss int, team int"), teams=spark.createDataFrame(teams, "team_id int, lead int"), notes=spark.createDataFrame(notes, "note int, author int, reader int")
    )
    foreign = (
        ("F", "people", "id", ("boss",), "people", ("id",), "cascade"), ("F", "people", "id", ("team",), "teams", ("team_id",), "cascade"), ("F", "teams", "team_id", ("lead",), "people", ("id",), "cascade"),
        ("F", "notes", "note", ("author",), "people", ("id",), "cascade"), ("F", "notes", "note", ("reader",), "people", ("id",), "set_null"),
    )
    for start in (59, 30, 5):
        gone, teams_gone = {start}, set()
        while True:
            more = {i for i, boss, team in people if boss in gone or team in teams_gone} | gone
            more_teams = {t for t, lead in teams if lead in more}
            if (more, more_teams) == (gone, teams_gone):
                break
            gone, teams_gone = more, more_teams
        cut = {n for n, author, _ in notes if author in gone}
        want = [("people", str(i), "cascade") for i in gone] + [("teams", str(t), "cascade") for t in teams_gone] + [("notes", str(n), "cascade") for n in cut]
        want += [("notes", str(n), "set_null") for n, _, reader in notes if reader in gone and n not in cut]
        assert sorted(map(tuple, integrity.delete_closure(tables, "people", f"id = {start}", foreign).collect())) == sorted(want)


def test_a_log_replayed_with_a_time_to_live(spark):
    rng, ttl = random.Random(11), 10
    rows = [(i, rng.choice([None, 1, 2]), 1, "r", "k", rng.choice(["h", "h", "h", "g"]), rng.choice([0, rng.randrange(40), rng.randrange(400)])) for i in range(600)]
    keyed, want = defaultdict(list), {}
    for r in rows:
        keyed[r[1]].append((r[6], r[0], r[5]))
    for own in keyed.values():
        held = None
        for at, i, asked in sorted(own):
            if held is None or held == asked and until < at:
                held, until = asked, at + ttl
                want[i] = "Acquired"
            else:
                want[i] = "InProgress" if held == asked else "Mismatch"
    log = spark.createDataFrame(rows, "request_id long, workspace_id int, principal_id int, route_code string, key_hash string, request_hash string, s int").repartition(3)
    log = log.withColumn("requested_at", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))))
    got = lifecycle.replayed_log_ttl(log, ttl)
    assert dict(got.collect()) == want
    assert "Python" not in plan_of(got) and "MapInPandas" not in plan_of(got) and "SinglePartition" not in plan_of(got)


def test_a_log_whose_keys_ask_once_moves_little(spark):
    """Only keys of several requests take part in the rounds, and no table holds a key's text."""
    log = spark.range(3000).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("workspace_id"), F.lit(1).alias("principal_id"), F.lit("r").alias("route_code"),
        F.when(F.col("id") < 20, "same").otherwise(F.concat(F.lit("k"), "id")).alias("key_hash"), F.when(F.col("id") != 2000, "h").alias("request_hash"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("requested_at"),
    )
    got = lifecycle.replayed_log_ttl(log, 5)
    want = {i: "InProgress" if i < 20 and i % 3 == 0 and i not in (0, 6, 12, 18) else "Acquired" for i in range(3000)}
    assert dict(got.collect()) == want and got.count() == 3000
    read = spark.read.parquet(*(f for f in got.inputFiles() if "/requests-" in f))
    assert read.count() == 7 and not {"digest", "key_hash"} & set(read.columns)


@pytest.mark.parametrize("keys", [["k"], []])
def test_numbers_and_rows_before_over_ranges(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None, 3]), i, rng.choice(["a", None, "b"])) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k int, i int, v string").repartition(5), keys, ["i"], "n", {"v": "pv", "i": "pi"})
    seen, want = {}, []
    for k, i, v in rows:
        n, pv, pi = seen.get(k if keys else 0, (0, None, None))
        want.append((k, i, v, n, pv, pi))
        seen[k if keys else 0] = (n + 1, v, i)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert "SinglePartition" not in plan_of(got)


def test_a_hot_workspace_is_verified_by_many_tasks(spark):
    events = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 30).otherwise(7).alias("workspace_id"), F.col("id").alias("audit_event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("occurred_at"))
    c = audit.chained(events, order=("occurred_at",)).cache()
    assert all(r["intact"] for r in audit.verified(c).collect())
    errors = audit.event_errors(c.withColumn("body", F.when(F.col("audit_event_id") == 4001, "{}").otherwise(F.col("body"))))
    assert [(r["workspace_id"], r["kind"]) for r in errors.where("kind is not null").collect()] == [(7, "HashTamperDetected")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = numbered(c, ["workspace_id"], ["sequence"], "n").where("workspace_id = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1


TEXTS = [
    '{"b":1,"a":2,"c":3}', ' [1.0, 1e2, -0.5, 1e-7, true, null, "é\\u001f\\n\\"" ] ', "not json", None, '{"\\ud83d\\ude00":1,"\\ufb33":2}', "", "{}", "[]", "null", '"x/y"', "12", "-0", "1.50", "123456789012345678901234",
    '{"z":{"y":[1,{"b":null,"a":false}]},"é":"ü","A":"<&>"}', '{"a":1,"a":2}', '{"😀":1,"豈":2,"z":3}', '{"a" : "b  c" , "d":[ ] }', "NaN", "[1,]", '{"k":"tab\\there"}', "01", '{"":0}', "true", '{"aa":1,"a":2,"b":3,"B":4}',
]


def test_canonical_json_natively(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    rows = audit.canonicalised(df, "t", "c").select("i", "c").join(df.select("i", audit.canonical_json("t").alias("w")), "i").collect()
    assert [r for r in rows if r["c"] != r["w"]] == [] and len(rows) == len(TEXTS)
    plain = df.where("i in (0, 14, 17)")
    assert [json.loads(r["c"]) for r in audit.canonicalised(plain, "t", "c").orderBy("i").collect()] == [json.loads(TEXTS[i]) for i in (0, 14, 17)]


def test_snapshots_meet_by_the_buckets_that_differ(spark):
    before = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    after = before.where("k != 77").withColumn("v", F.when(F.col("k") == 500, -1).when(F.col("k") == 600, 5).otherwise(F.col("v"))).union(spark.range(5000, 5001).select("id", "id"))
    assert 1 <= integrity.changed_buckets(before, after, "k", 1 << 20).count() <= 4
    for buckets in (1, 4096):
        assert sorted(map(tuple, integrity.append_only_violations(before, after, "k", buckets).collect())) == [("500", "updated"), ("600", "updated"), ("77", "deleted")]
    assert integrity.append_only_violations(before, before, "k").count() == 0


def test_the_session_context(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "workspace_id int, v string")
    shown = lambda table: sorted(r["v"] for r in df.where(access.session_policy(table)).collect())
    access.set_context(spark, 2)
    early = df.where(access.session_policy("memberships"))
    assert (shown("memberships"), shown("capability_grants"), shown("principals")) == (["b"], ["b", "c"], ["a", "b", "c"])
    access.clear_context(spark)
    assert (shown("memberships"), shown("capability_grants")) == ([], ["c"])
    assert [r["v"] for r in early.collect()] == ["b"] and df.select(access.current_context()).first()[0] is None


def test_trimming_of_all_white_space(spark):
    df = spark.createDataFrame([("\tabc\n",), (" abc ",), ("abc",)], "t string")
    assert len({r[0] for r in df.select(x.handle_hash(b"k", "t")).collect()}) == 1
    assert len({r[0] for r in df.select(x.csrf_token(b"k", "t", F.lit("https://a//"))).collect() + df.select(x.csrf_token(b"k", F.lit("abc"), F.lit(" https://a\t"))).collect()}) == 1
    assert [tuple(r) for r in spark.createDataFrame([("\t",), (" p ",), (None,)], "t string").select(integrity.return_path("t"), integrity.blank_to_null("t")).collect()] == [("/", None), ("p", "p"), ("/", None)]
