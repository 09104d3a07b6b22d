"""References to small tables do not move, and the orphans are the same however many parents are broadcast."""

from types import SimpleNamespace

from wardstone.operators import integrity

EDGES = (
    ("R", "grants", "grant_id", ("program_id",), "programs", ("program_id",), "cascade"),
    ("R", "grants", "grant_id", ("principal_id",), "principals", ("principal_id",), "cascade"),
    ("R", "programs", "program_id", ("owner",), "principals", ("principal_id",), "cascade"),
)


def _tables(spark):
    return SimpleNamespace(
        grants=spark.sql("select id as grant_id, case when id % 5 = 0 then 99 when id % 5 = 1 then null else id % 3 end as program_id, id % 120 as principal_id from range(1000)"),
        programs=spark.sql("select id as program_id, if(id = 2, -1, id) as owner from range(3)"), principals=spark.sql("select id as principal_id from range(100)"),
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orphans_by_broadcast_and_by_shuffle(spark):
    tables = _tables(spark)
    due = sorted([("grants", str(i)) for i in range(1000) if i % 5 == 0] + [("grants", str(i)) for i in range(1000) if i % 120 >= 100] + [("programs", "2")])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, joins in ((0, (0, 1)), (10, (1, 1)), (100_000, (1, 0))):
            rows = integrity.foreign_violations(tables, "R", EDGES, few)
            plan = _plan(rows)
            assert (plan.count("BroadcastHashJoin") > 0, plan.count("SortMergeJoin") > 0) == tuple(map(bool, joins))
            assert sorted((r["table_name"], r["row_key"]) for r in rows.collect()) == due
        plan = _plan(integrity.foreign_violations(tables, "R", EDGES))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_parents_at_all(spark):
    tables = _tables(spark)
    tables.principals = tables.principals.where("false")
    got = integrity.foreign_violations(tables, "R", EDGES).where("table_name = 'programs'").collect()
    assert sorted(r["row_key"] for r in got) == ["0", "1", "2"]
