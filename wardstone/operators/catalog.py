"""Migration status and catalog inspection over metadata DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import union_all
from . import integrity
from .access import SHARED, STRICT, privileges

APPLIED = "version long, description string, success boolean, checksum string"
BUNDLE = "version long, description string, checksum string"


def applied_migrations(spark, name: str) -> DataFrame:
    """The applied migrations by version; a table that does not exist has none."""
    return spark.table(name).orderBy("version") if spark.catalog.tableExists(name) else spark.createDataFrame([], APPLIED)


def pending(bundle: DataFrame, applied: DataFrame) -> DataFrame:
    return bundle.join(applied.select("version"), "version", "left_anti")


def migration_status(bundle: DataFrame, applied: DataFrame) -> DataFrame:
    """One row: how many are applied and pending, the current version, and whether all is up to date."""
    a = applied.agg(F.count("*").alias("applied"), F.max("version").alias("current_version"), F.coalesce(F.every("success"), F.lit(True)).alias("__ok"))
    p = pending(bundle, applied).agg(F.count("*").alias("pending"))
    return a.join(p, F.lit(True)).select("applied", "pending", "current_version", (F.col("__ok") & (F.col("pending") == 0)).alias("up_to_date"))


def newly_applied(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before.select("version"), "version", "left_anti")


def checksum_drift(bundle: DataFrame, applied: DataFrame) -> DataFrame:
    a = applied.select("version", F.col("checksum").alias("applied_checksum"))
    return bundle.join(a, "version").where(F.col("checksum") != F.col("applied_checksum")).select("version", "checksum", "applied_checksum")


def missing_services(required: DataFrame, running: DataFrame) -> DataFrame:
    return required.join(running, "service", "left_anti")


def columns_of(frames: dict[str, DataFrame], spark) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, nullable) of the tables' schemas."""
    rows = [(t, i + 1, f.name, f.dataType.simpleString(), f.nullable) for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean")


# --- what the model declares ------------------------------------------------------------------------------------------

#: (trigger, table, events that it refuses); fixed values of the model.
TRIGGERS = (("append_only", "audit_events", ("UPDATE", "DELETE")), ("kept_heads", "chain_heads", ("DELETE",)), ("rising_heads", "chain_heads", ("UPDATE",)))


def _name(kind: str, table: str, columns) -> str:
    return "_".join([kind, table, *columns])


def constraints(spark, foreign: tuple = integrity.FOREIGN, unique: tuple = integrity.UNIQUE) -> DataFrame:
    """(constraint_name, constraint_type, table_name, delete_rule) of the model's keys, from the tables that its rules go by."""
    rows = [(_name("fk", child, own), "FOREIGN KEY", child, action) for _, child, _, own, _, _, action in foreign]
    rows += [(_name("uq", table, keys), "UNIQUE", table, None) for _, table, keys, _ in unique]
    return spark.createDataFrame(rows, "constraint_name string, constraint_type string, table_name string, delete_rule string")


def key_columns(spark, foreign: tuple = integrity.FOREIGN, unique: tuple = integrity.UNIQUE) -> DataFrame:
    """(constraint_name, ordinal, column_name, parent_table, parent_column), a row for each column of each key."""
    rows = [(_name("fk", child, own), i + 1, c, parent, p) for _, child, _, own, parent, theirs, _ in foreign for i, (c, p) in enumerate(zip(own, theirs))]
    rows += [(_name("uq", table, keys), i + 1, c, None, None) for _, table, keys, _ in unique for i, c in enumerate(keys)]
    return spark.createDataFrame(rows, "constraint_name string, ordinal int, column_name string, parent_table string, parent_column string")


def foreign_drift(tables, spark, foreign: tuple = integrity.FOREIGN) -> DataFrame:
    """(constraint_name, held, orphans): how many references each foreign key has in the data, and how many refer to no row."""
    targets = list(dict.fromkeys((f[4], f[5]) for f in foreign))
    found = []
    for table, key in dict.fromkeys((f[1], f[2]) for f in foreign):
        own = [(i, targets.index((f[4], f[5])), f[3]) for i, f in enumerate(foreign) if f[1] == table]
        found.append(integrity.references(getattr(tables, table), key, own))
    counts = union_all(found).groupBy("edge", "target", "parts").agg(F.count("*").alias("n"))  # a row for each value that is referred to
    parents = integrity.referred([(i, getattr(tables, t), columns) for i, (t, columns) in enumerate(targets)]).withColumn("there", F.lit(True))
    met = counts.join(parents, ["target", "parts"], "left").groupBy("edge").agg(F.sum("n").alias("held"), F.sum(F.when(F.col("there").isNull(), F.col("n")).otherwise(0)).alias("orphans"))
    names = spark.createDataFrame([(i, _name("fk", f[1], f[3])) for i, f in enumerate(foreign)], "edge int, constraint_name string")
    zero = F.lit(0).cast("long")
    return names.join(met, "edge", "left").select("constraint_name", F.coalesce("held", zero).alias("held"), F.coalesce("orphans", zero).alias("orphans"))


def foreign_keys(tables, spark) -> DataFrame:
    """Foreign keys with their columns, the columns' types in the data, and how the data keeps them."""
    types = columns_of({t: getattr(tables, t) for t in dict.fromkeys(f[1] for f in integrity.FOREIGN)}, spark).select("table_name", "column_name", "data_type")
    rows = constraints(spark).where("constraint_type = 'FOREIGN KEY'").join(key_columns(spark), "constraint_name").join(types, ["table_name", "column_name"], "left")
    return rows.join(foreign_drift(tables, spark), "constraint_name").select(
        "constraint_name", "table_name", "column_name", "ordinal", "parent_table", "parent_column", "delete_rule", F.col("data_type").isNotNull().alias("in_data"), "held", "orphans"
    )


def unique_drift(tables, spark) -> DataFrame:
    """(constraint_name, table_name, columns, repeated): unique keys, and how many of their values occur more than once."""
    counts = []
    for table in dict.fromkeys(t for _, t, *_ in integrity.UNIQUE):
        rules = [(_name("uq", t, keys), keys, where) for _, t, keys, where in integrity.UNIQUE if t == table]
        counts.append(integrity.all_unique_violations(getattr(tables, table), table, rules).groupBy(F.col("rule").alias("constraint_name")).agg(F.count("*").alias("repeated")))
    columns = key_columns(spark).groupBy("constraint_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]), ",").alias("columns"))
    rows = constraints(spark).where("constraint_type = 'UNIQUE'").join(columns, "constraint_name").join(union_all(counts), "constraint_name", "left")
    return rows.select("constraint_name", "table_name", "columns", F.coalesce("repeated", F.lit(0).cast("long")).alias("repeated"))


def check_drift(tables) -> DataFrame:
    """(rule, table_name, held, broken): the CHECK conditions with how many rows they were held against and how many break them; one scan a table."""
    out = []
    for table in dict.fromkeys(t for _, t, *_ in integrity.CHECKS):
        rules = [(r, broken) for r, t, _, broken in integrity.CHECKS if t == table]
        counts = getattr(tables, table).agg(F.count("*").alias("held"), *(F.count(F.when(F.expr(b), 1)).alias(f"b{i}") for i, (_, b) in enumerate(rules)))
        each = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"b{i}").alias("broken")) for i, (r, _) in enumerate(rules)))
        out.append(counts.select("held", F.explode(each).alias("x")).select("x.rule", F.lit(table).alias("table_name"), "held", "x.broken"))
    return union_all(out)


def policies(spark) -> DataFrame:
    """(table_name, policy_name, mode): tables whose rows are scoped; a strict one shows rows of the context alone, a shared one those without a workspace too."""
    rows = [(t, f"{t}_by_workspace", mode) for mode, names in (("strict", STRICT), ("shared", SHARED)) for t in names]
    return spark.createDataFrame(rows, "table_name string, policy_name string, mode string")


def relations(frames: dict[str, DataFrame], spark) -> DataFrame:
    """(table_name, row_security, held, workspaces, unscoped): tables with their rows, and those that have no workspace."""
    out = []
    for name, df in frames.items():
        column = F.col("workspace_id") if "workspace_id" in df.columns else F.lit(None)
        secured = name in STRICT + SHARED
        out.append(df.agg(F.count("*").alias("held"), F.count(F.when(column.isNull(), 1)).alias("unscoped")).select(F.lit(name).alias("table_name"), F.lit(secured).alias("row_security"), "held", "unscoped"))
    return union_all(out)


def secured_relations(frames: dict[str, DataFrame], spark) -> DataFrame:
    """Tables with their policies, and how many of their rows a policy can show to no context or to all."""
    rows = relations(frames, spark).join(policies(spark), "table_name", "left")
    hidden, open_ = (F.when(F.col("mode") == mode, F.col("unscoped")).otherwise(0).alias(name) for mode, name in (("strict", "shown_to_none"), ("shared", "shown_to_all")))
    return rows.select("table_name", "row_security", "policy_name", "mode", "held", hidden, open_)


def trigger_refusals(changes: dict[str, DataFrame], spark) -> DataFrame:
    """(trigger_name, table_name, event, refused): triggers with how many of the changes (row_key, change) of their table they refuse."""
    names = {"updated": "UPDATE", "decreased": "UPDATE", "deleted": "DELETE"}
    event = F.coalesce(*(F.when(F.col("change") == k, v) for k, v in names.items()))
    counts = union_all([df.select(F.lit(t).alias("table_name"), event.alias("event")).groupBy("table_name", "event").agg(F.count("*").alias("refused")) for t, df in changes.items()])
    rows = spark.createDataFrame([(name, t, e) for name, t, events in TRIGGERS for e in events], "trigger_name string, table_name string, event string")
    return rows.join(counts, ["table_name", "event"], "left").select("trigger_name", "table_name", "event", F.coalesce("refused", F.lit(0).cast("long")).alias("refused"))


def role_reach(frames: dict[str, DataFrame], spark) -> DataFrame:
    """(role, table_name, privileges, held): what each role may do to how many rows."""
    own = privileges(spark).groupBy("role", "table_name").agg(F.array_join(F.array_sort(F.collect_list("privilege")), ",").alias("privileges"))
    return own.join(relations(frames, spark).select("table_name", "held"), "table_name").select("role", "table_name", "privileges", "held")
