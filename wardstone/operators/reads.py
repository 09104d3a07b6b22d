"""Point lookups, keyset pages, filtered lists and their projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values; the filters reach the scan. A None matches nulls."""
    for name, value in keys.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def lookup_ci(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose text equals ``value`` whatever the case."""
    return df.where(F.lower(column) == value.lower())


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must leave no ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def membership_of_pair(memberships: DataFrame) -> DataFrame:
    """The membership that stands for each (workspace, principal): an active one first, then the latest start, then the id."""
    return first_by(memberships, ["workspace_id", "principal_id"], [(F.col("status") == "active").desc(), F.desc("valid_from"), F.col("membership_id")])


def keyset_page(df: DataFrame, key: str, limit: int = 50, cursor=None) -> DataFrame:
    """A page of at most ``limit`` rows above ``cursor``, by ``key``, with has_more and next_cursor.

    One row more than the page is read, by a top-k and not a full sort. next_cursor is the key of the last row of the
    page if more follow, else null.
    """
    limit = min(max(limit, 1), 100)
    rows = df.where(F.col(key) > F.lit(cursor)) if cursor is not None else df
    rows = rows.orderBy(key).limit(limit + 1)  # bounded: what follows handles limit + 1 rows
    whole = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("__place", F.row_number().over(whole.orderBy(key))).withColumn("__n", F.count("*").over(whole))
    rows = rows.withColumn("has_more", F.col("__n") > limit).where(F.col("__place") <= limit)
    last = F.max(key).over(whole)
    return rows.withColumn("next_cursor", F.when(F.col("has_more"), last)).drop("__place", "__n")


def all_pages(df: DataFrame, scope: list[str], key: str, limit: int) -> DataFrame:
    """Every row with its page within its scope, and the page's next_cursor and has_more."""
    order = Window.partitionBy(*scope).orderBy(key)
    rows = df.withColumn("page", F.ceil(F.row_number().over(order) / F.lit(limit)).cast("long")).withColumn("__next", F.lead(key).over(order))
    page = Window.partitionBy(*scope, "page")
    rows = rows.withColumn("__last", F.max(key).over(page)).withColumn("has_more", F.max(F.when(F.col("__next") > F.col("__last"), True)).over(page).isNotNull())
    return rows.withColumn("next_cursor", F.when(F.col("has_more"), F.col("__last"))).drop("__next", "__last")


def page_request(limit: Column, cursor: Column, scope: Column) -> list[Column]:
    """Normalised page_limit (default 50, 1 to 100), page_cursor (null if unreadable) and scope_status (400 if unreadable)."""
    bad = scope.isNotNull() & scope.try_cast("long").isNull()
    return [
        F.least(F.greatest(F.coalesce(limit, F.lit(50)), F.lit(1)), F.lit(100)).alias("page_limit"),
        cursor.try_cast("long").alias("page_cursor"), F.when(bad, 400).otherwise(200).alias("scope_status"),
    ]


def ranked(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Rows with their position in their scope."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))


def text_match(term: str, columns: list[str]) -> Column:
    """Whether a column contains ``term`` whatever the case; a blank term matches all, another is not trimmed."""
    if not term.strip():
        return F.lit(True)
    held = F.lit(False)
    for c in columns:
        held = held | F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False))
    return held


def text_filter(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """The rows that match; of a page, those of the page: paging comes first, and its cursor stays what it is."""
    return df.where(text_match(term, columns))


def shown_of(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """One row: how many rows a text filter shows, and of how many."""
    return df.agg(F.count(F.when(text_match(term, columns), 1)).alias("shown"), F.count("*").alias("total"))


class CursorHistory:
    """The cursors of the pages before this one, for a Previous button; kept by the caller."""

    def __init__(self):
        self.before: list = []

    def next(self, current):
        self.before.append(current)

    def previous(self):
        return self.before.pop() if self.before else None


# --- projections to what an API shows ---------------------------------------------------------------------------------


def program_view(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("program_id").alias("id"), "organization_id", "name", F.col("program_code").alias("slug"), F.lit(None).cast("string").alias("description"),
        "created_at", F.col("created_at").alias("updated_at"),
    )


def workspace_view(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("workspace_id").alias("id"), "program_id", "organization_id", "name", F.col("workspace_code").alias("slug"),
        F.lit(None).cast("string").alias("current_source_state_id"),
    )


def membership_view(df: DataFrame) -> DataFrame:
    """Status and validity are not shown."""
    return df.select(
        F.col("membership_id").alias("id"), "workspace_id", "principal_id", F.col("role_code").alias("role"), F.col("valid_from").alias("created_at"),
        F.col("valid_from").alias("updated_at"),
    )


def grant_view(df: DataFrame) -> DataFrame:
    """A program's grant has an empty workspace; revocation is not shown."""
    return df.select(
        F.col("capability_grant_id").alias("id"), F.coalesce(F.col("workspace_id").cast("string"), F.lit("")).alias("workspace_id"), "principal_id",
        F.col("capability_code").alias("capability"), "granted_at", "expires_at",
    )
