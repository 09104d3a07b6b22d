"""Exact dedup of documents: two Bloom passes find possibly repeated hashes, and only those rows shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BYTES, column_filter
from .common import stored, text_of


def normalised(column: Column) -> Column:
    """The text without any character of space and U+0009 to U+000D."""
    return F.regexp_replace(column, r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A small row for each document: id, code points of its text, SHA-256 and a 64-bit hash of the normalised text."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("chars"), F.sha2(normalised(text), 256).alias("text_sha256")
    ).withColumn("hash", F.xxhash64("text_sha256"))


def suspected(rows: DataFrame, hash_col: str = "hash", expected: int | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """A column of ``rows`` that is true wherever the hash may occur in another row; reads the hashes once to build the filters."""
    return column_filter(rows, hash_col, rows.count() if expected is None else expected, max_bytes).holds(F.col(hash_col))


def _best(chars: Column, doc_id: Column) -> Column:
    """The least of these stays: most code points first, then the smallest id; a null id comes last."""
    return F.struct(-chars, doc_id.isNull(), doc_id)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space of ASCII; a null text is the empty one, and all such rows are
    one group. The row with the most code points stays, then the smallest doc_id (null ids last). Repeated rows count
    one by one in group_size, and each row that carries the id which stays is kept. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    flagged = rows.withColumn("suspect", suspected(rows, max_bytes=max_bytes))
    alone = flagged.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    again = flagged.where("suspect").select("doc_id", "chars", "text_sha256")
    groups = again.groupBy("text_sha256").agg(F.min_by("doc_id", _best(F.col("chars"), F.col("doc_id"))).alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(groups, "groups")  # a written table, so that the join's own exchange can split a hot group
    met = again.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all their columns.

    Rows whose hash cannot repeat pass without a shuffle. Of suspected rows only the digests are grouped; the losers'
    ids then leave by an anti-join. Identical repeated rows (same id, same text) collapse to one. Null and empty texts
    form one group. Extra columns pass through whatever their names.
    """
    tagged = docs.withColumn("__ws_sha", F.sha2(normalised(text_of(text_col)), 256)).withColumn("__ws_hash", F.xxhash64("__ws_sha"))
    marked = tagged.withColumn("__ws_again", suspected(tagged, "__ws_hash", docs.count(), max_bytes))
    again = marked.where("__ws_again")
    best = _best(F.length(text_of(text_col)), F.col(id_col))
    winners = stored(again.groupBy(F.col("__ws_sha").alias("__ws_win")).agg(F.min(best).alias("__ws_best")), "winners")
    met = again.join(winners, (F.col("__ws_sha") == F.col("__ws_win")) & best.eqNullSafe(F.col("__ws_best")), "left_semi")
    extra = ("__ws_sha", "__ws_hash", "__ws_again")
    return marked.where("not __ws_again").drop(*extra).unionByName(met.dropDuplicates(["__ws_sha"]).drop(*extra))
