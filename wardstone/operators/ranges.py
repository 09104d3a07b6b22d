"""Row numbers and previous rows in an order, with no window over a large key.

Rows are sorted by ranges of (keys, order), so a large key lies in several tasks, one after the other. Each range numbers its
own rows; what it can't know, how many rows of its first key lie before it and the last of them, comes from a summary with
one row for each range, which goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_PART, _AT = "__ws_part", "__ws_at"


def numbered(df: DataFrame, keys: list[str], order: list[str], index: str, previous: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``index`` (long, from 0) of each row in its key's rows by ``order``, and columns of the row before it.

    ``previous`` has new names by column; they are null for a key's first row. Without ``keys`` all rows are one list.
    ``order`` must leave no ties but between equal rows. Nulls come first, and null keys are a key. The rows are written to
    the shared folder, so that each range stays what it is.
    """
    previous = previous or {}
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(rows.withColumn(_PART, F.spark_partition_id()).withColumn(_AT, F.monotonically_increasing_id()), "ranges")
    held = F.struct(F.col(_AT).alias("at"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"p{i}") for i, c in enumerate(previous)))
    ends = rows.groupBy(_PART).agg(F.min(held).alias("first"), F.max(held).alias("last"))
    # a key's rows in a range, of the range's first and last key only
    edge = lambda side: _same(keys, side)
    counts = rows.join(F.broadcast(ends), _PART).groupBy(_PART).agg(F.sum(edge("first").cast("long")).alias("of_first"), F.sum(edge("last").cast("long")).alias("of_last"))
    summary = sorted(ends.join(counts, _PART).collect(), key=lambda r: r[_PART])  # one row a range
    before, held_over, last = [], 0, None
    own = lambda r: tuple(r[f"k{i}"] for i in range(len(keys)))
    for r in summary:
        goes_on = last is not None and own(last) == own(r["first"])
        before.append((r[_PART], held_over if goes_on else 0, last if goes_on else None))
        held_over = r["of_last"] + (held_over if goes_on and own(r["first"]) == own(r["last"]) else 0)
        last = r["last"]
    schema = f"{_PART} int, __ws_before long, __ws_last {ends.schema['last'].dataType.simpleString()}"
    borders = F.broadcast(df.sparkSession.createDataFrame(before, schema).join(ends.select(_PART, "first"), _PART))
    # within a range a key's rows follow each other: the window is over (range, key), a range at most
    w = Window.partitionBy(_PART, *keys).orderBy(_AT)
    out = rows.withColumn(index, F.row_number().over(w).cast("long") - 1).withColumns({new: F.lag(c).over(w) for c, new in previous.items()})
    out = out.join(borders, _PART)
    starts = _same(keys, "first")
    for i, new in enumerate(previous.values()):
        out = out.withColumn(new, F.when(starts & (F.col(index) == 0), F.col(f"__ws_last.p{i}")).otherwise(F.col(new)))
    out = out.withColumn(index, F.col(index) + F.when(starts, F.col("__ws_before")).otherwise(0))
    return out.select(*df.columns, index, *previous.values())


def _same(keys: list[str], side: str):
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{side}.k{i}"))
    return same
