"""Ordered work within keys of any size: running sums and digests over range partitions, with the borders stitched.

Rows are dealt out by ranges of (key, order), so the rows of a large key lie in several tasks, one after the other. What a
task can't know, the part of its first key that lies in the tasks before it, is settled in a second step over a row for
each key and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import stored

#: Bytes of a run that is handed on in pieces.
CHUNK = 1 << 20


def by_ranges(df: DataFrame, *order) -> DataFrame:
    """Rows in ranges of ``order`` over the tasks, and sorted by it in each."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def running(df: DataFrame, key: str, order: list, **sums: str) -> DataFrame:
    """``df`` with, for each name and long column of ``sums``, the column's sum over the key's rows up to each row.

    ``key`` is a long column, nulls being one key; ``order`` (columns) breaks all ties. Written to the shared folder.
    """
    names, part = list(sums), "__ws_part"
    schema = StructType([*df.schema.fields, StructField(part, IntegerType()), *(StructField(n, LongType()) for n in names)])

    def summed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, carry = TaskContext.get().partitionId(), None, [0] * len(names)
        for batch in frames:
            if not batch.num_rows:
                continue
            column = batch.column(key)
            keys, null = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            first = np.r_[True, (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])]
            goes_on = last == (keys[0], null[0])
            group = np.cumsum(first) - 1
            arrays = []
            for i, source in enumerate(sums.values()):
                total = np.cumsum(batch.column(source).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.r_[0, total[:-1]][first]
                if goes_on:
                    before[0] -= carry[i]
                own = total - before[group]
                carry[i] = int(own[-1])
                arrays.append(pa.array(own))
            last = (keys[-1], null[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task, np.int32)), *arrays], names=[*batch.schema.names, part, *names])

    rows = stored(by_ranges(df, key, *order).mapInArrow(summed, schema), "running")
    tasks = Window.partitionBy(key).orderBy(part)
    totals = rows.groupBy(key, part).agg(*(F.sum(source).alias(n) for n, source in sums.items()))
    before = tasks.rowsBetween(Window.unboundedPreceding, -1)
    borders = totals.select(F.col(key).alias("__ws_key"), F.col(part).alias("__ws_task"), F.lag(F.lit(1)).over(tasks).alias("__ws_more"), *(F.sum(n).over(before).alias(f"__ws_{n}") for n in names))
    borders = F.broadcast(borders.where("__ws_more is not null"))  # keys that began in an earlier task: one a task
    met = rows.join(borders, F.col(key).eqNullSafe(F.col("__ws_key")) & (F.col(part) == F.col("__ws_task")), "left")
    return met.select(*df.columns, *((F.col(n) + F.coalesce(f"__ws_{n}", F.lit(0))).alias(n) for n in names))


def dense_names(rows: DataFrame, columns: list[str], name: str = "name") -> DataFrame:
    """The distinct values of ``columns`` with numbers from 0 without gaps; only a count for each task goes to the driver."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    each = stored(rows.select(*columns).distinct().select(*columns, F.spark_partition_id().alias("__ws_part"), at.alias("__ws_at")), "names")
    counts = each.groupBy("__ws_part").agg(F.count("*").alias("n")).toPandas().sort_values("__ws_part")
    starts = pd.DataFrame({"__ws_part": counts["__ws_part"], "__ws_start": counts["n"].cumsum() - counts["n"]})
    starts = rows.sparkSession.createDataFrame(starts, "__ws_part int, __ws_start long")
    return each.join(F.broadcast(starts), "__ws_part").select(*columns, (F.col("__ws_start") + F.col("__ws_at")).alias(name))


def ordered_sha256(df: DataFrame, keys: list[str], order: list, piece: str, separator: bytes, chunk: int = CHUNK) -> DataFrame:
    """(keys, sha256): the lower-case hex SHA-256 of each key's pieces (strings or bytes) in ``order``, joined by ``separator``.

    A task hashes what lies in it whole; a key that may go on in another task is handed on in chunks, and one task hashes
    the chunks of a key one by one, as SHA-256 has no other way. No more than a chunk is held.
    """
    fields = [df.schema[k] for k in keys]
    schema = StructType([*fields, StructField("__ws_part", IntegerType()), StructField("__ws_at", LongType()), StructField("sha256", StringType()), StructField("__ws_chunk", BinaryType())])
    arrow = pa.schema([pa.field(f.name, t) for f, t in zip(schema.fields, [*(_arrow(f) for f in fields), pa.int32(), pa.int64(), pa.string(), pa.binary()])])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        rows: list[list] = [[] for _ in arrow]
        now, buffer, size, open_ = None, [], 0, True  # open_: the run may have begun before, or was handed on in part
        more = False  # the run has a piece already

        def put(digest, held):
            nonlocal at
            for column, x in zip(rows, (*now, task, at, digest, held)):
                column.append(x)
            at += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, arrow)], schema=arrow)
            for column in rows:
                column.clear()
            return out

        began = False
        for batch in batches:
            for *own, x in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(own)
                if not began or own != now:
                    if began:
                        if open_:
                            put(None, b"".join(buffer))
                        else:
                            put(hashlib.sha256(b"".join(buffer)).hexdigest(), None)
                    open_, began, now, buffer, size, more = not began, True, own, [], 0, False
                if more:
                    buffer.append(separator)
                buffer.append(x)
                more = True
                size += len(x) + 1
                if size >= chunk:
                    put(None, b"".join(buffer))
                    yield flush()
                    buffer, size, open_ = [], 0, True
            if rows[0]:
                yield flush()
        if began:  # the last key may go on in the next task
            put(None, b"".join(buffer))
            yield flush()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, task = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([*(pa.array([k], f.type) for k, f in zip(now, arrow)), pa.array([state.hexdigest()])], names=[*keys, "sha256"])

        for batch in batches:
            for *own, part, x in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(own)
                if state is None or own != now:
                    if state is not None:
                        yield done()
                    now, state = own, hashlib.sha256()
                elif part != task:  # a task's first chunk has no separator before it
                    state.update(separator)
                task = part
                state.update(x)
        if state is not None:
            yield done()

    rows = by_ranges(df.select(*keys, *(o for o in order if o not in keys), F.col(piece).cast("binary").alias("__ws_piece")), *keys, *order).select(*keys, "__ws_piece")
    out = stored(rows.mapInArrow(hashed, schema), "digests")
    parts = out.where("__ws_chunk is not null").repartition(*keys).sortWithinPartitions(*keys, "__ws_part", "__ws_at")
    rest = parts.select(*keys, "__ws_part", "__ws_chunk").mapInArrow(folded, StructType([*fields, StructField("sha256", StringType())]))
    return out.where("sha256 is not null").select(*keys, "sha256").unionByName(rest)


def _arrow(field: StructField) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[field.dataType.simpleString()]
