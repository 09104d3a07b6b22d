"""Line dedup across documents: once-seen and twice-seen Bloom filters, then exact confirmation of suspected lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BYTES, SENT_SCHEMA, layout, repeat_filter, sent
from .common import ASCII_SPACE, stored, text_of

_SPACE = ASCII_SPACE.encode()


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def line_key(line: bytes) -> bytes:
    """The UTF-8 line without white space of ASCII at both ends, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def _keys(text: str, least: int) -> list[bytes]:
    """The distinct keys of a text that have at least ``least`` code points."""
    found = {x.strip(_SPACE) for x in _raw(text).lower().split(b"\n")}
    return [k for k in found if len(k) >= 4 * least or len(k) >= least and len(k.decode("utf-8", "surrogatepass")) >= least]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)).view(np.int64)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``docs`` with its repeated lines dropped from ``text_col``, and columns n_lines and n_dropped (long).

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses all its lines except
    in the largest id that holds it (there every such line stays). Rows that share an id count as one document; a row
    with a null id loses no lines and counts for none. Null and empty texts have one empty line and become ''. Extra
    columns pass through; columns named n_lines or n_dropped are replaced. ``min_docs`` is 2 or more.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    text = text_of(text_col)
    some = docs.where(F.col(id_col).isNotNull())
    expected = some.agg(F.sum(F.regexp_count(text, F.lit("\n")) + 1)).first()[0] or 1
    where = layout(expected)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from sent((_hashes([k for t in frame["t"] for k in _keys(t, min_chars)]) for frame in frames), where)

    held = repeat_filter(some.select(text.alias("t")).mapInPandas(send, SENT_SCHEMA), where, max_bytes)

    def found(texts: pd.Series) -> list[list[bytes]]:
        keys = [_keys(t, min_chars) for t in texts]
        flags = held.suspects(_hashes([k for each in keys for k in each]))
        ends = np.cumsum([0, *map(len, keys)])
        return [[k for k, s in zip(each, flags[a:b]) if s] for each, a, b in zip(keys, ends, ends[1:])]

    @F.pandas_udf("array<binary>")
    def suspected(texts: pd.Series) -> pd.Series:
        return pd.Series(found(texts))

    @F.pandas_udf("boolean")
    def any_suspected(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(x) for x in found(texts)])

    @F.pandas_udf("text string, n_dropped long")
    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(texts, drops):
            gone, lines = set(d), _raw(t).split(b"\n")
            left = [x for x in lines if line_key(x) not in gone]
            out.append((b"\n".join(left).decode("utf-8", "surrogatepass"), len(lines) - len(left)))
        return pd.DataFrame(out, columns=["text", "n_dropped"])

    keys = stored(some.select(F.col(id_col).alias("id"), F.explode(suspected(text)).alias("key")).distinct(), "lines")
    counted = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    counted = stored(counted, "counted")  # a written table, so that the join's own exchange can split a hot key
    drops = keys.join(counted, "key").where(F.col("id") < F.col("last"))
    drops = drops.groupBy(F.col("id").alias("__ws_id")).agg(F.collect_list("key").alias("__ws_drops"))

    base = docs.drop("n_lines", "n_dropped").withColumn("n_lines", (F.regexp_count(text, F.lit("\n")) + 1).cast("long"))
    flagged = base.withColumn("__ws_any", any_suspected(text))
    plain = flagged.where("not __ws_any").drop("__ws_any").withColumn(text_col, text).withColumn("n_dropped", F.lit(0).cast("long"))
    met = flagged.where("__ws_any").drop("__ws_any").join(drops, F.col(id_col) == F.col("__ws_id"), "left")
    met = met.withColumn("__ws_out", without(text, F.coalesce("__ws_drops", F.array().cast("array<binary>"))))
    met = met.withColumn(text_col, F.col("__ws_out.text")).withColumn("n_dropped", F.col("__ws_out.n_dropped"))
    return plain.unionByName(met.drop("__ws_out", "__ws_drops", "__ws_id"))
