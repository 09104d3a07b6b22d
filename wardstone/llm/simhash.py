"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most three bits, one
segment differs in at most one bit, so both have a one-wildcard variant of that segment in common (the segment with
one bit left out). All variants are an index; an equality join on it gives the candidates, which are verified in full.
Buckets of the index that are very large are dealt out by the bytes of the other segment, so that no task gets one whole.
Equal fingerprints are one node from the start, and a bucket of the index gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bloom import column_filter
from .common import released, stored, text_of
from .components import connected_components, forest
from .similar import node_of, similar_groups

#: Words of a shingle, seed of XXH64, most differing bits of a link.
SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints of a bucket that are compared in place; larger buckets are cut by further bytes, exactly.
BUCKET = 512
#: Fingerprints of a bucket from which it is dealt out by the bytes of the other segment; most such buckets (8 bytes each, the
#: largest if there are more); they are found on one fingerprint of so many, which steers where pairs meet only.
LARGE, MOST_LARGE, LARGE_SHARE = 1 << 16, 1 << 20, 16

_BYTE_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int32)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is 1 if set in over half the hashes of its shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and white space of ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    # counts of each byte value at each of the 8 places, then bits of the byte values
    octets, ones = hashes.view(np.uint8).reshape(-1, 8), []
    for place in range(8):
        ones.append(np.bincount(octets[:, place], minlength=256) @ _BYTE_BITS)
    bits = np.concatenate(ones) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _variants(large: Broadcast | None = None):
    """The 64 index rows of each fingerprint: key (segment number, left-out bit, rest of the segment) and fingerprint.

    A row of a ``large`` bucket stands four times instead, under the bytes of the other segment: of two fingerprints of a
    bucket that differ in three bits at most, one of these four bytes is the same.
    """

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crowded = large.value if large else np.zeros(0, np.int64)
        for frame in frames:
            for part in np.array_split(frame["fp"].to_numpy(), len(frame) // 4096 + 1):
                fp = part.view(np.uint64)
                keys = []
                for segment in range(2):
                    value = (fp >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
                    for bit in range(32):
                        rest = value & ~np.uint64(1 << bit)
                        keys.append(rest | np.uint64((segment * 32 + bit) << 32))
                key, own = np.concatenate(keys).view(np.int64), np.tile(part, 64)
                full = np.isin(key, crowded) if len(crowded) else np.zeros(len(key), bool)
                if full.any():
                    parts = [(key[~full], own[~full])]
                    other = np.where(key[full] >> 37 & 1, 0, 32).astype(np.uint64)  # where the other segment begins
                    for place in range(4):
                        octet = (own[full].view(np.uint64) >> (other + np.uint64(8 * place))) & np.uint64(255)
                        parts.append((key[full] | ((octet.astype(np.int64) + 256 * place + 1) << 38), own[full]))
                    key, own = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"key": key, "fp": own})

    return made


def _near_forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; memory is linear, larger sets are cut by bytes.

    Of two fingerprints that differ in at most ``max_bits`` < 8 bits some byte of 8 is equal; so a set that is too
    large to compare in place is cut by each byte in turn, and again by the next ones, with no pair lost: a pair that
    is near shares 8 - max_bits bytes at least.
    """
    links: list[tuple[int, int]] = []

    def compare(part: np.ndarray) -> None:
        a, b, size = [], [], 0

        def shrink(a: list, b: list) -> tuple[list, list]:
            out = forest(np.concatenate(a), np.concatenate(b))
            return [np.array([x for x, _ in out], np.uint64)], [np.array([y for _, y in out], np.uint64)]

        for i in range(1, len(part)):
            near = np.flatnonzero(np.bitwise_count(part[:i] ^ part[i]) <= max_bits)
            if len(near):
                a.append(part[near])
                b.append(np.full(len(near), part[i]))
                size += len(near)
            if size > 1 << 18:
                (a, b), size = shrink(a, b), 0
        if a:
            a, b = shrink(a, b)
            links.extend(zip(a[0], b[0]))

    def cut(part: np.ndarray, place: int, left: int) -> None:
        """left: equal bytes still to be found for a pair, at places from ``place`` on."""
        if len(part) < 2:
            return
        if len(part) <= BUCKET or left == 0:
            compare(part)
            return
        for at in range(place, 9 - left):
            octet = (part >> np.uint64(8 * at)) & np.uint64(255)
            order = np.argsort(octet, kind="stable")
            edges = np.flatnonzero(np.diff(octet[order])) + 1
            for group in np.split(part[order], edges):
                cut(group, at + 1, left - 1)

    cut(fps, 0, 8 - max_bits)
    return links


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, a key's rows all in one partition: the links of each bucket, as spanning forests."""
    key, held = None, []

    def close() -> list[tuple[int, int]]:
        fps = np.unique(np.concatenate(held)).view(np.uint64) if held else np.zeros(0, np.uint64)
        return _near_forest(fps, MAX_BITS) if len(fps) > 1 else []

    for frame in frames:
        out: list[tuple[int, int]] = []
        keys, fps = frame["key"].to_numpy(), frame["fp"].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        for a, b in zip(starts, ends):
            if keys[a] != key:
                out += close()
                key, held = keys[a], []
            held.append(fps[a:b].copy())
        if out:
            yield pd.DataFrame(np.array(out, np.uint64).view(np.int64), columns=["a", "b"])
    if out := close():
        yield pd.DataFrame(np.array(out, np.uint64).view(np.int64), columns=["a", "b"])


def near_links(fingerprints: DataFrame, large: int = LARGE, share: int = LARGE_SHARE) -> DataFrame:
    """Links (a, b) among the distinct values of the long column fp: enough of them to connect all that are near."""
    own = fingerprints.select("fp").distinct()
    some = own.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).mapInPandas(released(_variants()), "key long, fp long")
    counts = some.groupBy("key").count().where(F.col("count") >= max(2, large // share))
    got = counts.orderBy(F.desc("count"), "key").limit(MOST_LARGE).select("key").toArrow().column(0)
    held = fingerprints.sparkSession.sparkContext.broadcast(np.sort(got.to_numpy()))
    met = own.mapInPandas(released(_variants(held)), "key long, fp long").repartition("key").sortWithinPartitions("key")
    return met.mapInPandas(released(_links), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the least id reachable.

    Fingerprints link at MAX_BITS or fewer differing bits. A null, empty or wordless text has fingerprint zero, which
    links like any other. Repeated rows give repeated rows; a null id joins a group but never names it while another
    id is there. No columns but the two are read. An empty table gives an empty result.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(text_of(text_col)).alias("fp")), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(stored(near_links(rows), "links"))
    joined = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", hexed, "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, shingle: int = 5, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id names their group: one document of each group, with all its columns.

    The groups are those of op1 (3-word shingles, MAX_BITS differing bits) or, with a ``similarity``, those of
    ``similar_groups``: all texts linked by so much Jaccard similarity of their shingles of ``shingle`` words (``exact``: none
    missed by chance). These go by the deletion variants of their fingerprints first, as op1 does, and the similarity decides.

    Of rows that repeat an id one stays. A row with a null id goes if its group has an id; of a group whose ids are all
    null, one row of each fingerprint stays. Most rows pass straight through: only those whose id may be a loser's or a
    repeated one, by a filter of such ids, shuffle.
    """
    if similarity is None:
        groups, named = simhash_groups(docs, id_col, text_col), _fingerprints(text_of(text_col))
    else:
        groups, named = similar_groups(docs, id_col, text_col, similarity, shingle, exact=exact, signatures=near_links), node_of(shingle)(text_of(text_col))
    groups = stored(groups, "groups")
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("component_id").alias("component_id")).where("doc_id is not null")
    gone = stored(repeated.where("n > 1 or component_id != doc_id").select("doc_id", F.xxhash64("doc_id").alias("h"), (F.col("component_id") != F.col("doc_id")).alias("loser")), "gone")
    maybe = column_filter(gone, "h", gone.count(), members=True)

    key = F.col(id_col)
    flagged = docs.withColumn("__ws_maybe", maybe.holds(F.when(key.isNotNull(), F.xxhash64(key.cast("long")))))
    plain = flagged.where(key.isNotNull() & ~F.col("__ws_maybe")).drop("__ws_maybe")
    losers = gone.where("loser").select(F.col("doc_id").alias("__ws_gone"))
    met = flagged.where("__ws_maybe").drop("__ws_maybe").join(losers, key == F.col("__ws_gone"), "left_anti").dropDuplicates([id_col])
    alone = groups.where("component_id is null").select(F.col("fingerprint").alias("__ws_alone")).distinct()
    nameless = docs.where(key.isNull()).withColumn("__ws_fp", F.lower(F.lpad(F.hex(named), 16, "0")))
    nameless = nameless.join(alone, F.col("__ws_fp") == F.col("__ws_alone"), "left_semi").dropDuplicates(["__ws_fp"]).drop("__ws_fp")
    return plain.unionByName(met).unionByName(nameless)
