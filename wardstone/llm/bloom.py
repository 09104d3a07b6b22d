"""Once-seen and twice-seen Bloom filters over 64-bit hashes, built by Spark in segments.

A hash belongs to one segment (by its top bits) and sets PROBES bits there. Tasks send each distinct hash once per
flush to its segment, as 32 bits; a hash that a flush holds twice is marked so. Each segment streams what it gets
through its once filter, which grows with the data and stays in the segment's task: a hash that it already holds is a
repeat. Only the repeats enter the twice filter, which goes to the executors. Its size follows the number of repeats up
to a bound. Past that a caller takes the segments in several passes, each with a filter within the bound, or one
filter that fills up: then more hashes are suspected, which costs shuffle but loses no repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, stored

#: Bits for each expected hash in the once filters; bits for each repeat in the twice filter, and the least of them, at which
#: one hash in six that does not repeat is suspected; bits set by a hash; the broadcast's bound in bytes.
BITS_PER_HASH, BITS_PER_REPEAT, LEAST_PER_REPEAT, PROBES, MAX_BYTES = 12, 10, 4, 4, 32 << 20
#: Least and most bits of a segment; segments that are cut before segments grow. A task sends a row a segment and flush, so the
#: number of segments must not follow the data: it stays from 134 million bits on, up to 17 billion of them.
LEAST_BITS, MOST_BITS, SEGMENTS = 1 << 18, 1 << 25, 1 << 9
#: Hashes that a task gathers before it sends them.
FLUSH = 1 << 18

SENT_SCHEMA = "segment int, once binary, twice binary"


@dataclass(frozen=True)
class Layout:
    """How many segments there are, and the bits of the once filter of each."""

    segments: int
    bits: int


def layout(expected: int) -> Layout:
    """Powers of two, so that ``expected`` hashes get BITS_PER_HASH bits each in the once filters."""
    need = 1 << (max(LEAST_BITS, expected * BITS_PER_HASH) - 1).bit_length()
    bits = min(MOST_BITS, max(LEAST_BITS, need // SEGMENTS))
    return Layout(need // bits, bits)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that weak low or high bits of the input do not matter."""
    h = hashes.astype(np.int64).view(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _placed(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's segment, and the 32 bits that stand for it there."""
    h = _mixed(hashes)
    return ((h >> np.uint64(32)) & np.uint64(segments - 1)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bit(keys: np.ndarray, size: int, probe: int) -> np.ndarray:
    """A bit number under ``size`` of each key."""
    a = keys.astype(np.uint64)
    b = (a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)
    return (((a + np.uint64(probe) * b) ^ (b >> np.uint64(7))) % np.uint64(size)).astype(np.int64)


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """PROBES bit numbers under ``size`` of each key, one row a probe."""
    return np.stack([_bit(keys, size, i) for i in range(PROBES)])


def sent(batches: Iterable[np.ndarray], where: Layout, all_twice: bool = False) -> Iterator[pd.DataFrame]:
    """What one task sends to the segments for its hashes; ``all_twice``: each counts as a repeat."""
    held: list[np.ndarray] = []

    def flush() -> pd.DataFrame:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        segment, keys = _placed(hashes, where.segments)
        order = np.argsort(segment, kind="stable")
        segment, keys, again = segment[order], keys[order], (counts[order] > 1) | all_twice
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        ends = np.r_[starts[1:], len(segment)]
        return pd.DataFrame({
            "segment": segment[starts].astype(np.int32),
            "once": [keys[a:b].tobytes() for a, b in zip(starts, ends)],
            "twice": [keys[a:b][again[a:b]].tobytes() for a, b in zip(starts, ends)],
        })

    size = 0
    for hashes in batches:
        if len(hashes):
            held.append(hashes)
            size += len(hashes)
        if size >= FLUSH:
            size = 0
            yield flush()
    if held:
        yield flush()


def _repeats(size: int):
    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stream rows sorted by segment through the once filter of each; gives the distinct keys that repeat."""
        at, once, found, held = None, None, [], 0

        def packed() -> pd.DataFrame:
            keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)
            return pd.DataFrame({"segment": np.array([at], np.int32), "n": [len(keys)], "keys": [keys.tobytes()]})

        for frame in frames:
            for segment, new, again in zip(frame["segment"], frame["once"], frame["twice"]):
                if segment != at:
                    if at is not None:
                        yield packed()
                    at, once, found, held = segment, np.zeros(size, np.uint8), [], 0
                keys = np.frombuffer(new, np.uint32)
                bits = _bits(keys, size)
                found += keys[once[bits].all(axis=0)], np.frombuffer(again, np.uint32)
                once[bits] = 1
                held += len(found[-1]) + len(found[-2])
                if held > 1 << 20:
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        if at is not None:
            yield packed()

    return merged


class RepeatFilter:
    """A broadcast twice filter of the segments from ``low`` on; ``suspects`` tells which hashes may occur twice or more."""

    def __init__(self, held: Broadcast, segments: int, size: int, low: int, high: int):
        self.held, self.segments, self.size, self.low, self.high = held, segments, size, low, high

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        segment, keys = _placed(hashes, self.segments)
        bits, whole = self.held.value, self.high - self.low == self.segments
        left = np.arange(len(keys)) if whole else np.flatnonzero((segment >= self.low) & (segment < self.high))
        for i in range(PROBES):  # most that do not repeat miss at the first bits: the next are looked up for the rest only
            at = (segment[left] - self.low) * self.size + _bit(keys[left], self.size, i)
            left = left[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out

    def holds(self, column: Column) -> Column:
        """Whether the hash in a long column is suspected; a null is not."""

        @F.pandas_udf("boolean")
        def suspected(h: pd.Series) -> pd.Series:
            return pd.Series(self.suspects(h.to_numpy()))

        return suspected(F.coalesce(column, F.lit(0).cast("long"))) & column.isNotNull()


def repeat_filters(payload: DataFrame, where: Layout, max_bytes: int = MAX_BYTES, most: int = 1) -> Iterator[RepeatFilter | None]:
    """Merge the rows of ``sent`` by segment and broadcast the twice filters, each of ``max_bytes`` at most.

    Repeats have BITS_PER_REPEAT each, or fewer so that one filter holds them all, but LEAST_PER_REPEAT at least. Past that
    there are as many filters as they need, each for a range of segments. If that is more than ``most`` there is one, which
    is full if ``most`` is 1, and else None: any hash may repeat.
    """
    merged = payload.repartition("segment").sortWithinPartitions("segment").mapInPandas(released(_repeats(where.bits)), "segment int, n long, keys binary")
    repeats = stored(merged, "repeats")
    largest = repeats.agg(F.max("n")).first()[0] or 0
    bound = max_bytes * 8
    room, (size, least) = bound // where.segments // 64 * 64, (max(64, -(-largest * bits // 64) * 64) for bits in (BITS_PER_REPEAT, LEAST_PER_REPEAT))
    size = min(size, max(room, least))
    passes = -(-where.segments * size // bound)
    if passes > most:
        if most > 1:
            yield None
            return
        passes, size = 1, max(64, bound // where.segments // 64 * 64)

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for segment, keys in zip(frame["segment"], frame["keys"]):
                bits = np.zeros(size, np.uint8)
                bits[_bits(np.frombuffer(keys, np.uint32), size)] = 1
                yield pd.DataFrame({"segment": np.array([segment], np.int32), "filter": [np.packbits(bits).tobytes()]})

    passes = min(passes, where.segments)
    for i in range(passes):
        low, high = where.segments * i // passes, where.segments * (i + 1) // passes
        bits = np.zeros((high - low) * size // 8, np.uint8)
        some = repeats.where((F.col("segment") >= low) & (F.col("segment") < high)).select("segment", "keys")
        for row in some.mapInPandas(drawn, "segment int, filter binary").collect():  # the filters themselves, of bounded size
            at = (row["segment"] - low) * size // 8
            bits[at : at + size // 8] = np.frombuffer(bytes(row["filter"]), np.uint8)
        yield RepeatFilter(payload.sparkSession.sparkContext.broadcast(bits), where.segments, size, low, high)


def repeat_filter(payload: DataFrame, where: Layout, max_bytes: int = MAX_BYTES) -> RepeatFilter:
    """The one filter of all segments; if the repeats need more than ``max_bytes`` it suspects more than they."""
    return next(repeat_filters(payload, where, max_bytes))


def column_filter(rows: DataFrame, hash_col: str, expected: int, max_bytes: int = MAX_BYTES, members: bool = False) -> RepeatFilter:
    """The filter of the hashes that occur twice or more in a long column, or, with ``members``, of all of them."""
    where = layout(expected)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from sent((frame["h"].to_numpy() for frame in frames), where, members)

    return repeat_filter(rows.select(F.col(hash_col).alias("h")).where("h is not null").mapInPandas(released(send), SENT_SCHEMA), where, max_bytes)
