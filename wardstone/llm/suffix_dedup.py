"""Suffix-array dedup: bytes covered by a long string that an earlier document holds are removed.

Spark deals the work out by content. Each window of ``length`` bytes is filed under its anchor, the leftmost of its
ANCHOR-byte strings with the least hash, so equal windows meet under one anchor. Anchors that only one document holds
leave by a once-seen/twice-seen filter, whose size follows the data; if it would be too large to broadcast, the anchors
are taken in several passes, by ranges of their hashes, and past MOST_PASSES all anchors travel. Of equal whole texts only the row with the least id goes this way, as the others
lose all their bytes to it. Neighbouring windows with the same anchor travel as one context; equal contexts
are merged before and after the shuffle, with the least document that holds them. A task then sorts the suffixes of the
contexts of many anchors by Lyndon-prefix groups (suffix_sort), equal windows stand side by side in that order, and
each gets the least document of its class. Anchors with too many different contexts are dealt out window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BYTES, SENT_SCHEMA, RepeatFilter, column_filter, layout, repeat_filters, sent
from .common import released, stored, swept, text_of
from .suffix_sort import suffix_order

#: Bytes of a repeated string, and of an anchor in it.
LENGTH, ANCHOR = 50, 28
#: Bound of a broadcast filter of repeated anchors: 134 million of them at four bits each in one pass; most passes with such
#: a filter each, every one of which hashes all texts again; past that one pass without a filter shuffles every context, 6
#: to 9 times the input.
FILTER_BYTES, MOST_PASSES = 2 * MAX_BYTES, 8
#: Different contexts of an anchor from which its windows are dealt out one by one, and most such anchors (8 bytes each).
CROWD, MOST_CROWDED = 1000, 1 << 20
#: Crowds are found on one document of so many, by a hash of its id; this steers where windows go, never what is found.
CROWD_SHARE = 8
#: Bytes of a text that are hashed at a time, contexts that a task merges before it sends them, bytes of contexts whose windows
#: are sorted together, which are a third of them or less as a rule.
CHUNK, MERGED, BLOCK = 1 << 16, 1 << 15, 1 << 15
#: Rows that the sorter gathers before it merges and groups them.
GATHERED = 10_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def _gram_hashes(octets: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k``-byte string: polynomials of doubled lengths, then a finaliser."""
    h, size, out, have = (octets.astype(np.uint64) + np.uint64(1)) * _MUL, 1, None, 0
    while size <= k:
        if k & size:
            if out is None:
                out, have = h, size
            else:
                m = len(octets) - have - size + 1
                out = out[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + h[have : have + m]
                have += size
        if size * 2 <= k:
            m = len(h) - size
            h = h[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    base = 0x9FB21C651E98DF25
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MUL)


def _content_hashes(octets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to each end, wherever they stand."""
    power, inverse = _powers(1 << max(len(octets) - 1, 1).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[octets] * power[: len(octets)], dtype=np.uint64)]
    return _mixed((sums[end] - sums[start]) * inverse[start])


def _runs(octets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each window, the hashes of all strings of ``k`` bytes; fewer than 2^20 bytes."""
    width, hashes = length - k + 1, _gram_hashes(octets, k)
    least = (hashes & ~np.uint64(0xFFFFF)) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost place
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least & np.uint64(0xFFFFF)).astype(np.int64), hashes


def _anchors_in(raws: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with the same anchor: bytes that were hashed together, the hashes of their strings of ``k`` bytes, and as
    arrays each run's start in them, text (its place in ``raws``), first window, windows, place and hash of the anchor. Short
    texts are hashed together, long ones CHUNK windows at a time.
    """
    pieces: list[tuple[int, int, bytes]] = []  # text, first window, bytes
    held = 0

    def found() -> tuple[np.ndarray, ...]:
        octets = np.frombuffer(b"".join(x for *_, x in pieces), np.uint8)
        place, hashes = _runs(octets, length, k)
        ends = np.cumsum([len(x) for *_, x in pieces])
        starts = np.r_[0, ends[:-1]]
        change = np.r_[True, place[1:] != place[:-1]]
        change[starts] = True  # a text's runs are its own
        cut = ends - length + 1
        change[cut[cut < len(change)]] = True  # windows that reach into the next text
        first = np.flatnonzero(change)
        many = np.diff(np.r_[first, len(change)])
        which = np.searchsorted(starts, first, side="right") - 1
        own = first + length <= ends[which]
        first, many, which = first[own], many[own], which[own]
        text, base = (np.array([x[i] for x in pieces], np.int64)[which] for i in (0, 1))
        at = place[first]
        return octets, hashes, first, text, first - starts[which] + base, many, at - starts[which] + base, hashes[at]

    for i, raw in enumerate(raws):
        for at in range(0, max(0, len(raw) - length + 1), CHUNK):
            part = raw if len(raw) < CHUNK + length else raw[at : at + CHUNK + length - 1]
            pieces.append((i, at, part))
            held += len(part)
            if held >= CHUNK:
                yield found()
                pieces, held = [], 0
    if pieces:
        yield found()


def anchors_of(raws: list[bytes], length: int = LENGTH, k: int = ANCHOR, content: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each run: text, first window, windows, place and hash of the anchor, and with ``content`` hash of the run's bytes."""
    for octets, _, start, *run in _anchors_in(raws, length, k):
        yield (*run, _content_hashes(octets, start, start + run[2] + length - 1)) if content else tuple(run)


def anchors(raw: bytes, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of one text: first window, windows, place and hash of the anchor, hash of the run's bytes."""
    got = [x[1:] for x in anchors_of([raw], length, k)]
    return tuple(map(np.concatenate, zip(*got))) if got else tuple(np.zeros(0, np.int64) for _ in range(5))


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Cutter:
    """The contexts of suspected anchors of texts, as arrays: text, h, hash of the context, first window, windows, anchor's offset."""

    def __init__(self, suspects: RepeatFilter | None, crowded: np.ndarray, length: int, k: int):
        self.suspects, self.crowded, self.length, self.k = suspects, crowded, length, k

    def _full(self, h: np.ndarray) -> np.ndarray:
        """Which anchors are crowded; ``crowded`` is sorted, and may have many more than ``h``."""
        if not len(self.crowded):
            return np.zeros(len(h), bool)
        return self.crowded[np.minimum(np.searchsorted(self.crowded, h), len(self.crowded) - 1)] == h

    def __call__(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        for octets, grams, start, text, first, many, place, hashes in _anchors_in(raws, self.length, self.k):
            h, offset = hashes.view(np.int64), place - first
            if self.suspects:
                keep = self.suspects.suspects(h)
                start, text, h, first, many, offset = (x[keep] for x in (start, text, h, first, many, offset))
            full = self._full(h)
            if full.any():  # window by window: each is a context of its own, filed under its own bytes
                n, last = many[full], self.length - self.k
                of, step = np.repeat(np.flatnonzero(full), n), np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
                window, own = start[of] + step, np.zeros(len(of), np.uint64)
                for i in (*range(0, last, self.k), last):
                    own = _mixed(own * _MUL + grams[window + i])
                more = window, text[of], own.view(np.int64), first[of] + step, np.ones(len(of), np.int64), offset[of] - step
                start, text, h, first, many, offset = (np.concatenate((x[~full], y)) for x, y in zip((start, text, h, first, many, offset), more))
            c = _content_hashes(octets, start, start + many + self.length - 1).view(np.int64)
            if len(h):
                yield text, h, c, first, many, offset


def _shared_runs(contexts: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """Of contexts as below: context and place in it of each window, and whether a window of its bucket has the same hash.

    Windows that are alone with their hash are equal to no other, so only the rest need be sorted; which of these are equal
    is for the sort to say.
    """
    octets = np.frombuffer(b"".join(x[4] for x in contexts), np.uint8)
    sizes, many, bucket = (np.array(x, np.int64) for x in ([len(x[4]) for x in contexts], [x[2] for x in contexts], [x[7] for x in contexts]))
    of, at = np.repeat(np.arange(len(contexts)), many), np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
    start = np.repeat(sizes.cumsum() - sizes, many) + at
    keys = _mixed(_content_hashes(octets, start, start + length) + bucket[of].astype(np.uint64) * _MUL)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order] = np.r_[same, False] | np.r_[False, same]
    return of, at, shared


def _window_owners(contexts: list[tuple], length: int, k: int) -> pd.DataFrame:
    """For contexts (h, c, windows, anchor's offset, bytes, least doc, last doc, bucket): runs of windows and least docs.

    What is sorted are the runs of windows that may have an equal, each different one of a bucket once, and none that is the
    only one of its bucket: its windows differ in their anchor's offset. The anchor, which all windows of a bucket share, stands
    as one byte that UTF-8 never has.
    """
    low, high = (np.array([x[i] for x in contexts], np.int64) for i in (5, 6))
    of, at, shared = _shared_runs(contexts, length)
    m = low[of]
    if shared.any():
        chosen = np.flatnonzero(shared)
        edge = np.flatnonzero(np.r_[True, (np.diff(chosen) != 1) | (of[chosen[1:]] != of[chosen[:-1]])])
        many = np.diff(np.r_[edge, len(chosen)])
        parts: dict[tuple[int, bytes], int] = {}
        which, sorted_runs = [], []
        for c, a, n in zip(of[chosen[edge]].tolist(), at[chosen[edge]].tolist(), many.tolist()):
            x = contexts[c]
            part = x[4][a : a + n + length - 1]
            place = parts.setdefault((x[7], part), len(parts))
            if place == len(sorted_runs):
                sorted_runs.append((n, x[3] - a, part, x[5], x[7]))
            elif x[5] < sorted_runs[place][3]:
                sorted_runs[place] = (*sorted_runs[place][:3], x[5], x[7])
            which.append(place)
        size, owner, home = (np.array([x[i] for x in sorted_runs], np.int64) for i in (0, 3, 4))
        least, first, several = np.repeat(owner, size), size.cumsum() - size, np.bincount(home)[home] > 1
        if several.any():
            least[np.repeat(several, size)] = _least_of_equals([x for x, own in zip(sorted_runs, several.tolist()) if own], length, k)
        m[chosen] = least[np.repeat(first[which], many) + np.arange(len(chosen)) - np.repeat(edge, many)]
    edge = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (of[1:] != of[:-1])])
    last = np.r_[edge[1:], len(m)] - 1
    use = m[edge] < high[of[edge]]
    edge, last = edge[use], last[use]
    c = of[edge]
    return pd.DataFrame({
        "h": np.array([x[0] for x in contexts], np.int64)[c], "c": np.array([x[1] for x in contexts], np.int64)[c],
        "a": at[edge].astype(np.int32), "b": at[last].astype(np.int32), "m": m[edge],
    })


def _least_of_equals(runs: list[tuple], length: int, k: int) -> np.ndarray:
    """For runs (windows, anchor's offset, bytes, least doc, bucket): the least doc of each window's equals."""
    text, stops, width = bytearray(b"\0"), [0], length - k + 1
    for _, offset, part, *_ in runs:
        text += part[:offset]
        text += b"\xff"
        text += part[offset + k :]
        text.append(0)
        stops.append(len(text) - 1)
    order = np.array(suffix_order(bytes(text), stops), np.int64)
    octets, starts = np.frombuffer(bytes(text), np.uint8), np.array(stops[:-1], np.int64) + 1
    many = np.array([x[0] for x in runs], np.int64)
    owner = np.full(len(octets), -1, np.int64)  # run of each window start
    first = many.cumsum() - many
    windows = np.repeat(starts - first, many) + np.arange(many.sum())
    owner[windows] = np.repeat(np.arange(len(runs)), many)
    order = order[owner[order] >= 0]
    new = np.zeros(len(order), bool)
    new[0] = True
    for j in range(width):
        seen = octets[order + j]
        new[1:] |= seen[1:] != seen[:-1]
    bucket = np.array([x[4] for x in runs], np.int64)[owner[order]]
    key = new.cumsum() * (bucket.max() + 1) + bucket
    least = np.array([x[3] for x in runs], np.int64)
    by = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
    low = np.minimum.reduceat(least[owner[order]][by], edge)
    at = np.empty(len(octets), np.int64)
    at[order[by]] = np.repeat(low, np.diff(np.r_[edge, len(by)]))
    return at[windows]


def _same(a: list[bytes], b: list[bytes]) -> None:
    """Equal hashes stand for equal bytes from here on; all contexts of one hash meet here, so that none goes unseen."""
    if a != b:
        raise ValueError("two contexts of one anchor have the same 64-bit hash: run with another length of anchors")


def _sorter(length: int, k: int, block: int = BLOCK):
    """Rows sorted by h, a bucket's rows all in one partition: the owners of the windows of each different context."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, least, contexts, size = [], 0, GATHERED, [], 0

        def merged(last: bool) -> tuple[np.ndarray, ...]:
            """Columns of the gathered rows, each context once; but for the last time, the last bucket's stay."""
            h, c, n, p, part, low, high = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((c, h))
            edge = np.flatnonzero(np.r_[True, (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)])
            one = order[edge]
            first = np.repeat(one, np.diff(np.r_[edge, len(order)]))
            more = first != order
            _same(part[first[more]].tolist(), part[order[more]].tolist())
            low, high = np.minimum.reduceat(low[order], edge), np.maximum.reduceat(high[order], edge)
            out = h[one], c[one], n[one], p[one], part[one], low, high
            if last:
                return out
            cut = int(np.searchsorted(out[0], out[0][-1]))
            held.append(tuple(x[cut:] for x in out))
            return tuple(x[:cut] for x in out)

        def owners(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal size
            h, c, n, p, part, low, high = merged(last)
            if not len(h):
                return
            start = np.flatnonzero(np.r_[True, np.diff(h) != 0])
            many = np.diff(np.r_[start, len(h)])
            met = np.minimum.reduceat(low, start) < np.maximum.reduceat(high, start)  # else one document only
            alone = start[met & (many == 1)]
            if len(alone):
                yield _whole(h[alone], c[alone], n[alone], low[alone])
            left = met & (many > 1)
            rows = list(zip(*(x[np.repeat(left, many)].tolist() for x in (h, c, n, p, part, low, high))))
            ends = many[left].cumsum().tolist()
            for a, b in zip([0, *ends], ends):
                by_anchor: dict[bytes, list[tuple]] = {}  # anchors of one hash are apart if their bytes are
                for x in rows[a:b]:
                    by_anchor.setdefault(x[4][x[3] : x[3] + k], []).append(x)
                for own in by_anchor.values():
                    if len(by_anchor) > 1 and min(x[5] for x in own) == max(x[6] for x in own):
                        continue  # one document only
                    if len(own) == 1:
                        (x,) = own
                        yield _whole(*(np.array([x[i]], np.int64) for i in (0, 1, 2, 5)))
                        continue
                    number = len(contexts)
                    for x in own:
                        contexts.append((*x, number))
                        size += len(x[4])
                if size >= block:
                    yield _window_owners(contexts, length, k)
                    contexts.clear()
                    size = 0

        for frame in frames:
            held.append(tuple(frame[x].to_numpy() for x in ("h", "c", "n", "p", "part", "low", "high")))
            rows += len(frame)
            if rows >= least:
                yield from owners(False)
                rows = len(held[0][0])
                least = max(GATHERED, 2 * rows)
        if held:
            yield from owners(True)
        if contexts:
            yield _window_owners(contexts, length, k)

    return run


def _whole(h: np.ndarray, c: np.ndarray, n: np.ndarray, low: np.ndarray) -> pd.DataFrame:
    """Contexts that are the only ones of their anchors: all their windows are their least documents'."""
    return pd.DataFrame({"h": h, "c": c, "a": np.zeros(len(h), np.int32), "b": (n - 1).astype(np.int32), "m": low})


class Copies:
    """Which rows are surely copies of a text with a smaller id: their mark repeats, and their id is no first one's."""

    def __init__(self, again: RepeatFilter, first: RepeatFilter):
        self.again, self.first = again, first

    def __call__(self, marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.again.suspects(marks) & ~self.first.suspects(ids)

    def left(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames with mark and idh, without such rows; in the worker that hashes the rest, so that no other is needed."""
        for frame in frames:
            kept = frame[~self(frame["mark"].to_numpy(), frame["idh"].to_numpy())]
            if len(kept):
                yield kept


def removed_spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, filter_bytes: int = FILTER_BYTES, crowd: int = CROWD, copies: Copies | None = None) -> DataFrame:
    """Rows (id, mark, starts, ends) of the byte runs to remove, for ``docs`` (id long, mark long, t string), ``copies`` left out."""
    total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    where = layout(2 * total // (length - k + 2) + 1)
    docs = docs.select("id", "mark", "t", F.xxhash64("id").alias("idh"))

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for frame in copies.left(frames) if copies else frames:
            for text, _, _, _, h in anchors_of([_raw(t) for t in frame["t"]], length, k, content=False):
                order = np.lexsort((h, text))  # once for each text (a long text's parts count on their own)
                h, text = h[order], text[order]
                yield h[np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]].view(np.int64)

    payload = docs.mapInPandas(released(lambda frames: sent(hashes(frames), where)), SENT_SCHEMA)
    runs = None
    for suspects in repeat_filters(payload, where, filter_bytes, MOST_PASSES):
        some = _runs_of(docs, suspects, length, k, crowd, copies)
        if runs is not None or suspects and suspects.high < suspects.segments:  # of several: so that its filter can go
            some = stored(some, "pass")
            suspects.held.unpersist()
        runs = some if runs is None else runs.union(some)
    return runs.groupBy("id", "mark").agg(F.collect_list(F.struct("s", "e")).alias("runs"))


def _runs_of(docs: DataFrame, suspects: RepeatFilter | None, length: int, k: int, crowd: int, copies: Copies | None) -> DataFrame:
    """Rows (id, mark, s, e): the byte runs to remove for the windows of the anchors that ``suspects`` has; None: of all."""
    left = copies.left if copies else iter

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Anchors and hashes of their contexts, each pair once in a while."""
        cut, seen, size = Cutter(suspects, np.zeros(0, np.int64), length, k), [], 0
        for frame in left(frames):
            for _, h, c, *_ in cut([_raw(t) for t in frame["t"]]):
                seen.append(pd.DataFrame({"h": h, "c": c}))
                size += len(h)
                if size >= 4 * MERGED:
                    yield pd.concat(seen).drop_duplicates()
                    seen, size = [], 0
        if seen:
            yield pd.concat(seen).drop_duplicates()

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(CROWD_SHARE)) == 0)
    counts = some.mapInPandas(released(pairs), "h long, c long").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > crowd // CROWD_SHARE)
    full = counts.orderBy(F.desc("n"), "h").limit(MOST_CROWDED).select("h").toArrow()  # if there are more, the largest
    crowded = np.sort(full.column(0).to_numpy())
    held = docs.sparkSession.sparkContext.broadcast(crowded)

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, parts, size = Cutter(suspects, held.value, length, k), [], 0

        def merged(raws: list[bytes]) -> pd.DataFrame:
            h, c, q, n, p, doc, row = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((c, h))
            h, c, doc = h[order], c[order], doc[order]
            edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            one = order[edge]
            parts.clear()
            first = np.repeat(one, np.diff(np.r_[edge, len(order)]))
            more = first != order

            def cut_out(of: np.ndarray) -> list[bytes]:
                return [raws[r][a:b] for r, a, b in zip(row[of].tolist(), q[of].tolist(), (q[of] + n[of] + length - 1).tolist())]

            _same(cut_out(first[more]), cut_out(order[more]))
            return pd.DataFrame({
                "h": h[edge], "c": c[edge], "n": n[one].astype(np.int32), "p": p[one].astype(np.int32),
                "part": cut_out(one),
                "low": np.minimum.reduceat(doc, edge), "high": np.maximum.reduceat(doc, edge),
            })

        for frame in left(frames):
            raws, ids = [_raw(t) for t in frame["t"]], frame["id"].to_numpy()
            for text, h, c, q, n, p in cut(raws):
                parts.append((h, c, q, n, p, ids[text], text))
                size += len(h)
                if size >= MERGED:
                    size = 0
                    yield merged(raws)
            if parts:  # the texts of a batch go with it
                size = 0
                yield merged(raws)

    met = docs.mapInPandas(released(contexts), "h long, c long, n int, p int, part binary, low long, high long")
    met = met.repartition("h").sortWithinPartitions("h")
    owners = stored(met.mapInPandas(released(_sorter(length, k)), "h long, c long, a int, b int, m long"), "owners")
    swept(docs.sparkSession)  # the contexts, twice the input

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, parts, size = Cutter(suspects, held.value, length, k), [], 0

        def gathered() -> pd.DataFrame:
            h, c, doc, mark, q = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            return pd.DataFrame({"h": h, "c": c, "id": doc, "mark": mark, "q": q.astype(np.int32)})

        for frame in left(frames):
            ids, marks = frame["id"].to_numpy(), frame["mark"].to_numpy()
            for text, h, c, q, *_ in cut([_raw(t) for t in frame["t"]]):
                parts.append((h, c, ids[text], marks[text], q))
                size += len(h)
                if size >= MERGED:
                    size = 0
                    yield gathered()
        if parts:
            yield gathered()

    spots = docs.mapInPandas(released(places), "h long, c long, id long, mark long, q int")
    return spots.join(owners, ["h", "c"]).where("m < id").select("id", "mark", (F.col("q") + F.col("a")).alias("s"), (F.col("q") + F.col("b") + length).alias("e"))


def _merge(runs: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def suffix_array_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = ANCHOR, filter_bytes: int = FILTER_BYTES, crowd: int = CROWD
) -> DataFrame:
    """``docs`` with its repeated bytes removed from ``text_col``, and n_bytes, n_removed, n_spans (long), kept_sha256.

    A byte goes if a string of ``length`` bytes over it also starts in a row with a smaller id; all is judged on the
    input. Rows that share an id do not remove from each other; a row with a null id loses nothing and makes nobody
    lose. Null and empty texts have no bytes and become ''. Where a removed run cuts a character, what is left of the
    character is dropped from the text, while kept_sha256 and the counts are of the bytes. Extra columns pass through;
    columns of the four names are replaced. An empty table gives an empty result.
    """
    names, key = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), F.col("__ws_id")
    base = docs.drop(*names).withColumn(text_col, text_of(text_col)).withColumn("__ws_id", F.col(id_col).cast("long")).withColumn("__ws_sha", F.sha2(text_col, 256))
    base = base.withColumn("__ws_mark", F.when(key.isNotNull(), F.xxhash64("__ws_sha")))

    rows = docs.count()
    mark, idh = F.col("__ws_mark"), F.xxhash64(key)
    repeated = column_filter(base, "__ws_mark", rows, filter_bytes)
    firsts = stored(base.where(repeated.holds(mark)).groupBy("__ws_sha").agg(F.xxhash64(F.min(key)).alias("first")), "firsts")
    copies = Copies(repeated, column_filter(firsts, "first", firsts.count(), filter_bytes, members=True))

    known = base.where(key.isNotNull()).select(key.alias("id"), mark.alias("mark"), F.col(text_col).alias("t"))
    runs = removed_spans(known, length, k, filter_bytes, crowd, copies).withColumn("h", F.xxhash64("id"))
    runs = stored(runs.select(F.col("id").alias("__ws_of"), F.col("mark").alias("__ws_text"), F.col("runs").alias("__ws_runs"), "h"), "runs")
    swept(docs.sparkSession)
    touched = column_filter(runs, "h", runs.count(), filter_bytes, members=True)

    @F.pandas_udf("long")
    def fate(marks: pd.Series, ids: pd.Series) -> pd.Series:
        """1: a copy of an earlier text, 2: has runs to remove, maybe, 0: neither."""
        marks, ids = marks.to_numpy(), ids.to_numpy()
        return pd.Series(np.where(copies(marks, ids), 1, np.where(touched.suspects(ids), 2, 0)))

    zero = F.lit(0).cast("long")
    base = base.withColumn("__ws_fate", F.when(key.isNotNull(), fate(F.coalesce(mark, zero), idh)).otherwise(0))
    base = base.withColumn("__ws_copy", F.col("__ws_fate") == 1).withColumn("__ws_met", F.col("__ws_fate") == 2)

    @F.pandas_udf("text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def without(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, each in zip(texts, runs):
            raw, spans = _raw(t), _merge(each)
            left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]))
            out.append((left.decode("utf-8", "ignore"), len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(out, columns=["text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    gone, size = F.col("__ws_copy") & (F.octet_length(text_col) >= length), F.octet_length(text_col).cast("long")
    plain = base.where(~F.col("__ws_met")).withColumns({
        "n_bytes": size, "n_removed": F.when(gone, size).otherwise(zero), "n_spans": F.when(gone, 1).otherwise(zero).cast("long"),
        "kept_sha256": F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("__ws_sha")), text_col: F.when(gone, "").otherwise(F.col(text_col)),
    })
    met = base.where("__ws_met").join(runs.drop("h"), (key == F.col("__ws_of")) & (F.col("__ws_mark") == F.col("__ws_text")), "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    met = met.withColumn("__ws_out", without(text_col, F.coalesce("__ws_runs", none)))
    met = met.withColumns({text_col: F.col("__ws_out.text"), **{x: F.col(f"__ws_out.{x}") for x in names}})
    extra = ("__ws_id", "__ws_sha", "__ws_mark", "__ws_fate", "__ws_copy", "__ws_met")
    return plain.drop(*extra).unionByName(met.drop(*extra, "__ws_out", "__ws_of", "__ws_text", "__ws_runs"))
