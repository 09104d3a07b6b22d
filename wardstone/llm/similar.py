"""Groups of similar texts: every pair whose shingle sets have a Jaccard similarity of at least a threshold is linked.

At 0.8 two 64-bit fingerprints differ in about 10 bits, and in 17 or more often enough that segments of them no longer
find the pairs. So candidates meet on shingles: of two sets that are similar enough, the first elements in a fixed order
(the prefix, a fifth of each set at 0.8) have one in common, always. The order is that of the hashes, but shingles that
many texts hold come last, so that a common passage gathers no crowd unless it is most of a text. As hashes are in no
order of the text, the first FIRST of a prefix do as well: that two texts at 0.8 have none of them in common has a chance
of less than one in a million. A text that is mostly of frequent shingles is filed under its whole prefix. SimHash
fingerprints of 512 bits sort out what meets by chance, and the exact similarity decides.

With ``signatures`` (the deletion variants of simhash.py) the 64-bit fingerprints come first: of those that they link, the exact
similarity decides, and what it links is one node for the rounds that follow, which find what three bits do not.

The first round links a bucket's members to a few leaders that they very likely resemble, so that a crowd of copies takes
one comparison a member; a very large bucket is dealt out in parts, whose leaders meet in the second. The third takes
those that these have not connected: fingerprints tell which members of a bucket may be similar, and join them to crowds.
A crowd's sets then meet, each set once, and are compared where they meet; what leaves a task is a spanning forest of
links, so nothing grows with a crowd's pairs but comparisons. Large buckets and crowds are dealt out as pairs of their
parts, each a key of its own, so no task holds or compares more than two parts; the sets of a very large crowd, which may
be a chain of many small buckets, meet by buckets instead.

FIRST and the fingerprints may miss a pair, by less than one chance in a million each; ``exact`` does without both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import SENT_SCHEMA, RepeatFilter, column_filter, layout, repeat_filter, sent
from .common import released, stored, text_of
from .components import connected_components, forest

SEED = 42
#: 64-bit words of a sketch; most differing bits of a pair that is compared in full, for sets of SHORT elements or more and
#: for smaller ones; most of a member and its leader. A pair at 0.8 differs in 77 bits, give or take 8, or in 97, give or
#: take 9, for the shortest texts: fewer than one such pair in a million exceeds the bounds. Unrelated ones differ in 256.
SKETCH_WORDS, MOST_BITS, MOST_BITS_SHORT, SHORT, LEADER_BITS = 8, 122, 142, 100, 85
#: Elements of a prefix that a text is filed under.
FIRST = 20
#: Documents that hold a shingle from which it comes late in the order, found on one text of SHARE; most such shingles.
#: These steer where texts meet, never what is found.
CROWD, SHARE, MOST_CROWDED = 512, 16, 1 << 20
#: Members of a bucket from which it is dealt out in parts, and of a part that is compared in full with another; rows that
#: are paired together; leaders of a bucket.
PART, SQUARE, ROWS, LEADERS = 1 << 16, 1 << 13, 1 << 15, 64
#: Elements of the sets of a part of a crowd; parts of a crowd beyond which its sets meet by buckets.
BLOCK, MOST_BLOCKS = 1 << 15, 64
#: Side of a row whose key has all of a bucket or one part of it; the two parts of other keys are sides 1 and 2.
WITHIN = 0

_BYTE_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int32)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles, ascending as signed numbers; words as op1 has them."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in parts], np.uint64).view(np.int64))


def node(hashes: np.ndarray) -> int:
    """The 64-bit name of a shingle set, signed; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def sketch(hashes: np.ndarray) -> bytes:
    """SimHash fingerprints of a set, SKETCH_WORDS of 64 bits."""
    h, out = hashes.view(np.uint64), []
    for i in range(SKETCH_WORDS):
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        octets = (mixed ^ (mixed >> np.uint64(29))).view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(octets[:, place], minlength=256) for place in range(8)]).reshape(8, 256) @ _BYTE_BITS
        out.append(np.packbits(ones.ravel() * 2 > len(hashes), bitorder="little"))
    return b"".join(x.tobytes() for x in out)


@lru_cache
def node_of(shingle: int):
    """A function of a text column: the name of its shingle set."""

    @F.pandas_udf("long")
    def named(texts: pd.Series) -> pd.Series:
        return pd.Series([node(shingle_set(t, shingle)) for t in texts], dtype="int64")

    return named


ROW = "doc_id long, mark long, node long, n int, sketch binary, fp long, prefix array<long>"


def _is_in(hashes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` are in the ascending ``some``."""
    return some[np.minimum(np.searchsorted(some, hashes), len(some) - 1)] == hashes if len(some) else np.zeros(len(hashes), bool)


def _rows(shingle: int, least: Fraction, late: Broadcast, exact: bool = False):
    """A row for each text: its set's name, size, sketch, the sketch's first word (fp) and the first of its prefix (all of it if ``exact``), in which the ``late`` hashes come last."""
    up, down = least.numerator, least.denominator

    def prefix(hashes: np.ndarray) -> np.ndarray:
        often, n = _is_in(hashes, late.value), len(hashes)
        length = n - -(-n * up // down) + 1 if n else 0
        return np.concatenate([hashes[~often], hashes[often]])[: length if exact or 2 * often.sum() > n else min(length, FIRST)]

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_set(t, shingle) for t in frame["t"]]
            sketches = [sketch(x) for x in sets]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "mark": frame["mark"], "node": [node(x) for x in sets], "n": [len(x) for x in sets],
                "sketch": sketches, "fp": np.frombuffer(b"".join(sketches), np.int64)[::SKETCH_WORDS], "prefix": [prefix(x) for x in sets],
            })

    return made


def _hashes(shingle: int, wanted: RepeatFilter | None = None):
    """The whole set of each text, by its name; only of those whose mark may be in ``wanted``, in the same worker."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if wanted:
                frame = frame[wanted.suspects(frame["mark"].to_numpy())]
                if not len(frame):
                    continue
            sets = [shingle_set(t, shingle) for t in frame["t"]]
            yield pd.DataFrame({"node": [node(x) for x in sets], "n": [len(x) for x in sets], "hashes": sets})

    return made


class Members:
    """Rows of buckets: node, n, label, side and sketch (a row of words each); sketches decide nothing if ``exact``."""

    def __init__(self, frame: pd.DataFrame, exact: bool = False):
        self.node, self.n, self.label, self.side = (frame[c].to_numpy(np.int64) for c in ("node", "n", "label", "side"))
        self.exact = exact
        self.sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(-1, SKETCH_WORDS)

    def near(self, x: np.ndarray, y: np.ndarray, up: int, down: int, most: int | None = None) -> np.ndarray:
        """Whether rows x and y may be similar, by size and sketches; ``most``: differing bits, else those of the bounds."""
        small, large = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
        out = small * down >= up * large
        if self.exact and most is None:
            return out
        at = np.flatnonzero(out)
        bits = np.bitwise_count(self.sketch[x[at]] ^ self.sketch[y[at]]).sum(axis=1, dtype=np.int64)
        out[at] = bits <= (np.where(small[at] >= SHORT, MOST_BITS, MOST_BITS_SHORT) if most is None else most)
        return out


def _leader_pairs(h: np.ndarray, rows: Members, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each member of a bucket with the first of its LEADERS that it very likely resembles; h is ascending.

    Leaders go by their names, so that a group has the same ones in each of its buckets.
    """
    left = np.lexsort((rows.node, h))
    for _ in range(LEADERS):
        if not len(left):
            return
        new = np.r_[True, h[left][1:] != h[left][:-1]]
        lead, rest = left[new][new.cumsum() - 1][~new], left[~new]
        hit = rows.near(lead, rest, up, down, LEADER_BITS)
        yield lead[hit], rest[hit]
        left = rest[~hit]


def _all_pairs(h: np.ndarray, rows: Members, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket with different labels that may be similar; rows are ascending by h, then n."""
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    ends, large = np.r_[starts[1:], len(h)], np.zeros(len(h), bool)
    for a, b in zip(starts, ends):
        if rows.side[a] != WITHIN:
            large[a:b] = True
            yield from _cross_pairs(a + np.flatnonzero(rows.side[a:b] == 1), a + np.flatnonzero(rows.side[a:b] == 2), rows, up, down)
        if b - a < 1024 or large[a]:
            continue
        labels, counts = np.unique(rows.label[a:b], return_counts=True)
        if 2 * counts.max() > b - a:  # most have one label: only the others look for partners
            large[a:b] = True
            most = labels[counts.argmax()]
            for i in a + np.flatnonzero(rows.label[a:b] != most):
                others = rows.label[a:b] != rows.label[i]
                others[: i - a] &= rows.label[a:i] == most  # of two that look for partners the first has looked
                rest = a + np.flatnonzero(others)
                one = np.full(len(rest), i)
                hit = rows.near(one, rest, up, down)
                yield one[hit], rest[hit]
    i, last = np.flatnonzero(~large), np.repeat(ends, ends - starts)
    for d in range(1, len(h)):
        i = i[i + d < last[i]]
        i = i[rows.n[i] * down >= up * rows.n[i + d]]  # the others are larger still
        if not len(i):
            return
        other = i[rows.label[i] != rows.label[i + d]]
        hit = rows.near(other, other + d, up, down)
        yield other[hit], other[hit] + d


def _cross_pairs(one: np.ndarray, two: np.ndarray, rows: Members, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``one`` and a row of ``two`` with different labels that may be similar; both are ascending by n."""
    low, high = (np.searchsorted(rows.n[two], x, side) for x, side in ((-(-rows.n[one] * up // down), "left"), (rows.n[one] * down // up, "right")))
    for x, a, b in zip(one, low, high):
        others = two[a:b][rows.label[two[a:b]] != rows.label[x]]
        if len(others):
            hit = rows.near(np.full(len(others), x), others, up, down)
            yield np.full(hit.sum(), x), others[hit]


def _pairs(similarity: Fraction, leaders: bool, exact: bool = False):
    """Buckets (rows sorted by h and salt, one partition a key) to pairs (a, b), a < b, that may be similar.

    With ``leaders`` each member pairs with one leader at most; else pairs of different labels connect what may be similar.
    """
    up, down = similarity.numerator, similarity.denominator

    def paired(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(parts).drop_duplicates(["h", "salt", "node"]).sort_values(["h", "salt", "n"], kind="stable")
        new = frame[["h", "salt"]].ne(frame[["h", "salt"]].shift()).any(axis=1).to_numpy()
        rows, a, b, size = Members(frame, exact), [], [], 0

        def held() -> pd.DataFrame:
            x, y = np.concatenate(a), np.concatenate(b)
            a.clear()
            b.clear()
            if leaders:
                return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()
            return pd.DataFrame(np.array(forest(x, y), np.int64).reshape(-1, 2), columns=["a", "b"])

        for x, y in (_leader_pairs if leaders else _all_pairs)(new.cumsum(), rows, up, down):
            a.append(rows.node[x])
            b.append(rows.node[y])
            size += len(x)
            if size > 1 << 18:
                size = 0
                yield held()
        if a:
            yield held()

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for frame in frames:
            parts.append(frame)
            size += len(frame)
            if size < ROWS:
                continue
            block = pd.concat(parts)
            last = (block["h"] == block["h"].iloc[-1]) & (block["salt"] == block["salt"].iloc[-1])  # may go on
            if not last.all():
                yield from paired([block[~last]])
            parts, size = [block[last]], int(last.sum())
        if parts:
            yield from paired(parts)

    return met


def _set_links(frame: pd.DataFrame, up: int, down: int, exact: bool) -> list[tuple[int, int]]:
    """The similar pairs of one key's rows, as a spanning forest of what its labels leave unconnected."""
    frame = frame.sort_values("n", kind="stable")
    rows, sizes = Members(frame, exact), frame["n"].to_numpy(np.int64)
    values, ids = np.unique(np.concatenate(frame["hashes"].to_list()), return_inverse=True)
    own, marked, part, out = np.split(ids, sizes.cumsum()[:-1]), np.zeros(len(values), bool), rows.label.copy(), []
    for i in range(len(frame)):
        fit = (part != part[i]) & (sizes * up <= sizes[i] * down)
        fit[: i + 1] = False  # the smaller ones have looked
        if rows.side[i] != WITHIN:
            fit &= rows.side != rows.side[i]
        others = np.flatnonzero(fit)
        others = others[rows.near(np.full(len(others), i), others, up, down)]
        if not len(others):
            continue
        marked[own[i]] = True
        common = np.add.reduceat(marked[np.concatenate([own[j] for j in others])], np.r_[0, sizes[others].cumsum()[:-1]], dtype=np.int64)
        marked[own[i]] = False
        for j in others[common * (up + down) >= (sizes[i] + sizes[others]) * up]:
            if part[i] != part[j]:
                out.append((rows.node[i], rows.node[j]))
                part[part == part[j]] = part[i]
    return out


def _met_sets(least: Fraction, exact: bool):
    """Sets (rows sorted by key and salt, one partition a key) to links (a, b); a key's rows are held, which are two parts."""
    up, down = least.numerator, least.denominator

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        got = np.array(_set_links(frame, up, down, exact), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": got.min(axis=1), "b": got.max(axis=1)})

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for frame in frames:
            out = []
            for key, some in frame.groupby(["key", "salt"], sort=False):
                if key != last:
                    if held:
                        out.append(links(pd.concat(held)))
                    last, held = key, []
                held.append(some)
            if out:
                yield pd.concat(out)
        if held:
            yield links(pd.concat(held))

    return met


def crowded(texts: DataFrame, shingle: int, crowd: int = CROWD, share: int = SHARE) -> np.ndarray:
    """Hashes of shingles that ``crowd`` texts or more hold, going by one text of ``share``; MOST_CROWDED at most, the most frequent."""
    some = texts.where(F.pmod(F.col("mark"), F.lit(share)) == 0).select("t").mapInPandas(released(_hashes(shingle)), "node long, n int, hashes array<long>")
    often = some.select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= max(2, crowd // share))
    got = often.orderBy(F.desc("count"), "h").limit(MOST_CROWDED).select("h").toArrow()
    return np.sort(got.column(0).to_numpy())


def prefix_index(rows: DataFrame) -> DataFrame:
    """A row (node, n, sketch, h) for each element h of each text's prefix that another text may hold in its own."""
    where = layout(rows.agg(F.sum(F.size("prefix"))).first()[0] or 0)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from sent((np.concatenate([*frame["prefix"], np.zeros(0, np.int64)]) for frame in frames), where)

    suspects = repeat_filter(rows.select("prefix").mapInPandas(released(send), SENT_SCHEMA), where)

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h = np.concatenate([*frame["prefix"], np.zeros(0, np.int64)])
            own, keep = np.repeat(np.arange(len(frame)), [len(x) for x in frame["prefix"]]), suspects.suspects(h)
            out = frame[["node", "n", "sketch"]].iloc[own[keep]].reset_index(drop=True)
            out["h"] = h[keep]
            yield out

    return stored(rows.select("node", "n", "sketch", "prefix").mapInPandas(released(met), "node long, n int, sketch binary, h long"), "index")


def similar_links(
    texts: DataFrame, rows: DataFrame, least: Fraction, shingle: int, part: int = PART, square: int = SQUARE, exact: bool = False, block: int = BLOCK, blocks: int = MOST_BLOCKS,
    signatures: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Links (a, b) of nodes at a similarity of ``least`` or more: enough of them to connect all that are.

    ``texts`` has t and mark, ``rows`` is what ``_rows`` makes of them. Only the texts of candidate pairs are hashed
    again, found by a filter of their marks, for the exact comparison.
    """
    up, down = least.numerator, least.denominator
    index = prefix_index(rows)
    large = stored(index.groupBy("h").count().where(F.col("count") > part).withColumn("parts", F.ceil(F.col("count") / part)), "large").drop("count")
    split = not large.isEmpty()

    def sets_of(needed: DataFrame, name: str) -> DataFrame:
        """The sets of the nodes of ``needed``, each once."""
        marks = stored(rows.select("node", "mark").join(needed, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark")), f"{name}_marks")
        wanted = column_filter(marks, "mark", marks.count(), members=True)
        sets = texts.select("t", "mark").mapInPandas(released(_hashes(shingle, wanted)), "node long, n int, hashes array<long>")
        return stored(sets.join(needed, "node", "left_semi").dropDuplicates(["node"]), f"{name}_sets")

    def verified(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        pairs = stored(pairs.distinct(), f"{name}_pairs")
        own = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), name)
        side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        common = F.size(F.array_intersect("ha", "hb")).cast("long")
        return pairs, stored(both.where(common * (up + down) >= (F.col("na") + F.col("nb")) * up).select("a", "b"), f"{name}_links")

    def buckets(labelled: DataFrame, leaders: bool) -> DataFrame:
        rows = labelled.repartition("h", "salt").sortWithinPartitions("h", "salt")
        return rows.select("h", "salt", "side", "node", "n", "sketch", "label").mapInPandas(released(_pairs(least, leaders, exact)), "a long, b long")

    def labelled(links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The index with each node's label, without the buckets of one label only, and the labels (node, root)."""
        parts = stored(connected_components(links), f"{name}_parts")
        rows = index.join(parts.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").withColumn("label", F.coalesce("root", "node")).drop("__node", "root")
        rows = stored(rows, f"{name}_index").withColumns({"salt": F.lit(0).cast("long"), "side": F.lit(WITHIN)})
        mixed = rows.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("count")).where("low < high")
        mixed = stored(mixed.select("h", F.ceil(F.col("count") / square).alias("squares")), f"{name}_mixed")
        return rows.join(mixed, "h"), parts

    def squared(rows: DataFrame) -> DataFrame:
        """Rows of large keys once for each part that theirs meets; with its salt a key has two parts, or one."""
        own, other, n = F.pmod(F.xxhash64("node", F.lit(1)), F.col("squares")), F.col("other"), F.col("squares")
        large = rows.where("squares > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        salt = F.least("own", other) * n + F.greatest("own", other)
        large = large.withColumn("salt", salt).withColumn("side", F.when(F.col("own") == other, WITHIN).when(F.col("own") < other, 1).otherwise(2))
        return rows.where("squares <= 1").unionByName(large.drop("own", "other"))

    def compared(met: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Links among ``members`` (h, node), the rows of buckets, of what ``met`` connects: by crowds, or buckets where these are large."""
        inner = stored(connected_components(met), "crowds")
        crowds = inner.union(inner.select(F.col("root").alias("node"), "root").distinct())
        own = sets_of(crowds.select("node"), "rest")
        drawn = rows.select("node", "sketch").join(own.select("node"), "node", "left_semi").groupBy("node").agg(F.min("sketch").alias("sketch"))
        full = own.join(drawn, "node").join(crowds.withColumnRenamed("root", "crowd"), "node").join(labels, "node", "left")
        full = stored(full.select("crowd", "node", "n", "sketch", F.coalesce("root", "node").alias("label"), "hashes"), "rest_full")
        count = F.ceil(F.sum("n") / block).alias("squares")
        sizes = stored(full.groupBy("crowd").agg(count), "crowd_sizes")
        small = full.join(sizes.where(F.col("squares") <= blocks), "crowd").withColumnRenamed("crowd", "key")
        wide = sizes.where(F.col("squares") > blocks)
        if not wide.isEmpty():
            some = stored(members.select(F.col("h").alias("key"), "node").join(full.drop("hashes").join(wide.drop("squares"), "crowd", "left_semi"), "node").drop("crowd"), "wide")
            by = stored(some.groupBy("key").agg(count, F.count("*").alias("many")).where("many > 1").drop("many"), "wide_sizes")
            small = small.unionByName(some.join(by, "key").join(full.select("node", "hashes"), "node"))
        keyed = squared(small.withColumns({"salt": F.lit(0).cast("long"), "side": F.lit(WITHIN)})).drop("squares")
        keyed = keyed.repartition("key", "salt").sortWithinPartitions("key", "salt")
        return stored(keyed.mapInPandas(released(_met_sets(least, exact)), "a long, b long").distinct(), "rest_links")

    def signed() -> tuple[DataFrame, DataFrame]:
        """Links of nodes whose 64-bit fingerprints the signatures connect, and the rows of the index but those of nodes linked to another one."""
        own = stored(rows.select("fp", "node").distinct(), "fps")
        heads = stored(own.groupBy("fp").agg(F.min("node").alias("head")), "heads")
        side = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}"))
        pairs = own.join(heads, "fp").select("node", "head").union(signatures(heads).join(side("a"), "a").join(side("b"), "b").select("ha", "hb")).where("node != head")
        links = verified(pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")), "signed")[1]
        parts = stored(connected_components(links), "signed_parts").where("node != root").select(F.col("node").alias("__node"))
        return links, index.join(parts, F.col("node") == F.col("__node"), "left_anti")

    near, unlinked = signed() if signatures else (None, index)
    first = unlinked.withColumns({"label": F.col("node"), "salt": F.lit(0).cast("long"), "side": F.lit(WITHIN)})
    if split:  # few rows: each stands for ``part`` rows of the index
        first = first.drop("salt").join(large, "h", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1).cast("long"))))
    tried, links = verified(buckets(first, True), "first")
    links = links.union(near) if near else links
    if split:  # one member of each label of a bucket, so that the parts' leaders meet
        some = labelled(links, "parts")[0].groupBy("h", "salt", "side", "label").agg(F.min(F.struct("node", "n", "sketch")).alias("one")).select("h", "salt", "side", "label", "one.*")
        links = links.union(verified(buckets(some, True).join(tried, ["a", "b"], "left_anti"), "parts")[1])
    left, labels = labelled(links, "rest")
    met = stored(buckets(squared(left), False).distinct(), "rest_met")
    return links.union(compared(met, left.select("h", "node"), labels))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, crowd: int = CROWD, share: int = SHARE, part: int = PART,
    square: int = SQUARE, exact: bool = False, block: int = BLOCK, blocks: int = MOST_BLOCKS, signatures: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits, the name of its shingle set) and component_id.

    A text of fewer words than ``shingle`` is one shingle; wordless texts are one group. Nulls, repeats and empty tables
    are treated as in ``simhash_groups``. With ``exact`` texts meet on their whole prefixes and no fingerprint sorts pairs
    out, so no pair is missed by chance. ``signatures`` gives links (a, b) among the 64-bit fingerprints of a column fp.
    """
    least = Fraction(str(similarity))
    if not 0 < least <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).withColumn("mark", F.xxhash64("t"))
    late = docs.sparkSession.sparkContext.broadcast(crowded(texts, shingle, crowd, share))
    rows = stored(texts.mapInPandas(released(_rows(shingle, least, late, exact)), ROW), "rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    parts = stored(connected_components(stored(similar_links(texts, rows, least, shingle, part, square, exact, block, blocks, signatures), "links")), "parts").withColumnRenamed("node", "__node")
    joined = nodes.join(parts, F.col("node") == F.col("__node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.select("node", "root").join(least, "root").select("node", "component_id")
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", hexed, "component_id")
