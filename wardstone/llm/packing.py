"""Best-fit packing of documents into token sequences, planned on the histogram of piece lengths.

Tokenising gives each piece a length and a rank among the pieces of that length in its task. Counts by length and task
give each task its first rank, so a piece's rank within its length needs no sort and no hot length meets in one task.
The plan is best-fit decreasing over at most ``capacity`` counts: it deals with all pieces of a length, and all open
sequences with the same room, at once. Pieces then find their slots by a join on length and rank.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored, text_of

CAPACITY = 2048
#: Word chunks whose ids a task remembers.
REMEMBERED = 100_000
#: Plan rows that are broadcast (under 100 bytes each); a plan has a few rows for each length that occurs.
PLAN_ROWS = 100_000


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ranks file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of a text as little-endian 32-bit words, by chunks that start at a space.

    The vocabulary's pattern always ends a token before a space that follows a character which is no white space, so
    such chunks can be encoded alone, and those seen before are remembered. Texts with a space after white space are
    encoded whole. The vocabulary's end mark is one id wherever it stands in a text, as its tokenizer file has it.

    Long runs of white space, on which tiktoken's pattern overflows its stack, are encoded without it: the pattern makes
    one piece of such a run, up to its last character if more text follows.
    """

    _GAP = re.compile(r"\s ")
    LONG_RUN = 10_000
    #: White space as the vocabulary's pattern has it, which is not all that Python's does.
    _RUN = re.compile("(?<![{0}])[{0}]{{{1},}}+".format(r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", LONG_RUN))
    MARK, MARK_ID = "<|endoftext|>", 50256

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.encoding, self.known, self.remembered = encoding(path), {}, remembered

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _encode(self, chunk: str) -> bytes:
        return self._bytes(self.encoding.encode_ordinary(chunk))

    def __call__(self, text: str) -> bytes:
        if self.MARK in text:
            return self.MARK_ID.to_bytes(4, "little").join(self(part) if part else b"" for part in text.split(self.MARK))
        if len(text) < self.LONG_RUN:
            return self._plain(text)
        out, at = [], 0
        for run in self._RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self._plain(text[at : run.start()]), self._bytes(self.encoding._encode_single_piece(text[run.start() : end]))
            at = end
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if self._GAP.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        known, out = self.known, [self._encode(first)]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                if len(known) >= self.remembered:
                    known.clear()
                ids = self._encode(" " + word)
                if len(word) < 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than ``capacity``."""
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document, with its rank among the pieces of its length in this task."""

    def tokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, ranks, part = Encoder(path), defaultdict(int), TaskContext.get().partitionId()
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["id"], frame["t"]):
                ids = encode(text) + b"\0\0\0\0"
                for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((doc_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, ranks[length]))
                    ranks[length] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).mapInPandas(released(tokenise), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first_rank, ranks, each, first_sequence, offset).

    Ranks first_rank to first_rank + ranks - 1 of a length go, ``each`` to a sequence, into the sequences from
    first_sequence on, from ``offset`` in each. An open group of sequences is (first sequence, how many) by room left.
    """
    rows, sequences = [], 0
    open_by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []  # rooms with open sequences, ascending

    def put_back(room: int, group: tuple[int, int]) -> None:
        if room:
            if not open_by_room[room]:
                at = bisect_left(rooms, room)
                if at == len(rooms) or rooms[at] != room:
                    rooms.insert(at, room)
            open_by_room[room].append(group)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms.pop(at)
            else:
                room = capacity
                first, many = sequences, -(-left // (capacity // length))
                sequences += many
            each = room // length
            full = min(many, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                put_back(room - each * length, (first, full))
            if full < many:
                rest = many - full
                if left:  # fewer than ``each``: into one sequence
                    rows.append((length, rank, left, left, first + full, capacity - room))
                    put_back(room - left * length, (first + full, 1))
                    full, rest, rank, left = full + 1, rest - 1, rank + left, 0
                if rest:
                    put_back(room, (first + full, rest))
    return rows


def best_fit_packing(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path``: a ranks file of byte-level BPE. A document is its ids and an end id 0; a null or empty text is the end
    alone. Longer documents than ``capacity`` are cut, all pieces but the first full. Rows that share an id, or have a
    null one, are packed each. An empty table gives an empty result. Columns other than the two are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = stored(pieces(docs, path, capacity, id_col, text_col), "pieces")
    counts = cut.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"), "count"), "ranks")
    by_length = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # ``capacity`` rows at most
    rows = plan(by_length, capacity)
    slots = docs.sparkSession.createDataFrame(
        [(n, [x[1:] for x in rows if x[0] == n]) for n in by_length],
        "length long, slots array<struct<first_rank: long, ranks: long, each: long, first_sequence: long, at: long>>",
    )
    # a row for each length and task, which grows with the tasks: no broadcast; both sides are written tables, so Spark can split a hot length
    ranked = cut.join(bases.select("length", "part", "base").hint("merge"), ["length", "part"]).withColumn("place", F.col("base") + F.col("rank"))
    # at most ``capacity`` rows, and at most PLAN_ROWS slots in them, or else a join that Spark plans by size
    placed = ranked.join(F.broadcast(slots) if len(rows) <= PLAN_ROWS else slots, "length")
    mine = lambda s: (s["first_rank"] <= F.col("place")) & (F.col("place") < s["first_rank"] + s["ranks"])
    placed = placed.withColumn("slot", F.get(F.filter("slots", mine), 0)).withColumn("turn", F.col("place") - F.col("slot.first_rank"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_sequence") + F.floor(F.col("turn") / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.at") + F.col("turn") % F.col("slot.each") * F.col("length")).alias("offset"),
    )
