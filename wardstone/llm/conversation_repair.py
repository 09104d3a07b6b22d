"""Repair of a conversation's structure at the least cost, by lazy weighted determinisation.

Role initials of a repaired conversation are ``(s?(ua)+)?``. What is left to pay from each state of that pattern to the
end of the conversation is a vector; less its least entry, a vector is a state of a deterministic automaton over the rows
read from the last to the first. States and arcs are made when a row first needs them and then looked up. The scan gives
costs, and going back over it, along arcs that are as cheap as the vectors say, the edits in order, the least letter first.

Rows are sorted by ranges, so a large conversation lies in several tasks. A task repairs what lies in it whole. For its
first and last conversation it gives the costs between all states instead; these, a row for each task, are put together,
and each part is traced from its entry by what is left to pay after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, stored
from .conversation_trie import EMPTY_SHA256, turn_keys
from .ordered import by_ranges, ordered_sha256

#: What edits cost: rerole, delete, insert, and a truncated row that stays.
COSTS = (1, 2, 5, 5)
#: States: nothing yet, after the system's turn, after the user's, after the assistant's; where an initial leads from each.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_FAR = 1 << 50
#: Classes of initials, and faults: none, truncated, and those that must go. A row's symbol is 3 * class + fault.
INITIALS = "sua"
FINE, CUT, GONE = range(3)
_ROLES = {"u": "user", "a": "assistant"}
_MUST_GO = 3 * len(INITIALS) + GONE  # a row that goes, whatever its role


class Repairs:
    """The determinised automaton: vectors by number, and arcs and choices in tables that fill as rows need them."""

    def __init__(self, costs: tuple[int, int, int, int] = COSTS):
        self.rerole, self.delete, self.insert, self.cut = costs
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.arcs: dict[tuple[int, int], tuple[int, int]] = {}
        self.choices: dict[tuple[int, int, int], tuple[str, str, str, int]] = {}
        self.units = [self.number(tuple(0 if q == end else _FAR for q in STATES))[0] for end in STATES]
        self.end = self.number(self.closed([0, _FAR, _FAR, 0]))[0]

    def number(self, vector) -> tuple[int, int]:
        """(number of the vector less its least entry, that entry)."""
        low = min(vector)
        key = tuple(x - low if x < _FAR else _FAR for x in vector)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], low

    def closed(self, vector: list[int]) -> tuple[int, ...]:
        for _ in STATES:
            vector = [min([own, *(self.insert + vector[q] for x, q in to.items() if x != "s")]) for own, to in zip(vector, _NEXT)]
        return tuple(min(x, _FAR) for x in vector)

    def _edits(self, after: tuple[int, ...], symbol: int, q: int) -> list[tuple[str, int, int, str]]:
        """(letter, cost to the end, next state, new role) of the edits of a row in state ``q``."""
        initial, fault = (INITIALS + " ")[symbol // 3], symbol % 3
        out = [("D", self.delete + after[q], q, "")]
        if fault != GONE:
            stays = self.cut if fault == CUT else 0
            if initial in _NEXT[q]:
                out.append(("K", stays + after[_NEXT[q][initial]], _NEXT[q][initial], ""))
            out += [("R", self.rerole + stays + after[to], to, _ROLES[x]) for x, to in _NEXT[q].items() if x != "s"]
        return out

    def before(self, state: int, symbol: int) -> tuple[int, int]:
        """(state before the row, cost to add) for the state after it."""
        found = self.arcs.get((state, symbol))
        if found is None:
            after = self.vectors[state]
            found = self.arcs[state, symbol] = self.number(self.closed([min(e[1] for e in self._edits(after, symbol, q)) for q in STATES]))
        return found

    def choice(self, state: int, symbol: int, q: int) -> tuple[str, str, str, int]:
        """(roles inserted, as initials, letter, new role or "", next state): the least letters that cost no more than need be."""
        found = self.choices.get((state, symbol, q))
        if found is None:
            after, inserted, at = self.vectors[state], "", q
            least = self.closed([min(e[1] for e in self._edits(after, symbol, p)) for p in STATES])
            while True:
                tight = [e for e in self._edits(after, symbol, at) if e[1] == least[at]]
                go = next((x for x, to in _NEXT[at].items() if x != "s" and self.insert + least[to] == least[at]), None)
                if go and not any(e[0] == "D" for e in tight):
                    inserted, at = inserted + go, _NEXT[at][go]
                    continue
                letter, _, to, role = min(tight)
                found = self.choices[state, symbol, q] = inserted, letter, role, to
                break
        return found

    def trailing(self, q: int) -> str:
        """Roles inserted after the last row."""
        out = ""
        while q not in (START, ASSISTANT):
            x = next(x for x in _NEXT[q] if x != "s")
            out, q = out + x, _NEXT[q][x]
        return out

    def scan(self, state: int, symbols: list[int], times: list[int]) -> tuple[list[int], int, int]:
        """(state after each row, state before the first, cost): from the last row to the first; a row's repeats follow it and go."""
        after, cost = [0] * len(symbols), 0
        for i in range(len(symbols) - 1, -1, -1):
            if times[i] > 1:
                state, more = self.before(state, _MUST_GO)
                cost += more + self.delete * (times[i] - 2)
            after[i] = state
            state, more = self.before(state, symbols[i])
            cost += more
        return after, state, cost

    def cost(self, state: int, symbols: list[int], times: list[int], q: int = START) -> int:
        _, first, cost = self.scan(state, symbols, times)
        return min(cost + self.vectors[first][q], _FAR)

    def trace(self, after: list[int], symbols: list[int], times: list[int], q: int) -> tuple[str, list, int]:
        """(letters, (row, inserted, new role) of rows that stay, last state)."""
        letters, kept = [], []
        for i, (state, symbol, n) in enumerate(zip(after, symbols, times)):
            inserted, letter, role, q = self.choice(state, symbol, q)
            letters.append("I" * len(inserted) + letter + "D" * (n - 1))
            if letter != "D":
                kept.append((i, inserted, role))
        return "".join(letters), kept, q


# --- rows -------------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, t, role, text, n) after planted faults, by crc32 of "conversation:turn" mod 20, nulls being one space."""
    space = F.lit(" ")
    shown = lambda x: F.coalesce(F.col(x).cast("string"), space)
    k = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col))) % 20
    text = F.coalesce(F.col(text_col), space)
    out = rows.select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.when(k == 4, "user").otherwise(F.coalesce(F.col(role_col), space)).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(k == 3, 2).otherwise(1).cast("long").alias("n"), k.alias("fault"),
    )
    return out.where("fault != 0").drop("fault")


def intact(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same columns without planted faults, nulls being one space."""
    space = F.lit(" ")
    return rows.select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text"), F.lit(1).cast("long").alias("n"),
    )


def _symbol(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    place = F.coalesce(*(F.when(initial == x, i) for i, x in enumerate(INITIALS)), F.lit(len(INITIALS)))
    return (place * 3 + fault).cast("int")


def skeletons(rows: DataFrame) -> DataFrame:
    """(c, t, r64, t64, k, n, initial, blank, cut, dup): equal rows of a turn are one; texts are left behind.

    ``dup``: the role and text were there at an earlier turn. Of the n rows the first is what it says, the others repeat it.
    """
    text, role = F.col("text"), F.col("role")
    rest = F.rtrim(text, F.lit(ASCII_SPACE))
    each = rows.select(
        "c", "t", *turn_keys(role, text), "n", _symbol(role, F.lit(0)).alias("initial"), (F.length(rest) == 0).alias("blank"),
        (~F.substring(rest, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    each = each.groupBy("c", "t", "k").agg(*(F.first(x).alias(x) for x in ("r64", "t64", "initial", "blank", "cut")), F.sum("n").alias("n"))
    each = stored(each, "turns")
    when = F.struct(F.col("t").isNotNull(), F.col("t"))
    firsts = each.groupBy(F.col("c").alias("c0"), F.col("k").alias("k0")).agg(F.min(when)["t"].alias("t0"))
    same = F.col("c").eqNullSafe(F.col("c0")) & (F.col("k") == F.col("k0")) & F.col("t").eqNullSafe(F.col("t0"))
    return each.join(firsts, same, "left").withColumn("dup", F.col("k0").isNull()).drop("c0", "k0", "t0")


_OUT = "kind string, c long, part int, t long, k binary, symbol int, n long, place long, inserted string, role string, letters string, cost long, illegal long, first int, last int, matrix array<long>"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_ARROW = pa.schema(list(zip(_NAMES, [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())])))


def _illegal(symbols: list[int], times: list[int]) -> int:
    """Adjacent initials that are not su, ua or au; a row and its repeat are never one of them."""
    classes = [x // 3 for x in symbols]
    return sum(times) - len(times) + sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(classes, classes[1:]))


def _kept(c, part: int, keys: list, kept: list) -> list[dict]:
    return [{"kind": "kept", "c": c, "part": part, "t": keys[i][0], "k": keys[i][1], "inserted": inserted, "role": role} for i, inserted, role in kept]


def _repaired(costs: tuple) -> callable:
    """Of a task's conversations in order: rows that stay and a row for each; of its first and last one the rows, and costs between states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, table = TaskContext.get().partitionId(), Repairs(costs)
        rows: list[dict] = []

        def whole(c, keys, symbols, times):
            after, first, cost = table.scan(table.end, symbols, times)
            letters, kept, q = table.trace(after, symbols, times, START)
            rows.extend(_kept(c, task, keys, kept))
            tail = table.trailing(q)
            rows.append({"kind": "whole", "c": c, "letters": letters + "I" * len(tail), "inserted": tail, "cost": cost + table.vectors[first][START], "illegal": _illegal(symbols, times)})

        def part(c, keys, symbols, times):
            matrix = [table.cost(unit, symbols, times, q) for unit in table.units for q in STATES]
            rows.append({"kind": "part", "c": c, "part": task, "illegal": _illegal(symbols, times), "first": symbols[0] // 3, "last": symbols[-1] // 3, "matrix": matrix})
            rows.extend({"kind": "row", "c": c, "part": task, "t": t, "k": k, "symbol": s, "n": n, "place": i} for i, ((t, k), s, n) in enumerate(zip(keys, symbols, times)))

        def out():
            batch = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            rows.clear()
            return batch

        now, began, open_ = None, False, True
        keys, symbols, times = [], [], []
        for batch in batches:
            for c, t, k, s, n in zip(*(x.to_pylist() for x in batch.columns)):
                if not began or c != now:
                    if began:
                        (part if open_ else whole)(now, keys, symbols, times)
                        open_ = False
                    now, began, keys, symbols, times = c, True, [], [], []
                keys.append((t, k))
                symbols.append(s)
                times.append(n)
            if len(rows) > 10_000:
                yield out()
        if began:
            part(now, keys, symbols, times)
        yield out()

    return run


def _entries(costs: tuple) -> callable:
    """What is left to pay after each part of a conversation: a vector, from the parts' costs between states, last to first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table, frame = Repairs(costs), frame.sort_values("part", ascending=False)
        vector, out = table.vectors[table.end], []
        for part, matrix in zip(frame["part"], frame["matrix"]):
            out.append((part, list(vector)))
            vector = table.closed([min(matrix[4 * end + q] + vector[end] for end in STATES) for q in STATES])
        return pd.DataFrame({"c": frame["c"].iloc[0], "part": [x[0] for x in out], "vector": [x[1] for x in out], "ends": [True] + [False] * (len(out) - 1)})

    return run


def _traced(costs: tuple) -> callable:
    """A part's edits from each state in which it may begin: rows that stay (first: that state), and a row for each state."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table, frame = Repairs(costs), frame.sort_values("place")
        c, part = (None if pd.isna(x) else int(x) for x in (frame["c"].iloc[0], frame["part"].iloc[0]))
        state, _ = table.number(tuple(int(x) for x in frame["vector"].iloc[0]))
        symbols, times = frame["symbol"].tolist(), frame["n"].tolist()
        keys = list(zip((None if pd.isna(t) else int(t) for t in frame["t"]), frame["k"]))
        after, first, _ = table.scan(state, symbols, times)
        rows = []
        for q in STATES:
            if table.vectors[first][q] < _FAR:
                letters, kept, end = table.trace(after, symbols, times, q)
                tail = table.trailing(end) if frame["ends"].iloc[0] else ""
                rows += [{**row, "first": q} for row in _kept(c, part, keys, kept)]
                rows.append({"kind": "part", "c": c, "part": part, "letters": letters + "I" * len(tail), "inserted": tail, "first": q, "last": end})
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)

    return run


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """The state in which each part begins, going through a conversation's parts from the first."""
    nexts = {(p, q): end for p, q, end in zip(frame["part"], frame["first"], frame["last"])}
    q, out = START, []
    for part in sorted(set(frame["part"])):
        out.append((part, q))
        q = nexts[part, q]
    return pd.DataFrame({"c": frame["c"].iloc[0], "part": [x[0] for x in out], "first": [x[1] for x in out]})


def repairs(rows: DataFrame, costs: tuple[int, int, int, int] = COSTS) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows that stay) of ``rows`` (c, t, role, text, n).

    Conversations: c, gaps, blank, duplicate, truncated, illegal, cost, audit, tail (roles inserted at the end). Rows that
    stay: c, t, k, role (new, or empty), inserted (initials of the roles put before it).
    """
    marked = stored(skeletons(rows), "skeletons")
    gone = F.col("blank") | F.col("dup")
    symbol = (F.when(gone, GONE).when(F.col("cut"), CUT).otherwise(FINE) + F.col("initial")).cast("int")
    order = ["c", "t", "r64", "t64", "k"]
    out = by_ranges(marked.select(*order, symbol.alias("symbol"), "n"), *order).select("c", "t", "k", "symbol", "n").mapInArrow(_repaired(costs), _OUT)
    out = stored(out, "repairs")
    # first and last conversations of tasks: at most two parts a task
    parts = out.where("kind = 'part'").select("c", "part", "illegal", "first", "last", "matrix")
    due = parts.select("c", "part", "matrix").groupBy("c").applyInPandas(_entries(costs), "c long, part int, vector array<long>, ends boolean")
    due = F.broadcast(stored(due.withColumnRenamed("c", "c1").withColumnRenamed("part", "p1"), "due"))
    here = lambda c, p: F.col("c").eqNullSafe(F.col(c)) & (F.col("part") == F.col(p))
    held = out.where("kind = 'row'").join(due, here("c1", "p1")).select("c", "part", "t", "k", "symbol", "n", "place", "vector", "ends")
    traced = stored(held.groupBy("c", "part").applyInPandas(_traced(costs), _OUT), "traced")
    ways = traced.where("kind = 'part'").select("c", "part", "first", "last", "letters", "inserted")
    taken = ways.select("c", "part", "first", "last").groupBy("c").applyInPandas(_joined, "c long, part int, first int")
    taken = F.broadcast(stored(taken.select(F.col("c").alias("c2"), F.col("part").alias("p2"), F.col("first").alias("f2")), "taken"))
    way = here("c2", "p2") & (F.col("first") == F.col("f2"))
    stays = out.where("kind = 'kept'").select("c", "t", "k", "role", "inserted").unionByName(traced.where("kind = 'kept'").join(taken, way, "left_semi").select("c", "t", "k", "role", "inserted"))
    # a conversation of several parts: letters in their order, and the initials that meet where one part ends
    listed = ways.join(taken, way, "left_semi").select("c", "part", "letters", "inserted").withColumnRenamed("c", "c1").withColumnRenamed("part", "p1")
    listed = parts.join(listed, here("c1", "p1")).select("c", F.struct("part", "letters", "inserted", "first", "last").alias("x"), "illegal")
    listed = listed.groupBy("c").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("illegal").alias("illegal"))
    legal = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0, 1), (1, 2), (2, 1))))
    meets = F.transform("x", lambda x, i: F.when(i > 0, F.array(F.element_at("x", F.when(i > 0, i).otherwise(1)).getField("last"), x["first"])))
    met = F.size(F.filter(meets, lambda m: m.isNotNull() & ~F.array_contains(legal, m)))
    letters = F.array_join(F.transform("x", lambda x: x["letters"]), "")
    split = listed.select("c", letters.alias("audit"), (F.col("illegal") + met).alias("illegal"), F.element_at("x", -1)["inserted"].alias("tail"))
    whole = out.where("kind = 'whole'").select("c", F.col("letters").alias("audit"), "illegal", F.col("inserted").alias("tail"), "cost")
    # the cost of a conversation of several parts is what its first part has left to pay, with it
    first = parts.join(due, here("c1", "p1")).select("c", "part", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda e: F.element_at("matrix", 4 * e + 1) + F.element_at("vector", e + 1)).alias("costs"))
    first = first.groupBy(F.col("c").alias("c1")).agg(F.array_min(F.min_by("costs", "part")).alias("cost"))
    split = split.join(first, F.col("c").eqNullSafe(F.col("c1"))).drop("c1")
    # what can be counted without an order
    one = lambda x: x.cast("long")
    fresh = ~gone
    turns = marked.groupBy("c", "t").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(~F.col("blank"), F.col("n") - one(~F.col("dup"))).otherwise(0)).alias("duplicate"),
        F.sum(one(fresh & F.col("cut"))).alias("truncated"),
    )
    wide = F.max("t").cast("decimal(38,0)") - F.min("t").cast("decimal(38,0)") + 1 - F.count("t")
    counts = turns.groupBy(F.col("c").alias("c1")).agg(
        F.when(wide.isNull(), 0).otherwise(F.least(wide, F.lit(2**63 - 1).cast("decimal(38,0)"))).cast("long").alias("gaps"), *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated"))
    )
    convs = whole.unionByName(split).join(counts, F.col("c").eqNullSafe(F.col("c1"))).drop("c1")
    return convs, stays


def repaired_texts(rows: DataFrame, stays: DataFrame) -> DataFrame:
    """(c, t, r64, t64, k, piece): of each row that stays, "role:text" with what is inserted before it, each on a line."""
    keyed = rows.select("c", "t", "role", "text", *turn_keys(F.col("role"), F.col("text")))
    keyed = keyed.groupBy("c", "t", "k").agg(*(F.first(x).alias(x) for x in ("r64", "t64", "role", "text")))
    new = stays.select(F.col("c").alias("c1"), F.col("t").alias("t1"), F.col("k").alias("k1"), F.col("role").alias("role1"), "inserted")
    same = F.col("c").eqNullSafe(F.col("c1")) & (F.col("k") == F.col("k1")) & F.col("t").eqNullSafe(F.col("t1"))
    role = F.when(F.col("role1") == "", F.col("role")).otherwise(F.col("role1"))
    return keyed.join(new, same).select("c", "t", "r64", "t64", "k", F.concat(_lines("inserted"), role, F.lit(":"), "text").alias("piece"))


def _lines(column: str) -> Column:
    """Initials of inserted roles as lines of empty texts."""
    each = F.filter(F.split(column, ""), lambda x: x != "")
    return F.array_join(F.transform(each, lambda x: F.when(x == "u", "user:\n").otherwise("assistant:\n")), "")


def repair_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", plant: bool = False, costs: tuple[int, int, int, int] = COSTS
) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role and text (by their first 64 characters, then by a
    digest). A null role or text is one space, so such a text is blank; rows with a null conv_id are one conversation. A
    row counts for its first fault: blank, duplicate (role and text seen earlier in the conversation), truncated. Equal
    rows of a turn are a row and its duplicates. With ``plant``, faults are planted first; a conversation that loses all
    its rows has zeros, an empty audit and the empty text's digest. gaps is at most 2^63 - 1. Other columns are not read.
    An empty table gives no row.
    """
    columns = (conv_col, turn_col, role_col, text_col)
    rows = (damaged if plant else intact)(conversations, *columns)
    convs, stays = repairs(rows, costs)
    convs, stays = stored(convs, "conversations"), stored(stays, "stays")
    pieces = repaired_texts(rows, stays).withColumn("end", F.lit(0))
    tails = convs.where("tail != ''").select("c", F.lit(None).cast("long").alias("t"), *(F.lit("").alias(x) for x in ("r64", "t64")), F.lit(b"").alias("k"), F.rtrim(_lines("tail"), F.lit("\n")).alias("piece"), F.lit(1).alias("end"))
    digests = ordered_sha256(pieces.unionByName(tails), ["c"], ["end", "t", "r64", "t64", "k"], "piece", b"\n")
    digests = digests.select(F.col("c").alias("c1"), "sha256")
    ids = conversations.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    met = ids.join(convs, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("c1")), "left")
    zero = F.lit(0).cast("long")
    return met.select(
        "conv_id", *(F.coalesce(x, zero).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )
