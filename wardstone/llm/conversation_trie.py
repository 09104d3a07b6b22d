"""The prefix trie of conversations, by prefix doubling.

Turns get dense names by their content, then blocks of 2, 4, 8, ... turns by the names of their two halves, a join round
for each doubling. A prefix of d turns is the blocks of d's binary digits, so equal prefixes have equal lists of names, and
a group by (depth, list) is a node. A node is known by its smallest member, so each conversation owns the nodes of a tail
of its own path; sums over subtrees are sums over members of what is left of their tails, with no walk over the tree.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordered import dense_names, ordered_sha256, running

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_keys(role: Column, text: Column) -> list[Column]:
    """The order of rows of one turn: role, then text, by their first 64 characters, then by a digest of both; ``k`` is the digest."""
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return [F.substring(role, 1, 64).alias("r64"), F.substring(text, 1, 64).alias("t64"), F.unhex(F.sha2(both, 256)).alias("k")]


def numbered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, p, k, n_bytes): each turn's place in its conversation from 0, its content's digest, its text's UTF-8 bytes."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role_col, text_col))
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), *turn_keys(role, text), F.octet_length(text).cast("long").alias("n_bytes"),
        F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("row"),
    )
    placed = running(turns, "c", ["t", "r64", "t64", "k", "row"], p="one")
    return placed.select("c", (F.col("p") - 1).alias("p"), "k", "n_bytes")


def branched(turns: DataFrame, group: int = 5, shared: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, p, k, n_bytes, n) and conversations (c, n): n is how many turns ``c`` has after that.

    The first h = crc32(c) mod ``shared`` turns come from conversation c - c mod ``group``, the others are c's own.
    """
    h = F.crc32(F.col("c").cast("string")) % shared
    own = stored(turns.groupBy("c").agg(F.count("*").alias("own")), "lengths")
    base = own.select(F.col("c").alias("b"), F.col("own").alias("base"))
    convs = own.select("c", "own", h.alias("h"), (F.col("c") - F.col("c") % group).alias("b")).join(base, "b", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("base", F.lit(0)))).withColumn("n", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("c", "b", "h", "m", "n"), "convs")
    heads = turns.where(F.col("p") < shared).select(F.col("c").alias("b"), "p", "k", "n_bytes")  # ``shared`` rows for each of ``group`` conversations at most
    first = heads.join(convs, "b").where("p < h").select("c", "p", "k", "n_bytes", "n")
    rest = turns.where(F.col("p") >= h).join(convs, "c").select("c", (F.col("m") + F.col("p") - F.col("h")).alias("p"), "k", "n_bytes", "n")
    return first.unionByName(rest), convs.select("c", "n")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, d, path, n_bytes, n): each conversation's prefix of d turns, 0 included; equal prefixes have equal paths.

    ``path`` has the dense names of the prefix's blocks, the smallest first; n_bytes is of the last turn. Written.
    """
    turns = stored(turns, "turns")
    longest = convs.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    names = dense_names(turns, ["k"])
    blocks = stored(turns.join(names, "k").select("c", F.col("p").alias("j"), "name", "n"), "blocks")
    last = turns.select("c", (F.col("p") + 1).alias("d"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("name"), "n_bytes", "n")
    parts, level = [last], 0
    while True:
        size = 1 << level
        first = (F.col("j") + 1) * size
        used = blocks.where("j % 2 = 0").select("c", F.explode(F.sequence(first, F.least(first + (size - 1), "n"))).alias("d"), F.lit(level).alias("level"), "name", F.lit(None).cast("long").alias("n_bytes"), "n")
        parts.append(used)
        level += 1
        if longest < 1 << level:
            break
        half = lambda side: F.max(F.when(F.col("j") % 2 == side, F.col("name")))
        pairs = blocks.groupBy("c", F.expr("j div 2").alias("j")).agg(half(0).alias("a"), half(1).alias("b"), F.max("n").alias("n"))
        pairs = stored(pairs.where("a is not null and b is not null"), "pairs")
        blocks = stored(pairs.join(dense_names(pairs, ["a", "b"]), ["a", "b"]).select("c", "j", "name", "n"), "blocks")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    block = F.when(F.col("level").isNotNull(), F.struct("level", "name"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["name"].cast("string")), ".")
    rows = rows.groupBy("c", "d").agg(path.alias("path"), F.max("n_bytes").alias("n_bytes"), F.max("n").alias("n"))
    root = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit("").alias("path"), F.lit(0).cast("long").alias("n_bytes"), "n")
    return stored(rows.unionByName(root), "prefixes")


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (c, p, k, n_bytes, n), ``convs`` (c, n) being its members."""
    rows = prefixes(turns, convs)
    found = stored(rows.groupBy("d", "path").agg(F.min("c").alias("c"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes")), "nodes")
    # a conversation's highest own node hangs below another one's
    tops = found.groupBy("c").agg(F.min("d").alias("top"))
    above = rows.select("c", "d", "path").join(tops.where("top > 0").select("c", (F.col("top") - 1).alias("d")), ["c", "d"])
    above = stored(above.select(F.col("c").alias("child"), "d", "path"), "above").join(found.select("d", "path", F.col("c").alias("up")), ["d", "path"])
    above = above.select(F.col("child").alias("c"), (F.col("d") + 1).alias("d"), "up")
    nodes = found.drop("path").join(above, ["c", "d"], "left").withColumn("parent", F.when(F.col("d") > 0, F.coalesce("up", "c"))).drop("up")
    nodes = stored(nodes, "parents")
    kids = nodes.where("d > 0").groupBy(F.col("parent").alias("c"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["c", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes, "children")
    # what is left of each conversation's own tail, for all of its prefixes
    zero = F.lit(0).cast("long")
    own = nodes.select("c", "d", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    tails = rows.select("c", "d", "path").join(own, ["c", "d"], "left").select("c", "d", "path", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saved", zero).alias("saved"), (-F.col("d")).alias("up"))
    tails = running(tails, "c", ["up"], leaves="leaf", saves="saved")
    sums = tails.groupBy("d", "path").agg(F.min("c").alias("c"), F.sum("leaves").alias("n_leaves"), F.sum("saves").alias("saved_tokens")).drop("path")
    ends = rows.where("d = n").select(F.col("c").alias("member"), "d", "path").join(found.select("d", "path", "c"), ["d", "path"])
    ends = ends.select("c", "d", "member", F.col("member").cast("string").alias("decimal"))
    ends = ordered_sha256(ends, ["c", "d"], ["member"], "decimal", b",").withColumnRenamed("sha256", "ends")
    return nodes.join(sums, ["c", "d"]).join(ends, ["c", "d"], "left").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 5, shared: int = 9) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, nulls first; rows of one turn by role and text (by their first 64 characters, then by a
    digest), and equal rows are turns each. A null role or text is empty; rows without a conv_id belong to no conversation.
    A long text is one turn like any other and only its digest and size travel. Other columns are not read. An empty table
    has no conversations and no node. ``shared`` of 1 leaves conversations as they are.
    """
    return trie_nodes(*branched(numbered_turns(rows, conv_col, turn_col, role_col, text_col), group, shared))
