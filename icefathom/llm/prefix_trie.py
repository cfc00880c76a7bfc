"""Prefix trie of conversations: which share their first turns, and what that saves.

Turns become dictionary ids, so that a conversation is a sequence of numbers. Equal
sequences are counted once. The distinct ones are dealt out by range, and each range
shard builds a ternary search tree of its own, balanced by inserting medians first. One
pass backwards over the tree's nodes (children are always made after their parents)
sums up members, leaves and savings. Only the nodes on the way to a shard's first and
last sequence can lie in several shards; these are merged by their path's digest.

What a neighbouring shard shares is known before the trees are built, from the length
of the common prefix of its nearest sequence. So each shard counts a shared node for
itself or leaves it to the shard before, all sums are plain additions, and merging is one
aggregation over the boundary nodes.

Bounds: a shard holds about ``SHARD_TURNS`` turns, whatever the table's size. A
conversation's ids travel as one array (8 bytes a turn; texts are never gathered).
Copies of a sequence, however many, are one row in its shard; the digest of their ids
is made by one stream over them, sorted, in memory that does not depend on their number.

Defined cases: a null role or text is an empty one; turns come in order of ``turn``, null
first, equal ones by role and then by the SHA-256 of role and text. A repeated row is a
further turn. Rows without a conversation id belong to no conversation and are left
out. An empty table has no nodes, not even a root. Columns beyond those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns in a shard, about.
SHARD_TURNS = 1 << 19
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NODE = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, path binary, parent_path binary, parent_conv long"


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): each conversation's turns in order, as dictionary ids and UTF-8 bytes of text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length keeps ("a", "bc") and ("ab", "c") apart.
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")
    ).checkpoint()
    words = rows.select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("id")).checkpoint()
    told = rows.join(words, "digest").select("conv_id", F.struct("turn", "role", "digest", "id", "size").alias("t"))
    ordered = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _turn_order).alias("ts"))
    return ordered.select("conv_id", F.col("ts.id").alias("ids"), F.col("ts.size").alias("sizes"))


def _turn_order(a: Column, b: Column) -> Column:
    """Turns by number, null first, then by role and digest."""

    def step(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(rest)

    same = step(a["role"], b["role"], step(a["digest"], b["digest"], F.lit(0)))
    absent = F.when(a["turn"].isNull() & b["turn"].isNull(), same).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1)
    return absent.otherwise(step(a["turn"], b["turn"], same))


def _ends(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's conversation ids, comma-joined; rows come sorted by both."""
    now, sha = None, None
    for batch in rows:
        keys, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
        done: list[tuple[bytes, str]] = []
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            told = ",".join(map(str, ids[at:end])).encode()
            if keys[at] == now:
                sha.update(b"," + told)
            else:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = keys[at], hashlib.sha256(told)
            at = end
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], ["seq", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["seq", "ends"])


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences: ids, sizes, members, least member and the digest of all of them."""
    seq = F.unhex(F.sha2(F.array_join("ids", ",").cast("binary"), 256)).alias("seq")
    members = convs.select(seq, "conv_id")
    ends = members.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_ends, "seq binary, ends string")
    counted = convs.groupBy("ids", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    return counted.withColumn("seq", seq).join(ends, "seq").drop("seq")


class Tree:
    """A ternary search tree over sequences of ids, as columns of node numbers.

    Node 0 is the textless root. ``less`` and ``more`` lead to siblings, ``below`` to the
    first child; ``up`` is the parent in the trie.
    """

    def __init__(self) -> None:
        self.split, self.less, self.more, self.below, self.up, self.depth = [-1], [0], [0], [0], [0], [0]
        self.size, self.members, self.least, self.ends, self.children = [0], [0], [None], [None], [0]

    def step(self, parent: int, turn: int, size: int) -> int:
        """The child of ``parent`` for ``turn``, made if absent."""
        at, link, holder = self.below[parent], self.below, parent
        while at:
            if turn == self.split[at]:
                return at
            link, holder = (self.less, at) if turn < self.split[at] else (self.more, at)
            at = link[holder]
        new = len(self.split)
        link[holder] = new
        self.split.append(turn)
        self.up.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.size.append(size)
        for column, value in ((self.less, 0), (self.more, 0), (self.below, 0), (self.members, 0), (self.least, None), (self.ends, None), (self.children, 0)):
            column.append(value)
        self.children[parent] += 1
        return new

    def insert(self, turns: list[int], sizes: list[int], n: int, least: int, ends: str) -> list[int]:
        """Adds one sequence; the nodes on its way, root first."""
        way = [0]
        for turn, size in zip(turns, sizes):
            way.append(self.step(way[-1], turn, size))
        self.members[way[-1]], self.least[way[-1]], self.ends[way[-1]] = n, least, ends
        return way


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every stretch before its halves."""
    spans = [(0, n)]
    for low, high in spans:
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans.append((low, middle))
            spans.append((middle + 1, high))


def _path_digests(turns: list[int]) -> list[bytes]:
    """Digest of every prefix, the empty one first."""
    told = [b""]
    for turn in turns:
        told.append(hashlib.sha256(told[-1] + turn.to_bytes(8, "big", signed=True)).digest())
    return told


def shard_nodes(shard: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one shard; those on its first or last way carry their path's digest."""
    shard = shard.sort_values("ids", key=lambda c: c.map(tuple), ignore_index=True)
    ids, sizes = [list(map(int, x)) for x in shard["ids"]], [list(map(int, x)) for x in shard["sizes"]]
    tree, ways = Tree(), {}
    for i in medians(len(ids)):
        way = tree.insert(ids[i], sizes[i], int(shard["n"][i]), int(shard["conv_id"][i]), shard["ends"][i])
        if i in (0, len(ids) - 1):
            ways[i] = way
    n_nodes = len(tree.split)
    # The shard before has the nodes of the first way up to this depth (-1: none of them).
    shared = int(shard["before"][0])
    ours = bytearray(b"\x01") * n_nodes
    for at in ways[0][: shared + 1]:
        ours[at] = 0
    path = {}
    for i, way in ways.items():
        path.update(zip(way, _path_digests(ids[i])))
    last = ways[len(ids) - 1][-1]
    goes_on = tree.children[last] == 0 and int(shard["after"][0]) == tree.depth[last]
    members, least, children = tree.members, tree.least, [0] * n_nodes
    leaves, saved = [0] * n_nodes, [0] * n_nodes
    for at in range(n_nodes - 1, -1, -1):
        if not tree.children[at] and not (at == last and goes_on):
            leaves[at] += 1
        saved[at] += (members[at] - ours[at]) * tree.size[at]
        if at:
            up = tree.up[at]
            members[up] += members[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
            children[up] += ours[at]
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    inner_up = [None if at == 0 or up in path else least[up] for at, up in enumerate(tree.up)]
    return pd.DataFrame(
        {
            "depth": tree.depth, "conv_id": least, "n_convs": members, "n_children": children, "n_leaves": leaves, "saved": saved,
            "ends": tree.ends, "path": [path.get(at) for at in range(n_nodes)],
            "parent_path": [None if at == 0 else path.get(up) for at, up in enumerate(tree.up)],
            "parent_conv": pd.array(inner_up, "Int64"),
        }
    )


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie over (conv_id, ids, sizes), one row each (``NODE_COLUMNS``)."""
    known = sequences(convs).checkpoint()
    turns = known.agg(F.sum(F.size("ids") + 1).alias("n")).first()["n"]
    shards = max(1, -(-int(turns or 0) // shard_turns))
    dealt = known.repartitionByRange(shards, "ids").withColumn("shard", F.spark_partition_id()).checkpoint()
    # One row for each shard, so the number of shards bounds this window.
    rims = dealt.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
    near = rims.selectExpr("shard", "low", "high", "lag(high) over (order by shard) as last", "lead(low) over (order by shard) as next")

    def common(a: str, b: str) -> Column:
        # zip_with fills the shorter one up with nulls, which are no id.
        equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        at = F.array_position(equal, False)
        return F.when(at > 0, at - 1).otherwise(F.size(equal)).cast("long")

    lcp = near.select("shard", F.coalesce(common("low", "last"), F.lit(-1)).alias("before"), F.coalesce(common("high", "next"), F.lit(-1)).alias("after"))
    nodes = dealt.join(lcp, "shard").groupBy("shard").applyInPandas(shard_nodes, _NODE).checkpoint()
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    rim = nodes.filter("path is not null").groupBy("depth", "path").agg(
        F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.first("parent_path").alias("parent_path")
    ).withColumn("parent_conv", F.lit(None).cast("long")).checkpoint()
    told = nodes.filter("path is null").select(*rim.columns).unionByName(rim)
    above = rim.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("rim_conv"))
    # Only children of boundary nodes look their parent up; the others have it from their shard.
    found = told.filter("parent_path is not null").join(above, "parent_path").withColumn("parent_conv", F.col("rim_conv"))
    whole = told.filter("parent_path is null").unionByName(found.select(*told.columns))
    return whole.select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin with the first turns of the first of their group.

    Of conversation c, the first h = crc32(c) % ``most`` turns come from c - c % ``group``
    (none if that is absent); its own turns after its first h follow.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = convs.withColumn("h", h.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    heads = convs.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most - 1).alias("head_ids"), F.slice("sizes", 1, most - 1).alias("head_sizes")
    )
    none = F.array().cast("array<bigint>")

    def joined(column: str, head: str) -> Column:
        start = F.slice(F.coalesce(F.col(head), none), F.lit(1), F.col("h"))
        rest = F.slice(column, F.col("h") + 1, F.greatest(F.size(column), F.lit(1)))
        return F.concat(start, rest)

    return own.join(heads, "base", "left").select("conv_id", joined("ids", "head_ids").alias("ids"), joined("sizes", "head_sizes").alias("sizes"))
