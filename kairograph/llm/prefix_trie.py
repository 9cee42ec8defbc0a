"""The trie of conversation beginnings, its subtrees measured on balanced parentheses.

A node is a distinct sequence of first turns.  Turns are numbered, and the hashes of
beginnings run on, in stretches of a sorted table, so a conversation of any length is
many stretches.  Nodes that lie below each other with the same members are one *link*;
every link knows the links above it, and those lists, sorted, are the order in which
parentheses open.  Range partitions of that order are the shards.  A shard opens the
links above its first one again (its spine), writes its own as parentheses, finds where
each closes by the least excess of blocks, counts leaves as pairs ``()`` by rank and
savings by a cumulative array; links on spines have a part in several shards, and parts
are added.

Defined results: rows without ``conv_id`` take no part; null role and text are empty;
rows without turn come first and rows of equal turn are ordered by the md5 of length of
role, role and text; repeated rows are turns; an empty table has no nodes, not even a
root; other columns are not read.  Beginnings are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import Batches, join_same, materialize

#: Parentheses in a block with a least excess of its own.
BLOCK = 256
#: Members in one piece of a node's list of ends.
PIECE = 65_536


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, at, content, chars``: turns in order; ``at`` counts on within a part."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = F.unhex(F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))))
    small = conversations.filter("conv_id is not null").select("conv_id", "turn", content.alias("content"), F.length(text("text")).cast("long").alias("chars"))
    order = ["conv_id", "turn", "content"]
    at = F.monotonically_increasing_id()
    rows = small.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "content", "chars", at.alias("at"))
    return materialize(rows.select("conv_id", F.shiftright("at", 33).cast("int").alias("part"), "at", "content", "chars"), "turns")


def _before(column: Column, how) -> Column:
    """A running total of what earlier parts of a conversation have."""
    return how(column).over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def rebuilt(conversations: DataFrame, block: int = 100, longest: int = 6) -> DataFrame:
    """``conv_id, part, depth, content, chars, last``: turns after the first ones are those of the block's first conversation.

    A row of depth 0 stands for the conversation itself.
    """
    turns = _turns(conversations)
    parts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = materialize(parts.select("conv_id", "part", "first", "n", F.coalesce(_before(F.col("n"), F.sum), F.lit(0)).alias("above")), "parts")
    index = (F.col("above") + F.col("at") - F.col("first") + 1).alias("i")
    heads = parts.filter((F.col("conv_id") % block == 0) & (F.col("above") < longest - 1))
    heads = turns.filter(F.col("conv_id") % block == 0).join(heads, ["conv_id", "part"]).select("conv_id", index, "content", "chars").filter(F.col("i") < longest)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "content", "chars"))).alias("head"))
    size = parts.groupBy("conv_id").agg(F.sum("n").alias("size"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    plan = size.select("conv_id", "size", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<i: bigint, content: binary, chars: bigint>>)")), 1, F.col("h"))
    plan = plan.select("conv_id", "h", head.alias("head"))
    plan = materialize(plan.join(size, "conv_id").select("conv_id", "h", "head", (F.size("head") + F.greatest(F.lit(0), F.col("size") - F.col("h"))).alias("length")), "plans")
    own = parts.join(plan.select("conv_id", "h", F.size("head").alias("n_head"), "length"), "conv_id")
    own = turns.join(own.drop("n"), ["conv_id", "part"]).select("*", index).filter(F.col("i") > F.col("h"))
    own = own.select("conv_id", "part", (F.col("n_head") + F.col("i") - F.col("h")).alias("depth"), "content", "chars", "length")
    lent = plan.select("conv_id", F.explode("head").alias("x"), "length").select("conv_id", F.lit(-1).alias("part"), F.col("x.i").alias("depth"), "x.content", "x.chars", "length")
    roots = plan.select("conv_id", F.lit(-2).alias("part"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("chars"), "length")
    rows = own.unionByName(lent).unionByName(roots)
    return rows.select("conv_id", "part", "depth", "content", "chars", (F.col("depth") == F.col("length")).alias("last"))


PLACE = ["depth", "p1", "p2"]


def _prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, q1, q2, chars, upto, last``: hashes of each beginning and of the one before, code points so far."""
    lane = lambda k: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "content"))
    rows = rows.select("conv_id", "part", "depth", "chars", "last", lane(1).alias("a"), lane(2).alias("b"))
    run = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", F.bit_xor("a").over(run).alias("la"), F.bit_xor("b").over(run).alias("lb"), F.sum("chars").over(run).alias("lc"))
    whole = rows.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("chars").alias("c"))
    zero = F.lit(0).cast("long")
    whole = whole.select("conv_id", "part", *(F.coalesce(_before(F.col(x), how), zero).alias(f"o{x}") for x, how in (("a", F.bit_xor), ("b", F.bit_xor), ("c", F.sum))))
    out = local.join(whole, ["conv_id", "part"])
    out = out.select("conv_id", "depth", "chars", "last", "a", "b", F.col("la").bitwiseXOR(F.col("oa")).alias("p1"), F.col("lb").bitwiseXOR(F.col("ob")).alias("p2"), (F.col("lc") + F.col("oc")).alias("upto"))
    return out.select("conv_id", *PLACE, F.col("p1").bitwiseXOR(F.col("a")).alias("q1"), F.col("p2").bitwiseXOR(F.col("b")).alias("q2"), "chars", "upto", "last")


class Parentheses:
    """Balanced parentheses of a shard, of which the last ones may stay open."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits, dtype=np.int64)
        n = -(-len(bits) // BLOCK)
        size = 1 << max(0, n - 1).bit_length()
        least = np.full(size * BLOCK, np.iinfo(np.int64).max)
        least[: len(bits)] = self.excess
        self.least = [least.reshape(size, BLOCK).min(1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(1))
        self.opens = np.flatnonzero(bits == 1)
        self.leaves = np.concatenate([[0], np.cumsum((bits[:-1] == 1) & (bits[1:] == -1)), [0]])
        self.leaves[-1] = self.leaves[-2]
        self.opened = np.concatenate([[0], np.cumsum(bits == 1)])

    def close(self, i: int) -> int:
        """The place that closes the parenthesis opened at ``i``; the end if none does."""
        goal = self.excess[i] - 1
        block = i // BLOCK
        found = np.flatnonzero(self.excess[i + 1 : (block + 1) * BLOCK] <= goal)
        if len(found):
            return i + 1 + int(found[0])
        level, block = 0, block + 1
        while level < len(self.least) and block < len(self.least[level]):
            if self.least[level][block] <= goal:
                while level:
                    level, block = level - 1, 2 * block
                    if self.least[level][block] > goal:
                        block += 1
                begin = block * BLOCK
                return begin + int(np.flatnonzero(self.excess[begin : begin + BLOCK] <= goal)[0])
            if block % 2:
                level, block = level + 1, block // 2 + 1
            else:
                block += 1
        return len(self.bits)

    def subtrees(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves and weights below each node, itself included, in the order of opening."""
        total = np.concatenate([[0], np.cumsum(weights)])
        ends = self.opens + 1
        for k in np.flatnonzero(np.append(self.bits, 1)[ends] == 1):
            ends[k] = self.close(int(self.opens[k]))
        return self.leaves[ends] - self.leaves[self.opens], total[self.opened[ends]] - total[: len(weights)]


def _shard(batches: Batches) -> Batches:
    """Parts of leaves and savings of the links of a shard and of its spine."""
    names: list[tuple[int, int]] = []
    weights: list[int] = []
    bits: list[int] = []
    depth, leaf = 0, False
    for batch in batches:
        for path, saved, is_leaf in zip(*(batch.column(c).to_pylist() for c in ("path", "saved", "leaf")), strict=True):
            if not names:
                for x in path[:-1]:
                    names.append((x["conv_id"], x["n_convs"]))
                    weights.append(0)
                    bits.append(1)
                depth = len(path) - 1
            bits.extend([-1] * (depth - len(path) + 1))
            bits.append(1)
            depth, leaf = len(path), is_leaf
            names.append((path[-1]["conv_id"], path[-1]["n_convs"]))
            weights.append(saved)
    if names:
        leaves, saved = Parentheses(np.array(bits + [-1] * leaf, np.int8)).subtrees(np.array(weights, np.int64))
        for k in range(0, len(names), 10_000):
            part = slice(k, k + 10_000)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*names[part], strict=True)), pa.array(leaves[part], pa.int64()), pa.array(saved[part], pa.int64())], ["conv_id", "n_convs", "leaves", "saved"])


def _ends(rows: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` of nodes at which conversations end; lists come in pieces of neighbouring ids."""
    some = rows.filter("last").groupBy(*PLACE, F.floor(F.col("conv_id") / PIECE).alias("piece"))
    pieces = some.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Batches) -> Batches:
        now, sha = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *place, ids in zip(*(batch.column(c).to_pylist() for c in (*PLACE, "ids")), strict=True):
                if place == now:
                    sha.update(b",")
                else:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = place, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield made(out)
        if now:
            yield made([(*now, sha.hexdigest())])

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*PLACE, "ends_sha256"])

    return pieces.repartition(*PLACE).sortWithinPartitions(*PLACE, "piece").mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    ``rows`` is what `rebuilt` gives, or has its columns: turns by ``part`` and
    ``depth``, and one row of depth 0 and of the least part for each conversation.
    """
    rows = materialize(_prefixes(rows), "beginnings")
    nodes = rows.groupBy(*PLACE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("q1", "q2", "chars", "upto")))
    nodes = materialize(nodes, "nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    tree = nodes.join(above, ["depth", "q1", "q2"], "left").join(below, PLACE, "left").na.fill(0, ["n_children"])
    tree = tree.withColumn("top", (F.col("depth") == 0) | (F.col("parent_conv_id") != F.col("conv_id")) | (F.col("parent_convs") != F.col("n_convs")))
    tree = materialize(tree.select("conv_id", *PLACE, "parent_conv_id", "n_convs", "n_children", "chars", "upto", "top"), "tree")

    before = F.col("upto") - F.col("chars")
    links = tree.groupBy("conv_id", "n_convs").agg(F.min(before).alias("over"), ((F.col("n_convs") - 1) * (F.max("upto") - F.min(before))).alias("saved"), (F.min("n_children") == 0).alias("leaf"))
    tops = tree.filter("top and depth > 0").select(*PLACE, F.col("conv_id").alias("of"), "n_convs")
    met = rows.filter("depth > 0").select("conv_id", *PLACE).join(tops, PLACE).select("conv_id", F.struct("depth", F.col("of").alias("conv_id"), "n_convs").alias("link"))
    paths = met.groupBy("conv_id").agg(F.sort_array(F.collect_list("link")).alias("links"))
    paths = paths.select("conv_id", "links", F.posexplode("links").alias("k", "link")).filter("link.conv_id = conv_id")
    step = lambda x: F.struct(x["conv_id"].alias("conv_id"), x["n_convs"].alias("n_convs"))
    root = tree.filter("depth = 0").select("conv_id", "n_convs", F.array(F.struct("conv_id", "n_convs")).alias("path"))
    first = root.first()
    if first is None:
        zero = F.lit(0).cast("long")
        return tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit("").alias("ends_sha256"))
    origin = F.array(F.struct(*(F.lit(first[c]).cast("long").alias(c) for c in ("conv_id", "n_convs"))))
    paths = paths.select("link.conv_id", "link.n_convs", F.concat(origin, F.transform(F.slice("links", 1, F.col("k") + 1), step)).alias("path")).unionByName(root)
    opened = materialize(paths.join(links, ["conv_id", "n_convs"]).select("path", "saved", "leaf"), "paths")
    shards = opened.repartitionByRange("path").sortWithinPartitions("path")
    under = shards.mapInArrow(_shard, "conv_id long, n_convs long, leaves long, saved long").groupBy("conv_id", "n_convs").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("below"))

    facts = under.join(links.select("conv_id", "n_convs", "over"), ["conv_id", "n_convs"])
    out = join_same(tree, facts, "conv_id", "n_convs").join(_ends(rows), PLACE, "left")
    saved = F.col("below") - (F.col("n_convs") - 1) * (before - F.col("over"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
