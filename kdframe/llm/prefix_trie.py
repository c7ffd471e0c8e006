"""Trie of the turns that conversations begin with, and what sharing them saves.

A turn is a 128-bit hash of role and text; a node is a depth and the running XOR of its turns' hashes
with their depths, so that a conversation of any length is hashed block by block. Nodes, members and
children are plain aggregates. What a node sums over its subtree comes from balanced parentheses:
chains of nodes without branch or end are one edge, distinct conversations are paths of such edges,
and paths in the order of the trie are dealt to shards by range. A shard encodes its paths as a
sequence of parentheses with blocks of least excess in a tree (range min-max): ``findclose`` delimits a
subtree, a rank of leaf pairs counts its leaves, and cumulative arrays give its savings. Nodes on the
spines that shards share occur in several of them, and their parts are added up: a node's own saving
counts only on the path of its smallest member, a leaf has one path only.

A path with k edges needs k conversations that end or branch at different depths, so that paths stay
short (below the root of twice the number of turns) however long conversations are.

Ids are longs. Defined cases: turns without id are left out; turns are ordered by number, null first,
then role and text; null roles and texts are empty; turns that repeat count each time; an empty table
has no nodes; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kdframe.operators.ranking import prefix_sum
from kdframe.session import materialize

BLOCK_BITS = 12  # turns, and ids, are handled in blocks of 4,096
GROUP_OF, BORROWED = 100, 6
SHARD_NODES = 1 << 20
EXCESS_BLOCK = 512

KEY = ["depth", "pa", "pb"]
EMPTY = hashlib.sha256().hexdigest()


def ranked_turns(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, depth, a, b, size): the turns of each conversation, numbered from 1, as hash and code points of the text."""
    empty = F.lit("")
    turns = conversations.select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text"),
    ).where("conv is not null")
    block = F.coalesce(F.shiftright(F.col("turn").cast("long"), BLOCK_BITS), F.lit(-(1 << 63)))
    ranked = prefix_sum(turns, ["turn", "role", "text"], [block], by=["conv"])
    return ranked.select(
        "conv",
        (F.col("rank") + 1).alias("depth"),
        F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.length("text").cast("long").alias("size"),
    )


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, length) of all conversations."""
    return turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))


def with_borrowed_heads(turns: DataFrame, group_of: int = GROUP_OF, borrowed: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations rebuilt: the first h turns of conversation c are those of c - c % ``group_of``,
    with h the unsigned CRC-32 of c modulo ``borrowed``; none if there is no such conversation."""
    head = turns.where(F.col("depth") < borrowed).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "size"))).alias("head"))
    own = lengths(turns).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % borrowed).cast("int"))
    base = F.col("conv") - F.col("conv") % group_of
    joined = own.withColumn("base", base).join(head.withColumnRenamed("conv", "base"), "base", "left")
    taken = F.when(F.col("h") > 0, F.slice("head", 1, F.col("h")))
    told = joined.select("conv", "h", "length", F.coalesce(taken, F.slice("head", 1, 0), F.expr("cast(array() as array<struct<depth:bigint,a:bigint,b:bigint,size:bigint>>)")).alias("head"))
    told = materialize(told)
    rest = turns.join(told.select("conv", "h", (F.size("head") - F.col("h")).alias("moved")), "conv").where("depth > h")
    rest = rest.select("conv", (F.col("depth") + F.col("moved")).alias("depth"), "a", "b", "size")
    heads = told.select("conv", F.inline("head")).select("conv", "depth", "a", "b", "size")
    length = F.size("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))
    return heads.unionByName(rest), told.select("conv", length.cast("long").alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the hash of all turns up to them (pa, pb), that of those before (qa, qb), and the code points up to them."""
    block = F.shiftright("depth", BLOCK_BITS)
    mixed = turns.select("conv", "depth", "size", F.xxhash64("a", "b", "depth").alias("a"), F.xxhash64("depth", "b", "a").alias("b"), block.alias("block"))
    totals = mixed.groupBy("conv", "block").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"), F.sum("size").alias("ts"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv", "block", F.bit_xor("ta").over(before).alias("ta"), F.bit_xor("tb").over(before).alias("tb"), F.sum("ts").over(before).alias("ts"))
    joined = mixed.join(offsets.where("ts is not null").hint("shuffle_hash"), ["conv", "block"], "left").fillna(0, ["ta", "tb", "ts"])
    running = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)

    def upto(name: str, total: str) -> Column:
        return F.bit_xor(name).over(running).bitwiseXOR(F.col(total))

    found = joined.withColumns({"pa": upto("a", "ta"), "pb": upto("b", "tb"), "upto": F.sum("size").over(running) + F.col("ts")})
    return found.select("conv", *KEY, F.col("pa").bitwiseXOR(F.col("a")).alias("qa"), F.col("pb").bitwiseXOR(F.col("b")).alias("qb"), "size", "upto")


class Parentheses:
    """A balanced sequence, with the least excess of each block and of pairs of blocks in a tree."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-len(opens) // EXCESS_BLOCK)
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        self.least = np.full(2 * self.leaves, len(opens) + 1)
        self.least[self.leaves : self.leaves + blocks] = np.minimum.reduceat(self.excess, np.arange(blocks) * EXCESS_BLOCK)
        for at in range(self.leaves - 1, 0, -1):
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def _below(self, start: int, block: int, excess: int) -> int:
        """The first place from ``start`` on in a block where the excess is below."""
        found = self.excess[start : (block + 1) * EXCESS_BLOCK] < excess
        at = int(found.argmax()) if len(found) else 0
        return start + at if len(found) and found[at] else -1

    def findclose(self, start: int) -> int:
        """The place of the parenthesis that closes the one at ``start``."""
        excess, block = self.excess[start], start // EXCESS_BLOCK
        if (at := self._below(start + 1, block, excess)) >= 0:
            return at
        node = block + self.leaves
        while node & 1 or self.least[node + 1] >= excess:  # up to the first block on the right that goes below
            node >>= 1
        node += 1
        while node < self.leaves:
            node = 2 * node + (self.least[2 * node] >= excess)
        block = node - self.leaves
        return self._below(block * EXCESS_BLOCK, block, excess)

    def leaf_pairs(self) -> np.ndarray:
        """Places of leaves: a parenthesis that is closed at once."""
        return np.flatnonzero(self.opens[:-1] & ~self.opens[1:])


class Shard:
    """Paths in the order of the trie, as balanced parentheses below a root."""

    def __init__(self):
        self.opens, self.path, self.nodes = [True], [], [(None, 0, 0, 0, False)]
        self.saved, self.at = [0], []  # at: numbers of the path's nodes

    def add(self, conv: int, path: list[dict]) -> None:
        """The next path: its edges' lowest nodes, from the top."""
        same = 0
        for old, new in zip(self.path, path):
            if old["owner"] != new["owner"] or old["depth"] != new["depth"]:
                break
            same += 1
        self.opens += [False] * (len(self.path) - same) + [True] * (len(path) - same)
        above = {"depth": 0, "upto": 0}
        del self.at[same:]
        for i, node in enumerate(path):
            if i >= same:
                self.at.append(len(self.nodes))
                self.nodes.append((node["owner"], node["depth"], above["depth"] + 1, above["upto"], node["leaf"]))
                self.saved.append(0)
            if node["owner"] == conv:
                self.saved[self.at[i]] = (node["n_convs"] - 1) * (node["upto"] - above["upto"])
            above = node
        self.path = path

    def sums(self) -> pa.RecordBatch:
        """Per node: the leaves and savings of its subtree in this shard."""
        found = Parentheses(np.array(self.opens + [False] * (len(self.path) + 1)))
        start = np.flatnonzero(found.opens)
        close = np.array([found.findclose(int(at)) for at in start])
        owner, depth, top, before, leaf = zip(*self.nodes)
        number = np.cumsum(found.opens) - 1  # nodes opened up to a place
        pairs = found.leaf_pairs()
        pairs = pairs[np.array(leaf)[number[pairs]]]  # the last path may go on in the next shard
        leaves = np.searchsorted(pairs, close) - np.searchsorted(pairs, start)
        total = np.append(0, np.cumsum(np.array(self.saved, dtype=np.int64)))
        savings = total[number[close] + 1] - total[number[start]]
        kind = pa.int64()
        columns = [pa.array(owner, kind), pa.array(depth, kind), pa.array(top, kind), pa.array(before, kind), pa.array(leaves, kind), pa.array(savings, kind)]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "depth", "top", "before", "n_leaves", "saved"])


def shard_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = None
    for batch in batches:
        for conv, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard = shard or Shard()
            shard.add(conv, path)
            if len(shard.nodes) > SHARD_NODES:
                yield shard.sums()
                shard = None
    if shard:
        yield shard.sums()


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the ascending ids of the conversations that end at a node, from (key, conv)."""
    block = F.shiftright("conv", BLOCK_BITS).alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    listed = members.groupBy(*KEY, block).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            columns = [batch.column(at).to_pylist() for at in (0, 1, 2, 4)]
            for depth, a, b, text in zip(*columns):
                if last == (depth, a, b):
                    state.update(b"," + text.encode())
                    continue
                if last is not None:
                    done.append((*last, state.hexdigest()))
                last, state = (depth, a, b), hashlib.sha256(text.encode())
            yield told(done)
        if last is not None:
            yield told([(*last, state.hexdigest())])

    def told(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*KEY, "ends_sha256"])

    ordered = listed.repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return ordered.mapInArrow(run, "depth long, pa long, pb long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``, from (conv, depth, a, b, size) and (conv, length), which holds turnless conversations, too."""
    lengths = materialize(lengths)
    reached = materialize(prefixes(turns).join(lengths, "conv").withColumn("ends", F.col("depth") == F.col("length")).drop("length"))
    zero = F.lit(0).cast("long")
    inner = reached.groupBy(*KEY).agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min(F.when(F.col("ends"), F.col("conv"))).alias("first_end"),
        *(F.first(name).alias(name) for name in ("qa", "qb", "size", "upto")),
    )
    root = lengths.groupBy().agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min(F.when(F.col("length") == 0, F.col("conv"))).alias("first_end"))
    root = root.where("n_convs > 0").select(*(zero.alias(k) for k in KEY), "conv", "n_convs", "first_end", *(zero.alias(n) for n in ("qa", "qb", "size", "upto")))
    nodes = materialize(inner.union(root))
    up = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(up, F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, KEY, "left").fillna(0, ["n_children"]))

    # the lowest nodes of edges, on the path of the smallest of equal conversations
    edges = nodes.where("depth > 0 and (n_children != 1 or first_end is not null)")
    edges = edges.select(*KEY, F.col("conv").alias("owner"), "n_convs", "upto", (F.col("n_children") == 0).alias("leaf"))
    whole = nodes.where("first_end is not null").select(F.col("first_end").alias("conv"))
    on_paths = reached.select("conv", *KEY).join(whole, "conv", "left_semi").join(edges, KEY)
    paths = on_paths.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "owner", "n_convs", "upto", "leaf"))).alias("path"))
    order = F.transform("path", lambda x: F.struct(x["owner"], x["depth"]))
    shards = paths.withColumn("order", order).repartitionByRange("order").sortWithinPartitions("order").drop("order")
    parts = shards.mapInArrow(shard_sums, "conv long, depth long, top long, before long, n_leaves long, saved long")
    sums = parts.groupBy("conv", "depth", "top", "before").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    sums = materialize(sums)

    # nodes of an edge have the leaves of its lowest one, and save less by what is above them
    by_block = F.explode(F.sequence(F.shiftright("top", BLOCK_BITS), F.shiftright("depth", BLOCK_BITS))).alias("block")
    chains = sums.where("depth > 0").select("conv", "top", F.col("depth").alias("bottom"), "before", "n_leaves", "saved", by_block)
    below = nodes.where("depth > 0").withColumn("block", F.shiftright("depth", BLOCK_BITS)).join(chains, ["conv", "block"])
    below = below.where("depth between top and bottom")
    saved = F.col("saved") - (F.col("n_convs") - 1) * (F.col("upto") - F.col("size") - F.col("before"))
    told = ["conv", *KEY, "qa", "qb", "n_convs", "n_children", "first_end"]
    at_root = nodes.where("depth = 0").join(sums.where("depth = 0").select("depth", "n_leaves", "saved"), "depth", "left")
    united = below.select(*told, "n_leaves", saved.alias("saved")).union(
        at_root.select(*told, F.coalesce("n_leaves", F.lit(1)), F.coalesce("saved", zero))
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv").alias("parent_conv_id"))
    turnless = lengths.where("length = 0").select(*(zero.alias(k) for k in KEY), "conv")
    digests = ends(reached.where("ends").select(*KEY, "conv").union(turnless))
    found = united.join(parents, ["depth", "qa", "qb"], "left").join(digests, KEY, "left")
    return found.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
