"""Connected groups of nodes that share bucket keys and pass an exact test.

Candidates are star-shaped: in each bucket all members are tested against one hub. What the star
leaves open is settled by an exact way: where members of a bucket, its hub left aside, are still in
different groups, the pairs across groups are tested in blocks of a bounded size. So no link between
two members of a bucket is lost, and pairs within a settled group are never made.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kdframe.session import materialize

BLOCK_MEMBERS = 1000


def components(edges: DataFrame) -> DataFrame:
    """The smallest node (``root``) of the group of each ``node`` that has an edge (a, b) of longs.

    Alternates large-star and small-star steps until all edges point from a node to its root. A step is
    one window over narrow rows by node. Every round is written to the shared folder.
    """
    by_node = Window.partitionBy("a")
    current = materialize(edges.select("a", "b").where("a != b").distinct())
    while True:
        # large star: neighbours above a node point to the smallest of its neighbourhood
        both = current.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        lowest = both.withColumn("low", F.least("a", F.min("b").over(by_node)))
        large = lowest.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # small star: a node and its neighbours below point to the smallest of them
        pulled = large.withColumn("low", F.min("b").over(by_node)).withColumn("up", F.explode(F.array("a", "b")))
        current = materialize(pulled.where("up != low").select(F.col("up").alias("a"), F.col("low").alias("b")).distinct())
        # done when every node has one edge, to a node without any
        ends = current.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(n).alias("out")) for c, n in (("a", 1), ("b", 0))))))
        counts = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("low"))
        if counts.where("out > 1 or out = 1 and low = 0").isEmpty():
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def shared_buckets(keys: DataFrame) -> DataFrame:
    """Of distinct rows (key, node), those of buckets with at least two nodes, without the smallest, the ``hub``; in a table."""
    several = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").drop("top")
    return materialize(keys.join(several, "key").where("node != hub"))


def common_members(values: pa.ChunkedArray) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """Sizes of non-empty sets, and a function that counts the members that each has in common with one of them."""
    values = values.combine_chunks()
    members = np.unique(values.flatten().to_numpy(), return_inverse=True)[1]
    size = np.diff(values.offsets.to_numpy()).astype(np.int64)
    edge = np.concatenate(([0], np.cumsum(size)))
    marks = np.zeros(members.max() + 1, dtype=bool)

    def common_with(i: int) -> np.ndarray:
        own = members[edge[i] : edge[i + 1]]
        marks[own] = True
        common = np.add.reduceat(marks[members], edge[:-1], dtype=np.int64)
        marks[own] = False
        return common

    return size, common_with


def grouped(
    members: DataFrame,
    payload: DataFrame,
    linked: Callable[[DataFrame], DataFrame],
    prepare: Callable[[pa.ChunkedArray], tuple[Callable[[int], np.ndarray], Callable[[int, int], bool] | None]],
    block_members: int = BLOCK_MEMBERS,
    *,
    tested: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The smallest node (``root``) of the group of each ``node`` that is linked with another.

    ``members``: rows of ``shared_buckets``. ``payload``: (node, value) of all of them. ``linked`` keeps those
    of pairs (a, b, value_a, value_b) that pass the test. ``prepare`` is the same test for a block: it gets the
    values and returns a function that says, for one of them, with which it may pass, and one that tests such
    a pair (None if there is nothing left to test). ``tested`` keeps those of pairs (a, b) that pass, in a way of
    its own.
    """

    def fetched(pairs: DataFrame) -> DataFrame:
        a = payload.select(F.col("node").alias("a"), F.col("value").alias("value_a"))
        b = payload.select(F.col("node").alias("b"), F.col("value").alias("value_b"))
        return linked(pairs.join(b, "b").join(a, "a")).select("a", "b")

    star = (tested or fetched)(members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    roots = materialize(components(star))
    # a group is named by its root; a node without link is a group of its own
    named = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("group"))
    open_keys = (
        named.groupBy("key")
        .agg(
            F.min("group").alias("low"),
            F.max("group").alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
        )
        .where("low < high")
        # buckets with the same members are looked at once
        .groupBy("n", "sum")
        .agg(F.min("key").alias("key"))
        .drop("sum")
    )
    rows = materialize(named.join(open_keys, "key"))
    if rows.isEmpty():
        return roots
    # a large bucket is cut into blocks; each pair of blocks is a task of its own
    cells = F.ceil(F.col("n") / block_members).cast("int")
    block = F.pmod(F.xxhash64("node"), cells).cast("int")
    dealt = (
        rows.withColumn("cells", cells)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .select("key", "node", "group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        .join(payload, "node")
    )

    def pairs(key: tuple, block: pa.Table) -> pa.Table:
        node, group = block.column("node").to_numpy(), block.column("group").to_numpy()
        may_pass, passes = prepare(block.column("value"))
        names, sizes = np.unique(group, return_counts=True)
        largest = names[sizes.argmax()]
        found = []
        for i in np.flatnonzero(group != largest):
            passed = np.flatnonzero(may_pass(i) & (group != group[i]) & ((group == largest) | (node > node[i])))
            joined = set()  # one link joins two groups, more add nothing
            for j in passed:
                if group[j] not in joined and (passes is None or passes(i, j)):
                    joined.add(group[j])
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        a, b = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
        return pa.table([a, b], names=["a", "b"])

    more = dealt.groupBy("key", "x", "y").applyInArrow(pairs, "a long, b long").distinct()
    more = materialize(more)
    if more.isEmpty():
        return roots
    return materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
