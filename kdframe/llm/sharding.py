"""Shards by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table, from two hashes of its name. The
shards take turns claiming the first slot of their permutation that is still free, until the table is
full; so each gets a nearly equal share, and a change of the shards moves few slots. The table is
broadcast (its size is a parameter), and a key finds its shard by one hash and one lookup.

A shard that holds many bytes is split into parts by a second hash, so a hot key doesn't make one
large file or task.

Defined cases: a null key is a key like any other; repeated keys share a shard; rows of one key are
spread over its parts by ``spread``; an empty table gives an empty result; other columns are kept, but for
one that has the name of a result column: it may be read as a key, and the result takes its place.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kdframe.llm.common import unused

SLOTS = 65_537
PART_BYTES = 128 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard of each slot. ``slots`` must be a prime, best a hundred times the shards."""
    if not is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("slots must be a prime, and shards different names, no more than slots")
    start, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    table = [-1] * slots
    free = slots
    while True:
        for shard in range(len(shards)):
            at = start[shard]
            while table[at] >= 0:
                at = (at + step[shard]) % slots
            table[at] = shard
            start[shard] = (at + step[shard]) % slots
            free -= 1
            if not free:
                return table


def slot_of(keys: list[str], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def assign_shards(
    docs: DataFrame, keys: list[str], shards: list[str], *, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard"
) -> DataFrame:
    """``docs`` with ``slot_col`` and ``shard_col``, the shard's name. One broadcast lookup, no shuffle."""
    spark: SparkSession = docs.sparkSession
    slot, shard = unused("_slot", docs), unused("_shard", docs)
    table = [(at, shards[number]) for at, number in enumerate(lookup_table(shards, slots))]
    lookup = spark.createDataFrame(table, f"{slot} int, {shard} string")
    placed = docs.withColumn(slot, slot_of(keys, slots)).join(F.broadcast(lookup), slot)
    return placed.drop(slot_col, shard_col).withColumnsRenamed({slot: slot_col, shard: shard_col})


def split_shards(
    assigned: DataFrame,
    spread: list[str],
    size: Column,
    *,
    part_bytes: int = PART_BYTES,
    shard_col: str = "shard",
    part_col: str = "part",
) -> DataFrame:
    """``assigned`` with ``part_col``: a shard of many bytes has several, chosen by a hash of ``spread``."""
    key, parts, part = (unused(name, assigned) for name in ("_of", "_parts", "_part"))
    count = F.greatest(F.lit(1), F.ceil(F.sum(size) / part_bytes)).cast("int")
    # one row for each shard, so bounded like the lookup table
    counted = F.broadcast(assigned.groupBy(F.col(shard_col).alias(key)).agg(count.alias(parts)))
    joined = assigned.join(counted, F.col(shard_col) == F.col(key))
    chosen = joined.withColumn(part, F.pmod(F.xxhash64(*spread, F.lit(1)), F.col(parts)).cast("int"))
    return chosen.drop(part_col, key, parts).withColumnRenamed(part, part_col)


def write_shards(split: DataFrame, path: str) -> None:
    """One folder for each shard, and in it about one file for each part."""
    split.repartition("shard", "part").write.partitionBy("shard").parquet(path)
