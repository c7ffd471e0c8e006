"""Seeded shuffle, row caps, weighted quotas, interleaving, splitting and mixture reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kdframe.operators.ranking import (
    cutoffs,
    key_bucket,
    key_digits,
    order_key,
    prefix_sum,
    range_bucket,
    shuffled_rank,
    take_first,
    take_shuffled,
)
from kdframe.session import materialize

REPEAT_CHUNK = 4096
HEAD_RANGE = 1 << 20


@dataclass(frozen=True)
class Source:
    """One line of a mixture specification. ``adapter`` and ``ids``, the columns that identify a row, are for ``mix``."""

    name: str
    weight: float
    adapter: Callable[..., DataFrame] | None = None
    ids: tuple[str, ...] = ()


def shuffle(df: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``position``, the place of the row in the seeded order."""
    return shuffled_rank(df, ids, seed, name="position")


def shuffle_without_id(df: DataFrame, seed: int = 42) -> DataFrame:
    """Seeded order of a table with no identifying column; the key is a hash of the whole row.

    Equal rows are interchangeable, so they are counted first and numbered as one run. A third of
    the table being copies of one row therefore shuffles as one row, and is written out again by
    several tasks.
    """
    names = df.columns
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    keyed = counted.withColumn("_row_key", F.md5(F.concat(F.lit(f"{seed}:"), body).cast("binary")))
    ranked = prefix_sum(
        keyed,
        ["_row_key"],
        [key_bucket(F.col("_row_key"), key_digits(df))],
        value=F.col("_copies"),
        name="_first",
    )
    return repeat_rows(ranked, F.col("_copies")).select(
        *names, (F.col("_first") + F.col("copy")).alias("position")
    )


def chunks_of(times: Column) -> Column:
    """Generator of the chunks (``_from``, ``_to``) that ``times`` copies are cut into, so that tasks can share them."""
    last = F.floor((times.cast("long") - 1) / REPEAT_CHUNK)
    starts = F.when(times > 0, F.sequence(F.lit(0).cast("long"), last))
    return F.inline(
        F.transform(
            starts,
            lambda c: F.struct(
                (c * REPEAT_CHUNK).alias("_from"), (F.least((c + 1) * REPEAT_CHUNK, times.cast("long")) - 1).alias("_to")
            ),
        )
    )


def copies(chunked: DataFrame) -> DataFrame:
    """The rows of chunks, numbered by ``copy`` from 0."""
    return chunked.withColumn("copy", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, numbered by ``copy`` from 0.

    Long runs are cut into chunks; Spark deals those anew, and only as many as make a task too large.
    """
    return copies(df.select("*", chunks_of(times)).hint("rebalance"))


def cap_rows(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42, mode: str = "sample") -> DataFrame:
    """``sample``: shuffle, then the first n. ``head``: the first n by id, to be shuffled after."""
    if mode == "sample":
        return take_shuffled(df, lambda total: F.least(F.lit(n), total), ids, seed)
    if mode == "head":
        return take_first(
            df, lambda total: F.least(F.lit(n), total), ids, range_bucket(F.col(ids[0]), HEAD_RANGE)
        )
    raise ValueError(f"unknown mode {mode!r}: use 'sample' or 'head'")


def quota(spec: Sequence[Source], target_total: int | None, source: str = "source") -> Callable[[Column], Column]:
    """Rows wanted per source: ``floor(target * weight)``, at most what there is."""

    def limit(total: Column) -> Column:
        if target_total is None:
            return total
        wanted = F.lit(None).cast("long")
        for line in spec:
            wanted = F.when(F.col(source) == line.name, F.lit(int(target_total * line.weight))).otherwise(wanted)
        return F.least(wanted, total)

    return limit


def weighted_quota(
    df: DataFrame,
    spec: Sequence[Source],
    target_total: int | None,
    ids: Sequence[str],
    seed: int = 42,
    source: str = "source",
) -> DataFrame:
    """Seeded sample of each source by weight; every row when there is no target."""
    known = df.where(F.col(source).isin([line.name for line in spec]))
    if target_total is None:
        return known
    return take_shuffled(known, quota(spec, target_total, source), ids, seed, by=[source])


def enough_turns(df: DataFrame, column: str = "conversations", least: int = 2) -> DataFrame:
    """Keep conversations with at least two turns."""
    return df.where(F.size(column) >= least)


def interleave(
    df: DataFrame,
    shards: Sequence[str],
    position: str,
    source: str = "source",
    wide: DataFrame | None = None,
    ids: Sequence[str] = (),
) -> DataFrame:
    """Round-robin over the shards until the longest is used up, cycling the shorter ones.

    ``position`` numbers the rows of each shard from 0. Adds ``round`` and ``out_pos``. Row ``p`` of
    a shard with ``n`` rows appears in rounds ``p, p + n, p + 2n, ...``.

    The rounds are worked out on ``df`` alone. Give it narrow, and the other columns in ``wide``: its
    rows are fetched by ``source`` and ``ids`` in one shuffle, and repeated only after it.
    """
    index = reduce(
        lambda rest, pair: F.when(F.col(source) == pair[1], F.lit(pair[0])).otherwise(rest),
        list(enumerate(shards)),
        F.lit(None).cast("int"),
    )
    known = df.where(F.col(source).isin(list(shards)))
    sizes = known.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_longest", F.max("_n").over(Window.partitionBy()))
    # broadcast: one row per shard named by the caller
    sized = known.join(F.broadcast(sizes), source)
    turns = F.ceil((F.col("_longest") - F.col(position)) / F.col("_n"))
    chunked = sized.select("*", chunks_of(turns))
    chunked = chunked.hint("rebalance") if wide is None else wide.join(chunked, [source, *ids])
    return (
        copies(chunked)
        .withColumn("round", F.col(position) + F.col("copy") * F.col("_n"))
        .withColumn("out_pos", F.col("round") * len(shards) + index)
        .drop("_n", "_longest", "copy")
    )


def mix(
    tables: dict[str, DataFrame], spec: Sequence[Source], target_total: int | None, seed: int = 42, least_turns: int = 2
) -> DataFrame:
    """The whole mixture job: cut each source to its quota in the seeded order, adapt it, drop conversations that are
    too short, and interleave what is left. Gives ``source``, ``round``, ``out_pos`` and ``conversations``.

    Sources may have different columns. Which rows are kept, and their places, is decided on ids, keys and
    lengths; adapted rows are read once, filtered by the cut-offs and shuffled once, to their rounds.
    """

    def adapted(line: Source) -> DataFrame:
        df = tables[line.name]
        marked = df.withColumns(
            {"_mix_id": F.concat_ws(":", *(F.col(c).cast("string") for c in line.ids)), "_mix_key": order_key(seed, *line.ids)}
        )
        return line.adapter(marked, keep=("_mix_id", "_mix_key")).withColumn("source", F.lit(line.name))

    def united(*columns: str | Column) -> DataFrame:
        return reduce(DataFrame.unionByName, (adapted(line).select("source", "_mix_id", "_mix_key", *columns) for line in spec))

    sort = ["_mix_key", "_mix_id"]
    keys = united()
    bucket = key_bucket(F.col("_mix_key"), max(key_digits(df) for df in tables.values()))
    long_enough = F.coalesce(F.size("conversations") >= least_turns, F.lit(False))
    if target_total is None:
        cut = None
    else:
        # broadcast: one row per source of the specification
        cut = F.broadcast(materialize(cutoffs(keys, quota(spec, target_total), sort, bucket, ["source"])))

    def kept(rows: DataFrame) -> DataFrame:
        if cut is None:
            return rows
        return rows.join(cut, "source").where(F.struct(*sort) <= F.col("_cut")).drop("_cut")

    chosen = kept(united(long_enough.alias("_ok"))).where("_ok").drop("_ok")
    placed = materialize(prefix_sum(chosen, sort, [bucket], by=["source"], name="_place").select("source", "_mix_id", "_place"))
    rows = kept(united("conversations").where(long_enough)).drop("_mix_key")
    mixed = interleave(placed, [line.name for line in spec], "_place", wide=rows, ids=["_mix_id"])
    return mixed.select("source", "round", "out_pos", "conversations")


def union_shards(shards: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """Weight-preserving union: each quota row once, labelled with its source."""
    labelled = [df.withColumn(source, F.lit(name)) for name, df in shards.items()]
    return reduce(lambda a, b: a.unionByName(b), labelled)


def mixture_report(
    available: DataFrame, kept: DataFrame, spec: Sequence[Source], target_total: int, source: str = "source"
) -> DataFrame:
    """Rows asked, available, kept and after interleaving, with shares; ``source`` NULL is the total."""
    spark = available.sparkSession
    asked = spark.createDataFrame(
        [(line.name, int(target_total * line.weight)) for line in spec], f"{source} string, asked long"
    )
    have = available.groupBy(source).agg(F.count(F.lit(1)).alias("available"))
    left = kept.groupBy(source).agg(F.count(F.lit(1)).alias("kept"))
    whole = Window.partitionBy()
    rows = (
        F.broadcast(asked)
        .join(have, source, "left")
        .join(left, source, "left")
        .na.fill(0, ["available", "kept"])
        .withColumn("interleaved", F.when(F.col("kept") > 0, F.max("kept").over(whole)).otherwise(F.lit(0)))
    )
    summed = rows.rollup(source).agg(
        *[F.sum(c).alias(c) for c in ("asked", "available", "kept", "interleaved")]
    )
    total = F.sum(F.when(F.col(source).isNull(), F.col("interleaved"))).over(whole)
    kept_total = F.sum(F.when(F.col(source).isNull(), F.col("kept"))).over(whole)
    return summed.withColumn("kept_share", F.try_divide("kept", kept_total)).withColumn(
        "effective_share", F.try_divide("interleaved", total)
    )


def train_test_split(
    df: DataFrame, test_size: float, ids: Sequence[str], seed: int = 42, column: str = "split"
) -> DataFrame:
    """Exact-size split: the first ``ceil(p * n)`` rows of the seeded order are the test part.

    No test size means everything is training data.
    """
    if not test_size:
        return df.withColumn(column, F.lit("train"))
    flagged = take_shuffled(
        df, lambda total: F.ceil(total * F.lit(test_size)), ids, seed, flag="_test"
    )
    return flagged.withColumn(column, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def concat_sides(df: DataFrame, shared: Sequence[str | Column], chosen: str, rejected: str) -> DataFrame:
    """One row per pair and side: ``side`` and ``completion``. The pairs are read once."""
    sides = [
        F.struct(F.lit(side).alias("side"), F.col(column).alias("completion"))
        for side, column in (("chosen", chosen), ("rejected", rejected))
    ]
    return df.select(*shared, F.inline(F.array(*sides)))


def split_sides(df: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Back to one row per pair."""
    return df.groupBy(*shared).agg(
        F.max(F.when(F.col("side") == "chosen", F.col("completion"))).alias("chosen"),
        F.max(F.when(F.col("side") == "rejected", F.col("completion"))).alias("rejected"),
    )
