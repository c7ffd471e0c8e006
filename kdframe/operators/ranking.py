"""Global ranks and prefix sums without a single-task window.

Rows are cut into buckets that follow the sort order (a prefix of a hash key, a range of an id).
Bucket totals are a small aggregate, their running sum gives each bucket its offset, and the exact
position inside a bucket comes from a window partitioned by bucket. Buckets are plain functions
of the row, so a lost executor recomputes the same answer and nothing has to be persisted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kdframe.session import materialize

BUCKET_BYTES = 64 << 20  # estimated input of one bucket of hash keys
LEAST_DIGITS, MOST_DIGITS = 2, 5  # of 256 to 1,048,576 buckets


def order_key(seed: int | Column, *ids: str | Column) -> Column:
    """Engine-independent pseudo-random sort key of a row."""
    parts = [F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string")]
    parts += [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def key_digits(df: DataFrame) -> int:
    """Hex digits that cut the table into buckets of about ``BUCKET_BYTES``, by the planner's estimate of its size.

    The estimate decides how work is cut, never what comes out.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    digits = LEAST_DIGITS
    while digits < MOST_DIGITS and size > BUCKET_BYTES * 16**digits:
        digits += 1
    return digits


def key_bucket(key: Column, digits: int) -> Column:
    """Leading hex digits of a hash key: uniform buckets in key order."""
    return F.substring(key, 1, digits)


def range_bucket(value: Column, width: int) -> Column:
    """Buckets of ``width`` consecutive values of a numeric sort column."""
    return F.floor(value / F.lit(width))


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    bucket: Sequence[Column],
    values: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Sum of each value over the rows before this one in ``order`` (exclusive), per ``by`` group.

    ``bucket`` must be monotone in ``order``. A hot ``by`` group is spread over its buckets.
    """
    buckets = {f"_bucket{i}": expression for i, expression in enumerate(bucket)}
    amounts = {f"_amount{i}": value.cast("long") for i, value in enumerate(values.values())}
    staged = df.withColumns({**buckets, **amounts})
    keys = [*by, *buckets]

    totals = staged.groupBy(*keys).agg(*[F.sum(a).alias(a) for a in amounts])
    before = Window.partitionBy(*by).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.sum(a).over(before).alias(f"_offset{a}") for a in amounts])
    # the first bucket of a group has nothing before it, and most groups have one bucket only
    later = offsets.where(F.col(f"_offset{next(iter(amounts))}").isNotNull())
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = {
        name: F.coalesce(F.col(f"_offset{a}"), zero) + F.coalesce(F.sum(a).over(inner), zero)
        for name, a in zip(values, amounts)
    }
    # hash join: the window below needs this very partitioning, and only it has to sort the rows
    return (
        staged.join(later.hint("shuffle_hash"), keys, "left")
        .withColumns(sums)
        .drop(*buckets, *amounts, *[f"_offset{a}" for a in amounts])
    )


def prefix_sum(
    df: DataFrame,
    order: Sequence[Column | str],
    bucket: Sequence[Column],
    value: Column | None = None,
    by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """One prefix sum. With no ``value`` every row counts 1: a dense rank from 0."""
    return prefix_sums(df, order, bucket, {name: F.lit(1) if value is None else value}, by)


def range_ordered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` in a table with ``_at``, a number that rises with ``order``: the range of the row and its place there.

    Spark samples the sort columns to split them into ranges of about equal size, whatever their
    distribution. ``order`` must identify a row.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))


def range_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Position of every row in ``order``, from 0, with one shuffle: the counts of the ranges, one number per
    task of that shuffle, give the offsets."""
    placed = range_ordered(df, order)
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for at in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(at, 0)
    start = F.get(F.array(*map(F.lit, offsets)), part.cast("int")) if offsets else F.lit(0)
    return placed.withColumn(name, (start + nth).cast("long")).drop("_at")


def shuffled_rank(
    df: DataFrame, ids: Sequence[str], seed: int = 42, by: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Position of every row in the seeded shuffle order, from 0."""
    keyed = df.withColumn("_key", order_key(seed, *ids))
    bucket = key_bucket(F.col("_key"), key_digits(df))
    return prefix_sum(keyed, ["_key", *ids], [bucket], by=by, name=name).drop("_key")


def cutoffs(
    df: DataFrame,
    limit: Callable[[Column], Column],
    sort: Sequence[str],
    bucket: Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """The sort columns of the last row to keep, one row per ``by`` group.

    ``limit`` maps a group's row count to the rows wanted and may use the ``by`` columns. Only the
    one bucket that contains the limit is sorted.
    """
    narrow = df.select(*by, *sort, bucket.alias("_bucket"))
    counts = narrow.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = counts.select(
        *by,
        "_bucket",
        "_n",
        F.sum("_n").over(running).alias("_high"),
        limit(F.sum("_n").over(group)).alias("_limit"),
    )
    inside = (F.col("_high") >= F.col("_limit")) & (F.col("_high") - F.col("_n") < F.col("_limit"))
    edge = edges.where(inside).select(
        *by, "_bucket", (F.col("_limit") - F.col("_high") + F.col("_n")).alias("_want")
    )
    # broadcast: one row per group of the caller's driver-side specification
    candidates = narrow.join(F.broadcast(edge), [*by, "_bucket"])
    order = Window.partitionBy(*by, "_bucket").orderBy(*sort)
    return (
        candidates.withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") == F.col("_want"))
        .select(*by, F.struct(*sort).alias("_cut"))
    )


def take_first(
    df: DataFrame,
    limit: Callable[[Column], Column],
    sort: Sequence[str],
    bucket: Column,
    by: Sequence[str] = (),
    flag: str | None = None,
) -> DataFrame:
    """The first ``limit`` rows in ``sort`` order, per ``by`` group.

    The wide rows are read once and compared with one cut-off per group: they are not shuffled.
    ``sort`` must identify a row within its group, ``bucket`` must be monotone in it, and the
    groups must be those of a driver-side specification (they are broadcast). With ``flag`` all
    rows are kept and marked instead.
    """
    cut = cutoffs(df, limit, sort, bucket, by)
    if by:
        joined = df.join(F.broadcast(cut), list(by), "left")
    else:
        joined = df.withColumn("_cut", cut.scalar())
    kept = F.coalesce(F.struct(*sort) <= F.col("_cut"), F.lit(False))
    marked = joined.withColumn(flag, kept) if flag else joined.where(kept)
    return marked.drop("_cut")


def take_shuffled(
    df: DataFrame,
    limit: Callable[[Column], Column],
    ids: Sequence[str],
    seed: int = 42,
    by: Sequence[str] = (),
    flag: str | None = None,
) -> DataFrame:
    """``take_first`` in the seeded shuffle order."""
    keyed = df.withColumn("_key", order_key(seed, *ids))
    return take_first(keyed, limit, ["_key", *ids], key_bucket(F.col("_key"), key_digits(df)), by, flag).drop("_key")
