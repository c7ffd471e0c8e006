"""Prompt + completion batches: concatenate, flush left, truncate, flatten, align.

A batch is a set of rows with the same ``batch_id`` and equally long arrays. Batches are small by
construction, so windows and aggregates by batch are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kdframe.session import broadcast_if_fits, materialize

MASK_BITS = 32
BROADCAST_BATCHES = 1_000_000


def join_prompt_completion(df: DataFrame) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``loss_mask`` of prompt followed by completion."""
    return df.withColumns(
        {
            "input_ids": F.concat("prompt_ids", "completion_ids"),
            "attention_mask": F.concat("prompt_mask", "completion_mask"),
            "loss_mask": F.concat(F.array_repeat(F.lit(0), F.size("prompt_mask")), F.col("completion_mask")),
        }
    )


def roll(a: Column, shift: int) -> Column:
    """Cyclic shift by one: -1 brings the second element to the front, +1 the last."""
    if shift == -1:
        return F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))
    if shift == 1:
        return F.concat(
            F.slice(a, F.size(a), F.lit(1)), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        )
    raise ValueError("shift must be -1 or 1")


def _rotate(a: Column, first: Column) -> Column:
    return F.concat(F.slice(a, first, F.size(a)), F.slice(a, F.lit(1), first - 1))


def packed_mask(mask: Column) -> Column:
    """A mask as an array of longs with 32 positions each."""
    words = F.sequence(F.lit(0), F.greatest(F.floor((F.size(mask) - 1) / MASK_BITS), F.lit(0)).cast("int"))

    def word(i: Column) -> Column:
        part = F.slice(mask, i * MASK_BITS + 1, F.lit(MASK_BITS))
        bits = F.transform(part, lambda m, k: F.when(m == 1, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), k).cast("long"))
        return F.aggregate(bits, F.expr("0L"), lambda a, b: a + b)

    return F.transform(words, word)


def used_columns(rotated: DataFrame, mask: str, batch: str) -> DataFrame:
    """Per batch, the columns before the first that is zero in all rows (``_width``).

    Masks travel bit-packed, 32 positions a row, and are OR-ed before the shuffle.
    """
    words = rotated.select(batch, F.size(mask).alias("_size"), F.posexplode(packed_mask(F.col(mask))).alias("_word", "_bits"))
    merged = words.groupBy(batch, "_word").agg(F.bit_or("_bits").alias("_bits"), F.max("_size").alias("_size"))
    # the lowest zero bit of a word that isn't full
    zero = F.bitwise_not("_bits").bitwiseAND(F.col("_bits") + 1)
    open_word = F.col("_bits") != (1 << MASK_BITS) - 1
    place = F.when(open_word, F.col("_word") * MASK_BITS + F.round(F.log2(zero.cast("double"))).cast("int"))
    return merged.groupBy(batch).agg(F.least(F.min(place), F.max("_size")).cast("int").alias("_width"))


def flush_left(df: DataFrame, mask: str, others: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """Rotate every row so that its first 1 is leftmost, then cut at the batch's first empty column.

    A row without any 1 is an error. Only packed masks and widths are brought together by batch: the
    arrays stay in their rows. ``df`` is read twice, so give it as a table where it is dear.
    """
    first = F.array_position(mask, 1).cast("int")
    checked = F.when(first == 0, F.raise_error(F.lit("flush_left: every row needs a 1 in its mask"))).otherwise(first)
    arrays = [*others, mask]
    rest = [c for c in df.columns if c not in (batch, *arrays)]
    rotated = df.withColumn("_first", checked).select(
        batch, *rest, *[_rotate(F.col(name), F.col("_first")).alias(name) for name in arrays]
    )
    widths = materialize(used_columns(rotated, mask, batch))
    flat = rotated.join(broadcast_if_fits(widths, BROADCAST_BATCHES), batch)
    return flat.select(
        batch, *rest, *[F.slice(F.col(name), F.lit(1), F.col("_width")).alias(name) for name in arrays]
    )


def truncate_batch(df: DataFrame, columns: Sequence[str], max_length: int, mode: str = "keep_end") -> DataFrame:
    """Cut the padded matrix to its last or first ``max_length`` columns."""
    if mode not in ("keep_end", "keep_start"):
        raise ValueError(f"truncation mode {mode!r} is neither 'keep_end' nor 'keep_start'")
    for name in columns:
        a = F.col(name)
        if mode == "keep_end":
            start = F.greatest(F.size(a) - max_length + 1, F.lit(1))
            df = df.withColumn(name, F.slice(a, start, F.lit(max_length)))
        else:
            df = df.withColumn(name, F.slice(a, 1, max_length))
    return df


def logits_to_keep(df: DataFrame, loss_mask: str = "loss_mask", batch: str = "batch_id") -> DataFrame:
    """Columns of logits the batch needs: width minus the earliest loss position, plus one."""
    position = F.array_position(loss_mask, 1) - 1
    earliest = F.min(F.when(position >= 0, position)).over(Window.partitionBy(batch))
    return df.withColumn("logits_to_keep", (F.size(loss_mask) - earliest + 1).cast("int"))


def keep_last(a: Column, n: Column) -> Column:
    start = F.greatest(F.size(a) - n + 1, F.lit(1))
    return F.slice(a, start, n)


def flatten_batch(df: DataFrame, row: str, batch: str = "batch_id") -> DataFrame:
    """Kept tokens of a batch in one run: ``flat_pos`` in the batch, ``position_id`` in the row."""
    cells = df.select(
        batch, row, F.posexplode(F.arrays_zip("input_ids", "attention_mask", "loss_mask")).alias("pos", "_cell")
    ).select(batch, row, "pos", "_cell.*")
    in_row = Window.partitionBy(batch, row).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = cells.withColumn("position_id", F.sum("attention_mask").over(in_row) - 1).where("attention_mask = 1")
    flat = F.row_number().over(Window.partitionBy(batch).orderBy(row, "pos")) - 1
    return kept.withColumn("flat_pos", flat)


def unflatten_batch(df: DataFrame, flat: DataFrame, value: str, row: str, batch: str = "batch_id") -> DataFrame:
    """Values of a flattened batch back on the ``(row, pos)`` grid, 0 where nothing was kept."""
    grid = df.select(batch, row, F.posexplode("attention_mask").alias("pos", "_one")).drop("_one")
    return grid.join(flat.select(batch, row, "pos", value), [batch, row, "pos"], "left").na.fill(0, [value])


def align_labels(df: DataFrame) -> DataFrame:
    """Labels and loss mask moved one to the left, so that position i predicts token i + 1."""
    return df.withColumn("labels", roll(F.col("input_ids"), -1)).withColumn(
        "loss_mask", roll(F.col("loss_mask"), -1)
    )


def masked(values: Column, mask: Column) -> Column:
    """Zero where the mask is zero; used for labels and for token log-probabilities."""
    return F.zip_with(values, mask, lambda v, m: F.when(m == 1, v).otherwise(F.lit(0)))
