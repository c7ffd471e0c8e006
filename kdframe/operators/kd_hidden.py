"""Loss audits over saved hidden states: one row per ``(seq_id, layer, pos)``."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.functions.vectors import cosine, huber_error, squared_error
from kdframe.session import materialize

# tasks receive the helpers of this module by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values
WARMUP_STEPS = 1000
LOSSES = ("mse", "cosine", "huber")
BROADCAST_FLOATS = 1 << 23
CELL_ROWS = 1 << 16


def map_layer(layer: Column, student_layers: int, teacher_layers: int) -> Column:
    """Teacher layer for a student layer, halves rounded to even."""
    if student_layers < 2:
        raise ValueError("a layer map needs a student with at least two layers")
    return F.bround(layer * F.lit(teacher_layers - 1) / F.lit(student_layers - 1)).cast("int")


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of list values that are not null, by width."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(size[size >= 0]).tolist():
        places = np.flatnonzero(size == width)
        chosen = vectors if len(places) == len(vectors) else vectors.take(pa.array(places))
        yield places, chosen.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(places), width)


def vectors_of(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """List values from (places, matrix); null where there is none."""
    found = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for _, m in parts]
    if not found:
        return pa.nulls(n, pa.list_(pa.float64()))
    where = np.full(n, -1)
    where[np.concatenate([places for places, _ in parts])] = np.arange(sum(len(places) for places, _ in parts))
    return pa.concat_arrays(found).take(pa.array(where, mask=where < 0))


def _projected(h: pa.Array, weights: np.ndarray, bias: np.ndarray) -> pa.Array:
    return vectors_of([(places, m @ weights.T + bias) for places, m in matrices(h)], len(h))


def _matrix(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    ordered = sorted(rows, key=lambda r: r[0])
    return np.array([w for _, w, _ in ordered], dtype=np.float64), np.array([b for _, _, b in ordered], dtype=np.float64)


def project(hidden: DataFrame, weights: DataFrame, on: str = "layer") -> DataFrame:
    """Linear projection ``w h + b`` of ``h`` by the weights whose ``layer`` is in the column ``on``; rows of other
    layers are dropped.

    ``weights`` has one row per ``(layer, out_idx)``. Up to ``BROADCAST_FLOATS`` numbers in all (counted)
    are broadcast as matrices. A larger set is dealt by layer: rows and weights of a layer meet in cells
    of ``CELL_ROWS`` rows, weights first, so that a task holds one matrix at a time. Either way the hidden
    states are read once, whatever the number of layers, and multiplied a batch at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in hidden.schema} | {"h": "array<double>"}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())
    if weights.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0] <= BROADCAST_FLOATS:
        return _project_broadcast(hidden, weights, on, schema)
    return _project_by_layer(hidden, weights, on, schema)


def _project_broadcast(hidden: DataFrame, weights: DataFrame, on: str, schema: str) -> DataFrame:
    rows: dict[int, list[tuple]] = {}
    for layer, *row in weights.select("layer", "out_idx", "w", "bias").collect():
        rows.setdefault(layer, []).append(row)
    told = hidden.sparkSession.sparkContext.broadcast({layer: _matrix(own) for layer, own in rows.items()})
    names = hidden.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layers = batch.column(names.index(on)).to_pylist()
            for layer in set(layers) & set(told.value):
                part = batch.take(pa.array([i for i, x in enumerate(layers) if x == layer], pa.int32()))
                columns = [_projected(part.column(i), *told.value[layer]) if name == "h" else part.column(i) for i, name in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return hidden.mapInArrow(run, schema)


def _project_by_layer(hidden: DataFrame, weights: DataFrame, on: str, schema: str) -> DataFrame:
    rest = [name for name in hidden.columns if name != "h"]
    rows = hidden.groupBy(F.col(on).alias("_layer")).agg(F.count(F.lit(1)).alias("_n"))
    cells = rows.select("_layer", F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_cells"))
    wanted = weights.select(F.col("layer").alias("_layer"), "out_idx", F.col("w").cast("array<double>").alias("w"), "bias")
    # one row per model layer
    known = materialize(cells.join(wanted.select("_layer").distinct(), "_layer"))
    vector = F.struct(*rest)
    left = wanted.join(F.broadcast(known), "_layer").select(
        "_layer",
        F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("_cell"),
        F.col("out_idx").cast("int").alias("_nth"),
        F.col("bias").cast("double").alias("_bias"),
        F.col("w").alias("_v"),
        F.lit(None).cast(hidden.select(vector.alias("x")).schema["x"].dataType).alias("_rest"),
    )
    right = hidden.join(F.broadcast(known), hidden[on] == F.col("_layer")).select(
        "_layer",
        F.pmod(F.xxhash64(*rest), F.col("_cells")).cast("int").alias("_cell"),
        F.lit(None).cast("int").alias("_nth"),
        F.lit(None).cast("double").alias("_bias"),
        F.col("h").cast("array<double>").alias("_v"),
        vector.alias("_rest"),
    )
    keys = ["_layer", "_cell"]
    # nulls last: the weights of a cell come before its rows
    met = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, F.col("_nth").asc_nulls_last())

    hidden_columns = hidden.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held, matrix = None, [], None
        for batch in batches:
            cell = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            weight = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            edges = [i for i in range(len(batch)) if i == 0 or cell[i] != cell[i - 1] or weight[i] != weight[i - 1]]
            for start, end in zip(edges, [*edges[1:], len(batch)]):
                part = batch.slice(start, end - start)
                if cell[start] != owner:
                    owner, held, matrix = cell[start], [], None
                if weight[start]:
                    held += zip(part.column(2).to_pylist(), [v.values.to_numpy() for v in part.column(4)], part.column(3).to_pylist())
                    continue
                if matrix is None:
                    matrix, held = _matrix(held), []
                columns = dict(zip(rest, part.column(5).flatten())) | {"h": _projected(part.column(4), *matrix)}
                yield pa.RecordBatch.from_arrays([columns[name] for name in hidden_columns], names=hidden_columns)

    return met.mapInArrow(run, schema)


def checked_shapes(df: DataFrame, student: str = "s", teacher: str = "t") -> DataFrame:
    """Fail on a student and teacher vector of different width."""
    text = F.concat(
        F.lit("vectors of different width: student "), F.size(student).cast("string"),
        F.lit(", teacher "), F.size(teacher).cast("string"),
    )
    return df.withColumn(
        student, F.when(F.size(student) == F.size(teacher), F.col(student)).otherwise(F.raise_error(text))
    )


def shape_rejects(df: DataFrame, student: str = "s", teacher: str = "t") -> DataFrame:
    return df.where(F.size(student) != F.size(teacher))


def _check(loss: str) -> None:
    if loss not in LOSSES:
        raise ValueError(f"no loss is called {loss!r}: use one of {LOSSES}")


def _plain(loss: str) -> Column:
    s, t = F.col("s"), F.col("t")
    if loss == "cosine":
        return F.avg(1 - cosine(s, t))
    error = squared_error(s, t) if loss == "mse" else huber_error(s, t)
    return F.sum(error) / F.sum(F.size("s"))


def _aggregate(df: DataFrame, columns: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """All losses in one pass, in long form."""
    wide = df.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])
    return wide.unpivot(list(by), list(columns), "loss_type", "loss")


def layer_losses(df: DataFrame, losses: Sequence[str] = LOSSES, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Unmasked losses of every layer; element mean, or mean of ``1 - cos`` over positions."""
    for loss in losses:
        _check(loss)
    return _aggregate(df, {loss: _plain(loss) for loss in losses}, by)


def layer_loss(df: DataFrame, loss: str = "mse", by: Sequence[str] = ("layer",)) -> DataFrame:
    return layer_losses(df, [loss], by).drop("loss_type")


def scaled_layer_mean(layers: DataFrame, hidden_dim: int) -> DataFrame:
    """Mean over layers, divided by the root of the hidden width."""
    return layers.agg((F.avg("loss") / math.sqrt(hidden_dim)).alias("kd"))


def layer_mean(layers: DataFrame) -> DataFrame:
    return layers.agg(F.avg("loss").alias("kd"))


def _masked(loss: str, strict: bool) -> Column:
    s, t = F.col("s"), F.col("t")
    m = (F.col("s_mask") * F.col("t_mask")).cast("double")
    kept = F.greatest(F.sum(m), F.lit(1.0))
    if loss == "cosine":
        return (F.sum(1 - cosine(s, t) * m) if strict else F.sum((1 - cosine(s, t)) * m)) / kept
    error = squared_error(s, t) if loss == "mse" else huber_error(s, t)
    elements = F.greatest(F.sum(m * F.size("s")), F.lit(1.0))
    return F.sum(error * m) / (kept if strict else elements)


def masked_layer_losses(
    df: DataFrame, losses: Sequence[str] = LOSSES, by: Sequence[str] = ("layer",), strict: bool = True
) -> DataFrame:
    """Losses over positions kept by both masks (``s_mask``, ``t_mask``).

    ``strict`` keeps two properties of the original: squared and Huber errors are divided by the
    number of positions, not elements; and for the cosine every masked position adds 1. Without it
    elements are averaged and masked positions are left out.
    """
    for loss in losses:
        _check(loss)
    return _aggregate(df, {loss: _masked(loss, strict) for loss in losses}, by)


def masked_layer_loss(
    df: DataFrame, loss: str = "cosine", by: Sequence[str] = ("layer",), strict: bool = True
) -> DataFrame:
    return masked_layer_losses(df, [loss], by, strict).drop("loss_type")


def pooled(df: DataFrame, vectors: dict[str, str], by: Sequence[str]) -> DataFrame:
    """Mask-weighted mean of vectors per group; ``vectors`` names the mask of each vector column. Rows that lack a
    vector are left out.

    All of them are pooled in one pass: a batch adds up its rows to one vector per group before the
    shuffle, and what is left of a group streams past in one task, added to one vector.
    """
    names = list(vectors)
    there = reduce(lambda a, b: a & b, (F.col(name).isNotNull() for name in names))
    masks = {f"_m{i}": F.coalesce(F.col(mask).cast("double"), F.lit(0.0)) for i, mask in enumerate(vectors.values())}
    rows = df.where(there).select(*by, *(F.col(n).cast("array<double>").alias(n) for n in names), *(m.alias(k) for k, m in masks.items()))
    k, width, columns = len(by), len(names), rows.columns

    def added(batch: pa.RecordBatch, weigh: bool) -> pa.RecordBatch:
        """One row per group of a batch, in the order of their first rows."""
        key = pd.DataFrame({str(i): batch.column(i).to_pandas() for i in range(k)})
        group = key.groupby(list(key), sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(group, return_index=True)[1]
        out = [batch.column(i).take(pa.array(first)) for i in range(k)]
        sums, counts = [], []
        for at in range(width):
            mask = batch.column(k + width + at).to_numpy(zero_copy_only=False)
            parts = []
            for places, m in matrices(batch.column(k + at)):
                own = group[places]
                order = np.argsort(own, kind="stable")
                edge = np.flatnonzero(np.diff(own[order], prepend=-1))
                weighed = m[order] * mask[places][order, None] if weigh else m[order]
                parts.append((own[order][edge], np.add.reduceat(weighed, edge, axis=0)))
            sums.append(vectors_of(parts, len(first)))
            counts.append(pa.array(np.bincount(group, weights=mask, minlength=len(first))))
        return pa.RecordBatch.from_arrays([*out, *sums, *counts], names=columns)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (added(batch, True) for batch in batches if len(batch))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if len(batch):
                # the last group may go on in the next batch
                whole = added(pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0] if last else batch, False)
                yield whole.slice(0, len(whole) - 1)
                last = whole.slice(len(whole) - 1)
        if last:
            yield last

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sums = rows.mapInArrow(combine, schema).repartition(*by).sortWithinPartitions(*by).mapInArrow(merge, schema)

    def mean(name: str, mask: str) -> Column:
        return F.transform(name, lambda x: x / F.greatest(F.col(mask), F.lit(1.0))).alias(name)

    return sums.select(*by, *map(mean, names, masks))


def mean_pool(hidden: DataFrame, by: Sequence[str] = ("seq_id", "layer"), h: str = "h", mask: str = "mask") -> DataFrame:
    """Mask-weighted mean vector of every sequence and layer."""
    return pooled(hidden, {h: mask}, by).withColumnRenamed(h, "pooled")


def pooled_layer_loss(df: DataFrame) -> DataFrame:
    """Mean of ``1 - cos`` of pooled vectors per layer, from one row per position with both sides."""
    both = pooled(df, {"s": "s_mask", "t": "t_mask"}, ["seq_id", "layer"])
    return both.groupBy("layer").agg(F.avg(1 - cosine(F.col("s"), F.col("t"))).alias("loss"))


def last_layers(student: DataFrame, teacher: DataFrame, last_k: int) -> tuple[DataFrame, DataFrame]:
    """Drop the embedding layer and keep the last K layers of both, numbered by ``pair`` from 0.

    ``projection`` of a student row is its real layer index.
    """
    # one value each: layer counts of the two models
    count = lambda df: df.agg(F.max("layer").alias("n"))
    k = F.least(F.lit(last_k), count(student).scalar(), count(teacher).scalar())

    def kept(df: DataFrame) -> DataFrame:
        offset = count(df).scalar() - k
        return df.where(F.col("layer") > F.greatest(offset, F.lit(0))).withColumn(
            "pair", F.col("layer") - 1 - offset
        )

    return kept(student).withColumn("projection", F.col("layer") - 1), kept(teacher)


def pair_positions(student: DataFrame, teacher: DataFrame, on: Sequence[str]) -> DataFrame:
    """Student and teacher vectors side by side; positions only one side has are trimmed."""
    right = teacher.select(*on, F.col("h").alias("t"), F.col("mask").alias("t_mask"))
    rest = [c for c in student.columns if c not in (*on, "h", "mask")]
    return student.select(*on, *rest, F.col("h").alias("s"), F.col("mask").alias("s_mask")).join(right, list(on))


def use_pooled(step: Column, configured: bool = False) -> Column:
    return (step < WARMUP_STEPS) | F.lit(configured)


def ramped_alpha(step: Column, alpha: float) -> Column:
    return F.least(F.lit(alpha), alpha * step / WARMUP_STEPS)


def guarded_total(df: DataFrame, alpha: float, step: str = "step", ce: str = "loss_xe", kd: str = "loss_kd") -> DataFrame:
    """Blend with the warm-up and the guards against missing and not-a-number losses."""
    bad = F.col(ce).isNull() | F.isnan(ce)
    weight = F.when(bad, F.lit(1.0)).otherwise(ramped_alpha(F.col(step), alpha))
    weighed = df.withColumn("alpha", weight).withColumn(ce, F.when(bad, F.lit(0.0)).otherwise(F.col(ce)))
    total = F.col("alpha") * F.col(kd) + (1 - F.col("alpha")) * F.col(ce)
    return weighed.withColumn("loss_total", F.nanvl(total, F.col(kd)))
