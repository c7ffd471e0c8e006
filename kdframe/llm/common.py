"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Text bytes that a Python worker holds as Python strings at a time.
SLICE_BYTES = 4 << 20

#: White space of the word contracts: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have a bounded size also where rows are whole texts: executors and Python
    workers hold a few of them for each task, outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def cuts(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (start, length) of rows that have about ``size`` bytes of text each, or are one row."""
    if len(texts):
        sizes = pc.fill_null(pc.binary_length(texts), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for start, end in zip(edges, edges[1:]):
            yield start, end - start


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts of a bounded amount of text."""
    for start, length in cuts(batch.column(batch.schema.get_field_index(text)), size):
        yield batch.slice(start, length)


def text_function(kind: str, make: Callable[[], Callable[..., list]], *more: str, once: bool = False) -> Callable[..., Column]:
    """A column function of a text, and of columns of the types ``more``, that runs in Python on Arrow batches.

    ``make`` is called once in a task and returns a function from a list of texts, of a bounded total
    length (and lists of the other columns' values), to a list of values of type ``kind``. The row's
    other columns stay in the JVM. With ``once``, conditions on the value don't compute it anew.
    """
    arrow = to_arrow_type(_parse_datatype_string(kind))

    def answers(apply: Callable[..., list], columns: tuple[pa.Array, ...]) -> pa.Array:
        parts = [pa.array(apply(*(c.slice(a, n).to_pylist() for c in columns)), arrow) for a, n in cuts(columns[0])]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for texts in batches:
            yield answers(apply, (texts,))

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        apply = make()
        for columns in batches:
            yield answers(apply, columns)

    function = F.arrow_udf(several if more else one, kind)
    return function.asNondeterministic() if once else function


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, elementwise."""
    x = x.astype(np.uint64, copy=True)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside other higher-order functions."""
    return F.transform(F.array(value), body)[0]


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no table has a column of that name."""
    taken = {column.lower() for table in tables for column in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*names: str) -> Column:
    """A 64-bit key for a row with these columns; rows that repeat share it."""
    return F.xxhash64(*names)


#: Bits of a ``KeyFilter`` for each key, and at most (16 MB).
KEY_BITS, MOST_BITS = 16, 1 << 27


class KeyFilter:
    """Bitmap of 64-bit hash keys, of a bounded size, to be broadcast. It errs only towards keeping a key."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        """From a column of hashes; two bits of each, united in the cluster."""
        (key,) = keys.columns
        size = min(MOST_BITS, 1 << max(10, (KEY_BITS * keys.count()).bit_length()))
        places = F.explode(F.array(F.col(key), F.shiftrightunsigned(key, 37))).alias("place")
        placed = keys.select(places).select(F.col("place").bitwiseAND(F.lit(size - 1)).alias("place"))
        bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
        found = placed.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(size // 64, dtype=np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for place in (keys.view(np.uint64), keys.view(np.uint64) >> np.uint64(37)):
            place = place & self.mask
            found &= self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1
        return found


def whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables of at least ``least`` rows that hold whole keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and len(batch) and sum(map(len, held)) >= least:
            # the key of the last row held may go on in this batch
            other = np.flatnonzero(batch.column(0).to_numpy() != held[-1].column(0)[-1].as_py())
            if len(other):
                yield pa.Table.from_batches([*held, batch.slice(0, int(other[0]))])
                held, batch = [], batch.slice(int(other[0]))
        if len(batch):
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
