"""Groups of near-duplicate documents by one-permutation hashing.

One hash of each word shingle serves all bins: its high bits choose a bin, the smallest hash of a bin
is its value, and an empty bin borrows from the first non-empty one of its own probe sequence
(optimal densification). Bands of bins are bucket keys. Documents with equal shingle sets are one node
with the smallest id; nodes that share a bucket are linked when their full sets are similar enough
(``groups``).

With 32 bands of 6 bins, a pair at the limit of 0.8 shares no bucket with a probability of 6e-5.

Ids are longs. Defined cases: null, empty and wordless texts have no shingles and are linked with
nothing; a text of fewer words than a shingle is one shingle; rows that share an id are one document,
which has all their links; a row without id belongs to the group of an equal text that has one, else
to none (null); an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import column, mix64, slices, unused
from kdframe.llm.groups import common_members, grouped, shared_buckets
from kdframe.session import broadcast_if_fits, materialize

WORDS = 5
SIMILARITY = 80
BANDS, ROWS = 32, 6
BROADCAST_IDS = 1_000_000

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, ASCII letters lower-cased."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    size = min(words, len(hashed))
    mixed = np.full(len(hashed) - size + 1, size, dtype=np.uint64)
    for at in range(size):
        mixed = mix64(mixed * np.uint64(31) + hashed[at : len(hashed) - size + 1 + at])
    return np.unique(mixed)


class Sketch:
    """Band keys of a sorted shingle set."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.probes: list[np.ndarray] = []

    def probe(self, attempt: int) -> np.ndarray:
        """The bin that each bin borrows from at an attempt."""
        while len(self.probes) <= attempt:
            seed = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, self.bins + 1, dtype=np.uint64)
            self.probes.append((mix64(seed + np.uint64(len(self.probes))) % np.uint64(self.bins)).astype(np.int64))
        return self.probes[attempt]

    def values(self, hashes: np.ndarray) -> np.ndarray:
        bin_of = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bin_of, prepend=-1))
        own = np.zeros(self.bins, dtype=bool)
        own[bin_of[first]] = True
        value = np.full(self.bins, EMPTY)
        value[bin_of[first]] = hashes[first]
        todo, attempt = np.flatnonzero(~own), 0
        while len(todo):
            source = self.probe(attempt)[todo]
            filled = own[source]
            value[todo[filled]] = value[source[filled]]
            todo = todo[~filled]
            attempt += 1
        return value

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        value = self.values(hashes).reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for at in range(self.rows):
            key = mix64(key * np.uint64(31) + value[:, at])
        return key.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row of (doc_id, text): size and 128-bit digest of its set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(bands, rows)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sizes, high, low, keys = [], [], [], []
            for text in column(batch, "text"):
                found = shingles(text, words)
                sizes.append(len(found))
                digest = xxhash.xxh3_128_intdigest(found) if len(found) else None
                high.append(None if digest is None else (digest >> 64) - (1 << 63))
                low.append(None if digest is None else (digest & (1 << 64) - 1) - (1 << 63))
                keys.append(sketch.keys(found) if len(found) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
            columns.append(pa.array(keys, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_shingles", "high", "low", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, high long, low long, keys array<long>")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, value) of rows of (doc_id, text): the hashes of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found = [shingles(text, words).view(np.int64) for text in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "value"])

    return docs.mapInArrow(run, "node long, value array<long>")


def similar_sets(similarity: int):
    """The test of ``grouped`` for a block of sets: which are similar enough to one of them."""

    def prepare(values: pa.ChunkedArray):
        size, common_with = common_members(values)

        def test(i: int) -> np.ndarray:
            common = common_with(i)
            return 100 * common >= similarity * (size[i] + size - common)

        return test, None

    return prepare


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id of its group.

    ``similarity`` is the least Jaccard similarity of linked sets in per cent.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(texts, words, bands, rows))
    nodes = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("high", "low")
        .agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
    )
    nodes = materialize(nodes)
    members = shared_buckets(nodes.select(F.explode("keys").alias("key"), "node"))
    wanted = members.select(F.col("node").alias("doc_id")).union(members.select("hub")).distinct()
    chosen = texts.join(broadcast_if_fits(materialize(wanted), BROADCAST_IDS), "doc_id", "left_semi")
    payload = materialize(sets(chosen.dropDuplicates(), words))

    def linked(pairs: DataFrame) -> DataFrame:
        size_a, size_b = F.size("value_a"), F.size("value_b")
        may = 100 * F.least(size_a, size_b) >= similarity * F.greatest(size_a, size_b)
        common = F.size(F.array_intersect("value_a", "value_b"))
        return pairs.where(may).where(100 * common >= similarity * (size_a + size_b - common))

    roots = grouped(members, payload, linked, similar_sets(similarity))
    return (
        signed.drop("keys")
        .join(nodes.drop("keys"), ["high", "low"], "left")
        .join(roots, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def is_kept() -> Column:
    """Whether a row of ``near_duplicates`` is the one of its group that stays."""
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents of a group but the one with the smallest id; rows without id stay."""
    gone = near_duplicates(docs, id_col=id_col, **options).where(~is_kept())
    name = unused("_gone", docs)
    known = broadcast_if_fits(materialize(gone.select(F.col("doc_id").alias(name)).distinct()), BROADCAST_IDS)
    return docs.join(known, F.col(id_col) == F.col(name), "left_anti")
