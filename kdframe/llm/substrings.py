"""Remove passages that occur before in another document, with prefix-partitioned suffix trees.

A suffix starts at each word that has ``window`` words behind it, and is cut to that length. Its group
is chosen by its variable-length prefix: of the runs of ``gram`` words in the window the one with the
smallest hash ends the prefix, and that run names the group. Equal windows so have equal prefixes, and
suffixes that follow each other mostly share their run; they travel as one segment of words. Groups
with one document only are dropped before any word travels; equal segments are one with the smallest
document. Where different segments are left in a group, the subtree over its suffixes is built top
down, word by word: internal nodes of the full depth are maximal repeats, and the smallest document
below such a node keeps its words. A group above ``GROUP`` suffixes gets the longest prefix, the whole
window: each of its subtrees is one deep node, whose smallest document is an aggregate.

A word is removed if it is covered by a window that also starts in a document with a smaller id; all
windows are judged on the input. Words are compared by 64-bit hashes.

Ids are longs. Defined cases: null, empty and wordless texts, and texts of fewer words than a window,
lose nothing; a row without id is neither compared nor changed; rows that share an id never repeat each
other; rows that repeat whole get the same result; an empty table gives an empty result; other columns
are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import KeyFilter, mix64, row_key, slices, text_function, unused, whole_keys
from kdframe.session import broadcast_if_fits, materialize

WINDOW = 50
LARGEST_SEGMENT = 60  # suffixes; a bit of a long tells of each
GROUP = 50_000
CHUNK = 1 << 20  # words of a text that are looked at together
PART_BYTES = 4 << 20
BROADCAST_IDS = 1_000_000

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACES = b" \t\n\v\f\r"


def gram_size(window: int) -> int:
    return max(window // 2, window + 1 - LARGEST_SEGMENT, 1)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in parts of a bounded size."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        end = min(at + PART_BYTES, len(data))
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[at:end].split()
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)) for part in words_of(text)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


class Rolling:
    """Hashes of all runs of equal length, by prefix sums of a polynomial."""

    def __init__(self):
        self.power, self.back = (np.ones(1, dtype=np.uint64) for _ in range(2))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(hashes):
            size = 2 * len(hashes)
            self.power, self.back = (np.cumprod(np.append(np.uint64(1), np.full(size, b))) for b in (BASE, INVERSE))
        return np.append(np.uint64(0), np.cumsum(hashes * self.power[: len(hashes)]))

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self.back[start])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    done = 1
    while 2 * done <= width:
        values, done = np.minimum(values[:-done], values[done:]), 2 * done
    more = width - done
    return np.minimum(values[: len(values) - more], values[more:]) if more else values


def segments_of(hashes: np.ndarray, window: int, rolling: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, digest, first suffix, number of suffixes) of the segments of a text."""
    gram = gram_size(window)
    for at in range(0, len(hashes) - window + 1, CHUNK):
        part = hashes[at : at + CHUNK + window - 1]
        sums = rolling.sums(part)
        starts = np.arange(len(part) - gram + 1)
        grams = rolling.between(sums, starts, starts + gram)
        # the place breaks ties: the first run of the window
        place = np.uint64((1 << 21) - 1)
        chosen = (lowest(grams & ~place | starts.astype(np.uint64), window - gram + 1) & place).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        count = np.diff(np.append(first, len(chosen)))
        digest = rolling.between(sums, first, first + count + window - 1) + count.astype(np.uint64)
        yield grams[chosen[first]].view(np.int64), mix64(digest).view(np.int64), first + at, count


def segments(docs: DataFrame, window: int) -> DataFrame:
    """(doc, row, key, digest, start, n) of all segments of (doc, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            owner, found = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for columns in segments_of(word_hashes(text), window, rolling):
                    owner.append(np.full(len(columns[0]), i, dtype=np.int32))
                    found.append(columns)
            if found:
                owners = pa.array(np.concatenate(owner))
                key, digest, start, n = (np.concatenate(x) for x in zip(*found))
                own = [batch.column(0).take(owners), batch.column(1).take(owners)]
                rest = [pa.array(key), pa.array(digest), pa.array(start), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(own + rest, names=["doc", "row", "key", "digest", "start", "n"])

    return docs.mapInArrow(run, "doc long, row long, key long, digest long, start long, n int")


def deep_nodes(node: np.ndarray, depth: int, word: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Top-down subtrees: the suffixes below internal nodes of the depth, and the numbers of these nodes.

    ``node``: the number of the root above each suffix. ``word`` gives the words of suffixes at a depth.
    """
    alive = np.arange(len(node))
    for at in range(depth + 1):
        # a node with one suffix is a leaf
        _, node, size = np.unique(node, return_inverse=True, return_counts=True)
        inner = size[node] > 1
        alive, node = alive[inner], node[inner]
        if at == depth or not len(alive):
            return alive, node
        symbol = word(alive, at)
        order = np.lexsort((symbol, node))
        edge = (np.diff(node[order], prepend=-1) != 0) | (np.diff(symbol[order], prepend=~symbol[order[:1]]) != 0)
        split = np.empty_like(node)
        split[order] = np.cumsum(edge)
        node = split
    raise AssertionError


def repeated_bits(segment: pa.Table, window: int) -> np.ndarray:
    """Per segment (key, digest, doc, n, words) a bit for each suffix that starts in a smaller document, too."""
    key, doc, n = (segment.column(name).to_numpy() for name in ("key", "doc", "n"))
    words = segment.column("words").combine_chunks()
    flat, base = words.flatten().to_numpy(), words.offsets.to_numpy().astype(np.int64)[:-1]
    base = base - words.offsets[0].as_py()
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = base[owner] + offset
    root = np.unique(key, return_inverse=True)[1]
    alive, node = deep_nodes(root[owner], window, lambda which, at: flat[start[which] + at])
    bits = np.zeros(len(n), dtype=np.uint64)
    if len(alive):
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[owner[alive]])
        late = alive[doc[owner[alive]] > least[node]]
        np.bitwise_or.at(bits, owner[late], np.uint64(1) << offset[late].astype(np.uint64))
    return bits.view(np.int64)


def picked(window: int) -> Callable[[], Callable[[list, list, list], list]]:
    """The hashed words of chosen segments."""

    def make():
        def pick(texts: list, starts: list, counts: list) -> list:
            out = []
            for text, start, count in zip(texts, starts, counts):
                hashes = word_hashes(text).view(np.int64)
                out.append([hashes[a : a + n + window - 1] for a, n in zip(start, count)])
            return out

        return pick

    return make


def differing(classes: DataFrame, texts: DataFrame, window: int, group: int) -> DataFrame:
    """(key, digest, bits) of segments of groups that have several: their suffixes that start in a smaller document."""
    groups = classes.groupBy("key").agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("suffixes")).where("segments > 1")
    wanted = materialize(classes.join(groups.drop("segments"), "key"))
    places = wanted.groupBy(F.col("first.row").alias("row")).agg(
        F.collect_list(F.struct("key", "digest", F.col("first.doc").alias("doc"), F.col("first.start").alias("start"), "n", "suffixes")).alias("places")
    )
    ids = broadcast_if_fits(materialize(places.select("row")), BROADCAST_IDS)
    chosen = texts.join(ids, "row", "left_semi").join(places, "row")
    pick = text_function("array<array<bigint>>", picked(window), "array<bigint>", "array<int>")
    fetched = chosen.select("places", pick("text", F.col("places.start"), F.col("places.n")).alias("words"))
    fetched = fetched.select(F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("words").alias("words"))).alias("x"))
    fetched = materialize(fetched.select("x.place.key", "x.place.digest", "x.place.doc", "x.place.n", "x.place.suffixes", "x.words").dropDuplicates(["key", "digest"]))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, max(1, group // LARGEST_SEGMENT)):
            columns = [table.column("key").combine_chunks(), table.column("digest").combine_chunks(), pa.array(repeated_bits(table, window))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "digest", "bits"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for i, words in enumerate(batch.column(4)):
                sums = rolling.sums(words.values.to_numpy().view(np.uint64))
                start = np.arange(batch.column(3)[i].as_py())
                hashed = rolling.between(sums, start, start + window).view(np.int64)
                own = [batch.column(at).take(pa.array(np.zeros_like(start) + i)) for at in range(3)]
                bits = pa.array((np.uint64(1) << start.astype(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([*own, bits, pa.array(hashed)], names=["key", "digest", "doc", "bits", "window"])

    rows = fetched.select("key", "digest", "doc", "n", "words", "suffixes")
    small = rows.where(F.col("suffixes") <= group).drop("suffixes")
    # the exchange after repartition is Spark's to split no more: only groups within the bound take it
    found = small.repartition("key").sortWithinPartitions("key").mapInArrow(subtrees, "key long, digest long, bits long")
    large = rows.where(F.col("suffixes") > group).drop("suffixes")
    if not large.isEmpty():
        nodes = materialize(large.mapInArrow(windows, "key long, digest long, doc long, bits long, window long"))
        least = nodes.groupBy("window").agg(F.min("doc").alias("least"))
        late = nodes.join(least, "window").where("doc > least")
        found = found.union(late.groupBy("key", "digest").agg(F.bit_or("bits").alias("bits")))
    return found.where("bits != 0")


def covered(starts: list, bits: list, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans that windows cover, apart from each other, from segments' starts and bits."""
    first = np.array(starts, dtype=np.int64)
    flags = np.array(bits, dtype=np.int64).view(np.uint64)
    offset = np.arange(LARGEST_SEGMENT)
    chosen = flags[:, None] >> offset.astype(np.uint64) & np.uint64(1) == 1
    at = np.unique((first[:, None] + offset)[chosen])
    edge = np.flatnonzero(np.diff(at) > window)
    return at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)] + window


def repeated_passages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    group: int = GROUP,
    into: str = "passages",
) -> DataFrame:
    """``docs`` with the column ``into``: the spans (starts and ends, in words) of passages that occur in a document
    with a smaller id; null if there are none."""
    row = row_key(id_col, text_col)
    texts = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), row.alias("row"), F.col(text_col).alias("text"))
    seen = materialize(segments(known, window))
    shared = materialize(seen.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key"))
    told = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(shared))

    @F.arrow_udf("boolean")
    def may_be_shared(keys: pa.Array) -> pa.Array:
        return pa.array(told.value.has(keys.to_numpy()))

    found = materialize(seen.where(may_be_shared("key")).join(shared, "key", "left_semi"))
    classes = materialize(
        found.groupBy("key", "digest").agg(F.min(F.struct("doc", "row", "start")).alias("first"), F.max("doc").alias("high"), F.min("n").alias("n"))
    )
    bits = materialize(differing(classes, texts, window, group))
    late = classes.select("key", "digest", F.col("first.doc").alias("low"), "high").join(bits, ["key", "digest"], "left")
    late = materialize(late.where("low < high or bits is not null").drop("high"))  # so that Spark can split a hot key of the join
    # the smallest document of equal segments loses what its tree says, the others lose all
    whole = F.expr("shiftleft(1L, n) - 1")
    marked = found.join(late, ["key", "digest"]).select("row", "start", F.when(F.col("doc") > F.col("low"), whole).otherwise(F.col("bits")).alias("bits"))
    listed = marked.where("bits is not null").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "bits"))).alias("bits"))

    @F.arrow_udf("struct<starts:array<bigint>,ends:array<bigint>>")
    def spanned(starts: pa.Array, bits: pa.Array) -> pa.Array:
        kind = pa.struct({"starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())})
        ends = (covered(s, b, window) for s, b in zip(starts.to_pylist(), bits.to_pylist()))
        return pa.array([{"starts": a, "ends": b} for a, b in ends], kind)

    key = unused("_row", docs)
    spans = listed.select(F.col("row").alias(key), spanned("bits.start", "bits.bits").alias(into))
    return docs.withColumn(key, row).join(spans.hint("shuffle_hash"), key, "left").drop(key)


def kept_words(text: str | None, starts: list | None, ends: list | None) -> tuple[int, list[bytes]]:
    """The number of words and those outside of the spans."""
    words = [word for part in words_of(text) for word in part]
    kept, at = [], 0
    for a, b in zip(starts or (), ends or ()):
        kept += words[at:a]
        at = b
    return len(words), kept + words[at:]


def digest(text: str, spans: str = "passages") -> Column:
    """Of texts and their spans: the number of words, of removed words, and the SHA-256 of kept words joined by a space."""

    def make():
        def judge(texts: list, starts: list, ends: list) -> list:
            out = []
            for text, a, b in zip(texts, starts, ends):
                n, kept = kept_words(text, a, b)
                out.append({"n_words": n, "n_removed": n - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()})
            return out

        return judge

    kind = "struct<n_words:bigint,n_removed:bigint,kept_sha256:string>"
    return text_function(kind, make, "array<bigint>", "array<bigint>")(text, F.col(f"{spans}.starts"), F.col(f"{spans}.ends"))


def drop_passages(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the repeated passages: the kept words of a text that loses some are joined by a space."""

    def make():
        def cut(texts: list, starts: list, ends: list) -> list:
            return [None if not a else b" ".join(kept_words(t, a, b)[1]).decode() for t, a, b in zip(texts, starts, ends)]

        return cut

    spans = unused("_passages", docs)
    marked = repeated_passages(docs, text_col=text_col, into=spans, **options)
    cut = text_function("string", make, "array<bigint>", "array<bigint>")(text_col, F.col(f"{spans}.starts"), F.col(f"{spans}.ends"))
    return marked.withColumn(text_col, F.coalesce(cut, text_col)).drop(spans)
