"""Pack token sequences into windows of a fixed capacity by Karmarkar-Karp differencing.

A document is its token ids and one separator id. Whole windows are cut off its front; only the
remainders are packed. Remainders go round-robin to groups of a bounded size and are cut into parts
of at most ``CUT`` ids. In each group, multiway differencing merges partial partitions with opposing
imbalances into near-equal windows, and the window count rises whenever capacity is exceeded.

Defined cases: a null or empty text is a document of one separator; repeated rows are packed one
by one; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import column, slices
from kdframe.session import materialize

WINDOW = 1024
GROUP_ITEMS = 1024
#: Most ids of a part. Smaller parts make the windows more equal, and more pieces.
CUT = 256
#: Text bytes that are encoded at a time.
ENCODED_BYTES = 1 << 20

#: Characters of which both libraries have the same classes; other texts go to the slower one.
COMMON = re.compile("[^\x00-ɏ‐-‧€]")

#: How the ranks' vocabulary cuts a text before its merges (a fixed value).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECE = "doc_id {id}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long"


@functools.lru_cache(maxsize=2)
def encoder(definition: bytes, ranks: bytes | None) -> Callable[[str], np.ndarray]:
    """Token ids of a text. With ``ranks``, the same vocabulary as byte ranks, usual texts take the faster library; the
    other one, which takes more memory, is loaded for the first text that needs it."""

    @functools.cache
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_str(definition.decode())

    if ranks is None:
        return lambda text: np.array(exact().encode(text, add_special_tokens=False).ids, dtype=np.int32)
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    special = {t["content"]: t["id"] for t in json.loads(definition)["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=PRETOKENS, mergeable_ranks=merges, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if COMMON.search(text):
            return np.array(exact().encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return fast.encode_to_numpy(text, allowed_special="all").astype(np.int32)

    return encode


def crc(ids: np.ndarray) -> int:
    """Checksum of ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def tokenize(
    docs: DataFrame,
    definition: str,
    ranks: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: int = 0,
    window: int = WINDOW,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per whole window and remainder of a document, in a table in the shared folder.

    ``definition`` and ``ranks`` are files that the driver reads; tasks get their content.
    ``serial`` numbers the rows of the table. Without ``keep_ids``, whole windows carry no ids.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    content = tuple(open(f, "rb").read() if f else None for f in (definition, ranks))
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*shared.value)
        serial = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole, "text", ENCODED_BYTES)):
            source, starts, lengths, kept, sums, totals = [], [], [], [], [], []
            for i, text in enumerate(column(batch, "text")):
                ids = np.append(encode(text or ""), np.int32(separator))
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    source.append(i)
                    starts.append(at)
                    lengths.append(len(piece))
                    kept.append(piece if keep_ids or len(piece) < window else None)
                    sums.append(crc(piece))
                    totals.append(len(ids))
            names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "serial"]
            numbers = np.arange(serial, serial + len(source), dtype=np.int64)
            serial += len(source)
            columns = [
                batch.column(0).take(pa.array(source, pa.int32())),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(kept, pa.list_(pa.int32())),
                pa.array(sums, pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array(numbers),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return materialize(rows.mapInArrow(run, f"{PIECE.format(id=kind)}, serial long"))


def merged(left: list[int], right: list[int], windows: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Two partitions in one: the largest sums of ``right`` on the smallest of ``left``, empty windows first.
    Sums rise; with each goes its place in ``left`` and in ``right``, or -1."""
    alone = min(len(right), windows - len(left))
    paired = len(right) - alone
    found = [(s, i, -1) for i, s in enumerate(left)]
    found += [(right[j], -1, j) for j in range(paired, len(right))]
    for i in range(paired):
        found[i] = (left[i] + right[paired - 1 - i], i, paired - 1 - i)
    found.sort()
    return [s for s, _, _ in found], [(i, j) for _, i, j in found]


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """A window for each item. The two partitions with the largest spreads are merged, the largest sums of
    one with the smallest of the other, until one partition is left. A partition keeps its sums in rising
    order and leaves out empty windows. Nearly all merges add one item; they only move one sum."""
    if windows <= 1 or len(lengths) < 2:
        return np.zeros(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable").tolist()
    sums: list = [[int(lengths[i])] for i in order]
    made: list = [None] * len(order)
    heap = [(-own[0], at) for at, own in enumerate(sums)]
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        if len(sums[a]) < len(sums[b]):
            a, b = b, a
        total, right = sums[a], sums[b]
        sums[a] = sums[b] = None
        if len(right) == 1:
            full = len(total) == windows
            value = right[0] + (total.pop(0) if full else 0)
            place = bisect.bisect_left(total, value)
            total.insert(place, value)
            made.append((a, b, place, full))
        else:
            total, places = merged(total, right, windows)
            made.append((a, b, places, None))
        sums.append(total)
        low = total[0] if len(total) == windows else 0
        heapq.heappush(heap, (low - total[-1], len(sums) - 1))
    window = np.empty(len(order), dtype=np.int64)
    where = {len(sums) - 1: list(range(len(sums[-1])))}
    for at in range(len(sums) - 1, -1, -1):
        slots = where.pop(at)
        if made[at] is None:
            window[order[at]] = slots[0]
            continue
        a, b, places, full = made[at]
        if full is None:
            of_left = sorted((i, slot) for slot, (i, _) in zip(slots, places) if i >= 0)
            of_right = sorted((j, slot) for slot, (_, j) in zip(slots, places) if j >= 0)
            where[a], where[b] = [slot for _, slot in of_left], [slot for _, slot in of_right]
        else:
            slot = slots.pop(places)
            if full:
                slots.insert(0, slot)
            where[a], where[b] = slots, [slot]
    return window


def fill(lengths: np.ndarray, capacity: int, cut: int = CUT) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in the item, length, window, offset) that cover all items.

    Items are cut into parts of ``cut`` and a last, shorter one, and the parts are differenced into as few windows
    as their sum needs. While a window is above capacity, the count rises, by what brings the mean down by
    half of the excess, and the parts are differenced again.
    """
    cut = min(cut, capacity)
    lengths = np.asarray(lengths, dtype=np.int64)
    parts = -(-lengths // cut)
    item = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = number * cut
    size = np.minimum(lengths[item] - start, cut)
    count = int(-(-lengths.sum() // capacity))
    while True:
        window = differencing(size, count)
        excess = int(np.bincount(window, weights=size, minlength=1).max()) - capacity
        if excess <= 0:
            break
        count += max(1, excess * count // (2 * capacity))
    pieces: list[tuple[int, int, int, int, int]] = []
    used = 0
    for i in np.lexsort((start, item, window)).tolist():
        own, first, long, at = int(item[i]), int(start[i]), int(size[i]), int(window[i])
        last = pieces[-1] if pieces else None
        if last is None or last[3] != at:
            used = 0
        if used and last[0] == own and last[1] + last[2] == first:
            pieces[-1] = (own, last[1], last[2] + long, at, last[4])
        else:
            pieces.append((own, first, long, at, used))
        used += long
    return pieces


def pack(pieces: DataFrame, *, window: int = WINDOW, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Place the rows of ``tokenize`` in sequences: their columns, ``sequence_id`` and ``offset``.

    Whole windows are sequences of their own and aren't shuffled. Serial numbers deal the remainders
    to groups evenly, whatever their documents are, so a group has about ``group_items`` of them.
    """
    rest = pieces.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group_items))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("serial")
        found = fill(rows.column("length").to_numpy(), window)
        item, start, size, at, offset = np.array(found, dtype=np.int64).reshape(-1, 5).T
        ids = rows.column("ids").combine_chunks()
        values, edges = ids.values.to_numpy(), np.append(0, np.cumsum(size))
        own = values[np.repeat(ids.offsets.to_numpy()[item] + start - edges[:-1], size) + np.arange(edges[-1])]
        columns = [
            rows.column("doc_id").take(pa.array(item)),
            pa.array(rows.column("start").to_numpy()[item] + start),
            pa.array(size),
            pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(own)),
            pa.array([crc(own[a:b]) for a, b in zip(edges, edges[1:])], pa.int64()),
            rows.column("doc_tokens").take(pa.array(item)),
            pa.array((key[0].as_py() << 20 | at) * 2),
            pa.array(offset),
        ]
        return pa.table(columns, names=names)

    # multiplying by an odd number spreads a partition's serial numbers over all groups
    dealt = rest.withColumn("group", F.pmod(F.col("serial") + F.shiftright("serial", 40) * F.lit(7919), F.lit(groups)))
    schema = f"{PIECE.format(id=kind)}, sequence_id long, offset long"
    packed = dealt.groupBy("group").applyInArrow(run, schema)
    whole = pieces.where(F.col("length") == window).select(
        *names[:6], (F.col("serial") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return whole.unionByName(packed)
