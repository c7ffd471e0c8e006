"""Remove lines that occur before, exactly or nearly, across all documents.

A line is normalised (lower case; ASCII punctuation and digits are spaces) and hashed; different
normal forms get a 64-bit SimHash of their words, weighted by length. SimHashes are cut into blocks,
and lines that agree on ``SHARED`` of ``BLOCKS`` blocks share a bucket: by the pigeonhole principle
that holds for any two that differ in at most ``BLOCKS - SHARED`` bits. Lines of a bucket are linked
if their edit similarity, 1 - distance / length in words, is high enough; a bound from their common
words spares most distances. Of each connected group the first occurrence, by document id and place,
stays.

SimHashes find the tight copies cheaply, but few pairs near the limit. ``complete`` adds a net that loses
none: two lines of at least the similarity have so many words in common that their rarest ones share one
(of a line of n words, the floor of its share of edits and one more). Length, and the parities of the words'
bits, prune pairs on narrow rows; what is left is tested like all others. The order of words is their count
in all texts, where words that share a counter are counted together, and a hash.

Lines of more than ``UNIT`` characters are handled in units of that length, cut at spaces, so that a
line of any length costs a bounded edit distance.

Ids must be sortable. Defined cases: null and empty texts stay as they are; blank lines are never
removed; a line without letters is compared by its other characters; a line whose units are all
removed goes with its line break; rows that repeat whole are one document and get the same result;
an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import bounded_batches, column, mix64, row_key, slices, text_function, unused
from kdframe.llm.groups import common_members, components, grouped, shared_buckets
from kdframe.session import broadcast_if_fits, fits, materialize, release

UNIT = 2000
BLOCKS, SHARED = 4, 2
SHORTEST, HEAVIEST = 4, 12  # a word of fewer bytes has no vote if others have; it weighs as its length, at most the second
SIMILARITY = 80
SIMHASH_UNITS = 256
HASHED_BYTES = 1 << 20  # text whose words are hashed together, at some 50 bytes for each of its bytes
COUNT_SLOTS = 1 << 20  # counters of word hashes
NET_UNITS = 1 << 19  # units that are sorted at a time
BUCKET_MEMBERS = 20_000
SKETCH_BITS = 1024  # of the words of a unit, to decide on pairs before their words are fetched
SKETCHED_UNITS = 1024
WIDE_WORDS, WIDE_BYTES = 96, 64  # a unit of twice so many words has so many bytes of parities beside its net: ``wide``
PAIRS_AT_ONCE = 1 << 20
BROADCAST_UNITS = 1_000_000  # numbers of units, and hashes of the wanted ones
BROADCAST_PAIRS = 1_000_000

#: Bytes of words: ASCII letters and all that isn't ASCII; and, for a line without those, all but white space.
LETTER = np.array([chr(c).isalpha() or c >= 128 for c in range(256)])
VISIBLE = np.array([not chr(c).isspace() or c >= 128 for c in range(256)])
LETTERS = bytes(c if LETTER[c] else 32 for c in range(256))

#: For each byte, its bits as numbers in 16-bit lanes of two words.
LANES = np.zeros((256, 2), dtype=np.uint64)
for _bit in range(8):
    LANES[np.arange(256) >> (7 - _bit) & 1 == 1, _bit // 4] |= np.uint64(1 << 16 * (_bit % 4))


def units(text: str) -> Iterator[tuple[int, str]]:
    """(line number, unit) of a text; the units of a line put together are the line."""
    for number, line in enumerate(text.split("\n")):
        at = 0
        while len(line) - at > UNIT:
            end = line.rfind(" ", at + 1, at + UNIT)
            end = at + UNIT if end <= at else end
            yield number, line[at:end]
            at = end
        yield number, line[at:]


def normal(unit: str) -> list[bytes]:
    """Words of the normal form; none for a blank unit."""
    return unit.lower().encode().translate(LETTERS).split() or unit.encode().split()


def hashed_words(parts: list[str], word_byte: np.ndarray = LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their sizes, and the numbers of their units.

    A word's hash is a polynomial of random byte values, finalised.
    """
    data = np.frombuffer("\n".join(parts).lower().encode(), dtype=np.uint8)
    inside = word_byte[data] & (data != 10)
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    size = end - first
    start = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(start, size)
    value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    power = np.cumprod(np.full(size.max(), 0xD6E8FEB86659FD93, dtype=np.uint64))
    word = mix64(np.add.reduceat(value[data[inside]] * power[place], start))
    return word, size, np.cumsum(data == 10, dtype=np.int32)[first]


def digests(parts: list[str], word_byte: np.ndarray = LETTER, rarity: np.ndarray | None = None, similarity: int = SIMILARITY) -> tuple:
    """Numbers of the units that have words, and the hashes and SimHashes of their words; with ``rarity``, also
    their nets and wide parities.

    A unit's hash is a sum of its words' hashes mixed with their places.
    """
    word, size, unit = hashed_words(parts, word_byte)
    if not len(word):
        empty = tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        return empty if rarity is None else (*empty, *nets(word, np.empty(0, dtype=np.int64), rarity, similarity))
    begin = np.flatnonzero(np.diff(unit, prepend=-1))
    numbers = unit[begin].astype(np.int64)
    nth = np.arange(len(word)) - np.repeat(begin, np.diff(np.append(begin, len(word))))
    whole = np.add.reduceat(mix64(word + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), begin)
    # in a unit of short words only, all vote
    votes = (size >= SHORTEST) | ~np.repeat(np.maximum.reduceat(size, begin) >= SHORTEST, np.diff(np.append(begin, len(word))))
    voters = np.flatnonzero(np.diff(unit[votes], prepend=-1))
    found = numbers, whole.view(np.int64), simhashes(word[votes], np.minimum(size, HEAVIEST)[votes], voters)
    return found if rarity is None else (*found, *nets(word, begin, rarity, similarity))


def rarities(rows: DataFrame) -> np.ndarray:
    """For each counter of word hashes, 128 times the logarithm of its words' count in all of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_SLOTS, dtype=np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text", HASHED_BYTES)):
            word = hashed_words([text or "" for text in column(batch, "text")])[0]
            counts += np.bincount((word >> np.uint64(32)).astype(np.int64) % COUNT_SLOTS, minlength=COUNT_SLOTS)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])

    found = rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_SLOTS)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(128 * np.log2(1 + counts), 4095).astype(np.uint64)


def nets(word: np.ndarray, begin: np.ndarray, rarity: np.ndarray, similarity: int = SIMILARITY) -> tuple[pa.StructArray, pa.Array]:
    """Of each unit the number of its words, the parities of 128 bits of them, and the keys of its rarest words; and
    the wide parities, more of them for longer units, none for those of less than ``WIDE_WORDS``.

    A key has the word's hash in its low half, above it the number of cells that its bucket is dealt to.
    """
    parts = []
    for at in range(0, max(len(begin), 1), NET_UNITS):
        starts = begin[at : at + NET_UNITS]
        low = starts[0] if len(starts) else 0
        high = begin[at + NET_UNITS] if at + NET_UNITS < len(begin) else len(word)
        own, starts = word[low:high], starts - low
        count = np.diff(np.append(starts, len(own)))
        unit = np.repeat(np.arange(len(starts), dtype=np.uint64), count)
        short = own & np.uint64(0xFFFFFFFF)
        order = rarity[(own >> np.uint64(32)).astype(np.int64) % COUNT_SLOTS]
        ranked = np.sort(unit << np.uint64(44) | order << np.uint64(32) | short)
        # a word that repeats is another one each time
        same = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
        nth = (np.arange(len(ranked)) - np.repeat(same, np.diff(np.append(same, len(ranked))))).astype(np.uint64)
        token = mix64((ranked & np.uint64((1 << 44) - 1)) + nth * np.uint64(0x9E3779B97F4A7C15))
        bit = np.uint64(1) << (token >> np.uint64(32) & np.uint64(63))
        upper = token >> np.uint64(40) & np.uint64(1) == 1
        odd = [np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), starts) if len(own) else bit for x in (upper, ~upper)]
        edits = count * (100 - similarity) // 100
        # a line too short for an edit may still be near one that is a word longer
        taken = np.where((count + 1) * (100 - similarity) // 100 > 0, edits + 1, 0)
        offsets = np.append(0, np.cumsum(taken))
        chosen = np.repeat(starts - offsets[:-1], taken) + np.arange(offsets[-1])
        members = np.exp2((ranked[chosen] >> np.uint64(32) & np.uint64(4095)).astype(np.float64) / 128)
        cells = np.ceil(members / BUCKET_MEMBERS).astype(np.uint64)
        keys = (cells << np.uint64(32) | token[chosen] & np.uint64(0xFFFFFFFF)).view(np.int64)
        columns = [
            pa.array(count.astype(np.int32)),
            *(pa.array(x.view(np.int64)) for x in odd),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys)),
        ]
        parts.append((pa.StructArray.from_arrays(columns, names=["n", "odd_a", "odd_b", "keys"]), wide_parities(token, count)))
    return tuple(pa.concat_arrays(x) for x in zip(*parts))


def wide_parities(token: np.ndarray, count: np.ndarray) -> pa.Array:
    """For units of so many words each: the parities of a number of bits that is a power of two and over the number of
    words. Those of a longer unit, folded, compare with those of a shorter one."""
    width = np.where(count < WIDE_WORDS, 0, (4 * WIDE_BYTES) << ((count >= 2 * WIDE_WORDS) + 1 * (count >= 4 * WIDE_WORDS)))
    edges = np.append(0, np.cumsum(width))
    last = np.repeat(width - 1, count)
    place = np.repeat(edges[:-1], count) + ((token >> np.uint64(41)).astype(np.int64) & last)
    odd = np.bincount(place[last >= 0], minlength=edges[-1]) & 1
    data = np.packbits(odd.astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((edges // 8).astype(np.int32)), pa.py_buffer(data)])


def folded(wide: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of the wide parities, from the shortest: the places of all that are as long, or -1, and these,
    folded to that length."""
    length = pc.fill_null(pc.binary_length(wide), 0).to_numpy(zero_copy_only=False)
    own = {int(n): np.flatnonzero(length == n) for n in np.unique(length[length > 0])}
    bits = {n: np.frombuffer(b"".join(wide.take(pa.array(at)).to_pylist()), dtype=np.uint64) for n, at in own.items()}
    found = []
    for size in own:
        longer = [n for n in own if n >= size]
        place = np.full(len(length), -1)
        place[np.concatenate([own[n] for n in longer])] = np.arange((length >= size).sum())
        parts = [np.bitwise_xor.reduce(bits[n].reshape(-1, n // size, size // 8), axis=1) for n in longer]
        found.append((place, np.concatenate(parts)))
    return found


NET = "struct<n:int,odd_a:bigint,odd_b:bigint,keys:array<bigint>>"


def close_pairs(nodes: DataFrame, similarity: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different groups that share a rare word and may be similar enough, from (node, net). ``nodes`` may
    have a ``group``; else each is one of its own.

    ``nearest`` leaves of a bucket's pairs those of each node with the nearest one before and behind it. Nodes may have
    more parities, ``wide``, or null: of two long lines 128 bits tell little.
    """
    more = [name for name in nodes.columns if name in ("group", "wide")]
    rows = nodes.select("node", "net.n", "net.odd_a", "net.odd_b", *more, F.explode("net.keys").alias("key"))
    cells = F.shiftright("key", 32).cast("int")
    block = F.pmod(F.xxhash64("node"), cells).cast("int")
    other = F.explode(F.sequence(F.lit(0), cells - 1))
    dealt = rows.withColumn("block", block).withColumn("other", other)
    dealt = dealt.withColumn("key", F.when(cells == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))))
    ordered = dealt.select("key", "n", "node", "odd_a", "odd_b", *more).repartition("key").sortWithinPartitions("key", "n")

    def paired(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, n, node, odd_a, odd_b = (table.column(i).to_numpy() for i in range(5))
        group = table.column("group").to_numpy() if "group" in more else node
        odd_a, odd_b = odd_a.view(np.uint64), odd_b.view(np.uint64)
        most = n.astype(np.int64) * (100 - similarity) // 100
        wider = folded(table.column("wide").combine_chunks()) if "wide" in more else []
        found: list = []
        held = 0

        def out() -> pa.RecordBatch:
            i, j, far = (np.concatenate(x) for x in zip(*found))
            if nearest:
                near = np.argsort(far, kind="stable")
                keep = np.union1d(*(near[np.unique(x[near], return_index=True)[1]] for x in (i, j)))
                i, j = i[keep], j[keep]
            ends = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])

        i, step = np.arange(len(key)), 0
        while len(i):
            step += 1
            i = i[i + step < len(key)]
            j = i + step
            # rows of a bucket are ordered by length: what is too long, is so for all further steps
            fits = (key[i] == key[j]) & (n[i] >= n[j] - most[j])
            i, j = i[fits], j[fits]
            far = np.bitwise_count(odd_a[i] ^ odd_a[j]).astype(np.int64) + np.bitwise_count(odd_b[i] ^ odd_b[j])
            apart = n[i] - n[j] + 2 * most[j]
            close = (far <= apart) & (group[i] != group[j]) & (node[i] != node[j])
            for place, bits in wider:
                both = np.flatnonzero(close & (place[i] >= 0) & (place[j] >= 0))
                close[both] = np.bitwise_count(bits[place[i[both]]] ^ bits[place[j[both]]]).sum(axis=1, dtype=np.int64) <= apart[both]
            if close.any():
                found.append((i[close], j[close], far[close]))
                held += int(close.sum())
            if held > PAIRS_AT_ONCE:
                yield out()
                found, held = [], 0
        if found:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            # a bucket may go on in the next batch
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (rest and rest[0].column(0)[0].as_py() != keys[0]):
                yield from paired(pa.Table.from_batches([*rest, batch.slice(0, last)]))
                rest = []
            rest.append(batch.slice(last))
        if rest:
            yield from paired(pa.Table.from_batches(rest))

    return ordered.mapInArrow(run, "a long, b long").distinct()


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences, with the columns of the table as bits of a number (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    all_bits, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = all_bits, 0, len(a)
    for y in b:
        match = where.get(y, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(diagonal | plus), plus & diagonal
        score += bool(up & last) - bool(down & last)
        up = up << 1 | 1
        plus = (down << 1 | ~(diagonal | up)) & all_bits
        minus = up & diagonal & all_bits
    return score


def near(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most ``most``. Words that are equal place by place may prove it; those that are
    equal at both ends don't count."""
    least = min(len(a), len(b))
    same = a[:least] == b[:least]
    if len(a) == len(b) and least - np.count_nonzero(same) <= most:
        return True
    first = least if same.all() else int(same.argmin())
    least -= first
    same = a[len(a) - least :][::-1] == b[len(b) - least :][::-1]
    behind = least if same.all() else int(same.argmin())
    x, y = a[first : len(a) - behind].tolist(), b[first : len(b) - behind].tolist()
    longest = max(len(x), len(y))
    if longest <= most:
        return True
    return longest - (Counter(x) & Counter(y)).total() <= most and distance(x, y) <= most


def bag(words: list[int]) -> np.ndarray:
    """Words as a set in which a repeated word is another one each time."""
    order = np.argsort(np.array(words, dtype=np.int64), kind="stable")
    ranked = np.array(words, dtype=np.int64)[order]
    begin = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
    nth = np.arange(len(ranked)) - np.repeat(begin, np.diff(np.append(begin, len(ranked))))
    return (ranked.view(np.uint64) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def simhashes(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of word hashes, the weighted majority of each bit. The weights of a unit add up to less
    than 2**16, so that the lanes of a sum stay apart."""
    out = []
    ends = np.append(starts[1:], len(hashes))
    heavy = weights.astype(np.uint64)[:, None]
    for at in range(0, len(starts), SIMHASH_UNITS):  # a table of lanes that stays in the cache
        a, b = starts[at], ends[min(at + SIMHASH_UNITS, len(starts)) - 1]
        lanes = np.take(LANES, hashes[a:b].view(np.uint8), axis=0).reshape(-1, 16)
        lanes *= heavy[a:b]
        begin = starts[at : at + SIMHASH_UNITS] - a
        votes = np.add.reduceat(lanes, begin, axis=0).view(np.uint16)
        half = np.add.reduceat(weights[a:b], begin) // 2
        out.append(np.packbits(votes > half[:, None], axis=1).view(np.int64).ravel())
    return np.concatenate(out)


def occurrences(docs: DataFrame, rarity: np.ndarray | None = None, similarity: int = SIMILARITY) -> DataFrame:
    """(row, unit, hash, sim) of all units with words, from (row, text); with ``rarity``, also their nets and wide parities."""
    told = None if rarity is None else docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", HASHED_BYTES)):
            owner, place, parts = [], [], []
            for i, text in enumerate(column(batch, "text")):
                own = [unit for _, unit in units(text or "")]
                owner += [i] * len(own)
                place += range(len(own))
                parts += own
            rarity = None if told is None else told.value
            numbers, hashes, sims, *net = digests(parts, rarity=rarity, similarity=similarity)
            rest = np.setdiff1d(np.arange(len(parts)), numbers, assume_unique=True)
            if len(rest):
                more, *found = digests([parts[i] for i in rest], VISIBLE, rarity, similarity)
                numbers = np.concatenate((numbers, rest[more]))
                hashes, sims = (np.concatenate(x) for x in zip((hashes, sims), found))
                net = [pa.concat_arrays(x) for x in zip(net, found[2:])]
            columns = [
                batch.column(0).take(pa.array(np.array(owner, dtype=np.int32)[numbers])),
                pa.array(np.array(place, dtype=np.int32)[numbers]),
                pa.array(hashes),
                pa.array(sims),
                *net,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "unit", "hash", "sim", "net", "wide"][: len(columns)])

    kind = f"row {docs.schema['row'].dataType.simpleString()}, unit int, hash long, sim long"
    return docs.mapInArrow(run, kind if rarity is None else f"{kind}, net {NET}, wide binary")


def block_keys(sim: str, blocks: int, shared: int) -> Column:
    """Bucket keys of a SimHash: one for each choice of ``shared`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for number, chosen in enumerate(itertools.combinations(masks, shared)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.lit(number), F.col(sim).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def close_units(similarity: int):
    """The test of ``grouped`` for a block of units."""

    def prepare(values: pa.ChunkedArray):
        words = values.combine_chunks().field("words").to_pylist()
        size, common_with = common_members(pa.chunked_array([pa.array(list(map(bag, words)), pa.list_(pa.int64()))]))

        def may_pass(i: int) -> np.ndarray:
            longest = np.maximum(size, size[i])
            return longest - common_with(i) <= longest * (100 - similarity) // 100

        def passes(i: int, j: int) -> bool:
            most = max(size[i], size[j]) * (100 - similarity) // 100
            return distance(words[i], words[j]) <= most

        return may_pass, passes

    return prepare


def sketches(word: np.ndarray, count: np.ndarray) -> list[bytes]:
    """For units of so many words each, parities of ``SKETCH_BITS`` bits of their words: two units differ in at most as
    many as they have different words."""
    out = []
    ends = np.cumsum(count)
    for at in range(0, len(count), SKETCHED_UNITS):
        own = count[at : at + SKETCHED_UNITS]
        unit = np.repeat(np.arange(len(own)), own)
        words = word[ends[at] - own[0] : ends[at + len(own) - 1]].view(np.uint64)
        # a word that repeats is another one each time
        order = np.lexsort((words, unit))
        ranked = words[order]
        begin = np.flatnonzero((np.diff(ranked, prepend=~ranked[:1]) != 0) | (np.diff(unit, prepend=-1) != 0))
        nth = np.arange(len(ranked)) - np.repeat(begin, np.diff(np.append(begin, len(ranked))))
        token = mix64(ranked + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bits = unit * SKETCH_BITS + (token % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.bincount(bits, minlength=len(own) * SKETCH_BITS).reshape(-1, SKETCH_BITS) & 1
        out += map(bytes, np.packbits(odd.astype(np.uint8), axis=1))
    return out


def sketch(words: list[int]) -> bytes:
    """The sketch of a single unit."""
    return sketches(np.array(words, dtype=np.int64), np.array([len(words)]))[0]


def differing_bits(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(side), dtype=np.uint64).reshape(len(side), -1) for side in (a, b))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def bounds(sizes: list[np.ndarray], similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most edits between two units, and the most words that then are in one of them only (negative: too far)."""
    longest, shortest = np.maximum(*sizes), np.minimum(*sizes)
    most = longest * (100 - similarity) // 100
    return most, np.where(longest - shortest > most, -1, shortest - longest + 2 * most)


def may_link(similarity: int) -> Callable[..., Column]:
    """Whether units may be similar enough, from their sketches and numbers of words."""

    @F.arrow_udf("boolean")
    def test(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        apart = bounds([n.to_numpy().astype(np.int64) for n in (n_a, n_b)], similarity)[1]
        return pa.array(differing_bits(a.to_pylist(), b.to_pylist()) <= apart)

    return test


def links(similarity: int) -> Callable[..., Column]:
    """Whether units are similar enough, from their words and sketches: cheap bounds first, then the distance."""

    @F.arrow_udf("boolean")
    def test(words_a: pa.Array, words_b: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        sizes = [np.diff(w.offsets.to_numpy()).astype(np.int64) for w in (words_a, words_b)]
        most, apart = bounds(sizes, similarity)
        passed = differing_bits(a.to_pylist(), b.to_pylist()) <= apart
        edges_a, edges_b = words_a.offsets.to_numpy(), words_b.offsets.to_numpy()
        all_a, all_b = words_a.values.to_numpy(), words_b.values.to_numpy()
        for i in np.flatnonzero(passed):
            passed[i] = near(all_a[edges_a[i] : edges_a[i + 1]], all_b[edges_b[i] : edges_b[i + 1]], most[i])
        return pa.array(passed)

    return test


def repeated_units(
    docs: DataFrame, *, id_col: str, text_col: str, similarity: int, blocks: int, shared: int, complete: bool
) -> DataFrame:
    """Per row key of ``docs``: the numbers of the units to remove (``gone``)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key")).alias("row"), F.col(text_col).alias("text"))
    netted = materialize(occurrences(rows, rarities(rows) if complete else None, similarity))
    firsts = materialize(
        netted.groupBy("hash").agg(
            F.min(F.struct("row", "unit")).alias("first"),
            F.count(F.lit(1)).alias("n"),
            *(F.first(name).alias(name) for name in netted.columns[3:]),
        )
    )
    seen = materialize(netted.select("row", "unit", "hash"))
    release(netted)  # nets are needed once for equal units
    members = shared_buckets(firsts.select(F.explode(block_keys("sim", blocks, shared)).alias("key"), F.col("hash").alias("node")))
    wanted = members.select("node").union(members.select("hub"))
    if complete:
        in_net = firsts.where(F.size("net.keys") > 0).select(F.col("hash").alias("node"), "net", "wide")
        nearest = materialize(close_pairs(in_net, similarity, True))
        in_pairs = nearest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = wanted.union(in_pairs)
    wanted = wanted.distinct()
    units_wanted = materialize(firsts.join(wanted, F.col("hash") == F.col("node"), "left_semi").select("first", "hash"))
    place = F.struct(F.col("first.unit").alias("unit"), "hash")
    places = units_wanted.groupBy(F.col("first.row.key").alias("key")).agg(F.collect_list(place).alias("places"))
    if fits(units_wanted, BROADCAST_UNITS):
        places = F.broadcast(places)
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    # rows that repeat whole give the same units again
    found = texts.join(places, "key")
    payload = materialize(unit_values(found).dropDuplicates(["node"]))
    similar = links(similarity)

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where(similar("value_a.words", "value_b.words", "value_a.sketch", "value_b.sketch"))

    def linked_pairs(pairs: DataFrame) -> DataFrame:
        """Sketches decide on most pairs; the words of the others are fetched, without moving all words where the pairs
        are few enough to be told to every task."""
        for x in ("b", "a"):
            told = payload.select(F.col("node").alias(x), F.col("value.sketch").alias(f"sketch_{x}"), F.size("value.words").alias(f"n_{x}"))
            pairs = pairs.join(told, x)
        may = may_link(similarity)
        pairs = materialize(pairs.where(may("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b").distinct())
        told = broadcast_if_fits(pairs, BROADCAST_PAIRS)
        sides = [payload.select(F.col("node").alias(x), F.col("value").alias(f"value_{x}")).join(told, x) for x in ("a", "b")]
        return linked(sides[0].join(sides[1], ["a", "b"])).select("a", "b")

    roots = grouped(members, payload, linked, close_units(similarity), tested=linked_pairs)
    if complete:
        # the nearest pairs join most groups; then all pairs across groups are tested
        roots = materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(linked_pairs(nearest))))
        own = in_net.join(in_pairs, "node").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
        pairs = materialize(close_pairs(own.drop("root"), similarity, False))
        more = materialize(linked_pairs(pairs))
        release(pairs)
        if not more.isEmpty():
            roots = materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    release(payload)
    named = firsts.join(roots.withColumnRenamed("node", "hash"), "hash", "left").drop("sim", "net", "wide")
    alone = named.where("root is null and n > 1").select("hash", F.col("first").alias("kept"))
    several = named.where("root is not null")
    kept = several.groupBy("root").agg(F.min("first").alias("kept"))
    repeated = alone.union(several.join(kept, "root").select("hash", "kept"))
    gone = materialize(seen.join(repeated, "hash").where(F.struct("row", "unit") != F.col("kept")).select(F.col("row.key").alias("key"), "unit"))
    for done in (seen, firsts, units_wanted, members, *([nearest] if complete else [])):
        release(done)
    listed = gone.groupBy("key").agg(F.sort_array(F.collect_set("unit")).alias("gone"))
    return F.broadcast(listed) if fits(gone, BROADCAST_UNITS) else listed.hint("shuffle_hash")


def valued(parts: list[str]) -> pa.StructArray:
    """The words, as hashes, and sketches of units."""
    word, _, unit = hashed_words(parts)
    rest = np.setdiff1d(np.arange(len(parts)), unit)
    if len(rest):
        more, _, of = hashed_words([parts[i] for i in rest], VISIBLE)
        word, unit = np.concatenate((word, more)), np.concatenate((unit, rest[of]))
        order = np.argsort(unit, kind="stable")
        word, unit = word[order], unit[order]
    count = np.bincount(unit, minlength=len(parts))
    words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(word.view(np.int64)))
    return pa.StructArray.from_arrays([words, pa.array(sketches(word, count), pa.binary())], names=["words", "sketch"])


def unit_values(placed: DataFrame) -> DataFrame:
    """(node, value) of the chosen units, from (text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", HASHED_BYTES)):
            nodes, parts = [], []
            for text, places in zip(column(batch, "text"), column(batch, "places")):
                own = [unit for _, unit in units(text or "")]
                nodes += [place["hash"] for place in places]
                parts += [own[place["unit"]] for place in places]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), valued(parts)], names=["node", "value"])

    return placed.select("text", "places").mapInArrow(run, "node long, value struct<words:array<bigint>,sketch:binary>")


def removed() -> Callable[[list, list], list]:
    """A text without units; None where nothing is removed."""

    def remove(texts: list, numbers: list) -> list:
        out = []
        for text, gone in zip(texts, numbers):
            if not gone:
                out.append(None)
                continue
            skip, lines = set(gone), {}
            for at, (number, unit) in enumerate(units(text)):
                if at not in skip:
                    lines.setdefault(number, []).append(unit)
            out.append("\n".join("".join(parts) for parts in lines.values()))
        return out

    return remove


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: int = SIMILARITY,
    blocks: int = BLOCKS,
    shared: int = SHARED,
    complete: bool = True,
    removed_col: str | None = None,
) -> DataFrame:
    """``docs`` with repeated lines removed from the text. ``removed_col`` names a column for their number.

    ``complete`` finds all pairs of at least ``similarity``; without it, only those that share SimHash blocks.
    """
    limits = {"similarity": similarity, "blocks": blocks, "shared": shared, "complete": complete}
    gone = repeated_units(docs, id_col=id_col, text_col=text_col, **limits)
    key, out = unused("_key", docs), unused("_gone", docs)
    gone = gone.withColumnsRenamed({"key": key, "gone": out})
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(gone, key, "left")
    remove = text_function("string", removed, "array<int>", once=True)
    cleaned = joined.withColumn(text_col, F.coalesce(remove(text_col, F.col(out)), text_col))
    if removed_col:
        cleaned = cleaned.withColumn(removed_col, F.coalesce(F.size(out), F.lit(0)).cast("long"))
    return cleaned.drop(key, out)
