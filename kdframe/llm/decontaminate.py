"""Find and remove benchmark passages with a generalised suffix automaton of the benchmark's items.

The items' words are the symbols. Documents stream through the automaton, which tracks the length of
the longest match that ends at each word. A match of at least ``window`` words (or a whole item of
fewer) makes its words hits. Spans of hits longer than a limit are cut out of a text, and a document
of which hits cover too much goes.

The automaton is broadcast; its size is bounded by the words of a block of items. A benchmark above
the bound is dealt to several blocks in Spark. A long item is cut into parts that overlap by all but one
word of a window, so that each window is in one part. The driver holds one block at a time, each block is
streamed against all documents, and the hits of all are united.

Defined cases: null or wordless texts have no hits, null or wordless items have no window; an item
without id counts as the empty id; repeated items count once; rows that repeat get the same result;
an empty benchmark hits nothing; extra columns are kept as they are, but for one named like the result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import row_key, text_function, unused
from kdframe.operators.ranking import prefix_sum
from kdframe.session import fresh_path, materialize, release

WINDOW = 13
SHARE = 20
BLOCK_WORDS = 500_000

#: ASCII letters lower-cased, digits kept, all other ASCII to a space; what isn't ASCII stays part of a word.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)


#: A word in a text whose letters keep their case.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def without(text: str, spans: Iterable[tuple[int, int]], least: int) -> str | None:
    """The text without spans (of word numbers) of at least ``least`` words; None if there are none."""
    long = [(a, b) for a, b in spans if b - a >= least]
    if not long:
        return None
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in long:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join((*kept, text[at:]))


class Automaton:
    """Suffix automaton of several word sequences; no path crosses from one item into the next."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        whole: dict[int, set[str]] = {}  # state of a whole short item: its ids
        within: dict[int, set[str]] = {}  # states that windows of long items end in: their ids
        paths = []
        for item, words in items:
            if not words:
                continue
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            last = 0
            for w in ids:
                last = self._extend(last, w)
            paths.append((item, ids))
        for item, ids in paths:
            state = 0
            if len(ids) < window:
                for w in ids:
                    state = self.next[state][w]
                whole.setdefault(state, set()).add(item)
                continue
            size = 0
            for at, w in enumerate(ids):
                state, size = self.step(state, size, w)
                if at >= window - 1:
                    within.setdefault(self._shrunk(state), set()).add(item)
        #: For each state, the longest and the ids of the short whole items among its suffixes.
        self.short: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        for state in sorted(range(len(self.size)), key=self.size.__getitem__):
            own = [(self.size[state], tuple(sorted(whole[state])))] if state in whole else []
            if above := self.short.get(self.link[state], []) + own:
                self.short[state] = above
        self.within = {state: tuple(sorted(ids)) for state, ids in within.items()}

    def _extend(self, last: int, w: int) -> int:
        follow, link, size = self.next, self.link, self.size
        if w in follow[last]:
            old = follow[last][w]
            return old if size[old] == size[last] + 1 else self._clone(last, w, old)
        new = len(size)
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and w not in follow[at]:
            follow[at][w] = new
            at = link[at]
        if at >= 0:
            old = follow[at][w]
            link[new] = old if size[old] == size[at] + 1 else self._clone(at, w, old)
        return new

    def _clone(self, at: int, w: int, old: int) -> int:
        twin = len(self.size)
        self.next.append(dict(self.next[old]))
        self.link.append(self.link[old])
        self.size.append(self.size[at] + 1)
        self.link[old] = twin
        while at >= 0 and self.next[at].get(w) == old:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """The longest match that ends at the next word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            size = self.size[state]
        if w in self.next[state]:
            return self.next[state][w], size + 1
        return 0, 0

    def _shrunk(self, state: int) -> int:
        """The state of the last ``window`` words of a match at least as long."""
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (start, end), apart from each other, and the ids of the items with windows there."""
        if not self.words:
            return [], set()
        follow, link, size_of, window, short = self.next, self.link, self.size, self.window, self.short
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        items: set[str] = set()
        state = size = 0
        for at, w in enumerate(map(self.words.get, words)):
            if w is None:
                state = size = 0
                continue
            to = follow[state].get(w)
            while to is None and state:
                state = link[state]
                size = size_of[state]
                to = follow[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            longest = 0
            if size >= window:
                longest = window
                end = self._shrunk(state)
                if end not in found:
                    found.add(end)
                    items.update(self.within.get(end, ()))
            if state in short:
                for length, ids in short[state]:
                    if length <= size:
                        longest = max(longest, length)
                        items.update(ids)
            if longest:
                start = at + 1 - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, items


HITS = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>,rest:string>"
Block = list[tuple[str, list[bytes]]]


def parts_of(window: int, size: int) -> Callable[[], Callable[[list], list]]:
    """Cuts items into parts of at most ``size`` windows, each with its number of words."""

    def cut(text: str | None) -> list[dict]:
        words = words_of(text)
        windows = max(1, len(words) - window + 1)
        parts = [words[at : min(at + size, windows) + window - 1] for at in range(0, windows, size)]
        return [{"n": len(part), "words": b" ".join(part).decode()} for part in parts if part]

    return lambda: lambda texts: list(map(cut, texts))


def blocks(items: DataFrame, block_words: int, window: int = WINDOW) -> tuple[int, Iterator[Block]]:
    """The number of blocks, and the items (id, text) in blocks, read one after the other.

    A block has at most a quarter, or a window, more than ``block_words`` words; running sums over the parts
    in the order of their hashes deal them.
    """
    size = max(window, block_words // 4 - window)
    cut = text_function("array<struct<n:bigint,words:string>>", parts_of(window, size))
    item, text = items.columns
    told = items.select(F.coalesce(F.col(item), F.lit("")).alias("item"), F.explode(cut(text)).alias("part"))
    parts = materialize(told.select("item", "part.n", "part.words").distinct())

    def block(rows: DataFrame) -> Block:
        return sorted((r["item"], r["words"].encode().split()) for r in rows.select("item", "words").toLocalIterator())

    if (parts.agg(F.sum("n")).first()[0] or 0) <= block_words:
        whole = block(parts)
        release(parts)
        return 1, iter([whole])
    keyed = parts.withColumn("key", F.xxhash64("item", "words"))
    placed = prefix_sum(keyed, ["key"], [F.shiftright("key", 52)], F.col("n"), name="before")
    path = fresh_path(items.sparkSession, "blocks")
    placed.select("item", "words", F.floor(F.col("before") / block_words).alias("block")).write.partitionBy("block").parquet(path)
    dealt = items.sparkSession.read.parquet(path)
    release(parts)
    numbers = sorted(r["block"] for r in dealt.select("block").distinct().collect())
    return len(numbers), (block(dealt.where(F.col("block") == number)) for number in numbers)


def united(cut_from: int) -> Callable[[], Callable[..., list]]:
    """Hits from spans and items of several blocks."""

    def unite(text: str | None, starts: list | None, ends: list | None, ids: list | None) -> dict:
        spans: list[list[int]] = []
        for a, b in sorted(zip(starts or (), ends or ())):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        return {
            "n_words": len(words_of(text)),
            "starts": [a for a, _ in spans],
            "ends": [b for _, b in spans],
            "items": ids or [],
            "rest": without(text, spans, cut_from) if spans else None,
        }

    return lambda: lambda *columns: list(map(unite, *columns))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    cut_from: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    into: str = "hits",
) -> DataFrame:
    """``docs`` with the column ``into``: the number of words, the spans of hit words (starts and ends), the
    sorted ids of the items that have windows in the text, and the text without spans of at least
    ``cut_from`` words (null if nothing is cut)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("words"))

    def scanner(shared, cuts: bool) -> Callable[[Column], Column]:
        def make():
            automaton = shared.value

            def scan(texts: list) -> list:
                rows = []
                for text in texts:
                    words = words_of(text)
                    spans, ids = automaton.scan(words)
                    starts, ends = [a for a, _ in spans], [b for _, b in spans]
                    rest = without(text, spans, cut_from) if spans and cuts else None
                    rows.append({"n_words": len(words), "starts": starts, "ends": ends, "items": sorted(ids), "rest": rest})
                return rows

            return scan

        return text_function(HITS, make, once=True)

    n_blocks, dealt = blocks(items, block_words, window)
    if n_blocks == 1:
        shared = spark.sparkContext.broadcast(Automaton(next(dealt), window))
        return docs.withColumn(into, scanner(shared, True)(F.col(text_col)))
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = []
    for block in dealt:
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        found.append(materialize(keyed.select("key", scanner(shared, False)("text").alias("hit"))))
        shared.unpersist()
    hits = functools.reduce(DataFrame.union, found).where("size(hit.starts) > 0").distinct()
    key, spans, ids = (unused(name, docs) for name in ("_key", "_spans", "_items"))
    by_row = hits.groupBy(F.col("key").alias(key)).agg(
        F.flatten(F.collect_list(F.arrays_zip("hit.starts", "hit.ends"))).alias(spans),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit.items")))).alias(ids),
    )
    by_row = materialize(by_row)
    for table in found:
        release(table)
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(by_row, key, "left")
    unite = text_function(HITS, united(cut_from), "array<int>", "array<int>", "array<string>")
    return joined.withColumn(into, unite(text_col, f"{spans}.starts", f"{spans}.ends", ids)).drop(key, spans, ids)


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(
        F.arrays_zip(f"{hits}.starts", f"{hits}.ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"]
    )


def is_contaminated(hits: str = "hits", share: int = SHARE) -> Column:
    """Whether hits are at least one in ``share`` words."""
    return (F.size(f"{hits}.starts") > 0) & (F.lit(share) * n_hit(hits) >= F.col(f"{hits}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", share: int = SHARE, **options) -> DataFrame:
    """``docs`` without documents above the coverage limit, and without long hit spans in the others."""
    hits = unused("_hits", docs)
    marked = find_hits(docs, benchmark, text_col=text_col, into=hits, **options)
    kept = marked.where(~is_contaminated(hits, share))
    return kept.withColumn(text_col, F.coalesce(f"{hits}.rest", text_col)).drop(hits)
