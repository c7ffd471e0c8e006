"""Group spelling variants: words one edit apart, found in a reduced alphabet.

Letters are hashed to a few symbols. For each word the full neighbourhood of its reduced form is
generated: all reduced strings that one replaced, deleted or inserted symbol gives, and itself. They
are joined with the reduced vocabulary, and what matches is verified on the original words. An edit of
a word is an edit of its reduced form, or none, so that no pair is lost; symbols only decide how many
pairs are verified in vain. Reduced strings are 64-bit polynomial hashes, so that the neighbours of a
word of any length are sums of its prefix's and its suffix's hash. A bitmap of the reduced vocabulary,
of a bounded size, drops neighbours that no word has before anything is shuffled.

A word's form is its near word of largest count, if that is at least ``ratio`` times its own; ties go
to the smallest word in code-point order. Following forms leads to its root: counts grow by ``ratio``
at each step, so that doubling the steps ends after few rounds.

Defined cases: null and empty texts have no words; a word without near words is its own root; rows
that repeat count each time; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import KeyFilter, mix64, slices
from kdframe.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 7
LEAST = 2
RATIO = 10
SYMBOLS = 8
THINNED = 31
COUNTED_AT_ONCE = 200_000
WORDS_AT_ONCE = 4096
CELLS_AT_ONCE = 1 << 20  # letters of words that are looked at together, unless one has more

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def count_words(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    least: int = LEAST,
    thinned: int | None = None,
) -> DataFrame:
    """(word, n) of the runs of letters of all texts, ASCII letters lower-cased, of at least ``shortest`` code points
    that occur at least ``least`` times.

    ``thinned`` plants spelling errors: where it divides the unsigned CRC-32 of ``<id>:<run>``, the run loses the
    code point whose number is that CRC modulo its length. A null id counts as empty.
    """
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in (part for whole in batches for part in slices(whole, "text")):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(runs.findall((text or "").encode().lower().decode()))
                if thinned:
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word in list(own):
                        code = zlib.crc32(word.encode(), start)
                        if code % thinned == 0:
                            at, n = code % len(word), own.pop(word)
                            if len(word) > shortest:
                                counts[word[:at] + word[at + 1 :]] += n
                counts.update(own)
                if len(counts) > COUNTED_AT_ONCE:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


class Reduced:
    """Hashes of the reduced forms of words and of their neighbourhoods, for many words at a time."""

    def __init__(self, symbols: int):
        # values of symbols; a letter's symbol is a hash of its code point
        self.values = mix64(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.power = np.ones(1, dtype=np.uint64)

    def read(self, words: list[str]) -> None:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        self.size = np.array([len(word) for word in words], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.symbol = (mix64(codes + np.uint64(1)) >> np.uint64(32)) % np.uint64(len(self.values))
        self.owner = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(codes)) - self.begin[self.owner]
        if len(self.power) <= self.size.max(initial=0) + 1:
            n = 2 * int(self.size.max()) + 2
            self.power = np.cumprod(np.append(np.uint64(1), np.full(n, BASE)))
        amount = self.values[self.symbol] * self.power[self.place]
        sums = np.append(np.uint64(0), np.cumsum(amount))
        self.amount = amount
        self.before = sums[:-1] - sums[self.begin[self.owner]]  # of the letters before, in the word
        self.whole = sums[self.begin + self.size] - sums[self.begin]

    @staticmethod
    def finished(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix64(sums + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)

    def own(self) -> np.ndarray:
        return self.finished(self.whole, self.size)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the word, hash) of all strings at most one edit from its reduced form, repeated ones too."""
        owner, place, before, amount = self.owner, self.place, self.before, self.amount
        whole, size = self.whole[owner], self.size[owner]
        yield np.arange(len(self.size)), self.own()
        yield owner, self.finished(before + (whole - before - amount) * INVERSE, size - 1)
        for number, value in enumerate(self.values):
            other = self.symbol != np.uint64(number)
            yield owner[other], self.finished((whole - amount + value * self.power[place])[other], size[other])
            yield owner, self.finished(before + value * self.power[place] + (whole - before) * BASE, size + 1)
            yield np.arange(len(self.size)), self.finished(self.whole + value * self.power[self.size], self.size + 1)


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches with their words, in parts of a bounded number of letters."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        start = held = 0
        for i, word in enumerate(words):
            if i > start and (held + len(word) > CELLS_AT_ONCE or i - start >= WORDS_AT_ONCE):
                yield batch.slice(start, i - start), words[start:i]
                start, held = i, 0
            held += len(word)
        if words:
            yield batch.slice(start), words[start:]


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): all pairs of words of (word, n) that differ by one inserted, deleted or replaced code
    point, in both orders."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(symbols)
        for batch, words in in_parts(batches):
            reduced.read(words)
            yield pa.RecordBatch.from_arrays([pa.array(reduced.own()), *batch.columns], names=["key", "near", "near_n"])

    known = vocabulary.mapInArrow(reduce, "key long, near string, near_n long")
    told = vocabulary.sparkSession.sparkContext.broadcast(KeyFilter.of(known.select("key").distinct()))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(symbols)
        for batch, words in in_parts(batches):
            reduced.read(words)
            found = []
            for owner, key in reduced.neighbours():
                kept = told.value.has(key)
                found.append((owner[kept], key[kept]))
            owner, key = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((key, owner))
            owner, key = owner[order], key[order]
            new = (np.diff(owner, prepend=-1) != 0) | (np.diff(key, prepend=~key[:1]) != 0)
            own = batch.take(pa.array(owner[new]))
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), *own.columns], names=["key", "word", "n"])

    asked = vocabulary.mapInArrow(generate, "key long, word string, n long")
    return asked.join(known, "key").where(F.levenshtein("word", "near", 1) == 1).drop("key")


def variants(vocabulary: DataFrame, *, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """Per word of (word, n): ``n_near``, its ``form`` and ``form_n``, and its ``root``."""
    vocabulary = materialize(vocabulary.select("word", "n"))
    near = near_words(vocabulary, symbols)
    best = near.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.max("near_n").alias("most"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    )
    formed = F.col("most") >= ratio * F.col("n")
    found = materialize(
        best.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("most")).alias("form_n"))
    )
    roots = materialize(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("on")))
        if moved.where("on").isEmpty():
            break
        roots = moved.drop("on")
    return (
        vocabulary.join(found, "word", "left")
        .join(roots, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )
