"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and the bigrams and trigrams of what
is left are hashed into buckets. Log-probabilities are rounded to fixed-point integers, so a text's
scores are the same in whatever batch it is scored. The matrix, languages by buckets, is broadcast;
batches of texts are scored sparsely, by gathering the entries of the n-grams that occur.

Fitting reads at most about ``fit_rows`` labelled texts of each language, chosen by a hash of the row
(a bound on the work of fitting; prediction reads all texts).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without label, text
or fold aren't learned from; ties go to the first language by name; without anything learned all is
``und``; repeated rows count as often as they occur; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import bounded_batches, column, slices, text_function

BUCKETS = 1 << 14
FIT_ROWS = 20_000
MAX_LANGUAGES = 2_000
UNKNOWN = "und"

#: N-grams whose evidence a score counts at most, so that long texts don't all score 1.
EVIDENCE = 50
#: Fixed-point scale of log-probabilities.
SCALE = 1 << 12
#: Characters scored at a time; longer texts are scored in overlapping parts.
PART = 1 << 20


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not hasattr(letters, "found"):
        letters.found = np.array([chr(c).isalpha() for c in range(0x110000)])
    return letters.found


def ngrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and the number of the text of each."""
    joined = "".join(f"{t} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    symbols = np.where(letter, codes, 32)[keep].astype(np.uint32)
    owner = owner[keep]
    found, owners = [], []
    for n in (2, 3):
        if len(symbols) < n:
            continue
        mixed = np.full(len(symbols) - n + 1, n, dtype=np.uint32)
        for at in range(n):
            mixed = (mixed ^ symbols[at : len(symbols) - n + 1 + at]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        inside = owner[: len(mixed)] == owner[n - 1 :]
        found.append(mixed[inside] % np.uint32(buckets))
        owners.append(owner[: len(mixed)][inside])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owners).astype(np.int64)


def parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-cased texts, cut into bounded parts that overlap by two characters, in batches of a bounded size."""
    numbers, batch, size = [], [], 0
    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        for at in range(0, max(1, len(lowered) - 2), PART):
            part = lowered[at : at + PART + 2]
            if size and size + len(part) > PART:
                yield numbers, batch
                numbers, batch, size = [], [], 0
            numbers.append(i)
            batch.append(part)
            size += len(part)
    if batch:
        yield numbers, batch


@dataclass
class Model:
    languages: list[str]
    #: Fixed-point log-probabilities, languages by buckets.
    matrix: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        totals = np.zeros((len(self.languages), len(texts)), dtype=np.int64)
        counts = np.zeros(len(texts), dtype=np.int64)
        for numbers, batch in parts(texts):
            found, owner = ngrams(batch, self.matrix.shape[1])
            if not len(found):
                continue
            owner = np.asarray(numbers)[owner]
            counts += np.bincount(owner, minlength=len(texts))
            for language, row in enumerate(self.matrix):
                # sums of integers below 2**53 are exact in doubles
                totals[language] += np.bincount(owner, weights=row[found], minlength=len(texts)).astype(np.int64)
        out = []
        for i in range(len(texts)):
            if not counts[i] or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            own = totals[:, i]
            best = int(own.argmax())
            evidence = min(int(counts[i]), EVIDENCE) / (int(counts[i]) * SCALE)
            out.append((self.languages[best], float(1 / np.exp((own - own[best]) * evidence).sum())))
        return out


def fit(
    labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", by: str = "doc_id", buckets: int = BUCKETS, fit_rows: int = FIT_ROWS
) -> Model:
    """A model of the non-null labels. ``by`` is only hashed, to choose the rows that are read."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(by).alias("by"))
    rows = rows.where("text is not null and label is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in {label_col}")
    languages = sorted(counts)
    number = {label: i for i, label in enumerate(languages)}
    share = F.lit(1.0)
    for label, count in counts.items():
        if count > fit_rows:
            share = F.when(F.col("label") == label, F.lit(fit_rows / count)).otherwise(share)
    chosen = rows.where(F.pmod("by", F.lit(1 << 20)) < share * (1 << 20)).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * buckets, dtype=np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            of = np.array([number[x] for x in column(batch, "label")])
            for numbers, texts in parts(column(batch, "text")):
                found, owner = ngrams(texts, buckets)
                if len(found):
                    total += np.bincount(of[np.asarray(numbers)][owner] * buckets + found, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    matrix = np.full(len(languages) * buckets, 0.5)
    if languages:
        summed = chosen.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        matrix[summed["at"].to_numpy()] += summed["n"].to_numpy()
    matrix = matrix.reshape(len(languages), buckets)
    logs = np.log(matrix / matrix.sum(axis=1, keepdims=True)) if languages else matrix
    return Model(languages, np.rint(logs * SCALE).astype(np.int32))


def predictor(docs: DataFrame, model: Model) -> Callable[[Column | str], Column]:
    """A column function of a text: ``lang_pred`` and ``score``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda texts: [{"lang_pred": a, "score": b} for a, b in known.predict(texts)]

    predict = text_function("struct<lang_pred:string,score:double>", make)
    return lambda c: predict(F.col(c) if isinstance(c, str) else c)


def fold(c: str, folds: int = 4) -> Column:
    """A fold of a row by the checksum of an id, the same wherever the row is read."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % folds
