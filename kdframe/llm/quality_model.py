"""Quality of documents by weak supervision.

Overlapping heuristic labellers vote good, bad or nothing on a text. Expectation-maximisation
estimates from the counts of vote patterns how often each labeller is right in each class, and gives a
posterior for each pattern. The posteriors are the labels of a linear scorer over hashed words and
character statistics, trained by logistic regression on a bounded sample: partitions descend from
shared weights, which are averaged after each epoch.

Votes and pattern counts cover all rows. Only the scorer is fitted on a sample of about ``fit_rows``
rows (a bound on the work of fitting), and all rows are scored.

Defined cases: null, empty and wordless texts score 0 and are bad; a text on which nobody votes has the
prior as posterior; repeated rows count as often as they occur; other columns are kept, but for those
named like a result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import column, slices, text_function, unused
from kdframe.session import materialize

FIT_ROWS = 20_000
FIT_PARTS = 8
EPOCHS = 12
BUCKETS, STATS = 1 << 14, 16
RATE = 0.5


#: Kinds of bytes: capitals, other ASCII letters, white space, symbols, the rest of ASCII, starts and the rest of other characters.
SYMBOLS = "#*$%&|<>!=_~^@"
KIND = np.array(
    [
        5 if c >= 192 else 6 if c >= 128 else 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if c in b" \t\n\x0b\f\r" else 3 if chr(c) in SYMBOLS else 4
        for c in range(256)
    ]
)


class Facts:
    """What labellers and scorer look at in a text with words."""

    def __init__(self, text: str):
        self.text = text.strip(" \t\n\x0b\f\r")
        data = self.text.encode()
        self.words = data.split()
        self.kinds = np.bincount(KIND[np.frombuffer(data, dtype=np.uint8)], minlength=7)[:6]
        self.chars = int(self.kinds.sum())
        self.distinct = len(set(self.words))
        self.again = sum(map(bytes.__eq__, self.words, self.words[1:])) / max(1, len(self.words))

    def share(self, *kinds: int) -> float:
        return sum(int(self.kinds[k]) for k in kinds) / self.chars


def ranged(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """A vote: 1 within ``good``, -1 outside ``bad``, else 0."""
    return 1 if good[0] <= value <= good[1] else 0 if bad[0] <= value <= bad[1] else -1


def by_variety(f: Facts) -> int:
    return 0 if len(f.words) < 20 else ranged(f.distinct / len(f.words) ** 0.5, (4, 1e9), (2, 1e9))


def by_sentences(f: Facts) -> int:
    return 1 if f.text.endswith((".", "?")) else -1 if len(f.words) > 10 else 0


def by_lines(f: Facts) -> int:
    lines = f.text.split("\n")
    return ranged(1 - len(set(lines)) / len(lines), (0, 0.1), (0, 0.4))


LABELLERS: dict[str, Callable[[Facts], int]] = {
    "symbols": lambda f: ranged(f.share(3), (0, 0.01), (0, 0.05)),
    "capitals": lambda f: ranged(f.share(0), (0, 0.06), (0, 0.3)),
    "letters": lambda f: ranged(f.share(0, 1, 2, 5), (0.93, 1), (0.8, 1)),
    "variety": by_variety,
    "word length": lambda f: ranged(f.chars / len(f.words), (4, 9), (3, 14)),
    "sentences": by_sentences,
    "stutter": lambda f: ranged(f.again, (0, 0.02), (0, 0.1)),
    "repeated lines": by_lines,
}


def votes_of(f: Facts) -> tuple[int, ...]:
    return tuple(vote(f) for vote in LABELLERS.values())


def known(text: str | None) -> Facts | None:
    """The facts of a text; None without words."""
    found = Facts(text) if text else None
    return found if found and found.words else None


def votes(text_col: str) -> Column:
    """A number that stands for the votes on a text, in base three; null for a text without words."""

    def make():
        def number(text: str | None) -> int | None:
            f = known(text)
            return None if f is None else sum((v + 1) * 3**k for k, v in enumerate(votes_of(f)))

        return lambda texts: list(map(number, texts))

    return text_function("int", make)(F.col(text_col))


@dataclass
class LabelModel:
    """How votes depend on the class: probabilities by labeller, class (bad, good) and vote (-1, 0, 1)."""

    prior: np.ndarray
    chance: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern of votes."""
        logs = np.log(self.prior) + sum(np.log(self.chance[k][:, patterns[:, k] + 1]).T for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Share of the votes of each labeller that are right."""
        right = self.prior[1] * self.chance[:, 1, 2] + self.prior[0] * self.chance[:, 0, 0]
        cast = (self.chance[:, :, [0, 2]].sum(axis=2) * self.prior).sum(axis=1)
        return right / cast


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns, starting from the majority of votes."""
    labellers = patterns.shape[1]
    good = np.clip(0.5 + patterns.mean(axis=1) / 2, 0.05, 0.95)
    model = LabelModel(np.array([0.5, 0.5]), np.full((labellers, 2, 3), 1 / 3))
    for _ in range(rounds if len(counts) else 0):
        weight = np.stack(((1 - good) * counts, good * counts))
        model.prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        for k in range(labellers):
            for vote in range(3):
                model.chance[k, :, vote] = weight[:, patterns[:, k] + 1 == vote].sum(axis=1) + 0.1
        model.chance /= model.chance.sum(axis=2, keepdims=True)
        good = model.posterior(patterns)
    return model


def label_model(docs: DataFrame, text_col: str) -> tuple[LabelModel, dict[tuple[int, ...], float]]:
    """The model and the posterior of each pattern. There are at most 3 ** labellers patterns."""
    rows = docs.select(votes(text_col).alias("votes")).where("votes is not null").groupBy("votes").count().collect()
    patterns = np.array([[r["votes"] // 3**k % 3 - 1 for k in range(len(LABELLERS))] for r in rows], dtype=np.int64)
    patterns = patterns.reshape(-1, len(LABELLERS))
    model = estimate(patterns, np.array([r["count"] for r in rows], dtype=np.float64))
    return model, dict(zip(map(tuple, patterns.tolist()), model.posterior(patterns).tolist()))


def features(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text. The first buckets hold statistics, the others words."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.lower, f.words)), dtype=np.uint64, count=len(f.words))
    found, counts = np.unique(hashed % np.uint64(BUCKETS - STATS), return_counts=True)
    values = np.log1p(counts)
    values /= np.linalg.norm(values)
    n = len(f.words)
    stats = np.array([1.0, *(f.kinds / f.chars), f.distinct / n, f.again, min(f.chars / n, 30) / 30])
    return np.concatenate((np.arange(len(stats)), found.astype(np.int64) + STATS)), np.concatenate((stats, values))


def logistic(weights: np.ndarray, at: np.ndarray, values: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[at] @ values, -30, 30))))


def fit(
    docs: DataFrame, posteriors: dict[tuple[int, ...], float], *, id_col: str, text_col: str, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights of the scorer, from a sample that a hash of id and text chooses."""
    rows = docs.select(F.xxhash64(id_col, text_col).alias("by"), F.col(text_col).alias("text"))
    share_of = min(1.0, fit_rows / max(1, docs.count()))
    chosen = rows.where(F.pmod("by", F.lit(1 << 20)) < int(share_of * (1 << 20)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            by, labels, places, values = [], [], [], []
            for key, text in zip(column(batch, "by"), column(batch, "text")):
                if f := known(text):
                    at, value = features(f)
                    by.append(key)
                    labels.append(posteriors[votes_of(f)])
                    places.append(at)
                    values.append(value)
            columns = [pa.array(by, pa.int64()), pa.array(labels, pa.float64())]
            columns += [pa.array(places, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["by", "label", "at", "values"])

    measured = chosen.mapInArrow(measure, "by long, label double, at array<long>, values array<double>")
    # a part is a part of the sample, so bounded
    sample = materialize(measured.repartition(FIT_PARTS, "by").sortWithinPartitions("by"))
    weights = np.zeros(BUCKETS)
    for epoch in range(epochs):
        shared = docs.sparkSession.sparkContext.broadcast(weights)

        def descend(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            own, n = shared.value.copy(), 0
            for batch in batches:
                for label, at, values in zip(*(batch.column(c) for c in range(3))):
                    at, values = at.values.to_numpy(), values.values.to_numpy()
                    wrong = logistic(own, at, values) - label.as_py()
                    own[at] -= RATE / (1 + epoch / 4) * wrong * values
                n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.tobytes()])], names=["n", "weights"])

        found = sample.select("label", "at", "values").mapInArrow(descend, "n long, weights binary").where("n > 0").collect()
        if found:
            weights = np.average([np.frombuffer(r["weights"]) for r in found], axis=0, weights=[r["n"] for r in found])
    return weights


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``weak_score``, the posterior of the votes, ``quality_score`` of the scorer, and ``good``."""
    _, posteriors = label_model(docs, text_col)
    weights = fit(docs, posteriors, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast((posteriors, weights))

    def make():
        weak, trained = shared.value

        def score(text: str | None) -> dict:
            f = known(text)
            if f is None:
                return {"weak": 0.0, "strong": 0.0}
            return {"weak": weak[votes_of(f)], "strong": logistic(trained, *features(f))}

        return lambda texts: list(map(score, texts))

    own = unused("_scores", docs)
    scored = docs.withColumn(own, text_function("struct<weak:double,strong:double>", make)(F.col(text_col)))
    rated = scored.withColumns({"weak_score": F.col(f"{own}.weak"), "quality_score": F.col(f"{own}.strong")}).drop(own)
    return rated.withColumn("good", F.col("quality_score") >= 0.5)
