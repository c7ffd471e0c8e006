"""Vector arithmetic over ``ARRAY<DOUBLE>`` columns, all in JVM expressions.

``let`` binds an intermediate value to a lambda variable. Without it the optimizer inlines the
value into the inner lambda and evaluates it once per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Cosine of the L2-normalised vectors; ``eps`` is the floor of each norm."""
    na = F.greatest(norm(a), F.lit(eps))
    nb = F.greatest(norm(b), F.lit(eps))
    return dot(a, b) / (na * nb)


def squared_error(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def huber_error(a: Column, b: Column, delta: float = 1.0) -> Column:
    def one(x: Column, y: Column) -> Column:
        gap = F.abs(x - y)
        return F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))

    return vsum(F.zip_with(a, b, one))


def logsumexp(a: Column) -> Column:
    return let(F.array_max(a), lambda m: m + F.log(vsum(F.transform(a, lambda x: F.exp(x - m)))))


def log_softmax(a: Column, temperature: float = 1.0) -> Column:
    def normalised(s: Column) -> Column:
        return let(logsumexp(s), lambda z: F.transform(s, lambda x: x - z))

    # the scaled array is built once
    return let(scale(a, 1.0 / temperature), normalised) if temperature != 1.0 else normalised(a)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(a, temperature), F.exp)


def kl_divergence(teacher: Column, student: Column, temperature: float = 1.0) -> Column:
    """Sum over the vocabulary of ``p (log p - log q)`` for one position."""
    terms = F.zip_with(
        log_softmax(teacher, temperature),
        log_softmax(student, temperature),
        lambda lp, lq: F.exp(lp) * (lp - lq),
    )
    return vsum(terms)


def pad_zeros(a: Column, width: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(width - F.size(a), F.lit(0))))
