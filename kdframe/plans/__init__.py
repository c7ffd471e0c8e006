"""Registered queries: each has a Spark plan and, where SQL can say it, an independent SQL text."""

from __future__ import annotations


def _load() -> None:
    from kdframe.plans import dataset, evaluation, losses, prompts, streams, tokens  # noqa: F401


def all_queries():
    from kdframe.plans.catalog import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from kdframe.plans.catalog import ORACLES

    _load()
    return dict(ORACLES)
