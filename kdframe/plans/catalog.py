"""The registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kdframe.plans.sqltables import with_tables

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan. ``sql`` may use the derived tables of ``sqltables`` by name."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return plan

    return register


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def digest(c: Column | str) -> Column:
    """Fingerprint of a long text, to keep results small."""
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def spoken(conversations: Column | str) -> Column:
    """One text for a nested conversation."""
    return F.array_join(
        F.transform(conversations, lambda t: F.concat(t["from"], F.lit("="), F.coalesce(t["value"], F.lit("<none>")))),
        "|",
    )


def listed(messages: Column | str) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
