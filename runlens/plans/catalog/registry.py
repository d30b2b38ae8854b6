"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = Entry(run, sql)
        return run

    return register


def rounded(*names: str, digits: int = 10) -> list[Column]:
    """Doubles rounded where two engines may differ in the last bits."""
    return [F.round(F.col(n), digits).alias(n) for n in names]


def round_sql(digits: int = 10, **expressions: str) -> str:
    return ",\n       ".join(
        f"round(coalesce({e}, 0.0), {digits}) AS {n}" for n, e in expressions.items()
    )
