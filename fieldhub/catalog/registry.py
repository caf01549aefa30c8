"""Registration of named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def wrap(run: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(run, sql)
        return run

    return wrap
