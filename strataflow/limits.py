"""What an evaluation may use, and how a running one is stopped."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from strataflow.errors import BudgetExceeded

ROWS = 1 << 40


@dataclass
class Limits:
    """Rounds of a fixpoint or a walk, rows that one derives, and seconds from when it is asked; beyond any of them BudgetExceeded
    is raised, in whatever way the rounds are run. edges and tuples say up to which size walks and fixpoints may run in
    memory, in place of the modules' own figures; the answers are the same."""

    rounds: int = 10_000
    rows: int = ROWS
    seconds: float = float("inf")
    edges: int | None = None
    tuples: int | None = None
    began: float = field(default_factory=time.monotonic, compare=False)

    def started(self) -> Limits:
        return replace(self, began=time.monotonic())

    def round(self, n: int, what: str) -> None:
        if n > self.rounds:
            raise BudgetExceeded(f"{what}: more than {self.rounds} rounds")
        if time.monotonic() - self.began > self.seconds:
            raise BudgetExceeded(f"{what}: more than {self.seconds} seconds")

    def total(self, rows: int, what: str) -> None:
        if rows > self.rows:
            raise BudgetExceeded(f"{what}: more than {self.rows} rows")

    @property
    def counts(self) -> bool:
        return self.rows < ROWS


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts inside can be stopped by cancel(spark, tag) from any other: reads, rounds and answers."""
    spark.sparkContext.setInterruptOnCancel(True)
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
