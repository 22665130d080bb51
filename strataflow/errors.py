"""Refusals. All of them are raised before any Spark job starts, unless said otherwise."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class SyntaxRefused(ValueError):
    """Text that isn't a program; `at` is where the offending piece starts."""

    def __init__(self, message: str, at: int = 0) -> None:
        super().__init__(f"{message} (at {at})")
        self.at = at


class CheckError(ValueError):
    """A program that can't be run as written.

    kind is one of: unknown, arity, redefined, unbound, recursion, aggregate, projection, order, type,
    bind, walk, fact, version.
    """

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind

    @property
    def fix(self) -> str | None:
        """The name that may have been meant."""
        return str(self).rpartition("did you mean ")[2].rstrip("?") if "did you mean " in str(self) else None


class BudgetExceeded(RuntimeError):
    """A fixpoint or a walk that takes more rounds or rows than allowed; raised while running."""


def suggestion(name: str, known: Iterable[str]) -> str:
    near = difflib.get_close_matches(name, list(known), 1)
    return f"; did you mean {near[0]}?" if near else ""


def located(text: str, error: Exception) -> tuple[int, int, str]:
    """Line and column, from 1, where a refused text goes wrong, and that line. What is refused as a whole is at its start."""
    at = min(getattr(error, "at", 0), len(text))
    start = text.rfind("\n", 0, at) + 1
    stop = text.find("\n", at)
    return text.count("\n", 0, at) + 1, at - start + 1, text[start : stop if stop >= 0 else len(text)]
