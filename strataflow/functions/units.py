"""Units of numbers: SI prefixes, and the dimensions of products and quotients.

A unit is a tag on a column. Numbers are kept in base units; the algebra runs on the driver.
"""

from __future__ import annotations

import re

# SI prefixes and the dimensions of named units over kg, m, s, A, K, mol, cd.
PREFIXES = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
NAMED = {
    "kg": (1, 0, 0, 0, 0, 0, 0), "m": (0, 1, 0, 0, 0, 0, 0), "s": (0, 0, 1, 0, 0, 0, 0), "A": (0, 0, 0, 1, 0, 0, 0),
    "K": (0, 0, 0, 0, 1, 0, 0), "mol": (0, 0, 0, 0, 0, 1, 0), "cd": (0, 0, 0, 0, 0, 0, 1), "Hz": (0, 0, -1, 0, 0, 0, 0),
    "N": (1, 1, -2, 0, 0, 0, 0), "J": (1, 2, -2, 0, 0, 0, 0), "W": (1, 2, -3, 0, 0, 0, 0), "V": (1, 2, -3, -1, 0, 0, 0),
    "ohm": (1, 2, -3, -2, 0, 0, 0), "S": (-1, -2, 3, 2, 0, 0, 0), "F": (-1, -2, 4, 2, 0, 0, 0), "H": (1, 2, -2, -2, 0, 0, 0),
    "C": (0, 0, 1, 1, 0, 0, 0), "Wb": (1, 2, -2, -1, 0, 0, 0), "T": (1, 0, -2, -1, 0, 0, 0), "Pa": (1, -1, -2, 0, 0, 0, 0),
}
BASE = ("kg", "m", "s", "A", "K", "mol", "cd")
ALIASES = {"Ω": "ohm", "Ohm": "ohm"}
_added: dict[str, tuple[float, str]] = {}


def add_unit(name: str, factor: float, unit: str) -> None:
    """A host's own unit: `name` is `factor` of `unit`."""
    _added[name] = (factor, unit)


def base(unit: str) -> tuple[float, str]:
    """The factor to the base unit, and that unit; an unknown unit is a base unit of its own."""
    if unit in _added:
        factor, of = _added[unit]
        inner, name = base(of)
        return factor * inner, name
    unit = ALIASES.get(unit, unit)
    if unit in NAMED:
        return 1.0, unit
    if unit == "g":
        return 1e-3, "kg"
    if len(unit) > 1 and unit[0] in PREFIXES:
        rest = ALIASES.get(unit[1:], unit[1:])
        if rest in NAMED and rest != "kg":
            return PREFIXES[unit[0]], rest
        if rest == "g":
            return PREFIXES[unit[0]] * 1e-3, "kg"
    return 1.0, unit


def dimensions(unit: str) -> tuple[int, ...] | None:
    if not unit:
        return (0,) * 7
    if unit in NAMED:
        return NAMED[unit]
    out = [0] * 7
    for part in unit.split("*"):
        m = re.fullmatch(r"([A-Za-z]+)(?:\^(-?\d+))?", part)
        if not m or m[1] not in BASE:
            return None
        out[BASE.index(m[1])] += int(m[2] or 1)
    return tuple(out)


def named(d: tuple[int, ...]) -> str:
    if not any(d):
        return ""
    for name, dims in NAMED.items():
        if dims == d:
            return name
    return "*".join(b if n == 1 else f"{b}^{n}" for b, n in zip(BASE, d, strict=True) if n)


def product(a: str, b: str, sign: int = 1) -> str | None:
    """The unit of a product, or with sign -1 of a quotient; None if a host's unit has no dimensions."""
    if not b:
        return a
    if not a and sign == 1:
        return b
    x, y = dimensions(a), dimensions(b)
    if x is None or y is None:
        return "" if a == b and sign == -1 else None
    return named(tuple(p + sign * q for p, q in zip(x, y, strict=True)))
