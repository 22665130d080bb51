"""What a predicate is, and the standard ones.

A test filters rows of bound arguments. A function is a relation with its results last; each of its
modes says which arguments it needs and computes the others, one row or an array of rows. A mode's
value that comes out null means that the function has no row there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.errors import CheckError
from strataflow.functions import units
from strataflow.values import ANY, NUM, TEXT, Kind, Val, compare, held, is_absent, numeric, text


@dataclass(frozen=True)
class Mode:
    """needs -> gives. run gets the values of all needed places and returns one Val a given place, or,
    for `many`, an array column of structs with a field for each given place, and the fields' kinds."""

    needs: tuple[int, ...]
    gives: tuple[int, ...]
    run: Callable
    many: bool = False


@dataclass(frozen=True)
class Predicate:
    name: str
    arity: int
    test: Callable[[list[Val]], Column] | None = None
    modes: tuple[Mode, ...] = ()
    doc: str = ""
    constants: tuple[int, ...] = field(default=())  # arguments that must be constants
    frame: object = None  # a host's generator over whole frames: see functions.host
    least: int | None = None  # arguments that must be given; the rest may be left out


def plain(v: Val) -> Column:
    """Text for a test: an absent value reads as empty. A column without nulls stays as it is, so that the test reaches the scan."""
    return v.col if v.kind.name == "text" and not v.kind.nullable else F.coalesce(text(v), F.lit(""))


def literal(v: Val, what: str) -> str:
    value = getattr(v, "constant", None)
    if not isinstance(value, str):
        raise CheckError("type", f"{what} must be a constant text")
    return value


def glob(pattern: str) -> str:
    """A GLOB pattern as a regular expression over the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            first = i + (pattern[i : i + 1] == "^")
            stop = pattern.find("]", first + 1)
            if stop < 0:
                raise CheckError("type", f"unclosed [ in {pattern!r}")
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[first:stop])
            out += "[" + ("^" if first > i else "") + inside + "]"
            i = stop + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def regex(pattern: str) -> str:
    """A pattern in the common part of the two dialects: look-around and back references are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<", pattern):
        raise CheckError("type", f"look-around and back references aren't supported: {pattern!r}")
    try:
        re.compile(re.sub(r"\\[zZ]", "", re.sub(r"\(\?P<", "(?P<", pattern)))
    except re.error as e:
        raise CheckError("type", f"bad pattern {pattern!r}: {e}") from None
    return pattern.replace("(?P<", "(?<")


def by_character(s: Column, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), change), "")


def upper(s: Column) -> Column:
    """Each character to its own upper case: one that has none of a single character stays, so lengths do too."""
    return F.when(F.length(F.upper(s)) == F.length(s), F.upper(s)).otherwise(by_character(s, lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)))


def lower(s: Column) -> Column:
    """Each character to its own lower case, wherever it stands."""
    return F.when(s.rlike("[\u03a3\u0130]"), by_character(s, lambda c: F.substring(F.lower(c), 1, 1))).otherwise(F.lower(s))


def one(col: Column, kind: Kind = TEXT) -> list[Val]:
    return [Val(col, kind)]


def by_constant(of: Callable[[str], str]) -> Callable[[list[Val]], Column]:
    return lambda a: plain(a[0]).rlike(of(literal(a[1], "a pattern")))


def concat_modes() -> tuple[Mode, ...]:
    def head(v: dict[int, Val]) -> list[Val]:
        t, x = text(v[1]), text(v[2])
        return one(F.when(x.endswith(t), x.substr(F.lit(1), F.length(x) - F.length(t))))

    def tail(v: dict[int, Val]) -> list[Val]:
        h, x = text(v[0]), text(v[2])
        return one(F.when(x.startswith(h), x.substr(F.length(h) + 1, F.length(x))))

    return (Mode((0, 1), (2,), lambda v: one(F.concat(text(v[0]), text(v[1])))), Mode((0, 2), (1,), tail), Mode((1, 2), (0,), head))


def replaced(v: dict[int, Val]) -> list[Val]:
    s, old, new = (text(v[i]) for i in range(3))
    between = F.concat(new, F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.concat(c, new)), ""))
    return one(F.when(old == "", between).otherwise(F.replace(s, old, new)))


def numbered(items: Column, kind: Kind) -> tuple[Column, list[Kind]]:
    return F.transform(items, lambda x, i: F.struct(i.cast("long").alias("a"), x.alias("b"))), [Kind("num", "", False, True), kind]


def pieces(v: dict[int, Val]) -> Column:
    s, sep = text(v[0]), text(v[1])
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.when(sep == "", chars).otherwise(F.split(s, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """a op b; null where an operand isn't a number, units don't fit or a divisor is 0."""
    x, y = numeric(a), numeric(b)
    ua, ub = a.kind.unit, b.kind.unit
    unit: str | None
    if op in "+-":
        unit = ua or ub if not (ua and ub and ua != ub) else None
        col = x + y if op == "+" else x - y
    elif op == "*":
        unit, col = units.product(ua, ub), x * y
    else:
        unit, col = units.product(ua, ub, -1), F.when(y != 0, x.cast("double") / y.cast("double"))
    if unit is None or "text" in (a.kind.name, b.kind.name):
        return Val(F.lit(None).cast("double"), NUM)
    if "any" in (a.kind.name, b.kind.name):
        ru = [v.col["u"] if v.kind.name == "any" else F.lit(v.kind.unit) for v in (a, b)]
        fits = (ru[0] == "") | (ru[1] == "") | (ru[0] == ru[1]) if op in "+-" else (ru[0] == "") | (ru[1] == "")
        got = F.when(ru[0] != "", ru[0]).otherwise(ru[1])
        made = F.struct(F.lit(1).cast("tinyint").alias("k"), col.cast("double").alias("n"), F.lit(None).cast("string").alias("s"), got.alias("u"))
        return Val(F.when(fits & col.isNotNull(), made), ANY)
    return Val(col, Kind("num", unit, a.kind.nullable or b.kind.nullable or op == "/", op != "/" and a.kind.whole and b.kind.whole))


def simplified(op: str, r: Column, a: Column, b: Column) -> Column:
    """The result cut to 15 digits where both operands can still be had back from it."""
    x, y = a.cast("double"), b.cast("double")
    short = F.format_string("%.14e", r.cast("double")).try_cast("double")
    safe = lambda p, q: F.when(q != 0, p / q)
    second, first = {"+": (short - x, short - y), "-": (x - short, short + y), "*": (safe(short, x), safe(short, y)), "/": (safe(x, short), short * y)}[op]
    return F.when((second == y) & (first == x), short).otherwise(r)


def shortened(name: str, op: str, back: str) -> Predicate:
    """solver() with simplified forward results."""
    p = solver(name, op, back)

    def run(v: dict[int, Val]) -> list[Val]:
        out = arithmetic(op, v[0], v[1])
        return [short_of(op, out, v[0], v[1])]

    return Predicate(name, 3, modes=(Mode((0, 1), (2,), run), *p.modes[1:]))


def short_of(op: str, out: Val, a: Val, b: Val) -> Val:
    if out.kind.name != "num" or out.kind.whole:
        return out
    return Val(simplified(op, out.col, numeric(a), numeric(b)), out.kind)


def negative(a: Val) -> Val:
    if a.kind.name == "any":
        return Val(F.when(a.col["k"] == 1, F.struct(a.col["k"].alias("k"), (-a.col["n"]).alias("n"), F.lit(None).cast("string").alias("s"), a.col["u"].alias("u"))), ANY)
    return Val(-numeric(a), a.kind if a.kind.name == "num" else NUM)


def solver(name: str, op: str, back: str) -> Predicate:
    """a op b = c, solved for any of the three."""
    forward = Mode((0, 1), (2,), lambda v: [arithmetic(op, v[0], v[1])])
    first = Mode((1, 2), (0,), lambda v: [arithmetic(back, v[2], v[1])])
    if op in "-/":
        second = Mode((0, 2), (1,), lambda v: [arithmetic(op, v[0], v[2])])
    else:
        second = Mode((0, 2), (1,), lambda v: [arithmetic(back, v[2], v[0])])
    return Predicate(name, 3, modes=(forward, second, first))


def boxed_items(t: Column) -> Column:
    """The elements of a JSON list as boxed values: numbers, text, and null for absent."""
    texts, numbers = F.from_json(t, "array<string>"), F.from_json(t, "array<double>")
    none = F.lit(None)

    def box(x: Column, n: Column) -> Column:
        kind = F.when(x.isNull(), 0).when(n.isNotNull(), 1).otherwise(2).cast("tinyint")
        return F.struct(kind.alias("k"), n.alias("n"), F.when(n.isNull(), x).otherwise(none).alias("s"), F.lit("").alias("u"))

    return F.when(F.trim(t).startswith("["), F.zip_with(texts, F.coalesce(numbers, F.array().cast("array<double>")), box))


def items(v: Val) -> tuple[Column, Kind]:
    """A list's elements and their kind; null where the value isn't a list. A constant list of numbers has plain ones."""
    if v.kind.name.startswith("array"):
        inner = v.kind.name[6:-1]
        return v.col, Kind("num", "", True, inner in ("int", "bigint", "smallint", "tinyint")) if inner in ("float", "double", "int", "bigint", "smallint", "tinyint") else TEXT
    value = getattr(v, "constant", None)
    if isinstance(value, str):
        try:
            parts = json.loads(value)
        except ValueError:
            parts = None
        if isinstance(parts, list) and parts and all(isinstance(x, (int, float)) for x in parts):
            return F.array(*map(F.lit, parts)), Kind("num", "", False, all(isinstance(x, int) for x in parts))
        if isinstance(parts, list) and all(isinstance(x, str) for x in parts):
            return F.array(*map(F.lit, parts)).cast("array<string>"), TEXT
    return boxed_items(text(v)), ANY


def path_part(v: Val, what: str) -> Column:
    """A path's nodes or edges as boxed values; null where the value isn't a path or names no edges."""
    t = text(v)
    inside = lambda name: F.get_json_object(t, f"$.{name}")
    return boxed_items(F.when(F.trim(t).startswith("["), t).otherwise(inside("nodes"))) if what == "nodes" else boxed_items(inside("edges"))


def part_text(v: Val, what: str) -> Column:
    t = text(v)
    return F.when(F.trim(t).startswith("["), t).otherwise(F.get_json_object(t, "$.nodes")) if what == "nodes" else F.get_json_object(t, "$.edges")


def steps(v: dict[int, Val]) -> tuple[Column, list[Kind]]:
    n = path_part(v[0], "nodes")
    pairs = F.zip_with(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0))), F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("f"), b.alias("t")))
    made = F.transform(pairs, lambda p, i: F.struct(i.cast("long").alias("a"), p["f"].alias("b"), p["t"].alias("c")))
    return F.when(F.size(n) > 1, made), [Kind("num", "", False, True), ANY, ANY]


def at(v: dict[int, Val]) -> list[Val]:
    (array, kind), i = items(v[0]), numeric(v[1]).cast("int")
    return one(F.try_element_at(array, F.when(i >= 0, i + 1).otherwise(i)), kind)


def one_piece(v: dict[int, Val]) -> list[Val]:
    i = numeric(v[2]).cast("int")
    return one(F.try_element_at(pieces(v), F.when(i >= 0, i + 1).otherwise(i)))


def member(v: dict[int, Val]) -> tuple[Column, list[Kind]]:
    return numbered(*items(v[0]))


def length(array: Column, less: int = 0) -> list[Val]:
    return one(F.when(array.isNotNull(), F.size(array) - less).cast("long"), Kind("num", "", True, True))


def standard() -> dict[str, Predicate]:
    fn = lambda name, arity, *modes: Predicate(name, arity, modes=tuple(modes))
    text_fn = lambda name, f: fn(name, 2, Mode((0,), (1,), lambda v: one(f(text(v[0])))))
    found = [
        Predicate("str.contains", 2, lambda a: plain(a[0]).contains(plain(a[1])), doc="text holds another"),
        Predicate("str.prefix", 2, lambda a: plain(a[0]).startswith(plain(a[1])), doc="text starts with another"),
        Predicate("str.suffix", 2, lambda a: plain(a[0]).endswith(plain(a[1])), doc="text ends with another"),
        Predicate("str.glob", 2, by_constant(glob), constants=(1,)),
        Predicate("str.match", 2, by_constant(regex), constants=(1,)),
        Predicate("absent", 1, lambda a: is_absent(a[0])),
        fn("str.distance", 3, Mode((0, 1), (2,), lambda v: one(F.levenshtein(text(v[0]), text(v[1])).cast("long"), Kind("num", "", True, True)))),
        Predicate("str.concat", 3, modes=concat_modes()),
        fn("str.replace", 4, Mode((0, 1, 2), (3,), replaced)),
        text_fn("str.lower", lower),
        text_fn("str.upper", upper),
        text_fn("str.capitalize", lambda s: F.concat(upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.greatest(F.length(s), F.lit(1))))),
        fn("str.split", 4, Mode((0, 1, 2), (3,), one_piece), Mode((0, 1), (2, 3), lambda v: numbered(pieces(v), TEXT), True)),
        Predicate("str.find", 4, modes=(Mode((0, 1), (2, 3), lambda v: numbered(F.filter(F.regexp_extract_all(text(v[0]), F.lit(regex(literal(v[1], "a pattern"))), F.lit(0)), lambda x: x != ""), TEXT), True),), constants=(1,)),
        fn("num.value", 2, Mode((0,), (1,), lambda v: one(numeric(v[0]), Kind("num", "", True, v[0].kind.whole)))),
        fn("num.unit", 2, Mode((0,), (1,), lambda v: one(F.when(v[0].col["u"] != "", v[0].col["u"]) if v[0].kind.name == "any" else F.when(numeric(v[0]).isNotNull(), F.lit(v[0].kind.unit)) if v[0].kind.unit else F.lit(None).cast("string")))),
        solver("num.add", "+", "-"), solver("num.sub", "-", "+"), solver("num.mul", "*", "/"), solver("num.div", "/", "*"),
        fn("num.neg", 2, Mode((0,), (1,), lambda v: [negative(v[0])]), Mode((1,), (0,), lambda v: [negative(v[1])])),
        fn("coalesce", 3, Mode((0, 1), (2,), lambda v: [first_of(v[0], v[1])])),
        fn("list.member", 3, Mode((0,), (1, 2), member, True)),
        fn("list.length", 2, Mode((0,), (1,), lambda v: length(items(v[0])[0]))),
        fn("list.at", 3, Mode((0, 1), (2,), at)),
        fn("path.length", 2, Mode((0,), (1,), lambda v: length(path_part(v[0], "nodes"), 1))),
        fn("path.node", 3, Mode((0,), (1, 2), lambda v: numbered(path_part(v[0], "nodes"), ANY), True)),
        fn("path.edge", 3, Mode((0,), (1, 2), lambda v: numbered(path_part(v[0], "edges"), ANY), True)),
        fn("path.step", 4, Mode((0,), (1, 2, 3), steps, True)),
        fn("path.nodes", 2, Mode((0,), (1,), lambda v: one(part_text(v[0], "nodes")))),
        fn("path.edges", 2, Mode((0,), (1,), lambda v: one(part_text(v[0], "edges")))),
    ]
    return {p.name: p for p in found}


def simplifying() -> dict[str, Predicate]:
    """The four operations with results cut to 15 digits where nothing is lost."""
    return {n: shortened(n, op, back) for n, op, back in (("num.add", "+", "-"), ("num.sub", "-", "+"), ("num.mul", "*", "/"), ("num.div", "/", "*"))}


def first_of(a: Val, b: Val) -> Val:
    if a.kind.name == b.kind.name and a.kind.name != "any" and a.kind.unit == b.kind.unit:
        return Val(F.coalesce(a.col, b.col), Kind(a.kind.name, a.kind.unit, a.kind.nullable and b.kind.nullable, a.kind.whole and b.kind.whole))
    return Val(F.when(is_absent(a), held(b, ANY)).otherwise(held(a, ANY)), ANY)


def filter_of(check: Callable[..., Column], name: str, arity: int) -> Predicate:
    """A host's own test from a function of columns."""
    return Predicate(name, arity, lambda a: F.coalesce(check(*[v.col for v in a]), F.lit(False)))


def function_of(compute: Callable[..., Column], name: str, arity: int, kind: Kind = NUM) -> Predicate:
    """A host's own function from columns to a column; its result is the last argument."""
    return Predicate(name, arity, modes=(Mode(tuple(range(arity - 1)), (arity - 1,), lambda v: [Val(compute(*[v[i].col for i in range(arity - 1)]), kind)]),))


def equal(a: Val, b: Val) -> Column:
    return compare("=", a, b)
