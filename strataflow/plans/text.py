"""Program text to syntax tree, and back."""

from __future__ import annotations

import re

from strataflow.errors import SyntaxRefused
from strataflow.plans.tree import Agg, Atom, Call, Column, Compare, Const, Maybe, Not, Op, Query, Reduce, Rule, Var, Wild

AGGREGATES = ("count", "sum", "avg", "min", "max", "list")
TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      |(?P<var>\?[A-Za-z0-9_]+)
      |(?P<string>"(?:\\.|[^"\\])*")
      |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![A-Za-z0-9_]*[(]))(?P<unit>[A-Za-zΩµ%][A-Za-z0-9Ωµ/*^]*)?
      |(?P<name>[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*)
      |(?P<mark>:-|\?-|=>|<=|>=|!=|[-+*/(){},;:<>=!.])""",
    re.X | re.S,
)


class Reader:
    """Tokens with one token of lookahead."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens: list[tuple[str, str, str, int]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SyntaxRefused("unclosed string" if text[at] == '"' else f"unexpected {text[at]!r}", at)
            kind = next(k for k in ("skip", "var", "string", "number", "name", "mark") if m[k] is not None)
            if kind != "skip":
                self.tokens.append((kind, m[kind], m["unit"] or "", at))
            at = m.end()
        self.tokens.append(("end", "", "", len(text)))
        self.i = 0

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def word(self) -> str:
        return self.tokens[self.i][1] if self.kind != "string" else ""

    @property
    def at(self) -> int:
        return self.tokens[self.i][3]

    def next(self) -> tuple[str, str, str, int]:
        self.i += 1
        return self.tokens[self.i - 1]

    def take(self, *words: str) -> str | None:
        if self.kind in ("mark", "name") and self.word in words:
            return self.next()[1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SyntaxRefused(f"expected {word!r}, found {self.tokens[self.i][1] or 'the end'!r}", self.at)

    def ahead(self, n: int = 1) -> str:
        j = min(self.i + n, len(self.tokens) - 1)
        return self.tokens[j][1] if self.tokens[j][0] in ("mark", "name") else ""

    # terms and expressions

    def term(self) -> object:
        kind, word, unit, at = self.next()
        if kind == "var":
            return Var(word[1:])
        if kind == "name" and word == "_":
            return Wild()
        if kind == "string":
            return Const(word[1:-1])
        if kind == "number":
            return number(word, unit)
        if kind == "mark" and word in "+-" and self.kind == "number":
            c = self.term()
            return Const(-c.value, c.unit) if word == "-" else c
        raise SyntaxRefused(f"expected a term, found {word or 'the end'!r}; a variable is written ?{word}" if kind == "name" else f"expected a term, found {word or 'the end'!r}", at)

    def expr(self, level: int = 0) -> object:
        if level == 2:
            return self.unary()
        left = self.expr(level + 1)
        while op := self.take(*("+-", "*/")[level]):
            left = Op(op, (left, self.expr(level + 1)))
        return left

    def unary(self) -> object:
        if self.take("-"):
            inner = self.unary()
            return Const(-inner.value, inner.unit) if isinstance(inner, Const) and not isinstance(inner.value, str) else Op("neg", (inner,))
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.kind == "name" and self.ahead() == "(":
            name = self.next()[1]
            return Call(name, self.listed(self.expr))
        return self.term()

    def listed(self, item) -> tuple:
        self.need("(")
        out = []
        while not self.take(")"):
            if out:
                self.need(",")
            out.append(item())
        return tuple(out)

    def aggregate(self) -> Agg | None:
        if self.kind != "name" or self.word not in AGGREGATES or self.ahead() != "(":
            return None
        save = self.i
        func = self.next()[1]
        self.need("(")
        distinct = bool(self.kind == "name" and self.word == "distinct" and self.next())
        if self.kind != "var":
            self.i = save
            return None
        var = self.next()[1][1:]
        if not self.take(")"):
            self.i = save
            return None
        return Agg(func, var, distinct)

    # literals

    def atom(self) -> Atom:
        if self.kind != "name":
            raise SyntaxRefused(f"expected a relation, found {self.tokens[self.i][1] or 'the end'!r}", self.at)
        name = self.next()[1]
        return Atom(name, self.listed(self.term))

    def literal(self) -> object:
        if self.kind == "name" and self.word == "not" and self.ahead() != "(":
            self.next()
            return Not(self.atom())
        if self.take("!"):
            return Not(self.atom())
        if self.kind == "name" and self.word == "optional" and self.ahead() == "{":
            self.next()
            return Maybe(self.braces())
        if self.kind == "name" and self.ahead() == "(":
            save = self.i
            try:
                atom = self.atom()
                if self.take("as"):
                    if self.kind != "var":
                        raise SyntaxRefused("`as` takes a variable", self.at)
                    return Atom(atom.rel, atom.args, self.next()[1][1:])
                if self.word not in ("=", "!=", "<", "<=", ">", ">=", "+", "-", "*", "/"):
                    return atom
            except SyntaxRefused:
                pass
            self.i = save
        left = self.expr()
        op = self.take("=", "!=", "<=", ">=", "<", ">")
        if not op:
            raise SyntaxRefused("expected a comparison", self.at)
        if op == "=" and isinstance(left, Var) and (agg := self.aggregate()):
            if self.take(":"):
                return Reduce(left.name, agg, self.braces())
            raise SyntaxRefused("an aggregate in a literal needs `: { ... }`", self.at)
        return Compare(op, left, self.expr())

    def braces(self) -> tuple:
        self.need("{")
        body = self.literals()
        self.need("}")
        return body

    def literals(self) -> tuple:
        out = [self.literal()]
        while self.take(","):
            out.append(self.literal())
        return tuple(out)

    # clauses

    def item(self) -> object:
        return self.aggregate() or self.expr()

    def head_arg(self) -> tuple:
        item = self.item()
        declared = None
        if self.take(":"):
            start, depth = self.at, 0
            while not (depth == 0 and self.word in (",", ")")) and self.kind != "end":
                depth += (self.word in ("(", "{")) - (self.word in (")", "}"))
                self.next()
            declared = self.text[start : self.at].strip()
        return item, declared

    def end(self) -> bool:
        if self.take(";"):
            return True
        if self.word == "." and self.kind == "mark":
            after = self.at + 1
            if after >= len(self.text) or self.text[after].isspace() or self.text[after : after + 2] == "=>":
                self.next()
                return True
        return False

    def program(self, goal: bool = True) -> Query:
        rules, found = [], None
        while self.kind != "end":
            if self.take("?-") or self.take("=>"):
                body = self.literals()
                self.end()
                found = Query(goal=body)
                continue
            save = self.i
            if self.kind == "name" and self.ahead() == "(":
                name = self.next()[1]
                try:
                    args = self.listed(self.head_arg)
                except SyntaxRefused:
                    args = None
                if args is not None and self.take(":-"):
                    body = self.literals()
                    rules.append(Rule(name, tuple(a for a, _ in args), body, tuple(t for _, t in args)))
                    if not self.end() and self.kind != "end":
                        raise SyntaxRefused("expected `;` after a rule", self.at)
                    continue
                if args is not None and not goal and self.end():  # a fact of a module
                    rules.append(Rule(name, tuple(a for a, _ in args), ()))
                    continue
                self.i = save
            if found is not None:
                raise SyntaxRefused("more than one goal", self.at)
            found = self.goal()
            self.end()
        if goal and found is None:
            raise SyntaxRefused("no goal", self.at)
        found = found or Query()
        return Query(tuple(rules), found.goal, found.select, found.having, found.order, found.after, found.limit, found.offset)

    def goal(self) -> Query:
        body = self.literals()
        if self.word == "." and self.ahead() == "=>":
            self.next()
        if not self.take("=>"):
            return Query(goal=body)
        select, having, order, after, limit, offset = [self.column()], [], [], (), None, 0
        while self.take(","):
            select.append(self.column())
        if self.take("having"):
            while True:
                agg = self.aggregate()
                op = self.take("=", "!=", "<=", ">=", "<", ">") if agg else None
                if not op:
                    raise SyntaxRefused("`having` takes an aggregate and a comparison", self.at)
                having.append((agg, op, self.term()))
                if not self.take(","):
                    break
        if self.take("order"):
            self.need("by")
            while True:
                item = self.item()
                order.append((item, self.take("asc", "desc") == "desc"))
                if not self.take(","):
                    break
            if self.take("after"):
                values = [self.term()]
                while self.take(","):
                    values.append(self.term())
                after = tuple(values)
        if self.take("limit"):
            limit = self.count("limit", 1)
        if self.take("offset"):
            offset = self.count("offset", 0)
        return Query((), body, tuple(select), tuple(having), tuple(order), after, limit, offset)

    def column(self) -> Column:
        start = self.at
        item = self.item()
        return Column(item, re.sub(r"\?|\s+$", "", self.text[start : self.at]).rstrip(" ,."))

    def count(self, what: str, least: int) -> int:
        kind, word, _, at = self.next()
        if kind != "number" or not word.isdigit() or int(word) < least:
            raise SyntaxRefused(f"`{what}` takes a whole number, {least} at least", at)
        return int(word)


def number(word: str, unit: str = "") -> Const:
    if unit:
        from strataflow.functions.units import base

        factor, unit = base(unit)
        return Const(float(word) * factor, unit)
    return Const(int(word) if re.fullmatch(r"\d+", word) else float(word))


def parse(text: str) -> Query:
    return Reader(text).program()


def parse_rules(text: str) -> tuple[Rule, ...]:
    return Reader(text).program(goal=False).rules


# the other way


def show(x: object) -> str:
    if isinstance(x, Var):
        return f"?{x.name}"
    if isinstance(x, Wild):
        return "_"
    if isinstance(x, Const):
        return f'"{x.value}"' if isinstance(x.value, str) else f"{x.value}{x.unit}" if x.value is not None else "absent"
    if isinstance(x, Op):
        return f"-{show(x.args[0])}" if x.name == "neg" else f"({show(x.args[0])} {x.name} {show(x.args[1])})"
    if isinstance(x, Call):
        return f"{x.name}({', '.join(map(show, x.args))})"
    if isinstance(x, Agg):
        return f"{x.func}({'distinct ' * x.distinct}?{x.var})"
    if isinstance(x, Atom):
        return f"{x.rel}({', '.join(map(show, x.args))})" + (f" as ?{x.fact}" if x.fact else "")
    if isinstance(x, Not):
        return f"not {show(x.atom)}"
    if isinstance(x, Compare):
        return f"{show(x.left)} {x.op} {show(x.right)}"
    if isinstance(x, Reduce):
        return f"?{x.var} = {show(x.agg)} : {{ {show_body(x.body)} }}"
    if isinstance(x, Maybe):
        return f"optional {{ {show_body(x.body)} }}"
    if isinstance(x, Rule):
        head = f"{x.rel}({', '.join(map(show, x.args))})"
        return f"{head} :- {show_body(x.body)};" if x.body else f"{head};"
    if isinstance(x, Query):
        out = [show(r) for r in x.rules] + [show_body(x.goal)]
        if x.select is not None:
            out[-1] += " => " + ", ".join(show(c.item) for c in x.select)
        if x.having:
            out[-1] += " having " + ", ".join(f"{show(a)} {op} {show(t)}" for a, op, t in x.having)
        if x.order:
            out[-1] += " order by " + ", ".join(show(i) + " desc" * d for i, d in x.order)
        if x.after:
            out[-1] += " after " + ", ".join(map(show, x.after))
        if x.limit is not None:
            out[-1] += f" limit {x.limit}"
        if x.offset:
            out[-1] += f" offset {x.offset}"
        return "\n".join(out)
    return str(x)


def show_body(body: tuple) -> str:
    return ", ".join(map(show, body))
