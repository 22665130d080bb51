"""Cypher text to clauses. Expressions are tuples: (kind, parts...)."""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      |(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
      |(?P<number>0x[0-9a-fA-F]+|\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
      |(?P<name>[A-Za-z_][A-Za-z0-9_]*|`[^`]+`)
      |(?P<param>\$[A-Za-z0-9_]+)
      |(?P<mark><=|>=|<>|!=|=~|\.\.|->|<-|[-+*/%^(){}\[\],.:;|=<>])""",
    re.X | re.S,
)
WRITES = ("create", "merge", "delete", "detach", "set", "remove", "foreach", "load", "use")


class Refused(ValueError):
    """Cypher that isn't compiled: a mistake, or with gap a construct that programs don't express."""

    def __init__(self, message: str, at: int = 0, gap: bool = False) -> None:
        super().__init__(f"{message} (at {at})")
        self.at, self.gap = at, gap


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise Refused(f"unexpected {text[at]!r}", at)
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup or "", m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.i = 0
        self.text = text

    @property
    def at(self) -> int:
        return self.tokens[self.i][2]

    def peek(self, n: int = 0) -> str:
        kind, word, _ = self.tokens[min(self.i + n, len(self.tokens) - 1)]
        return word.lower() if kind == "name" else word if kind == "mark" else f"<{kind}>"

    def take(self, *words: str) -> bool:
        for k, w in enumerate(words):
            if self.peek(k) != w:
                return False
        self.i += len(words)
        return True

    def need(self, word: str) -> None:
        if not self.take(word):
            raise Refused(f"expected {word}, found {self.tokens[self.i][1] or 'the end'}", self.at)

    def name(self) -> str:
        kind, word, at = self.tokens[self.i]
        if kind != "name":
            raise Refused(f"expected a name, found {word or 'the end'}", at)
        self.i += 1
        return word.strip("`")

    # statements

    def statement(self) -> list[tuple[bool, list]]:
        """Parts joined by UNION, each a list of clauses."""
        while self.take("profile") or self.take("cypher"):
            while self.peek() == "<number>" or (self.tokens[self.i][0] == "name" and self.peek(1) == "="):
                self.i += 1 if self.peek() == "<number>" else 3
        if self.peek() == "explain":
            raise Refused("EXPLAIN isn't a query", self.at)
        parts = [(False, self.clauses())]
        while self.take("union"):
            parts.append((self.take("all"), self.clauses()))
        self.take(";")
        if self.tokens[self.i][0] != "end":
            raise Refused(f"unexpected {self.tokens[self.i][1]}", self.at)
        return parts

    def clauses(self) -> list:
        out = []
        while True:
            word, at = self.peek(), self.at
            if word in WRITES:
                raise Refused(f"{word.upper()}: only reading is supported", at, True)
            if self.take("optional", "match"):
                out.append(("match", True, self.patterns(), self.where(), at))
            elif self.take("match"):
                out.append(("match", False, self.patterns(), self.where(), at))
            elif self.take("with"):
                distinct = self.take("distinct")
                items = self.items()
                if self.peek() in ("order", "skip", "offset", "limit"):
                    raise Refused("an order or a limit inside WITH", self.at, True)
                out.append(("with", distinct, items, self.where(), at))
            elif self.take("unwind"):
                e = self.expr()
                self.need("as")
                out.append(("unwind", e, self.name(), at))
            elif self.take("call"):
                if self.peek() == "{":
                    raise Refused("CALL { } subqueries", at, True)
                name = self.name()
                while self.take("."):
                    name += "." + self.name()
                self.need("(")
                args = self.list_of(self.expr, ")")
                fields = []
                if self.take("yield"):
                    while True:
                        field = self.name()
                        fields.append((field, self.name() if self.take("as") else field))
                        if not self.take(","):
                            break
                out.append(("call", name, args, fields, self.where(), at))
            elif self.take("return"):
                self.take("distinct")
                items = self.items()
                order, skip, limit = [], 0, None
                if self.take("order", "by"):
                    while True:
                        e = self.expr()
                        down = self.take("desc") or self.take("descending")
                        if not down:
                            self.take("asc") or self.take("ascending")
                        order.append((e, down))
                        if not self.take(","):
                            break
                while self.peek() in ("skip", "offset", "limit"):
                    word = self.name().lower()
                    value = self.expr()
                    if value[0] != "const" or not isinstance(value[1], int):
                        raise Refused(f"{word.upper()} takes a number", self.at)
                    skip, limit = (skip, value[1]) if word == "limit" else (value[1], limit)
                out.append(("return", items, order, skip, limit, at))
                return out
            else:
                break
        if not out:
            raise Refused(f"not a query: {self.tokens[self.i][1] or 'nothing'}", self.at)
        raise Refused("a query ends in RETURN", self.at, True)

    def where(self) -> tuple | None:
        return self.expr() if self.take("where") else None

    def items(self) -> list:
        """(expression, alias); ("*",) for all."""
        out = []
        while True:
            if self.take("*"):
                out.append((("*",), ""))
            else:
                start = self.at
                e = self.expr()
                shown = self.text[start : self.at].strip()
                out.append((e, self.name() if self.take("as") else shown.strip("`")))
            if not self.take(","):
                return out

    def list_of(self, item, close: str) -> list:
        out = []
        while not self.take(close):
            if out:
                self.need(",")
            out.append(item())
        return out

    # patterns

    def patterns(self) -> list:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def path(self) -> tuple:
        """(path variable, shortest, [node, (edge, node)...])."""
        var, shortest = None, False
        if self.tokens[self.i][0] == "name" and self.peek(1) == "=":
            var = self.name()
            self.need("=")
        if self.take("shortest"):
            if self.peek() != "<number>" or self.tokens[self.i][1] != "1":
                raise Refused("only SHORTEST 1", self.at, True)
            self.i += 1
            shortest = True
        elif self.peek() == "all" and self.peek(1) == "shortest":
            raise Refused("ALL SHORTEST paths", self.at, True)
        if self.peek() == "shortestpath":
            self.name()
            self.need("(")
            shortest = True
            elements = self.chain()
            self.need(")")
        else:
            elements = self.chain()
        return var, shortest, elements

    def chain(self) -> list:
        out: list = [self.node()]
        while self.peek() in ("-", "<-") or (self.peek() == "<" and self.peek(1) == "-"):
            out += [self.edge(), self.node()]
        return out

    def node(self) -> tuple:
        self.need("(")
        if self.peek() == "(":
            raise Refused("quantified path patterns", self.at, True)
        var = self.name() if self.tokens[self.i][0] == "name" and self.peek() not in ("where", "is") else None
        labels = []
        while self.take(":") or self.take("is"):
            labels.append(self.name())
            while self.peek() in ("|", "%") or self.peek() == "&":
                raise Refused("label expressions", self.at, True)
        props = self.properties()
        where = self.where()
        self.need(")")
        return "node", var, labels, props, where

    def properties(self) -> list:
        if not self.take("{"):
            return []

        def pair() -> tuple:
            key = self.name()
            self.need(":")
            return key, self.expr()

        return self.list_of(pair, "}")

    def edge(self) -> tuple:
        back = self.take("<-")
        if not back:
            self.need("-")
        var, types, props, span = None, [], [], None
        if self.take("["):
            if self.tokens[self.i][0] == "name":
                var = self.name()
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            if self.take("*"):
                low = int(self.tokens[self.i][1]) if self.peek() == "<number>" else None
                self.i += low is not None
                if self.take(".."):
                    high = int(self.tokens[self.i][1]) if self.peek() == "<number>" else None
                    self.i += high is not None
                    span = (1 if low is None else low, high or 0)
                else:
                    span = (low if low is not None else 1, low or 0)
            props = self.properties()
            self.need("]")
        forth = self.take("->")
        if not forth:
            self.need("-")
        if back and forth:
            back = forth = False
        if self.take("+"):
            span = (1, 0)
        elif self.peek() == "*" and self.peek(1) == "(":
            self.i += 1
            span = (0, 0)
        elif self.peek() == "{":
            self.i += 1
            low = int(self.tokens[self.i][1]) if self.peek() == "<number>" else 0
            self.i += self.peek() == "<number>"
            high = low
            if self.take(","):
                high = int(self.tokens[self.i][1]) if self.peek() == "<number>" else 0
                self.i += self.peek() == "<number>"
            self.need("}")
            span = (low, high)
        if var and span:
            raise Refused("a variable on a relationship of variable length", self.at, True)
        return "edge", var, types, props, span, "<" if back else ">" if forth else "-"

    # expressions

    def expr(self) -> tuple:
        left = self.xor()
        while self.take("or"):
            left = ("or", left, self.xor())
        return left

    def xor(self) -> tuple:
        left = self.conj()
        while self.take("xor"):
            left = ("xor", left, self.conj())
        return left

    def conj(self) -> tuple:
        left = self.inverse()
        while self.take("and"):
            left = ("and", left, self.inverse())
        return left

    def inverse(self) -> tuple:
        return ("not", self.inverse()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        while True:
            if self.take("is", "not", "null"):
                left = ("not", ("null", left))
            elif self.take("is", "null"):
                left = ("null", left)
            elif self.take("starts", "with"):
                left = ("test", "str.prefix", left, self.sum())
            elif self.take("ends", "with"):
                left = ("test", "str.suffix", left, self.sum())
            elif self.take("contains"):
                left = ("test", "str.contains", left, self.sum())
            elif self.take("=~"):
                left = ("match", left, self.sum())
            elif self.take("in"):
                left = ("in", left, self.sum())
            elif self.peek() in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.tokens[self.i][1]
                self.i += 1
                left = ("compare", "!=" if op == "<>" else op, left, self.sum())
            else:
                return left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek() in ("+", "-"):
            op = self.tokens[self.i][1]
            self.i += 1
            left = ("op", op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while self.peek() in ("*", "/", "%", "^"):
            op = self.tokens[self.i][1]
            if op in "%^":
                raise Refused(f"the operator {op}", self.at, True)
            self.i += 1
            left = ("op", op, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.take("-"):
            e = self.unary()
            return ("const", -e[1]) if e[0] == "const" else ("neg", e)
        e = self.primary()
        while True:
            if self.take("."):
                e = ("prop", e, self.name())
            elif self.take("["):
                i = self.expr()
                self.need("]")
                e = ("index", e, i)
            elif self.peek() == ":" and e[0] == "var":
                self.i += 1
                e = ("label", e, self.name())
            else:
                return e

    def primary(self) -> tuple:
        kind, word, at = self.tokens[self.i]
        if kind == "string":
            self.i += 1
            return "const", re.sub(r"\\(.)", r"\1", word[1:-1])
        if kind == "number":
            self.i += 1
            return "const", int(word, 16) if word.startswith("0x") else int(word) if word.isdigit() else float(word)
        if kind == "param":
            self.i += 1
            return "param", word[1:]
        if self.take("["):
            return "list", self.list_of(self.expr, "]")
        if self.peek() == "{":
            raise Refused("maps", at, True)
        if self.peek() == "(":
            if self.is_pattern():
                return "pattern", self.chain()
            self.need("(")
            e = self.expr()
            self.need(")")
            return e
        low = self.peek()
        if low in ("exists", "count") and self.peek(1) == "{":
            self.i += 2
            self.take("match")
            body = (low + "{}", self.patterns(), self.where())
            self.need("}")
            return body
        if low == "case":
            raise Refused("CASE", at, True)
        if low in ("true", "false"):
            raise Refused("a truth value as a value", at, True)
        if low == "null":
            self.i += 1
            return "const", None
        name = self.name()
        if self.take("("):
            if name.lower() == "exists" and self.peek() == "(":
                inner = ("pattern", self.chain())
                self.need(")")
                return inner
            if self.take("*"):
                self.need(")")
                return "call", name.lower(), False, [("*",)]
            distinct = self.take("distinct")
            return "call", name.lower(), distinct, self.list_of(self.expr, ")")
        return "var", name

    def is_pattern(self) -> bool:
        """Whether the ( here begins a pattern: its closing ) is followed by a relationship."""
        depth, j = 0, self.i
        while j < len(self.tokens):
            word = self.tokens[j][1]
            if self.tokens[j][0] == "mark":
                depth += (word == "(") - (word == ")")
                if depth == 0:
                    after = [t[1] for t in self.tokens[j + 1 : j + 3]]
                    return after[:1] == ["<-"] or after in (["-", "["], ["-", "-"], ["-", "->"]) or after[:2] == ["-", "("]
            j += 1
        return False
