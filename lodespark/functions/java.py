"""A small Java front end: tokens, the declarations of a compilation unit, and complexity of method bodies.

It knows declarations and statements, not expressions' types. Broken code yields what can be read of it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n\r]*|/\*.*?(?:\*/|\Z))|(?P<lit>"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n\r])*"|\'(?:\\.|[^\'\\\n\r])*\'|\d[\w.]*)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|&&|\|\||\+\+|--|[=!<>+\-*/&|^%]=|\.\.\.|.)',
    re.DOTALL,
)
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


@dataclass(frozen=True)
class Token:
    text: str
    at: int
    end: int
    line: int
    kind: str


@dataclass
class Span:
    """A type as it is written."""

    text: str
    offset: int
    length: int
    line: int


@dataclass
class Method:
    modifiers: list[str]
    returns: Span | None
    name: str
    parameters: list[tuple[Span, str]]
    start: int
    start_line: int
    end_line: int
    body: tuple[int, int] | None

    @property
    def constructor(self) -> bool:
        return self.returns is None

    @property
    def signature(self) -> str:
        front = [*self.modifiers, *([self.returns.text] if self.returns else []), self.name]
        return re.sub(r"\s+", " ", " ".join(front) + "(" + ", ".join(p for _, p in self.parameters) + ")").strip()


@dataclass
class Field:
    modifiers: list[str]
    type: Span
    name: str
    offset: int
    length: int
    line: int


@dataclass
class Type:
    name: str
    kind: str
    superclass: Span | None = None
    interfaces: list[Span] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)
    references: list[str] = field(default_factory=list)


@dataclass
class Unit:
    package: str
    imports: list[str]
    types: list[Type]
    tokens: list[Token]
    broken: bool


def tokens(source: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        text = m.group()
        if m.lastgroup != "skip":
            out.append(Token(text, m.start(), m.end(), line, m.lastgroup or "op"))
        line += text.count("\n") + text.count("\r") - text.count("\r\n")
    return out


class _Reader:
    def __init__(self, source: str) -> None:
        self.source, self.t = source, tokens(source)
        self.broken = False

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def close(self, i: int) -> int:
        """Past the bracket that closes the one at i."""
        depth = 0
        while i < len(self.t):
            x = self.t[i].text if self.t[i].kind == "op" else ""
            depth += (x in _OPEN) - (x in _CLOSE)
            i += 1
            if depth == 0:
                return i
        self.broken = True
        return i

    def angle(self, i: int) -> int:
        """Past the type arguments that begin at i."""
        depth = 0
        while i < len(self.t):
            depth += self.text(i).count("<") - self.text(i).count(">")
            if self.text(i) in (";", "{", ")"):
                return i
            i += 1
            if depth <= 0:
                return i
        return i

    def annotation(self, i: int) -> int:
        i += 2
        while self.text(i) == ".":
            i += 2
        return self.close(i) if self.text(i) == "(" else i

    def front(self, i: int) -> tuple[list[str], int]:
        """Modifiers, and past them; annotations are passed over."""
        found = []
        while i < len(self.t):
            x = self.text(i)
            if x == "@" and self.text(i + 1) != "interface":
                i = self.annotation(i)
            elif x == "non" and self.text(i + 1) == "-" and self.text(i + 2) == "sealed":
                found.append("non-sealed")
                i += 3
            elif x in MODIFIERS and not (x == "default" and self.text(i + 1) in (":", "->")):
                found.append(x)
                i += 1
            else:
                break
        return found, i

    def type(self, i: int) -> tuple[Span | None, int]:
        while self.text(i) == "@":
            i = self.annotation(i)
        first = i
        if i >= len(self.t) or self.t[i].kind != "id":
            return None, i
        i += 1
        while True:
            if self.text(i) == "<":
                i = self.angle(i)
            elif self.text(i) == "." and i + 1 < len(self.t) and self.t[i + 1].kind == "id":
                i += 2
            elif self.text(i) == "[" and self.text(i + 1) == "]":
                i += 2
            elif self.text(i) == "..." and first < i:
                i += 1
            else:
                break
        a, b = self.t[first], self.t[i - 1]
        return Span(re.sub(r"\s+", "" if "<" not in self.source[a.at : b.end] else " ", self.source[a.at : b.end]), a.at, b.end - a.at, a.line), i

    def types(self, i: int) -> tuple[list[Span], int]:
        out = []
        while True:
            one, i = self.type(i)
            if one is None:
                return out, i
            out.append(one)
            if self.text(i) not in (",", "&"):
                return out, i
            i += 1

    def declaration(self, i: int) -> tuple[Type | None, int]:
        """The type that is declared at its keyword, and past it."""
        kind = KINDS.get(self.text(i), "class")
        if self.text(i) == "@":
            kind, i = "annotation", i + 1
        out = Type(self.text(i + 1), kind)
        i += 2
        if self.text(i) == "<":
            i = self.angle(i)
        if self.text(i) == "(" and kind == "record":
            i = self.close(i)
        while i < len(self.t) and self.text(i) != "{":
            if self.text(i) in ("extends", "implements", "permits"):
                word = self.text(i)
                found, i = self.types(i + 1)
                if word == "extends" and kind == "class":
                    out.superclass = found[0] if found else None
                elif word != "permits":
                    out.interfaces += found
            else:
                i += 1
        if i >= len(self.t):
            self.broken = True
            return out, i
        end = self.close(i)
        self.members(out, i + 1, end - 1)
        return out, end

    def members(self, out: Type, i: int, end: int) -> None:
        if out.kind == "enum":
            while i < end and self.text(i) != ";":
                i = self.close(i) if self.text(i) in _OPEN else i + 1
            i += 1
        while i < end:
            start = i
            modifiers, i = self.front(i)
            x = self.text(i)
            if i >= end:
                break
            if x == ";":
                i += 1
                continue
            if x == "{":
                i = self.close(i)
                continue
            if x in ("class", "interface", "enum") or x == "@" or x == "record" and self.t[i + 1].kind == "id" and self.text(i + 2) in ("(", "<"):
                _, i = self.declaration(i)
                continue
            if x == "<":
                i = self.angle(i)
            first = start
            while self.text(first) == "@":
                first = self.annotation(first)
            if self.text(i) == out.name and self.text(i + 1) in ("(", "{"):
                i = self.method(out, modifiers, None, i, start)
                continue
            kind, j = self.type(i)
            if kind is None or j >= end or self.t[j].kind != "id":
                i = self.close(i) if self.text(i) in _OPEN else i + 1
                continue
            if self.text(j + 1) == "(":
                i = self.method(out, modifiers, kind, j, start)
            else:
                i = self.fields(out, modifiers, kind, j, end)

    def method(self, out: Type, modifiers: list[str], returns: Span | None, i: int, start: int) -> int:
        name, parameters = self.text(i), []
        i += 1
        if self.text(i) == "(":
            end = self.close(i)
            i += 1
            while i < end - 1:
                first = i
                _, i = self.front(i)
                kind, i = self.type(i)
                if kind is None:
                    i += 1
                    continue
                while i < end - 1 and self.text(i) != ",":
                    i += 1
                parameters.append((kind, self.source[self.t[first].at : self.t[i - 1].end]))
                i += 1
            i = end
        while i < len(self.t) and self.text(i) not in ("{", ";"):
            i = self.close(i) if self.text(i) in "([" and self.text(i) else i + 1
        body = None
        if self.text(i) == "{":
            body = (i, self.close(i))
            i = body[1]
        else:
            i += 1
        last = self.t[min(i, len(self.t)) - 1]
        out.methods.append(Method(modifiers, returns, name, parameters, self.t[start].at, self.t[start].line, last.line, body))
        return i

    def fields(self, out: Type, modifiers: list[str], kind: Span, i: int, end: int) -> int:
        while i < end:
            name, first = self.t[i], i
            i += 1
            while i < end and self.text(i) not in (",", ";"):
                i = self.close(i) if self.text(i) in _OPEN else self.angle(i) if self.text(i) == "<" and self.text(i - 1)[:1].isupper() else i + 1
            out.fields.append(Field(modifiers, kind, name.text, name.at, self.t[max(i - 1, first)].end - name.at, name.line))
            if self.text(i) != ",":
                return i + 1
            i += 1
        return i


def parse(source: str) -> Unit:
    r = _Reader(source)
    package, imports, types, i = "", [], [], 0
    while i < len(r.t):
        start = i
        _, i = r.front(i)
        x = r.text(i)
        if x in ("package", "import"):
            i += 1
            if r.text(i) == "static":
                i += 1
            name = ""
            while i < len(r.t) and r.text(i) != ";":
                name += r.text(i)
                i += 1
            if x == "package":
                package = name
            else:
                imports.append(name.removesuffix(".*"))
            i += 1
        elif x in KINDS or x == "@":
            one, i = r.declaration(i)
            if one is not None and one.name:
                types.append(one)
        else:
            r.broken |= x not in (";", "")
            i = max(i, start) + 1
    return Unit(package, imports, types, r.t, r.broken)


#: Names of types, in their order of appearance: capitalised names that don't follow a dot and aren't called or declared.
def type_references(unit: Unit) -> list[str]:
    found: dict[str, None] = {}
    t = unit.tokens
    for k, x in enumerate(t):
        if x.kind != "id" or not x.text[:1].isupper() or k and t[k - 1].text in (".", "class", "interface", "enum", "record", "::", "@"):
            continue
        after = t[k + 1].text if k + 1 < len(t) else ""
        before = t[k - 1].text if k else ""
        if after == "(" and before != "new" or after in ("=", ";", ",", ")") and before not in ("new", "extends", "implements", ",", "(", "throws", "<", "permits", "|"):
            continue
        found[x.text] = None
    return list(found)


class _Walk:
    """Decisions of a body: (cyclomatic, cognitive, deepest nesting, count by kind)."""

    def __init__(self, t: list[Token]) -> None:
        self.t = t
        self.cyclomatic, self.cognitive, self.deepest = 1, 0, 0
        self.kinds: Counter[str] = Counter()

    def at(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def only(self, kind: str) -> None:
        self.cyclomatic += 1
        self.kinds[kind] += 1

    def nested(self, kind: str, nesting: int, cost: int | None = None) -> int:
        self.only(kind)
        self.cognitive += 1 + (nesting if cost is None else cost)
        self.deepest = max(self.deepest, nesting + 1)
        return nesting + 1

    def block(self, i: int, nesting: int) -> int:
        i += 1
        while i < len(self.t) and self.at(i) != "}":
            i = max(self.statement(i, nesting), i + 1)
        return i + 1

    def group(self, i: int, nesting: int) -> int:
        """Past the bracketed expressions at i."""
        end = _OPEN[self.at(i)]
        i += 1
        while i < len(self.t) and self.at(i) != end:
            i = self.expression(i, nesting, (",", ";", end))
            i += self.at(i) in (",", ";")
        return i + 1

    def statement(self, i: int, nesting: int, after_else: bool = False) -> int:
        x = self.at(i)
        if x == "{":
            return self.block(i, nesting)
        if x == "if" and self.at(i + 1) == "(":
            inner = self.nested("if", nesting, max(0, nesting - 1) if after_else else None)
            i = self.statement(self.group(i + 1, inner), inner)
            if self.at(i) == "else":
                i = self.statement(i + 1, inner, self.at(i + 1) == "if")
            return i
        if x in ("for", "while") and self.at(i + 1) == "(":
            inner = self.nested("loop", nesting)
            return self.statement(self.group(i + 1, inner), inner)
        if x == "do":
            inner = self.nested("loop", nesting)
            i = self.statement(i + 1, inner)
            return self.group(i + 1, inner) + 1 if self.at(i) == "while" else i
        if x == "try":
            i += 1
            if self.at(i) == "(":
                i = self.group(i, nesting)
            i = self.block(i, nesting)
            while self.at(i) in ("catch", "finally"):
                inner = nesting
                if self.at(i) == "catch":
                    inner = self.nested("catch", nesting)
                    i = self.group(i + 1, inner) - 1
                i = self.block(i + 1, inner)
            return i
        if x == "switch" and self.at(i + 1) == "(":
            inner = self.nested("switch", nesting)
            return self.switch(self.group(i + 1, inner), inner)
        if x == "synchronized" and self.at(i + 1) == "(":
            return self.block(self.group(i + 1, nesting), nesting)
        if i + 1 < len(self.t) and self.t[i].kind == "id" and self.at(i + 1) == ":":
            return self.statement(i + 2, nesting)
        return self.expression(i, nesting, (";", "}")) + (self.at(self.last) == ";")

    def switch(self, i: int, nesting: int) -> int:
        if self.at(i) != "{":
            return i
        i += 1
        while i < len(self.t) and self.at(i) != "}":
            if self.at(i) == "case" or self.at(i) == "default" and self.at(i + 1) in (":", "->"):
                self.only("switchCase")
                i = self.expression(i + 1, nesting, (":", "->")) + 1
            else:
                i = max(self.statement(i, nesting), i + 1)
        return i + 1

    def expression(self, i: int, nesting: int, stops: tuple[str, ...]) -> int:
        while i < len(self.t):
            x = self.t[i]
            if x.kind == "op" and x.text in stops or x.text in _CLOSE:
                break
            if x.text == "switch" and self.at(i + 1) == "(":
                i = self.switch(self.group(i + 1, nesting), nesting)
                continue
            if x.kind == "op":
                if x.text in ("(", "["):
                    i = self.group(i, nesting)
                    continue
                if x.text == "{":
                    i = self.block(i, nesting)
                    continue
                if x.text in ("&&", "||"):
                    self.only("booleanOperator")
                    self.cognitive += 1
                elif x.text == "?" and self.at(i - 1) not in ("<", ",") and self.at(i + 1) not in ("extends", "super", ">", ","):
                    nesting = self.nested("conditionalExpression", nesting)
                    i = self.expression(i + 1, nesting, (":", ";", ","))
            i += 1
        self.last = i
        return i


def complexity(unit: Unit, method: Method) -> dict:
    w = _Walk(unit.tokens)
    if method.body:
        w.t = unit.tokens[: method.body[1]]
        w.block(method.body[0], 0)
    return {"cyclomaticComplexity": w.cyclomatic, "cognitiveComplexity": w.cognitive, "maxNestingDepth": w.deepest, "decisionPointCount": sum(w.kinds.values()), "decisionPointsByKind": dict(w.kinds)}
