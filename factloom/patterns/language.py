"""The access-path pattern language: syntax trees, a recursive-descent parser and a printer.

  detection := import[D] (glob | path) | read[O] path [base:types] | write path {value:types | base:types}
             | call[R][Promise][NotNew] path filter* | component path filter*
  path      := '<' glob '>' | '{' path, .. '}' | '(' path '\\' path ')', then .prop  .{prop,..}  ()  ?  **
  filter    := '[' min? ',' max? ']' | (base | [-]n)[.prop]* ':' types
  types     := type | '{' type, .. '}'
A pattern that cannot be read raises PatternError with a column, counted from 1.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Simple types; tested as prefixes, in this order.
SIMPLE = ("undefined", "boolean", "string", "number", "array", "empty-array", "object", "null", "function", "any")
PROP = re.compile(r"[^,{}./()*<>\[\]:\\ ]+")


class PatternError(ValueError):
    def __init__(self, column: int, what: str):
        super().__init__(f"column {column}: {what}")
        self.column = column


@dataclass(frozen=True)
class Module:
    glob: str

    def __str__(self):
        return f"<{self.glob}>"


@dataclass(frozen=True)
class Prop:
    base: object
    names: tuple[str, ...]

    def __str__(self):
        return f"{self.base}.{self.names[0] if len(self.names) == 1 else '{' + ','.join(self.names) + '}'}"


@dataclass(frozen=True)
class Result:
    base: object

    def __str__(self):
        return f"{self.base}()"


@dataclass(frozen=True)
class Component:
    base: object

    def __str__(self):
        return f"{self.base}<>"


@dataclass(frozen=True)
class Either:
    parts: tuple

    def __str__(self):
        return "{" + ",".join(map(str, self.parts)) + "}"


@dataclass(frozen=True)
class Without:
    include: object
    exclude: object

    def __str__(self):
        return f"({self.include}\\{self.exclude})"


@dataclass(frozen=True)
class MaybeUnknown:
    base: object

    def __str__(self):
        return f"{self.base}?"


@dataclass(frozen=True)
class Wildcard:
    base: object

    def __str__(self):
        return f"{self.base}**"


@dataclass(frozen=True)
class Type:
    """kind: simple (name, arity for functions), value (a literal) or named (a nominal type)."""

    kind: str
    value: object
    arity: int | None = None

    def __str__(self):
        if self.kind == "value":
            return {True: "true", False: "false"}[self.value] if isinstance(self.value, bool) else f'"{self.value}"' if isinstance(self.value, str) else str(self.value)
        return f"{self.value}{'' if self.arity is None else self.arity}"


@dataclass(frozen=True)
class ArgCount:
    least: int | None
    most: int | None

    def __str__(self):
        return f"[{'' if self.least is None else self.least},{'' if self.most is None else self.most}]"


@dataclass(frozen=True)
class TypeFilter:
    """head: "base", "value" or an argument's number (negative: from the end)."""

    head: object
    props: tuple[str, ...]
    types: tuple[Type, ...]

    def __str__(self):
        types = str(self.types[0]) if len(self.types) == 1 else "{" + ",".join(map(str, self.types)) + "}"
        return ".".join([str(self.head), *self.props]) + ":" + types


@dataclass(frozen=True)
class Detection:
    kind: str
    flags: frozenset[str]
    path: object
    filters: tuple = ()

    def __str__(self):
        word = self.kind + "".join(f for f in ("D", "O", "R", "Promise", "NotNew") if f in self.flags)
        path = self.path.base if self.kind in ("call", "component") else self.path
        return " ".join([word, str(path), *map(str, self.filters)])


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str):
        raise PatternError(self.at + 1, what)

    def peek(self, token: str) -> bool:
        return self.text[self.at : self.at + len(token)].lower() == token.lower()

    def eat(self, token: str) -> bool:
        if self.peek(token):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.eat(token):
            self.fail(f"expected {token!r}")

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def match(self, pattern: str) -> str | None:
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    def prop(self) -> str:
        m = PROP.match(self.text, self.at)
        if not m:
            self.fail("expected a property")
        self.at = m.end()
        return m[0]

    def glob(self, stop: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stop:
            self.at += 1
        if start == self.at:
            self.fail("expected a module")
        return self.text[start : self.at]

    def path(self):
        if self.eat("<"):
            p = Module(self.glob(">"))
            self.need(">")
        elif self.eat("{"):
            parts = [self.path()]
            while self.eat(","):
                self.space()
                parts.append(self.path())
            self.need("}")
            p = Either(tuple(parts)) if len(parts) > 1 else parts[0]
        elif self.eat("("):
            inc = self.path()
            self.need("\\")
            p = Without(inc, self.path())
            self.need(")")
        else:
            self.fail("expected <, { or (")
        while True:
            if self.eat("**"):
                p = Wildcard(p)
            elif self.eat("?"):
                p = MaybeUnknown(p)
            elif self.eat("()"):
                p = Result(p)
            elif self.eat("."):
                if self.eat("{"):
                    names = [self.prop()]
                    while self.eat(","):
                        self.space()
                        names.append(self.prop())
                    self.need("}")
                    p = Prop(p, tuple(names))
                else:
                    p = Prop(p, (self.prop(),))
            else:
                return p

    def type(self) -> Type:
        for name in SIMPLE:
            if self.eat(name):
                arity = self.match(r"\d+") if name == "function" else None
                return Type("simple", name, None if arity is None else int(arity))
        if self.eat("true"):
            return Type("value", True)
        if self.eat("false"):
            return Type("value", False)
        if self.eat('"'):
            text = self.match(r'[^"]*') or ""
            self.need('"')
            return Type("value", text)
        if (n := self.match(r"-?\d+")) is not None:
            return Type("value", int(n))
        name = self.match(r"[^,{}\s]+")
        if name is None:
            self.fail("expected a type")
        return Type("named", name)

    def types(self) -> tuple[Type, ...]:
        if not self.eat("{"):
            return (self.type(),)
        out = [self.type()]
        while self.eat(","):
            self.space()
            out.append(self.type())
        self.need("}")
        return tuple(out)

    def type_filter(self, heads: tuple[str, ...], numbers: bool) -> TypeFilter:
        head: object = next((h for h in heads if self.eat(h)), None)
        if head is None and numbers and (n := self.match(r"-?\d+")) is not None:
            head = int(n)
        if head is None:
            self.fail("expected a filter")
        props = []
        while self.eat("."):
            props.append(self.prop())
        self.need(":")
        return TypeFilter(head, tuple(props), self.types())

    def call_filter(self):
        if self.eat("["):
            least = self.match(r"\d+")
            self.need(",")
            most = self.match(r"\d+")
            self.need("]")
            return ArgCount(None if least is None else int(least), None if most is None else int(most))
        return self.type_filter(("base",), True)

    def detection(self) -> Detection:
        self.space()
        flags, filters = set(), []
        more = lambda: self.at < len(self.text)
        if self.eat("import"):
            flags |= {"D"} if self.eat("D") else set()
            self.space()
            if self.peek("<"):
                path = self.path()
                if not isinstance(path, Module):
                    self.fail("import takes a module")
            else:
                path = Module(self.glob(" "))
            kind = "import"
        elif self.eat("read"):
            flags |= {"O"} if self.eat("O") else set()
            self.space()
            kind, path = "read", self.path()
            if not isinstance(path, Prop):
                self.fail("read takes a path that ends in a property")
            self.space()
            if more():
                filters.append(self.type_filter(("base",), False))
        elif self.eat("write"):
            self.space()
            kind, path = "write", self.path()
            if not isinstance(path, Prop):
                self.fail("write takes a path that ends in a property")
            self.space()
            while more():
                filters.append(self.type_filter(("value", "base"), False))
                self.space()
        elif self.eat("call"):
            for flag in ("R", "Promise", "NotNew"):
                flags |= {flag} if self.eat(flag) else set()
            self.space()
            kind, path = "call", Result(self.path())
            self.space()
            while more():
                filters.append(self.call_filter())
                self.space()
        elif self.eat("component"):
            self.space()
            kind, path = "component", Component(self.path())
            self.space()
            while more():
                filters.append(self.call_filter())
                self.space()
        else:
            self.fail("expected import, read, write, call or component")
        self.space()
        if more():
            self.fail("unexpected text")
        return Detection(kind, frozenset(flags), path, tuple(filters))


def parse(text: str) -> Detection:
    return _Parser(text).detection()


def walk(path):
    """The path and everything below it."""
    yield path
    for part in getattr(path, "parts", ()) or [x for x in (getattr(path, "base", None), getattr(path, "include", None), getattr(path, "exclude", None)) if x is not None]:
        yield from walk(part)


def globs(patterns: list[Detection]) -> set[str]:
    return {p.glob for d in patterns for p in walk(d.path) if isinstance(p, Module)}


def properties(patterns: list[Detection]) -> set[str]:
    """Property names that the patterns mention; others need not be told apart."""
    return {n for d in patterns for p in walk(d.path) if isinstance(p, Prop) for n in p.names}


def convert(rows: list[dict]) -> list[dict]:
    """Pattern rows of any of the three known shapes → {id, pattern, version, enabled}; the id stays with its pattern."""
    out = []
    for i, r in enumerate(rows):
        if "semanticPatch" in r:
            out.append({"id": r.get("semanticPatchId", str(i)), "pattern": r["semanticPatch"]["detectionPattern"], "version": r.get("version"), "enabled": r.get("enabled", True)})
        else:
            out.append({"id": r.get("id", r.get("semanticPatchId", str(i))), "pattern": r.get("pattern", r.get("detectionPattern")), "version": r.get("version"), "enabled": r.get("enabled", True)})
    return out


def newest(rows: list[dict]) -> list[dict]:
    """Of each id the newest version, folded in order of input; a newer disabled version deletes what was there."""
    kept: dict = {}
    last: dict = {}
    for r in rows:
        v = r.get("version") or 0
        if r["id"] in last and v < last[r["id"]]:
            continue
        last[r["id"]] = v
        if r.get("enabled", True):
            kept[r["id"]] = r
        else:
            kept.pop(r["id"], None)
    return list(kept.values())
