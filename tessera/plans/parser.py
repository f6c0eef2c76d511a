"""Reads statements of the query language.

    [EXPLAIN] (FIND {..} | [OPTIONAL] MATCH path | SEARCH VECTOR [..] TOP k [EXPAND [:L*min..max]]) [WHERE ..] RETURN ..
        [ORDER BY ..] [LIMIT n] [OFFSET n]
    CREATE path, ..
    MATCH path [WHERE ..] (SET v.f == x, .. | [DETACH] DELETE v, .. | CREATE path, ..)

Keywords are reserved, in any case. Text after a statement's end is an error.
"""

from __future__ import annotations

import re

from ..errors import ParseError
from ..functions.filters import MAX_DEPTH, Filter
from .ast import Bool, Compare, Edge, Item, Literal, Matches, Mutation, Node, Path, Prop, Query, Search

KEYWORDS = frozenset(
    "and as asc avg by collect count create delete desc detach distinct expand explain false find limit match matches max min not null "
    "offset optional or order return search set sum top true vector where".split()
)
FUNCTIONS = ("count", "sum", "avg", "min", "max", "collect")
_TOKEN = re.compile(
    r"""(?P<space>\s+|--(?!\[)[^\n]*)
      |(?P<number>-?\d+(?:\.(?!\.)\d+)?)
      |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
      |(?P<op>\$[A-Za-z]+)
      |(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      |(?P<sign>==|!=|>=|<=|->|<-|\.\.|[(){}\[\]:,.<>\-*|])""",
    re.X | re.S,
)


class Token:
    __slots__ = ("at", "kind", "text", "value")

    def __init__(self, kind: str, text: str, value: object, at: int) -> None:
        self.kind, self.text, self.value, self.at = kind, text, value, at


def tokenize(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise ParseError(f"unexpected {source[at]!r} at {at}")
        kind, text = m.lastgroup, m.group()
        if kind == "number":
            out.append(Token("number", text, float(text) if "." in text else int(text), at))
        elif kind == "name":
            word = text.lower()
            out.append(Token("keyword", word, word, at) if word in KEYWORDS else Token("name", text, text, at))
        elif kind == "text":
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), text[1:-1], flags=re.S)
            out.append(Token("text", text, value, at))
        elif kind != "space":
            out.append(Token(kind, text, text, at))
        at = m.end()
    out.append(Token("end", "", None, at))
    return out


class Parser:
    def __init__(self, source: str) -> None:
        self.source, self.tokens, self.i, self.depth, self.unnamed = source, tokenize(source), 0, 0, 0

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def take(self) -> Token:
        t = self.now
        self.i += t.kind != "end"
        return t

    def at(self, *texts: str) -> bool:
        return self.now.kind in ("keyword", "sign", "op") and self.now.text in texts

    def skip(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.skip(text):
            raise self.error(f"expected {text}")

    def error(self, what: str) -> ParseError:
        return ParseError(f"{what}, found {self.now.text or 'the end'!r} at {self.now.at}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.error("expected a name")
        return self.take().text

    def whole(self) -> int:
        if self.now.kind != "number" or not isinstance(self.now.value, int) or self.now.value < 0:
            raise self.error("expected a whole number")
        return self.take().value

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ParseError("nested too deeply")

    # statements
    def statement(self) -> Query | Mutation:
        if self.skip("create"):
            out: Query | Mutation = Mutation(None, create=self.paths())
        else:
            explain = self.skip("explain")
            optional = self.skip("optional")
            if optional and not self.at("match"):
                raise self.error("expected MATCH")
            if self.skip("find"):
                entry: Filter | Path | Search = self.filter()
            elif self.skip("match"):
                entry = self.path()
            elif self.skip("search"):
                entry = self.search()
            else:
                raise self.error("expected FIND, MATCH, SEARCH or CREATE")
            where = self.predicate() if self.skip("where") else None
            if isinstance(entry, Path) and not explain and self.at("set", "delete", "detach", "create"):
                out = self.mutation(Query(entry, where, source=self.source))
            else:
                out = self.rest(entry, where, explain, optional)
        if self.now.kind != "end":
            raise self.error("expected the end")
        return out

    def rest(self, entry: Filter | Path | Search, where: object, explain: bool, optional: bool) -> Query:
        self.need("return")
        items = None if self.skip("*") else tuple(self.many(self.item))
        order: list[tuple[Prop | Literal, bool]] = []
        if self.skip("order"):
            self.need("by")
            order = self.many(self.order_key)
        limit = self.whole() if self.skip("limit") else None
        offset = self.whole() if self.skip("offset") else 0
        return Query(entry, where, items, tuple(order), limit, offset, explain, optional, self.source)

    def mutation(self, match: Query) -> Mutation:
        if self.skip("set"):
            return Mutation(match, assign=tuple(self.many(self.assignment)))
        if self.skip("create"):
            return Mutation(match, create=self.paths())
        detach = self.skip("detach")
        self.need("delete")
        return Mutation(match, delete=tuple(self.many(self.name)), detach=detach)

    def many(self, one) -> list:
        out = [one()]
        while self.skip(","):
            out.append(one())
        return out

    def assignment(self) -> tuple[Prop, object]:
        left = self.prop()
        if left.key is None:
            raise self.error("expected a field")
        self.need("==")
        return left, self.json()

    # patterns
    def paths(self) -> tuple[Path, ...]:
        return tuple(self.many(lambda: self.path(create=True)))

    def path(self, create: bool = False) -> Path:
        nodes, edges = [self.node(create, first=True)], []
        while self.at("-", "<-"):
            edges.append(self.edge(create))
            nodes.append(self.node(create, first=create))
        return Path(tuple(nodes), tuple(edges))

    def node(self, create: bool, first: bool) -> Node:
        self.need("(")
        if self.now.kind == "name":
            var = self.name()
        elif first:
            self.unnamed += 1
            var = f"_{self.unnamed}"
        else:
            raise self.error("expected a name")
        found, payload = None, None
        if self.at("{"):
            if create:
                payload = self.json()
            else:
                found = self.filter()
        self.need(")")
        return Node(var, found, payload)

    def edge(self, create: bool) -> Edge:
        back = self.take().text == "<-"
        labels: list[str] = []
        hops, weight = None, 1.0
        self.need("[")
        if self.skip(":"):
            labels.append(self.name())
            while self.skip("|"):
                self.skip(":")
                labels.append(self.name())
        if self.skip("*"):
            lo = self.whole()
            self.need("..")
            hops = (lo, self.whole())
            if hops[0] > hops[1]:
                raise ParseError("hops: min is above max")
        if create and self.at("{"):
            weight = self.json().get("weight", 1.0)
        self.need("]")
        forward = self.skip("->")
        if not forward:
            self.need("-")
        if back and forward:
            raise ParseError("an edge has one direction")
        return Edge(tuple(labels), "in" if back else "out" if forward else "both", hops, float(weight))

    def search(self) -> Search:
        self.need("vector")
        self.need("[")
        vector = []
        while not self.at("]"):
            if self.now.kind != "number":
                raise self.error("expected a number")
            vector.append(float(self.take().value))
            if not self.skip(","):
                break
        self.need("]")
        self.need("top")
        top, expand = self.whole(), None
        if self.skip("expand"):
            self.need("[")
            labels = []
            if self.skip(":"):
                labels.append(self.name())
                while self.skip("|"):
                    self.skip(":")
                    labels.append(self.name())
            self.need("*")
            lo = self.whole()
            self.need("..")
            expand = Edge(tuple(labels), "out", (lo, self.whole()))
            self.need("]")
        return Search(tuple(vector), top, expand)

    # documents
    def filter(self) -> Filter:
        return Filter.from_json(self.json())

    def json(self) -> object:
        self.deeper()
        try:
            if self.skip("{"):
                out: dict = {}
                while not self.at("}"):
                    if self.now.kind not in ("name", "text", "op", "keyword"):
                        raise self.error("expected a key")
                    key = self.take()
                    if key.kind == "keyword":
                        raise ParseError(f"{key.text} is reserved; write it in quotes")
                    self.need(":")
                    out[key.value] = self.json()
                    if not self.skip(","):
                        break
                self.need("}")
                return out
            if self.skip("["):
                items = []
                while not self.at("]"):
                    items.append(self.json())
                    if not self.skip(","):
                        break
                self.need("]")
                return items
            return self.literal()
        finally:
            self.depth -= 1

    def literal(self) -> object:
        if self.now.kind in ("number", "text"):
            return self.take().value
        if self.at("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[self.take().text]
        raise self.error("expected a value")

    # predicates
    def predicate(self) -> object:
        return self.chain("or", lambda: self.chain("and", self.negation))

    def chain(self, op: str, one) -> object:
        self.deeper()
        parts = [one()]
        while self.skip(op):
            parts.append(one())
        self.depth -= 1
        return parts[0] if len(parts) == 1 else Bool(op, tuple(parts))

    def negation(self) -> object:
        if self.skip("not"):
            self.deeper()
            out = Bool("not", (self.negation(),))
            self.depth -= 1
            return out
        if self.skip("("):
            inner = self.predicate()
            self.need(")")
            return inner
        if self.at("{"):
            return Matches(None, self.filter())
        var = self.name()
        if self.skip("matches"):
            return Matches(var, self.filter())
        self.need(".")
        left = Prop(var, self.name())
        if not self.at("==", "!=", ">", ">=", "<", "<="):
            raise self.error("expected a comparison")
        op = self.take().text
        if self.now.kind == "name":
            word = self.name()
            return Compare(left, op, Prop(word, self.name()) if self.skip(".") else Literal(word))
        return Compare(left, op, Literal(self.literal()))

    # results
    def prop(self) -> Prop:
        var = self.name()
        return Prop(var, self.name()) if self.skip(".") else Prop(var)

    def item(self) -> Item:
        distinct = self.skip("distinct")
        func = None
        if self.at(*FUNCTIONS):
            func = self.take().text
            self.need("(")
            expr = self.prop()
            self.need(")")
        else:
            expr = self.prop()
        return Item(expr, func, distinct, self.name() if self.skip("as") else None)

    def order_key(self) -> tuple[Prop | Literal, bool]:
        if self.now.kind in ("number", "text"):
            key: Prop | Literal = Literal(self.take().value)
        else:
            key = self.prop()
            if key.key is None:
                raise self.error("expected a field")
        down = self.skip("desc")
        if not down:
            self.skip("asc")
        return key, down


def parse(source: str) -> Query | Mutation:
    """The statement that source holds."""
    return Parser(source).statement()


def parse_query(source: str) -> Query:
    out = parse(source)
    if not isinstance(out, Query):
        raise ParseError("expected a query, found a change")
    return out
