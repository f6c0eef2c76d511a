"""Document filters: $eq $ne $gt $gte $lt $lte $in $nin $exists $size $all $type $and $or, compiled to columns.

Fields are top-level. Every leaf is true or false, never null: a missing or mistyped operand is false, so that $ne and $nin hold for a
missing field.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError
from .fields import KINDS, Field, json_of, no, schema_of

MAX_DEPTH = 128
_NUMERIC = ("$gt", "$gte", "$lt", "$lte")
_LISTS = ("$in", "$nin", "$all")


@dataclass(frozen=True)
class Filter:
    op: str
    key: str = ""
    value: object = None
    parts: tuple[Filter, ...] = ()

    @staticmethod
    def eq(key: str, value: object) -> Filter:
        return Filter("$eq", key, value)

    @staticmethod
    def ne(key: str, value: object) -> Filter:
        return Filter("$ne", key, value)

    @staticmethod
    def gt(key: str, value: float) -> Filter:
        return Filter("$gt", key, value)

    @staticmethod
    def gte(key: str, value: float) -> Filter:
        return Filter("$gte", key, value)

    @staticmethod
    def lt(key: str, value: float) -> Filter:
        return Filter("$lt", key, value)

    @staticmethod
    def lte(key: str, value: float) -> Filter:
        return Filter("$lte", key, value)

    @staticmethod
    def is_in(key: str, values: list) -> Filter:
        return Filter("$in", key, values)

    @staticmethod
    def nin(key: str, values: list) -> Filter:
        return Filter("$nin", key, values)

    @staticmethod
    def exists(key: str, there: bool = True) -> Filter:
        return Filter("$exists", key, there)

    @staticmethod
    def size(key: str, n: int) -> Filter:
        return Filter("$size", key, n)

    @staticmethod
    def all(key: str, values: list) -> Filter:
        return Filter("$all", key, values)

    @staticmethod
    def type_match(key: str, name: str) -> Filter:
        return Filter("$type", key, name)

    @staticmethod
    def both(*parts: Filter) -> Filter:
        return Filter("$and", parts=parts)

    @staticmethod
    def either(*parts: Filter) -> Filter:
        return Filter("$or", parts=parts)

    @staticmethod
    def from_json(doc: object, depth: int = 0) -> Filter:
        if depth > MAX_DEPTH:
            raise ParseError("filter is nested too deeply")
        if not isinstance(doc, dict) or not doc:
            raise ParseError("a filter is a non-empty object")
        parts: list[Filter] = []
        for key, value in doc.items():
            if key in ("$and", "$or"):
                if not isinstance(value, list):
                    raise ParseError(f"{key} takes a list")
                parts.append(Filter(key, parts=tuple(Filter.from_json(x, depth + 1) for x in value)))
            elif key.startswith("$"):
                raise ParseError(f"unknown operator {key}")
            elif isinstance(value, dict) and any(k.startswith("$") for k in value):
                parts += [_leaf(key, op, x) for op, x in value.items()]
            else:
                parts.append(Filter("$eq", key, value))
        return parts[0] if len(parts) == 1 else Filter("$and", parts=tuple(parts))

    def compile(self, field: Callable[[str], Field]) -> Column:
        if self.op == "$and":
            return reduce(lambda a, b: a & b, (p.compile(field) for p in self.parts), F.lit(True))
        if self.op == "$or":
            return reduce(lambda a, b: a | b, (p.compile(field) for p in self.parts), F.lit(False))
        f, v = field(self.key), self.value
        match self.op:
            case "$eq":
                return f.equals(v)
            case "$ne":
                return ~f.equals(v)
            case "$in":
                return _any(f, v)
            case "$nin":
                return ~_any(f, v)
            case "$gt":
                test = f.number > F.lit(float(v))
            case "$gte":
                test = f.number >= F.lit(float(v))
            case "$lt":
                test = f.number < F.lit(float(v))
            case "$lte":
                test = f.number <= F.lit(float(v))
            case "$exists":
                return F.coalesce(f.present, no()) == F.lit(bool(v))
            case "$size":
                test = (f.kind == "array") & (f.size == F.lit(v))
            case "$type":
                test = (f.kind == v) if v in KINDS else no()
            case "$all":
                test = f.kind == "array"
                for x in v:
                    test = test & F.exists(f.items, _item_is(x))
        return F.coalesce(test, no())

    def matches(self, doc: dict) -> bool:
        """The same test on one document in Python."""
        if self.op == "$and":
            return all(p.matches(doc) for p in self.parts)
        if self.op == "$or":
            return any(p.matches(doc) for p in self.parts)
        there, x, v = self.key in doc, doc.get(self.key), self.value
        is_number = isinstance(x, (int, float)) and not isinstance(x, bool)
        match self.op:
            case "$eq":
                return there and same(x, v)
            case "$ne":
                return not (there and same(x, v))
            case "$in":
                return there and any(same(x, y) for y in v)
            case "$nin":
                return not (there and any(same(x, y) for y in v))
            case "$gt":
                return is_number and x > v
            case "$gte":
                return is_number and x >= v
            case "$lt":
                return is_number and x < v
            case "$lte":
                return is_number and x <= v
            case "$exists":
                return there == bool(v)
            case "$size":
                return isinstance(x, list) and len(x) == v
            case "$type":
                return there and kind_of(x) == v
            case "$all":
                return isinstance(x, list) and all(any(same(i, y) for i in x) for y in v)
        raise ParseError(f"unknown operator {self.op}")


def _leaf(key: str, op: str, value: object) -> Filter:
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if op in _NUMERIC and not is_number:
        raise ParseError(f"{op} takes a number")
    if op in _LISTS and not isinstance(value, list):
        raise ParseError(f"{op} takes a list")
    if op == "$exists" and not isinstance(value, bool):
        raise ParseError("$exists takes true or false")
    if op == "$size" and (not isinstance(value, int) or isinstance(value, bool) or value < 0):
        raise ParseError("$size takes a whole number")
    if op == "$type" and not isinstance(value, str):
        raise ParseError("$type takes a name")
    if op not in (*_NUMERIC, *_LISTS, "$eq", "$ne", "$exists", "$size", "$type"):
        raise ParseError(f"unknown operator {op}")
    return Filter(op, key, value)


def _item_is(x: object) -> Callable[[Column], Column]:
    return lambda i: (i["json"] == json_of(x)) & (i["schema"] == schema_of(x))


def _any(f: Field, values: list) -> Column:
    texts = [v for v in values if isinstance(v, str)]
    if values and len(texts) == len(values):
        return F.coalesce((f.kind == "string") & f.text.isin(texts), no())
    return reduce(lambda a, b: a | b, (f.equals(v) for v in values), F.lit(False))


def same(a: object, b: object) -> bool:
    """JSON equality with types."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


def kind_of(x: object) -> str:
    if x is None:
        return "null"
    for kind, name in ((bool, "boolean"), ((int, float), "number"), (str, "string"), (list, "array")):
        if isinstance(x, kind):
            return name
    return "object"
