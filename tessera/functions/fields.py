"""Payload fields as columns: typed columns where the schema is known, VARIANT where it isn't.

Predicates here are two-valued. A Field gives the pieces they need; each piece is null where it doesn't apply, and predicates coalesce.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("null", "boolean", "number", "string", "array", "object")


def no() -> Column:
    return F.lit(False)


@dataclass
class Field:
    present: Column
    kind: Column  # one of KINDS, null if missing
    number: Column  # double
    text: Column
    flag: Column
    is_int: Column
    size: Column  # of an array
    json: Column  # canonical JSON text
    schema: Column  # type text that tells apart equal JSON texts of other types
    items: Column  # an array's items: array<struct<json, schema>>
    value: Column  # for output

    def equals(self, literal: object) -> Column:
        """Strict JSON equality; integers and floats differ."""
        if literal is None:
            test = self.kind == "null"
        elif isinstance(literal, bool):
            test = (self.kind == "boolean") & (self.flag == F.lit(literal))
        elif isinstance(literal, int):
            test = self.is_int & (self.number == F.lit(float(literal)))
        elif isinstance(literal, float):
            test = (self.kind == "number") & ~self.is_int & (self.number == F.lit(literal))
        elif isinstance(literal, str):
            test = (self.kind == "string") & (self.text == F.lit(literal))
        else:
            test = (self.json == json_of(literal)) & (self.schema == schema_of(literal))
        return F.coalesce(test, no())


def json_of(value: object) -> Column:
    """A literal's JSON text as it is written for VARIANT values."""
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


def schema_of(value: object) -> Column:
    return F.schema_of_variant(F.parse_json(F.lit(json.dumps(value))))


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


_ITEMS = "array<struct<json:string,schema:string>>"


def missing() -> Field:
    return Field(no(), none("string"), none("double"), none("string"), none("boolean"), none("boolean"), none("int"), none("string"), none("string"), none(_ITEMS), none("string"))


def typed(col: Column, kind: T.DataType) -> Field:
    """A field that is a column; null stands for a missing field."""
    f = missing()
    f.present, f.value, f.json = col.isNotNull(), col, F.to_json(F.to_variant_object(F.struct(col.alias("v")))["v"]) if isinstance(kind, (T.ArrayType, T.StructType)) else col.cast("string")
    named = lambda name: F.when(col.isNotNull(), F.lit(name))
    if isinstance(kind, T.BooleanType):
        f.kind, f.flag, f.schema = named("boolean"), col, named("BOOLEAN")
    elif isinstance(kind, T.NumericType):
        f.kind, f.number, f.is_int = named("number"), col.cast("double"), F.lit(isinstance(kind, T.IntegralType))
        f.schema = named("BIGINT" if isinstance(kind, T.IntegralType) else "DOUBLE")
    elif isinstance(kind, T.ArrayType):
        variant = F.to_variant_object(col)
        f.kind, f.size, f.json, f.schema = named("array"), F.size(col), F.to_json(variant), F.schema_of_variant(variant)
        f.items = _variant_items(variant)
    elif isinstance(kind, (T.StructType, T.MapType)):
        variant = F.to_variant_object(col)
        f.kind, f.json, f.schema = named("object"), F.to_json(variant), F.schema_of_variant(variant)
    else:
        text = col.cast("string")
        f.kind, f.text, f.value, f.schema = named("string"), text, text, named("STRING")
        f.json = F.to_json(F.struct(text.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6)
    f.kind = f.kind.cast("string")
    return f


def _variant_items(v: Column) -> Column:
    return F.transform(F.expr("null").cast("array<variant>") if v is None else F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.to_json(x).alias("json"), F.schema_of_variant(x).alias("schema")))


def _once(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), where c is computed once however often of uses it."""
    return F.transform(F.array(c), of)[0]


def variant(payload: Column, key: str) -> Field:
    """A top-level field of a VARIANT payload."""
    path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    v = F.try_variant_get(payload, path, "variant")
    schema = F.schema_of_variant(v)
    is_int = schema.rlike("^(BIG|SMALL|TINY)?INT$")
    # one look at the type text for all its tests; a missing field has none
    kind = _once(
        schema,
        lambda s: F.when(s.isNull(), none("string"))
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "boolean")
        .when(s.rlike("^((BIG|SMALL|TINY)?INT$|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object"),
    )
    get = lambda name, spark_type: F.when(kind == name, F.try_variant_get(payload, path, spark_type))
    is_array = kind == "array"
    return Field(
        present=v.isNotNull(),
        kind=kind,
        number=get("number", "double"),
        text=get("string", "string"),
        flag=get("boolean", "boolean"),
        is_int=F.coalesce(is_int, no()),
        size=F.when(is_array, F.size(F.try_variant_get(payload, path, "array<variant>"))),
        json=F.to_json(v),
        schema=schema,
        items=F.when(is_array, _variant_items(v)),
        value=F.when(kind == "string", F.try_variant_get(payload, path, "string")).when(kind != "null", F.to_json(v)),
    )
