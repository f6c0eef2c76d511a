import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import ParseError
from tessera.functions import fields
from tessera.functions.filters import Filter
from tessera.queries import QUERIES

VALUES = [None, True, False, 0, 1, 5, 0.0, 5.0, -2.5, "", "a", "5", [], [1], ["a", "b"], [1.0], {"k": 1}, {"k": 1.0}]
DOCS = [{}, *({"f": v} for v in VALUES), {"f": [None, "a", {"k": 1}]}, {"g": 1}]


def leaves():
    for op, v in itertools.product(("$eq", "$ne"), VALUES):
        yield {"f": {op: v}}
    for op, v in itertools.product(("$gt", "$gte", "$lt", "$lte"), (0, 5, -2.5)):
        yield {"f": {op: v}}
    for op in ("$in", "$nin"):
        yield from ({"f": {op: v}} for v in ([], ["a", "5"], [5, None, ["a", "b"]], [5.0, True]))
    yield from ({"f": {"$all": v}} for v in ([], ["a"], ["a", "b"], [1], [1.0], [{"k": 1}]))
    yield from ({"f": {"$exists": v}} for v in (True, False))
    yield from ({"f": {"$size": n}} for n in (0, 1, 2))
    yield from ({"f": {"$type": n}} for n in ("null", "boolean", "number", "string", "array", "object", "other"))
    yield {"$and": []}
    yield {"$or": []}
    yield {"$or": [{"f": 5}, {"g": {"$exists": True}}]}
    yield {"f": {"$gt": 0, "$lt": 6}, "g": {"$exists": False}}


def test_every_operator_on_every_kind_of_value(spark):
    tests = list(leaves())
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, p string").withColumn("payload", F.parse_json("p"))
    cols = [Filter.from_json(t).compile(lambda k: fields.variant(F.col("payload"), k)).alias(f"t{n}") for n, t in enumerate(tests)]
    for r in df.select("i", *cols).collect():
        for n, t in enumerate(tests):
            assert r[f"t{n}"] == Filter.from_json(t).matches(DOCS[r["i"]]), (t, DOCS[r["i"]])


def test_typed_columns_and_missing_fields(spark):
    df = spark.createDataFrame([(1, "a", 2.0, ["x"]), (None, None, None, None)], "n bigint, s string, d double, l array<string>")
    kinds = {f.name: f.dataType for f in df.schema}
    field = lambda k: fields.typed(F.col(k), kinds[k]) if k in kinds else fields.missing()
    for doc, want in [({"n": 1}, [True, False]), ({"n": 1.0}, [False, False]), ({"n": {"$ne": 1}}, [False, True]), ({"s": {"$in": ["a"]}}, [True, False]), ({"d": {"$gte": 2}}, [True, False]), ({"l": {"$all": ["x"]}}, [True, False]), ({"l": ["x"]}, [True, False]), ({"z": {"$nin": [1]}}, [True, True]), ({"z": None}, [False, False]), ({"l": {"$size": 1}}, [True, False])]:
        assert [r[0] for r in df.select(Filter.from_json(doc).compile(field)).collect()] == want, doc


@pytest.mark.parametrize("doc", [{}, [], 5, {"$x": 1}, {"f": {"$x": 1}}, {"f": {"$gt": "a"}}, {"f": {"$in": 1}}, {"f": {"$exists": 1}}, {"f": {"$size": -1}}, {"f": {"$type": 1}}, {"$and": {}}])
def test_errors(doc):
    with pytest.raises(ParseError):
        Filter.from_json(doc)


def test_depth():
    doc = {"a": 1}
    for _ in range(200):
        doc = {"$and": [doc]}
    with pytest.raises(ParseError):
        Filter.from_json(doc)


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.floats(-5, 5) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6)


@given(st.dictionaries(st.sampled_from("fgh"), JSON, max_size=3), st.integers(0, 10_000))
@settings(max_examples=200, deadline=None)
def test_matching_never_fails(doc, seed):
    f = Filter.from_json(random.Random(seed).choice(list(leaves())))
    assert f.matches(doc) in (True, False)


def test_builders():
    assert Filter.both(Filter.eq("a", 1), Filter.either(Filter.gt("b", 1), Filter.nin("c", [1]))) == Filter.from_json({"$and": [{"a": 1}, {"$or": [{"b": {"$gt": 1}}, {"c": {"$nin": [1]}}]}]})


def test_document_queries_parse_once(spark, tmp_path):
    """A document query builds and parses a payload once, whatever its filter asks."""
    spark.sql("SELECT id AS event_id, id % 7 AS user_id, if(id % 2 = 0, 'error', 'view') AS event_type, id * 9D AS value FROM range(20)").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("find_or", "find_and", "find_all", "find_type"):
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1, name
    assert {r[0] for r in QUERIES["find_or"](spark, str(tmp_path)).collect()} == {i + 1 for i in range(20) if i % 2 == 0 or (i % 3 and i * 9 >= 90)}
