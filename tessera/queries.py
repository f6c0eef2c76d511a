"""The engine's queries over the tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.cognitive import analyse_query
from .functions.filters import Filter
from .functions.text import bm25, keyword_recall
from .operators import ann, factors as FA, graph_algorithms as G, vector_search as VS
from .operators.activation import Fatigue, spread
from .operators.hybrid import Retriever, SearchConfig, diversify, shadow_channel
from .plans import planner
from .sources import datasets as D
from .sources.graph import Graph
from .sources.store import EDGES, LOG, NODES, GraphStore, fold_edges, fold_nodes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# documents as filters: events with a schemaless payload ------------------------------------------------------------------------------

_EVENTS = """
WITH n AS (SELECT event_id + 1 AS id, event_type AS type, CASE WHEN event_id % 3 <> 0 THEN value::DECIMAL(18,4)::DOUBLE END AS value,
  event_id % 5 = 0 AS note_null, CASE WHEN event_id % 5 = 1 THEN 'n' END AS note, user_id AS usr, event_id % 2 = 0 AS two_tags FROM events)
SELECT id AS node_id FROM n WHERE """


def _find(name: str, doc: dict, where: str) -> None:
    @query(name, _EVENTS + where)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = D.events_graph(spark, sf_dir)
        return g.nodes.where(g.test(Filter.from_json(doc))).select(F.col("id").alias("node_id"))


_find("find_eq", {"type": "click"}, "type = 'click'")
_find("find_eq_null", {"note": None}, "note_null")
_find("find_ne_missing", {"note": {"$ne": "n"}}, "note IS NULL")
_find("find_gt", {"value": {"$gt": 50}}, "coalesce(value > 50, false)")
_find("find_gte", {"value": {"$gte": 50.5}}, "coalesce(value >= 50.5, false)")
_find("find_lt", {"value": {"$lt": 20}}, "coalesce(value < 20, false)")
_find("find_lte", {"value": {"$lte": 20}}, "coalesce(value <= 20, false)")
_find("find_in", {"type": {"$in": ["click", "view"]}}, "type IN ('click', 'view')")
_find("find_nin", {"note": {"$nin": ["n", "m"]}}, "note IS NULL")
_find("find_exists", {"note": {"$exists": True}}, "note_null OR note IS NOT NULL")
_find("find_exists_false", {"value": {"$exists": False}}, "value IS NULL")
_find("find_size", {"tags": {"$size": 2}}, "two_tags")
_find("find_all", {"tags": {"$all": ["a", "b"]}}, "two_tags")
_find("find_array_eq", {"tags": ["a"]}, "NOT two_tags")
_find("find_type", {"note": {"$type": "null"}}, "note_null")
_find("find_and", {"type": "click", "value": {"$gt": 10, "$lt": 60}}, "type = 'click' AND coalesce(value > 10 AND value < 60, false)")
_find("find_or", {"$or": [{"type": "error"}, {"value": {"$gte": 90}}]}, "type = 'error' OR coalesce(value >= 90, false)")
_find("find_number_type", {"usr": {"$type": "number"}}, "false")


@query("where_mixed_types", _EVENTS + "coalesce(value > 30, false) AND NOT (note IS NOT NULL)")
def where_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison of a missing field is false, and its negation true."""
    g = D.events_graph(spark, sf_dir)
    return planner.run(g, 'FIND {type: {$exists: true}} WHERE n.value > 30 AND NOT n.note == "n" RETURN n').select(F.col("n_id").alias("node_id"))


# patterns over the commerce graph ----------------------------------------------------------------------------------------------------

_ID = {k: f"({(i + 1) * D.STEP + 1})" for i, k in enumerate(D.KINDS)}
_C, _O, _P, _S, _N, _R = (_ID[k] for k in ("customer", "order", "part", "supplier", "nation", "region"))


def _match(name: str, text: str, sql: str | None, **options: bool) -> None:
    @query(name, sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return planner.run(D.graph(spark, sf_dir), text, **options)


_match("match_forward", 'MATCH (c {kind: "customer"})-[:PLACED]->(o) WHERE o.totalprice > 100000 RETURN c.name, o.totalprice',
       "SELECT c_name AS c_name, o_totalprice AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
_match("match_backward", 'MATCH (o {status: "F"})<-[:PLACED]-(c) RETURN c.segment, o.totalprice',
       "SELECT c_mktsegment AS c_segment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
_match("match_undirected", 'MATCH (n {kind: "nation"})-[:IN_REGION]-(r) RETURN n.name AS nation, r.name AS region',
       "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_match("match_multilabel", 'MATCH (a)-[:IN_REGION|IN_NATION]->(b) RETURN b.name, count(a) AS n',
       "SELECT b_name, count(*) AS n FROM (SELECT r_name AS b_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
_match("match_two_hop", 'MATCH (c {segment: "BUILDING"})-[:PLACED]->(o)-[:CONTAINS]->(p) WHERE p.size > 40 RETURN c.name, p.brand, o.totalprice',
       "SELECT c_name, p_brand, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND p_size > 40")
_match("match_varlen", 'MATCH (s {kind: "supplier"})-[:IN_NATION|IN_REGION*1..2]->(x) RETURN x.name, count(s) AS n',
       "SELECT x_name, count(*) AS n FROM (SELECT n_name AS x_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
_match("match_varlen_zero", 'MATCH (n {kind: "nation"})-[:IN_REGION*0..1]->(x) RETURN x.kind, count(n) AS n',
       "SELECT 'nation' AS x_kind, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey")
_match("match_repeat_var", 'MATCH (n {kind: "nation"})-[:IN_REGION]-(r)-[:IN_REGION]-(n) RETURN n.name, r.name',
       "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_match("where_cross_var", 'MATCH (c {kind: "customer"})-[:IN_NATION]->(n)<-[:IN_NATION]-(s {kind: "supplier"}) WHERE c.acctbal > s.acctbal RETURN n.name, count(c) AS pairs',
       "SELECT n_name, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > s_acctbal GROUP BY 1")
_match("where_compare", 'FIND {kind: "part"} WHERE p.size >= 10 AND (p.price < 1200.0 OR NOT p.brand == "Brand#11") RETURN p.name, p.size',
       "SELECT p_name, p_size::BIGINT AS p_size FROM part WHERE p_size >= 10 AND (p_retailprice < 1200 OR NOT p_brand = 'Brand#11')")
_match("where_not", 'FIND {kind: "customer"} WHERE NOT c.acctbal > 0 RETURN c.name',
       "SELECT c_name FROM customer WHERE NOT c_acctbal > 0")
_match("where_matches", 'MATCH (c)-[:PLACED]->(o) WHERE o MATCHES {totalprice: {$lt: 20000}} AND c MATCHES {segment: {$in: ["BUILDING", "MACHINERY"]}} RETURN o.id, c.segment',
       f"SELECT {_O} + o_orderkey AS o_id, c_mktsegment AS c_segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < 20000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
_match("match_id", f"MATCH (c {{id: {3 * D.STEP + 6}}})-[:PLACED]->(o) RETURN c.name, o.id",
       f"SELECT c_name, {_O} + o_orderkey AS o_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 5")
_NO_PARTS = 'OPTIONAL MATCH (c {kind: "customer"})-[:PLACED]->(o {status: "P"}) RETURN c.name, o.totalprice'
_match("optional_inner", _NO_PARTS, "SELECT c_name, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
_match("optional_outer", _NO_PARTS, "SELECT c_name, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey", optional_outer=True)
_match("agg_group", 'MATCH (c)-[:PLACED]->(o) RETURN c.segment, count(o) AS n, sum(o.totalprice) AS total, avg(o.totalprice) AS mean, min(o.totalprice) AS lo, max(o.totalprice) AS hi', None)


@query("agg_rounded",
       "SELECT c_mktsegment AS c_segment, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def agg_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = QUERIES["agg_group"](spark, sf_dir)
    return df.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


_match("agg_count", "MATCH (c)-[:PLACED]->(o) RETURN count(o.nothing) AS n", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
_match("agg_sum_missing", 'MATCH (c)-[:PLACED]->(o) RETURN sum(o.nothing) AS s, sum(o) AS k', "SELECT 0.0::DOUBLE AS s, count(*)::DOUBLE AS k FROM orders JOIN customer ON o_custkey = c_custkey")
_match("agg_avg_missing", 'MATCH (c)-[:PLACED]->(o) RETURN avg(o.status) AS a, min(o.status) AS b', "SELECT NULL::DOUBLE AS a, NULL::DOUBLE AS b")
_match("agg_min", 'FIND {kind: "part"} RETURN min(p.price) AS lo', "SELECT min(p_retailprice) AS lo FROM part")
_match("agg_max", 'FIND {kind: "part"} RETURN p.brand, max(p.size) AS hi', "SELECT p_brand, max(p_size)::DOUBLE AS hi FROM part GROUP BY 1")
_match("agg_empty", 'FIND {kind: "nothing"} RETURN count(x) AS n', "SELECT 0::BIGINT AS n WHERE false")


@query("agg_collect", "SELECT r_name AS r_name, string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = planner.run(D.graph(spark, sf_dir), "MATCH (n)-[:IN_REGION]->(r) RETURN r.name, collect(n.name) AS names")
    return df.withColumn("names", F.concat_ws(",", "names"))


_match("distinct_var", "MATCH (c)-[:PLACED]->(o) RETURN DISTINCT c.id", f"SELECT DISTINCT {_C} + o_custkey AS c_id FROM orders JOIN customer ON o_custkey = c_custkey")
_match("distinct_prop", 'MATCH (c)-[:PLACED]->(o) RETURN DISTINCT c.segment AS segment, o.priority',
       "SELECT segment, o_priority FROM (SELECT c_mktsegment AS segment, o_orderpriority AS o_priority, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey) WHERE n = 1")
_match("distinct_props", 'MATCH (c)-[:PLACED]->(o) RETURN DISTINCT c.segment AS segment, DISTINCT o.priority AS priority',
       "SELECT DISTINCT c_mktsegment AS segment, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey")
_match("order_limit_offset", 'FIND {kind: "order"} RETURN o.id, o.totalprice ORDER BY o.totalprice DESC LIMIT 10 OFFSET 5',
       f"SELECT {_O} + o_orderkey AS o_id, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_match("order_nulls", 'MATCH (a)-[:IN_NATION]->(n) RETURN a.id, a.segment ORDER BY a.segment DESC LIMIT 40',
       f"SELECT a_id, a_segment FROM (SELECT {_C} + c_custkey AS a_id, c_mktsegment AS a_segment FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {_S} + s_suppkey, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey) ORDER BY a_segment DESC NULLS FIRST, a_id LIMIT 40")


@query("return_node", "SELECT node_id, name FROM (SELECT 1000000001 + r_regionkey::BIGINT AS node_id, r_name AS name FROM region)")
def return_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = planner.run(D.graph(spark, sf_dir, ("region",), ("IN_REGION",)), 'FIND {kind: "region"} RETURN *')
    return df.select("node_id", F.get_json_object("node", "$.name").alias("name"))


@query("explain")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.run(D.graph(spark, sf_dir), 'EXPLAIN MATCH (c {kind: "customer"})-[:PLACED]->(o) WHERE o.totalprice > 100000 RETURN c.name')


# scans -------------------------------------------------------------------------------------------------------------------------------


@query("id_lookup", f"SELECT {_C} + c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph(spark, sf_dir).get(3 * D.STEP + 8).select("id", "name")


@query("label_scan", f"SELECT {_N} + n_nationkey AS src, {_R} + n_regionkey AS dst FROM nation")
def label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph(spark, sf_dir).edges_by_label("IN_REGION")


@query("reverse_scan", f"SELECT {_C} + c_custkey AS src FROM customer WHERE c_nationkey = 3 UNION ALL SELECT {_S} + s_suppkey FROM supplier WHERE s_nationkey = 3")
def reverse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph(spark, sf_dir).incoming(2 * D.STEP + 4)


@query("field_lookup", f"SELECT {_P} + p_partkey AS id FROM part WHERE p_size = 7")
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph(spark, sf_dir).by_field("size", 7).select("id")


@query("in_degree", f"SELECT {_P} + l_partkey AS id, count(*) AS in_degree FROM lineitem GROUP BY 1")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph(spark, sf_dir, ("part",), ("CONTAINS",)).in_degree()


@query("node_count", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n")
def node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph(spark, sf_dir, ("customer", "order"), ("PLACED",)).nodes.agg(F.count("*").alias("n"))


@query("edges_with_nodes", f"SELECT {_N} + n_nationkey AS id, count(r_regionkey) AS num_edges FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def edges_with_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.graph(spark, sf_dir, ("nation",), ("IN_REGION",))
    n = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("num_edges"))
    return g.nodes.join(n, "id", "left").select("id", F.coalesce("num_edges", F.lit(0).cast("bigint")).alias("num_edges"))


# vectors -----------------------------------------------------------------------------------------------------------------------------

_COS = "CASE WHEN list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]) = 0 THEN 0 ELSE list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))) END"
_COS_SQL = _COS.format(a="e.embedding", b="q.embedding")


def _first(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(D.embeddings(spark, sf_dir).where(F.col("id") == vec_id).first()["vector"])


@query("cosine_topk", f"SELECT e.vec_id AS id, round({_COS_SQL}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS_SQL} DESC, id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VS.exact_topk(D.embeddings(spark, sf_dir), _first(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("payload_prefilter", f"SELECT e.vec_id AS id, round({_COS_SQL}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = (SELECT min(label) FROM embeddings) ORDER BY {_COS_SQL} DESC, id LIMIT 10")
def payload_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.embeddings(spark, sf_dir)
    low = v.agg(F.min("label")).first()[0]
    return VS.exact_topk(v, _first(spark, sf_dir), 10, where=F.col("label") == low).withColumn("score", F.round("score", 6))


@query("min_score", f"SELECT e.vec_id AS id, round({_COS_SQL}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 1 AND {_COS_SQL} >= 0.3 ORDER BY {_COS_SQL} DESC, id LIMIT 20")
def min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VS.exact_topk(D.embeddings(spark, sf_dir), _first(spark, sf_dir, 1), 20, min_score=0.3).withColumn("score", F.round("score", 6))


@query("batch_topk", f"""SELECT query_id, rank, id, score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS_SQL}, 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS_SQL}, 12) DESC, e.vec_id)::INTEGER AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.embeddings(spark, sf_dir)
    return VS.batch_topk(v, v.where("id % 100 = 0"), 10).withColumn("score", F.round("score", 6))


_SIG = "list_transform({v}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_HAM = f"list_sum(list_transform(list_zip({_SIG.format(v='e.embedding')}, {_SIG.format(v='q.embedding')}), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END))::INTEGER"


@query("bq_hamming_topk", f"SELECT e.vec_id AS id, {_HAM} AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY distance, id LIMIT 25")
def bq_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VS.hamming_topk(D.embeddings(spark, sf_dir), _first(spark, sf_dir), 25)


@query("bq_cascade", f"""SELECT id, round(c, 6) AS score FROM (SELECT e.vec_id AS id, {_HAM} AS d, {_COS_SQL} AS c FROM embeddings e, embeddings q WHERE q.vec_id = 0
  ORDER BY d, id LIMIT (SELECT greatest(ceil(count(*) * 0.05), 10)::BIGINT FROM embeddings)) ORDER BY c DESC, id LIMIT 10""")
def bq_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VS.cascade_topk(D.embeddings(spark, sf_dir), _first(spark, sf_dir), 10, 0.05).withColumn("score", F.round("score", 6))


@query("int8_cascade")
def int8_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VS.cascade_topk(D.embeddings(spark, sf_dir), _first(spark, sf_dir), 10, 0.2, use_int8=True)


@query("bitmatch_topk", f"SELECT e.vec_id AS id, (64 - {_HAM})::DOUBLE AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, id LIMIT 10")
def bitmatch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = D.embeddings(spark, sf_dir).select("id", V.signature(F.col("vector"), 64).alias("vector"))
    return VS.bitmatch_topk(bits, list(bits.where("id = 0").first()["vector"]), 10)


def similarity_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Embeddings, and from each an edge SIMILAR to its five nearest others."""
    v = D.embeddings(spark, sf_dir)
    near = VS.batch_topk(v, v, 6).where("id <> query_id and rank <= 6")
    return Graph(v, near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("SIMILAR").alias("label"), F.col("score").alias("weight")))


def _ring(spark: SparkSession, sf_dir: str) -> Graph:
    """Embeddings with edges to the next id, and from every fifth to the id ten on."""
    v = D.embeddings(spark, sf_dir)
    e = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("NEXT").alias("label"), F.lit(0.9).alias("weight"))
    j = v.where("id % 5 = 0").select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"), F.lit("JUMP").alias("label"), F.lit(0.5).alias("weight"))
    ids = v.select(F.col("id").alias("dst"))
    return Graph(v, e.unionByName(j).join(ids, "dst", "left_semi").select("src", "dst", "label", "weight"))


_RING = """r AS (SELECT vec_id AS src, vec_id + 1 AS dst, 'NEXT' AS label, 0.9::DOUBLE AS weight FROM embeddings UNION ALL SELECT vec_id, vec_id + 10, 'JUMP', 0.5 FROM embeddings WHERE vec_id % 5 = 0),
ring AS (SELECT * FROM r WHERE dst IN (SELECT vec_id FROM embeddings))"""
_TOP3 = f"top AS (SELECT e.vec_id AS id FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS_SQL} DESC, e.vec_id LIMIT 3)"


def _literal(v: list[float]) -> str:
    return "[" + ", ".join(f"{x:.9f}" for x in v) + "]"


@query("search_topk", f"WITH {_TOP3} SELECT id AS n_id FROM top")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.run(_ring(spark, sf_dir), f"SEARCH VECTOR {_literal(_first(spark, sf_dir))} TOP 3 RETURN n.id")


@query("search_expand", f"WITH {_RING}, {_TOP3} SELECT DISTINCT n_id FROM (SELECT id AS n_id FROM top UNION ALL SELECT dst FROM top JOIN ring ON src = id UNION ALL SELECT b.dst FROM top JOIN ring a ON a.src = id JOIN ring b ON b.src = a.dst)")
def search_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.run(_ring(spark, sf_dir), f"SEARCH VECTOR {_literal(_first(spark, sf_dir))} TOP 3 EXPAND [:NEXT|JUMP*1..2] RETURN n.id")


@query("search_where", f"WITH {_RING}, {_TOP3} SELECT n_id FROM (SELECT DISTINCT id AS n_id FROM (SELECT id FROM top UNION ALL SELECT dst FROM top JOIN ring ON src = id WHERE label = 'NEXT')) JOIN embeddings ON vec_id = n_id WHERE label >= 2")
def search_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.run(_ring(spark, sf_dir), f"SEARCH VECTOR {_literal(_first(spark, sf_dir))} TOP 3 EXPAND [:NEXT*1..1] WHERE n.label >= 2 RETURN n.id")


# text --------------------------------------------------------------------------------------------------------------------------------

_BM25 = """
WITH d AS (SELECT doc_id AS id, lower(text) AS t, CASE WHEN length(text) = 1 THEN 1 ELSE length(text) - 1 END AS dl FROM documents WHERE length(text) > 0),
s AS (SELECT count(*) AS n, avg(dl) AS a FROM d), q AS (SELECT unnest({tokens}) AS token),
tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, dl, unnest(CASE WHEN length(t) = 1 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) END) AS token FROM d)
  WHERE token IN (SELECT token FROM q) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1)
SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (token), s GROUP BY id"""


@query("bm25", _BM25.format(tokens="['li', 'ic', 'ce', 'en', 'ns', 'se']"))
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return bm25(docs, "license", "doc_id").withColumn("score", F.round("score", 6))


@query("keyword_recall", "SELECT id, count(*)::DOUBLE AS score FROM (SELECT doc_id AS id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY id")
def keyword_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents").select(F.concat(F.lit("Kw-"), "lang").alias("keyword"), F.col("doc_id").alias("id"))
    return keyword_recall(docs, "kw-en and KW-DE, then kw-en")


@query("hybrid_fusion")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.embeddings(spark, sf_dir)
    texts = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    r = Retriever(v, _ring(spark, sf_dir).edges, texts)
    return r.search(_first(spark, sf_dir), "license", SearchConfig.hybrid(0.7, top_k=10, expand_depth=1))


# activation --------------------------------------------------------------------------------------------------------------------------

_SEED = "seed AS (SELECT vec_id AS id, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id IN (0, 5))"


def _spread(name: str, sql: str, **options: object) -> None:
    @query(name, sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        seeds = D.embeddings(spark, sf_dir).where("id in (0, 5)").select("id", F.lit(1.0).alias("score"))
        return spread(_ring(spark, sf_dir).edges, seeds, **options).withColumn("score", F.round("score", 6))


_HOP = "h{n} AS (SELECT dst AS id, sum(score * {w}) AS score FROM {of} JOIN ring ON src = {of}.id {more} WHERE score > 0 GROUP BY dst)"
_ALL = "SELECT id, round(sum(score), 6) AS score FROM (SELECT * FROM seed {hops}) GROUP BY id"
_spread("expand_depth1", f"WITH {_RING}, {_SEED}, {_HOP.format(n=1, w='weight', of='seed', more='')} {_ALL.format(hops='UNION ALL SELECT * FROM h1')}", depth=1)
_spread("expand_depth2", f"WITH {_RING}, {_SEED}, {_HOP.format(n=1, w='weight', of='seed', more='')}, {_HOP.format(n=2, w='weight', of='h1', more='')} {_ALL.format(hops='UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2')}", depth=2)
_spread("expand_ppr", f"WITH {_RING}, {_SEED}, {_HOP.format(n=1, w='weight * 0.5', of='seed', more='')} {_ALL.format(hops='UNION ALL SELECT * FROM h1')}", depth=1, teleport=0.5)
_spread("expand_inverse", f"WITH {_RING}, {_SEED}, deg AS (SELECT dst AS d, count(*) AS n FROM ring GROUP BY 1), {_HOP.format(n=1, w='weight / n ** 0.55', of='seed', more='JOIN deg ON d = dst')} {_ALL.format(hops='UNION ALL SELECT * FROM h1')}", depth=1, inverse_inhibition=True)
_spread("expand_fatigue", f"WITH {_RING}, {_SEED}, {_HOP.format(n=1, w='weight * CASE WHEN dst = 1 THEN 0.15 ELSE 1 END', of='seed', more='')} {_ALL.format(hops='UNION ALL SELECT * FROM h1')}", depth=1, tired={1})
_spread("expand_lateral", f"WITH {_RING}, {_SEED}, one AS (SELECT * FROM seed ORDER BY score DESC, id LIMIT 1), {_HOP.format(n=1, w='weight', of='one', more='')} {_ALL.format(hops='UNION ALL SELECT * FROM h1')}", depth=1, lateral=1)


@query("expand_inhibition", f"WITH {_RING}, {_SEED}, i AS (SELECT dst AS id, sum(-score * weight) AS score FROM seed JOIN ring ON src = id GROUP BY dst) SELECT id, round(sum(score), 6) AS score FROM (SELECT * FROM seed UNION ALL SELECT * FROM i) GROUP BY id")
def expand_inhibition(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = D.embeddings(spark, sf_dir).where("id in (0, 5)").select("id", F.lit(1.0).alias("score"))
    return spread(_ring(spark, sf_dir).edges.withColumn("label", F.lit("inhibition")), seeds, 2).withColumn("score", F.round("score", 6))


@query("fatigue_session")
def fatigue_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Retriever(D.embeddings(spark, sf_dir), _ring(spark, sf_dir).edges, fatigue=Fatigue())
    config = SearchConfig(top_k=5, expand_depth=1, refractory=True)
    r.search(_first(spark, sf_dir), config=config).count()
    return r.search(_first(spark, sf_dir), config=config)


@query("dpp_select")
def dpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.embeddings(spark, sf_dir)
    return diversify(VS.exact_topk(v, _first(spark, sf_dir), 30), v, 10, 1.0)


@query("fista_shadow")
def fista_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.embeddings(spark, sf_dir)
    q = _first(spark, sf_dir)
    seeds = VS.exact_topk(v.where("id <> 0"), q, 5)
    return shadow_channel(v, seeds, q, SearchConfig(top_k=10, min_score=-1.0, fista_threshold=0.0).clamped())


@query("nmf_topics")
def nmf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analyse_query(_first(spark, sf_dir), FA.nmf_rows(D.embeddings(spark, sf_dir), 4))
    return spark.createDataFrame([(k, float(p), float(t.depth), int(t.coverage), float(t.novelty)) for k, p in enumerate(t.topics)], "topic int, weight double, depth double, coverage bigint, novelty double")


# graph algorithms --------------------------------------------------------------------------------------------------------------------


@query("neighbors", f"WITH {_RING}, a AS (SELECT dst FROM ring WHERE src = 0), b AS (SELECT dst FROM a UNION SELECT r.dst FROM a JOIN ring r ON r.src = a.dst) SELECT DISTINCT dst AS id FROM b WHERE dst <> 0")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbors(_ring(spark, sf_dir).edges, 0, 2)


_REACH = f"WITH RECURSIVE {_RING}, k AS (SELECT 0::BIGINT AS id, 0 AS distance UNION SELECT dst, distance + 1 FROM k JOIN ring ON src = id WHERE distance < 4) SELECT id, min(distance)::INTEGER AS distance FROM k GROUP BY id"


@query("khop", _REACH)
def khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.k_hop(_ring(spark, sf_dir).edges, 0, 4)


_PATHS = f"""WITH RECURSIVE {_RING}, p AS (SELECT 0::BIGINT AS id, [0::BIGINT] AS path UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN ring ON src = id WHERE len(path) <= {{n}} AND NOT list_contains(path, dst))
SELECT {{cols}} FROM p WHERE {{where}}"""
_TEXT = "array_to_string(path, '>') AS path"


@query("varlen_paths", _PATHS.format(n=3, cols=f"id, {_TEXT}", where="len(path) - 1 BETWEEN 2 AND 3"))
def varlen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.variable_paths(_ring(spark, sf_dir).edges, 0, 2, 3).withColumn("path", F.concat_ws(">", "path"))


@query("all_paths", _PATHS.format(n=6, cols=_TEXT, where="id = 12 AND len(path) > 1"))
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.all_paths(_ring(spark, sf_dir).edges, 0, 12, 6).withColumn("path", F.concat_ws(">", "path"))


@query("shortest_path", _PATHS.format(n=8, cols=_TEXT, where="id = 23 ORDER BY len(path), p.path LIMIT 1"))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = G.shortest_path(_ring(spark, sf_dir).edges, 0, 23, 8)
    return spark.createDataFrame([(">".join(map(str, path)),)] if path else [], "path string")


@query("wcc", f"SELECT {_N} + n_nationkey AS id, {_R} + n_regionkey AS component FROM nation UNION ALL SELECT {_R} + r_regionkey, {_R} + r_regionkey FROM region")
def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.graph(spark, sf_dir, ("region", "nation"), ("IN_REGION",))
    return G.connected_components(g.nodes, g.edges)


@query("wcc_commerce")
def wcc_commerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.graph(spark, sf_dir)
    return G.components_by_size(g.nodes, g.edges)


@query("degree", f"""WITH v AS (SELECT {_N} + n_nationkey AS id FROM nation UNION ALL SELECT {_R} + r_regionkey FROM region), e AS (SELECT {_N} + n_nationkey AS src, {_R} + n_regionkey AS dst FROM nation),
c AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS o, (SELECT count(*) FROM e WHERE dst = id) AS i FROM v)
SELECT id, o AS out_degree, i AS in_degree, o + i AS total, (o + i) / ((SELECT count(*) FROM v) - 1)::DOUBLE AS normalized FROM c""")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.graph(spark, sf_dir, ("region", "nation"), ("IN_REGION",))
    return G.degree(g.nodes, g.edges)


def _pagerank_sql(rounds: int, where: str = "true") -> str:
    parts = [f"{_RING}", f"e AS (SELECT src, dst FROM ring WHERE {where})", "v AS (SELECT vec_id AS id FROM embeddings)", "n AS (SELECT count(*)::DOUBLE AS n FROM v)",
             "o AS (SELECT src, count(*)::DOUBLE AS deg FROM e GROUP BY 1)", "p0 AS (SELECT id, 1 / n AS rank FROM v, n)"]
    for k in range(rounds):
        parts += [
            f"l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM p{k} WHERE id NOT IN (SELECT src FROM o))",
            f"g{k} AS (SELECT dst AS id, sum(rank / deg) AS gain FROM p{k} JOIN e ON e.src = id JOIN o ON o.src = id GROUP BY dst)",
            f"p{k + 1} AS (SELECT v.id, 0.15 / n + 0.85 * (coalesce(gain, 0) + lost / n) AS rank FROM v LEFT JOIN g{k} USING (id), n, l{k})",
        ]
    return "WITH " + ",\n".join(parts) + f" SELECT id, round(rank * 1000000, 4) AS rank FROM p{rounds}"


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.round(F.col("rank") * 1_000_000, 4))


@query("pagerank", _pagerank_sql(5))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _ring(spark, sf_dir)
    return _ranked(G.pagerank(g.nodes, g.edges, iterations=5, tol=None))


@query("pagerank_label", _pagerank_sql(5, "label = 'JUMP'"))
def pagerank_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _ring(spark, sf_dir)
    return _ranked(G.pagerank(g.nodes, g.edges, iterations=5, tol=None, label="JUMP"))


@query("betweenness_sampled")
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _ring(spark, sf_dir)
    return G.betweenness(g.nodes, g.edges, sample=50)


@query("lpa")
def lpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = similarity_graph(spark, sf_dir)
    return G.label_propagation(g.nodes.select("id"), g.edges)


@query("centroids")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.embeddings(spark, sf_dir)
    return G.centroids(v, v.select("id", F.col("label").alias("community"))).select("community", F.concat_ws(",", F.transform("centroid", lambda x: F.format_number(x, 5))).alias("centroid"), "size")


@query("centroid_norms", "SELECT community, round(sqrt(sum(m * m)), 6) AS norm, max(n) AS size FROM (SELECT label AS community, i, avg(embedding[i]::DOUBLE) AS m, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1")
def centroid_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.embeddings(spark, sf_dir)
    return G.centroids(v, v.select("id", F.col("label").alias("community"))).select("community", F.round(V.norm(F.col("centroid")), 6).alias("norm"), "size")


# changes -----------------------------------------------------------------------------------------------------------------------------


def small_store(spark: SparkSession) -> GraphStore:
    """A few linked people."""
    s = GraphStore(spark, 2)
    for name, age, v in (("Ana", 30, [1, 0]), ("Bo", 25, [0, 1]), ("Cy", 35, [0.5, 0.5])):
        s.insert(v, {"name": name, "age": age})
    s.link(1, 2, "knows")
    s.link(2, 3, "knows")
    s.link(1, 3, "likes")
    return s


def _change(name: str, text: str, sql: str) -> None:
    @query(name, sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = small_store(spark)
        s.execute(text)
        n, e = s.snapshot
        out = e.groupBy("src").agg(F.count("*").alias("n_out"))
        get = lambda key: F.get_json_object("payload", f"$.{key}")
        return n.join(out, n["id"] == out["src"], "left").select("id", get("name").alias("name"), get("age").cast("bigint").alias("age"), F.coalesce("n_out", F.lit(0).cast("bigint")).alias("n_out"))


def _rows(*rows: tuple) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', {a if a is not None else 'NULL'}::BIGINT, {o}::BIGINT)" for i, n, a, o in rows) + ") t(id, name, age, n_out)"


_change("dml_create", 'CREATE (a {name: "Di", age: 20})-[:knows {weight: 0.5}]->(b {name: "Ed"})', _rows((1, "Ana", 30, 2), (2, "Bo", 25, 1), (3, "Cy", 35, 0), (4, "Di", 20, 1), (5, "Ed", None, 0)))
_change("dml_match_create", 'MATCH (a {name: "Cy"}) CREATE (a)-[:knows]->(b {name: "Fi"})', _rows((1, "Ana", 30, 2), (2, "Bo", 25, 1), (3, "Cy", 35, 1), (4, "Fi", None, 0)))
_change("dml_set", 'MATCH (a {name: "Ana"})-[:knows]->(b) SET b.age == 26, b.name == "Bob"', _rows((1, "Ana", 30, 2), (2, "Bob", 26, 1), (3, "Cy", 35, 0)))
_change("dml_delete", 'MATCH (a {name: "Bo"}) DETACH DELETE a', _rows((1, "Ana", 30, 1), (3, "Cy", 35, 0)))


@query("dml_unlink", "SELECT 2::BIGINT AS src, 3::BIGINT AS dst UNION ALL SELECT 1, 3")
def dml_unlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = small_store(spark)
    s.link(1, 2, "likes")
    s.unlink(1, 2)
    return s.snapshot[1].select("src", "dst")


@query("migrate", "SELECT i::BIGINT AS id, 5 AS dim FROM range(1, 4) t(i)")
def migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_store(spark).migrate(5).snapshot[0].select("id", F.size("vector").alias("dim"))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as changes to their users: the first sets a user, an error deletes it, others set its payload; purchases link users."""
    e = D.table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("first", F.lit(True))
    op = F.when(F.col("event_type") == "error", "delete").when(F.coalesce("first", F.lit(False)) | (F.col("event_type") == "signup"), "insert").when(F.col("event_type") == "purchase", "link").otherwise("payload")
    log = e.join(first, ["user_id", "event_id"], "left").select(
        F.col("event_id").alias("seq"), F.lit(0).cast("bigint").alias("tx"), op.alias("op"), F.col("user_id").alias("id"), ((F.col("user_id") * 7) % 50).alias("dst"),
        F.lit("buys").alias("label"), F.lit(1.0).alias("weight"), F.col("event_type").alias("payload"), F.lit(None).cast("array<float>").alias("vector"))
    return log


_LOG = """WITH f AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1),
l AS (SELECT e.event_id AS seq, user_id AS id, event_type AS payload, CASE WHEN event_type = 'error' THEN 'delete' WHEN e.event_id = f.event_id OR event_type = 'signup' THEN 'insert' WHEN event_type = 'purchase' THEN 'link' ELSE 'payload' END AS op,
  (user_id * 7) % 50 AS dst FROM events e JOIN f USING (user_id))"""


@query("changelog_fold", f"""{_LOG} SELECT id, arg_max(payload, seq) FILTER (op IN ('insert', 'payload')) AS payload FROM l GROUP BY id HAVING arg_max(op, seq) FILTER (op IN ('insert', 'delete')) = 'insert'""")
def changelog_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_nodes(spark.createDataFrame([], NODES), _event_log(spark, sf_dir).select(*(x.split()[0] for x in LOG.split(", ")))).select("id", "payload")


@query("changelog_edges", f"""{_LOG} SELECT id AS src, dst, seq AS edge_id FROM l a WHERE op = 'link' AND NOT EXISTS (SELECT 1 FROM l d WHERE d.op = 'delete' AND d.seq > a.seq AND d.id IN (a.id, a.dst))""")
def changelog_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_edges(spark.createDataFrame([], EDGES), _event_log(spark, sf_dir)).select("src", "dst", "edge_id")


# approximate indexes -----------------------------------------------------------------------------------------------------------------


@query("lpi_search")
def lpi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ProjectionIndex.build(D.embeddings(spark, sf_dir), 10).search(_first(spark, sf_dir), 10, probes=5)


@query("ppi_search")
def ppi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.PermutationIndex.build(D.embeddings(spark, sf_dir), 8).search(_first(spark, sf_dir), 10)


@query("gru_hash_search")
def gru_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.GatedHashIndex.build(D.embeddings(spark, sf_dir)).search(_first(spark, sf_dir), 10)


@query("dpp_graph_search")
def dpp_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.SignatureGraph(D.embeddings(spark, sf_dir), select="diverse").search(_first(spark, sf_dir), 10)


@query("hnsw_search")
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.SignatureGraph(D.embeddings(spark, sf_dir), select="heuristic").search(_first(spark, sf_dir), 10, by_signature=True)

