"""The tables as one property graph. An id is kind * 1e9 + key + 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph

#: Kinds in the order of their codes, from 1. Fixed values.
KINDS = ("region", "nation", "customer", "supplier", "part", "order", "document", "embedding", "event", "page", "turn", "user")
STEP = 1_000_000_000


def node_id(kind: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return (F.lit((KINDS.index(kind) + 1) * STEP + 1) + key.cast("bigint")).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: kind: table, key, fields (name to SQL).
NODES = {
    "region": ("region", "r_regionkey", {"name": "r_name"}),
    "nation": ("nation", "n_nationkey", {"name": "n_name"}),
    "customer": ("customer", "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment"}),
    "supplier": ("supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}),
    "part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "cast(p_size as bigint)", "price": "p_retailprice"}),
    "order": ("orders", "o_orderkey", {"status": "o_orderstatus", "totalprice": "o_totalprice", "date": "cast(o_orderdate as string)", "priority": "o_orderpriority"}),
    "document": ("documents", "doc_id", {"lang": "lang", "source": "source", "n_chars": "n_chars"}),
    "event": ("events", "event_id", {"type": "event_type", "value": "value"}),
    "page": ("pages", "page_id", {"url": "url"}),
    "turn": ("conversations", "conv_id * 1000 + turn", {"role": "role"}),
}


def kind_nodes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    name, key, columns = NODES[kind]
    return table(spark, sf_dir, name).select(node_id(kind, F.expr(key)).alias("id"), F.lit(kind).alias("kind"), *(F.expr(sql).alias(f) for f, sql in columns.items()))


def _edges(df: DataFrame, label: str, src: Column, dst: Column, weight: Column | None = None) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"))


def label_edges(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    match label:
        case "PLACED":
            return _edges(t("orders"), label, node_id("customer", "o_custkey"), node_id("order", "o_orderkey"))
        case "CONTAINS":
            return _edges(t("lineitem"), label, node_id("order", "l_orderkey"), node_id("part", "l_partkey"), F.col("l_quantity") / 50)
        case "SUPPLIED_BY":
            return _edges(t("lineitem").select("l_partkey", "l_suppkey").distinct(), label, node_id("part", "l_partkey"), node_id("supplier", "l_suppkey"))
        case "IN_NATION":
            c = _edges(t("customer"), label, node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"))
            return c.unionByName(_edges(t("supplier"), label, node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey")))
        case "IN_REGION":
            return _edges(t("nation"), label, node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"))
        case "DID":
            return _edges(t("events"), label, node_id("user", "user_id"), node_id("event", "event_id"), F.col("value"))
        case "NEXT":
            a, b = t("conversations").select("conv_id", "turn"), t("conversations").select("conv_id", (F.col("turn") - 1).alias("turn"))
            return _edges(a.join(b, ["conv_id", "turn"]), label, node_id("turn", F.col("conv_id") * 1000 + F.col("turn")), node_id("turn", F.col("conv_id") * 1000 + F.col("turn") + 1))
    raise KeyError(label)


COMMERCE = ("region", "nation", "customer", "supplier", "part", "order")
COMMERCE_LABELS = ("PLACED", "CONTAINS", "SUPPLIED_BY", "IN_NATION", "IN_REGION")


def graph(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = COMMERCE, labels: tuple[str, ...] = COMMERCE_LABELS) -> Graph:
    """Kinds and labels are constants of their part of a union, so a filter on one leaves only the tables that it needs."""
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    nodes = reduce(union, (kind_nodes(spark, sf_dir, k) for k in kinds))
    if "user" not in kinds and "DID" in labels:
        users = table(spark, sf_dir, "events").select("user_id").distinct().select(node_id("user", "user_id").alias("id"), F.lit("user").alias("kind"))
        nodes = union(nodes, users)
    return Graph(nodes, reduce(union, (label_edges(spark, sf_dir, x) for x in labels)))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (vec_id), vector, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Events with a schemaless payload: the props JSON, plus type and value."""
    e = table(spark, sf_dir, "events")
    payload = F.concat(
        F.lit('{"type":"'), F.col("event_type"), F.lit('"'),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(',"value":'), F.col("value").cast("decimal(18,4)").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("event_id") % 5 == 0, F.lit(',"note":null')).when(F.col("event_id") % 5 == 1, F.lit(',"note":"n"')).otherwise(F.lit("")),
        F.lit(',"user":'), F.col("user_id").cast("string"),
        F.lit(',"tags":["a"'), F.when(F.col("event_id") % 2 == 0, F.lit(',"b"')).otherwise(F.lit("")), F.lit("]}"),
    )
    nodes = e.select((F.col("event_id") + 1).alias("id"), payload.alias("payload"))
    edges = e.select((F.col("event_id") + 1).alias("src"), (F.col("event_id") + 1).alias("dst"), F.lit("SELF").alias("label"), F.lit(1.0).alias("weight")).limit(0)
    return Graph.from_json(nodes, edges)
