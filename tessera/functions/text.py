"""Text recall: BM25 over character bigrams, and registered keywords found in a query."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut

K1, B = 1.2, 0.75


def bigrams(text: Column) -> Column:
    """The overlapping character pairs of the lower-cased text; a text of one character is its own."""
    low = F.lower(text)
    return F.when(F.length(low) == 1, F.array(low)).otherwise(F.regexp_extract_all(low, F.lit("(?s)(?=(..))"), 1))


def query_bigrams(text: str) -> list[str]:
    low = text.lower()
    return [low] if len(low) == 1 else sorted({low[i : i + 2] for i in range(len(low) - 1)})


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """token, id, tf of all texts that aren't empty."""
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.explode(bigrams(F.col(text_col))).alias("token"))
    return rows.groupBy("token", "id").agg(F.count("*").alias("tf"))


def token_count(low: Column, token: str) -> Column:
    """How often a bigram stands in a lower-cased text (overlaps count); a token of one character is a text of its own."""
    if len(token) == 1:
        return (low == F.lit(token)).cast("int")
    if token[0] == token[1]:
        return F.regexp_count(low, F.lit(f"(?s)(?=\\Q{token}\\E)"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(token), F.lit("")))) / 2).cast("int")


def text_length(text: Column) -> Column:
    """A text's number of tokens."""
    return F.when(F.length(text) == 1, 1.0).otherwise(F.length(text) - 1.0)


def _scores(tf: DataFrame, n_tokens: int, stats: DataFrame, k1: float, b: float) -> DataFrame:
    """id, score from tf (id, dl, t0, t1, ...) and one row of stats (n, avg_dl, df0, df1, ...)."""
    joined = tf.where(F.greatest(*(F.col(f"t{k}") for k in range(n_tokens)), F.lit(0)) > 0).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for k in range(n_tokens):
        df, t = F.col(f"df{k}"), F.col(f"t{k}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        total = total + F.when(t > 0, idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))).otherwise(0.0)
    return joined.select("id", total.alias("score"))


def bm25(docs: DataFrame | TextIndex, query: str, id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """id, score of texts that share a bigram with query. A query's repeated bigrams count once. Texts are scanned once, and only for those
    bigrams; a TextIndex isn't scanned but for their rows."""
    asked = query_bigrams(query)
    if isinstance(docs, TextIndex):
        return docs.search(query, k1, b)
    if not asked:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    low = F.lower(text_col)
    texts = docs.where(F.length(text_col) > 0)
    tf = cut(texts.select(F.col(id_col).alias("id"), text_length(F.col(text_col)).alias("dl"), *(token_count(low, t).alias(f"t{k}") for k, t in enumerate(asked))))
    found = [F.count(F.when(F.col(f"t{k}") > 0, 1)).alias(f"df{k}") for k in range(len(asked))]
    return _scores(tf, len(asked), tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"), *found), k1, b)


@dataclass(frozen=True)
class TextIndex:
    """Stored postings: token, id, tf and the text's length dl, range-sorted by token, so that a query reads the row groups of its own bigrams; and
    the number of texts with their mean length."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> TextIndex:
        texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        rows = texts.select("id", text_length(F.col("text")).alias("dl"), F.explode(bigrams(F.col("text"))).alias("token"))
        counted = rows.groupBy("token", "id", "dl").agg(F.count("*").cast("int").alias("tf"))
        counted.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
        texts.agg(F.count("*").alias("n"), F.avg(text_length(F.col("text"))).alias("avg_dl")).write.mode("overwrite").parquet(f"{path}/stats")
        return TextIndex(docs.sparkSession, path)

    @staticmethod
    def of_fields(nodes: DataFrame, path: str, fields: list[str] | None = None) -> TextIndex:
        """Over all text fields of nodes, or those named, joined by a space."""
        names = fields or [f.name for f in nodes.schema if f.dataType.simpleString() == "string"]
        return TextIndex.build(nodes.select("id", F.concat_ws(" ", *names).alias("text")), path)

    def search(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        asked = query_bigrams(query)
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("token").isin(asked))
        tf = rows.groupBy("id", "dl").agg(*(F.sum(F.when(F.col("token") == t, F.col("tf")).otherwise(0)).alias(f"t{k}") for k, t in enumerate(asked)))
        if not asked:
            return tf.select("id", F.lit(0.0).alias("score")).limit(0)
        found = rows.agg(*(F.count(F.when(F.col("token") == t, 1)).alias(f"df{k}") for k, t in enumerate(asked)))
        return _scores(tf, len(asked), self.spark.read.parquet(f"{self.path}/stats").crossJoin(F.broadcast(found)), k1, b)


def keyword_matches(keywords: list[str], query: str) -> list[str]:
    """The keywords that stand in query, in lower case: leftmost, then longest, without overlap; one entry for each place."""
    words = sorted({k.lower() for k in keywords if k}, key=lambda k: (-len(k), k))
    return re.findall("|".join(map(re.escape, words)), query.lower()) if words else []


def keyword_recall(keywords: DataFrame, query: str) -> DataFrame:
    """id, score: one point for each match of a keyword (keyword, id) that is registered for the id. The search for keywords runs on the
    table: a keyword is kept if the query holds it, so only those reach the driver."""
    held = keywords.select(F.lower("keyword").alias("keyword"), "id").where(F.length("keyword") > 0).where(F.contains(F.lit(query.lower()), F.col("keyword")))
    found = keyword_matches([r[0] for r in held.select("keyword").distinct().collect()], query)
    hits = keywords.sparkSession.createDataFrame([(k,) for k in found], "keyword string")
    return held.join(F.broadcast(hits), "keyword").groupBy("id").agg(F.count("*").cast("double").alias("score"))
