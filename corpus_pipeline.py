"""A training corpus from raw documents: toxic documents go, one of each group of near-duplicates stays, repeated passages are cut from all
documents but the first, contaminated documents go, and what is left is packed into token sequences.

Each stage works on all that the one before it kept. Between stages the table is written and read again. The first four return the columns
of documents, whatever else they hold. A stage's result depends on its documents and on small tables of ids alone; what else it wrote is deleted
as it ends. Plans are the same at every size: texts move once, by id, in each stage that drops or cuts documents by id.

Defined results: rows without an id are judged as toxic or contaminated like others, and pass the stages that compare documents by id
unchanged; of several texts with one id the smallest stays, of repeated rows one; empty and null texts stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import minhash, packing, positional_index, suffixes
from tessera.llm import toxicity as tox
from tessera.llm.common import drop, materialise, scratch, table

#: Columns that stages add for a while: no table is likely to have them.
KEY, COPY = "__tessera_key", "__tessera_copy"


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose key stands in gone (KEY)."""
    return docs.withColumn(COPY, key).join(gone.select(F.col(KEY).alias(COPY)).hint("merge"), COPY, "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model learned from the labels calls toxic."""
    with scratch(spark):
        model = tox.learn(docs, table(spark, sf_dir, "labels"))
    return tox.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; of rows with one id, one."""
    with scratch(spark):
        classes = minhash.near_duplicates(docs)
        ids = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
        ids = materialise(ids.where("n > 1 or doc_id <> class_id").select(F.col("doc_id").alias(KEY), (F.col("doc_id") == F.col("class_id")).alias("stays")), "ids", keep=True)
    kept = _without(docs, F.col("doc_id"), ids)
    if not ids.where("stays").limit(1).count():
        return kept
    # ids that stand in several rows: one of them
    rest = [c for c in docs.columns if c != "doc_id"]
    plain = [f.name for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name not in ("doc_id", "text")]
    again = docs.withColumn(COPY, F.col("doc_id")).join(ids.where("stays").select(F.col(KEY).alias(COPY)).hint("merge"), COPY, "left_semi")
    one = again.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(c) for c in rest)), F.struct("text", *plain)).alias("row"))
    return kept.unionByName(one.select("doc_id", *(F.col("row").getField(c).alias(c) for c in rest)).select(*docs.columns))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand in a document with a smaller id are cut; a document of which no word is left goes."""
    with scratch(spark):
        passages = materialise(suffixes.repeated_passages(docs).select("doc_id", "first_word", "n_words").distinct(), "cuts", keep=True)
    cut = suffixes.remove_passages(docs, passages, drop_empty=True)
    n_chars = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold windows of a benchmark item: in a training corpus one leaked item is one too many, if a whole window of it
    leaked; of items too short for a window it takes two. Texts are judged by themselves, so that rows without an id are, too."""
    key = F.xxhash64("text")
    with scratch(spark):
        found = positional_index.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        full = F.exists("spans", lambda s: s["last_word"] - s["first_word"] >= positional_index.WINDOW - 1)
        bad = materialise(found.where(F.col("contaminated") | full).select(F.col("doc_id").alias(KEY)).distinct(), "bad", keep=True)
    return _without(docs, key, bad)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces, read from a table of their own: another run doesn't touch them."""
    docs, before = table(spark, sf_dir, "documents"), None
    with scratch(spark):
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name, keep=name == STAGES[-1][0])
            if before is not None:
                drop(before)
            before = docs
    return docs


#: No SQL: scores, sketches and token ids can't be expressed; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None
