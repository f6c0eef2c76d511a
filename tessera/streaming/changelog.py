"""The change log as a stream: changes that arrive as files are checked, folded and appended in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import EDGES, LOG, NODES, fold_edges, fold_nodes


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the change log's rows from JSON files under path."""
    return spark.readStream.schema(LOG).json(path)


def fold_stream(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps a snapshot under out: each micro-batch folds its changes, in order of seq, into the snapshot before and writes a new one. Batches have
    folders of their own, so one that runs twice writes the same."""
    spark = changes.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        nodes, edges = snapshot(spark, out, n - 1)
        fold_nodes(nodes, batch).write.mode("overwrite").parquet(f"{out}/batch-{n:08d}/nodes")
        fold_edges(edges, batch).write.mode("overwrite").parquet(f"{out}/batch-{n:08d}/edges")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, out: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after batch n; empty before the first."""
    if n < 0:
        return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    return spark.read.schema(NODES).parquet(f"{out}/batch-{n:08d}/nodes"), spark.read.schema(EDGES).parquet(f"{out}/batch-{n:08d}/edges")
