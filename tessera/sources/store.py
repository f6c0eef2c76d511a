"""A versioned graph store: a snapshot and a change log, both DataFrames, folded by the last change of each id.

Every change gets a number; a transaction's changes are appended at once or not at all. compact() writes a snapshot to a new folder and then the
name of the folder to use, so that a reader always finds a whole one.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptedFile, DimensionMismatch, InvalidVector, NodeExists, NodeNotFound, PayloadTooLarge, QueryError
from ..plans import planner
from ..plans.ast import Path, Query
from ..plans.parser import parse
from ..plans.storage import ranked
from .graph import Graph

LOG = "seq bigint, tx bigint, op string, id bigint, dst bigint, label string, weight double, payload string, vector array<float>"
NODES = "id bigint, payload string, vector array<float>"
EDGES = "src bigint, dst bigint, label string, weight double, edge_id bigint"
PAYLOAD_BYTES = 8 << 20


def fold_nodes(base: DataFrame, log: DataFrame) -> DataFrame:
    """The nodes after all changes of the log. An id's payload and vector are the last ones set; a delete drops it."""
    rows = base.select("id", F.lit(-1).cast("bigint").alias("seq"), F.lit("insert").alias("op"), "payload", "vector")
    rows = rows.unionByName(log.where(F.col("op").isin("insert", "delete", "payload", "vector")).select("id", "seq", "op", "payload", "vector"))
    sets = lambda col, *ops: F.max_by(col, F.when(F.col("op").isin(*ops), F.col("seq")))
    last = rows.groupBy("id").agg(sets("payload", "insert", "payload").alias("payload"), sets("vector", "insert", "vector").alias("vector"), F.max_by("op", F.when(F.col("op").isin("insert", "delete"), F.col("seq"))).alias("op"))
    return last.where("op = 'insert'").select("id", "payload", "vector")


def fold_edges(base: DataFrame, log: DataFrame) -> DataFrame:
    """The edges after all changes: links less those that a later unlink of both ends, or delete of one, took."""
    rows = base.select("src", "dst", "label", "weight", "edge_id", F.lit(-1).cast("bigint").alias("seq"))
    rows = rows.unionByName(log.where("op = 'link'").select(F.col("id").alias("src"), "dst", "label", "weight", F.col("seq").alias("edge_id"), "seq"))
    cut = log.where("op = 'unlink'").groupBy(F.col("id").alias("src"), "dst").agg(F.max("seq").alias("cut"))
    gone = log.where("op = 'delete'").groupBy("id").agg(F.max("seq").alias("gone"))
    rows = rows.join(cut, ["src", "dst"], "left").where("cut is null or cut < seq").drop("cut")
    for end in ("src", "dst"):
        rows = rows.join(gone.withColumnRenamed("id", end), end, "left").where("gone is null or gone < seq").drop("gone")
    return rows.select("src", "dst", "label", "weight", "edge_id")


class GraphStore:
    def __init__(self, spark: SparkSession, dim: int, nodes: DataFrame | None = None, edges: DataFrame | None = None, next_id: int = 1, next_seq: int = 0) -> None:
        self.spark, self.dim = spark, dim
        self.base_nodes = spark.createDataFrame([], NODES) if nodes is None else nodes
        self.base_edges = spark.createDataFrame([], EDGES) if edges is None else edges
        self.logs: list[DataFrame] = []
        self.pending: list[tuple] = []
        self.next_id, self.seq, self.tx = next_id, next_seq, 0
        self.indexes: set[str] = set()

    # the change log
    def _append(self, op: str, id_: int, dst: int | None = None, label: str | None = None, weight: float | None = None, payload: str | None = None, vector: list[float] | None = None) -> None:
        self.pending.append((self.seq, self.tx, op, id_, dst, label, weight, payload, vector))
        self.seq += 1
        self._changed()

    def _append_rows(self, rows: DataFrame) -> int:
        """rows: a log's columns but seq and tx."""
        n = rows.count()
        if n:
            self._flush()
            numbered = ranked(rows.withColumn("tx", F.lit(self.tx).cast("bigint")), F.col("id"), name="seq").withColumn("seq", F.col("seq").cast("bigint") + self.seq)
            self.logs.append(planner_cut(numbered.select(*self.log.columns)))
            self.seq += n
            self._changed()
        return n

    def _flush(self) -> None:
        if self.pending:
            self.logs.append(self.spark.createDataFrame(self.pending, LOG))
            self.pending = []

    def _changed(self) -> None:
        self.__dict__.pop("snapshot", None)
        self.__dict__.pop("graph", None)

    @property
    def log(self) -> DataFrame:
        self._flush()
        out = self.spark.createDataFrame([], LOG)
        for x in self.logs:
            out = out.unionByName(x)
        return out

    @cached_property
    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        log = self.log
        return fold_nodes(self.base_nodes, log), fold_edges(self.base_edges, log)

    @cached_property
    def graph(self) -> Graph:
        return Graph.from_json(*self.snapshot)

    # checks
    def _vector(self, vector: Iterable[float]) -> list[float]:
        v = [float(x) for x in vector]
        if len(v) != self.dim:
            raise DimensionMismatch(f"{len(v)}, not {self.dim}")
        if not all(map(math.isfinite, v)):
            raise InvalidVector("a vector holds NaN or infinity")
        return v

    @staticmethod
    def _payload(payload: object) -> str:
        text = json.dumps(payload, allow_nan=False, default=lambda _: None)
        if len(text.encode()) > PAYLOAD_BYTES:
            raise PayloadTooLarge(f"{len(text)} characters")
        return text

    def contains(self, id_: int) -> bool:
        return bool(self.snapshot[0].where(F.col("id") == id_).limit(1).count())

    def _need(self, *ids: int) -> None:
        there = {r[0] for r in self.snapshot[0].where(F.col("id").isin(list(ids))).select("id").collect()}
        for i in ids:
            if i not in there:
                raise NodeNotFound(str(i))

    # reads
    def query(self, text: str, **options: bool) -> DataFrame:
        return planner.run(self.graph, text, **options)


    def count(self) -> int:
        return self.snapshot[0].count()

    # changes
    def insert(self, vector: Iterable[float], payload: object) -> int:
        self.next_id += 1
        self._append("insert", self.next_id - 1, payload=self._payload(payload), vector=self._vector(vector))
        return self.next_id - 1

    def insert_with_id(self, id_: int, vector: Iterable[float], payload: object) -> None:
        if id_ < 1:
            raise QueryError("ids begin at 1")
        if self.contains(id_):
            raise NodeExists(str(id_))
        self._append("insert", id_, payload=self._payload(payload), vector=self._vector(vector))
        self.next_id = max(self.next_id, id_ + 1)

    def batch_insert(self, rows: Iterable[tuple[Iterable[float], object]]) -> list[int]:
        return [self.insert(v, p) for v, p in rows]

    def insert_frame(self, nodes: DataFrame) -> int:
        """Adds many nodes (id, payload, vector) whose ids are new."""
        if nodes.join(self.snapshot[0], "id", "left_semi").limit(1).count():
            raise NodeExists("an id is taken")
        none = lambda kind: F.lit(None).cast(kind)
        n = self._append_rows(nodes.select("id", F.lit("insert").alias("op"), none("bigint").alias("dst"), none("string").alias("label"), none("double").alias("weight"), "payload", "vector"))
        self.next_id = max(self.next_id, (nodes.agg(F.max("id")).first()[0] or 0) + 1)
        return n

    def link(self, src: int, dst: int, label: str = "related", weight: float = 1.0) -> None:
        self._need(src, dst)
        self._append("link", src, dst, label, float(weight))

    def unlink(self, src: int, dst: int) -> None:
        self._need(src)
        self._append("unlink", src, dst)

    def delete(self, id_: int) -> None:
        self._need(id_)
        self._append("delete", id_)

    def update_payload(self, id_: int, payload: object) -> None:
        self._need(id_)
        self._append("payload", id_, payload=self._payload(payload))

    def update_vector(self, id_: int, vector: Iterable[float]) -> None:
        self._need(id_)
        self._append("vector", id_, vector=self._vector(vector))

    def create_index(self, key: str) -> None:
        """A note that a field is looked up often; scans prune by statistics of the written files."""
        self.indexes.add(key)

    def drop_index(self, key: str) -> None:
        self.indexes.discard(key)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def execute(self, text: str) -> int:
        """Runs a change; returns how many nodes and edges it touched. A query changes nothing and returns 0."""
        m = parse(text)
        if isinstance(m, Query):
            return 0
        self.tx += 1
        if m.match is None:
            return self._create(m.create, {})
        names = [n.var for n in m.match.entry.nodes]
        if m.create:
            first = planner.run(self.graph, Query(m.match.entry, m.match.where, None, limit=1)).first()
            return 0 if first is None else self._create(m.create, {v: first[f"{v.strip('_') or 'node'}_id"] for v in names})
        found = planner.run(self.graph, Query(m.match.entry, m.match.where, None))
        for v in (*m.delete, *(p.var for p, _ in m.assign)):
            if v not in names:
                raise QueryError(f"unknown variable {v}")
        none = lambda kind: F.lit(None).cast(kind)
        log = lambda df, op, payload: df.select("id", F.lit(op).alias("op"), none("bigint").alias("dst"), none("string").alias("label"), none("double").alias("weight"), payload.alias("payload"), none("array<float>").alias("vector"))
        if m.delete:
            ids = None
            for v in m.delete:
                one = found.select(F.col(f"{v.strip('_') or 'node'}_id").alias("id"))
                ids = one if ids is None else ids.unionByName(one)
            return self._append_rows(log(ids.distinct(), "delete", none("string")))
        # a node may be met under several variables: all their assignments are made on it
        targets = list(dict.fromkeys(p.var for p, _ in m.assign))
        rows = None
        for v in targets:
            name = v.strip("_") or "node"
            one = found.select(F.col(f"{name}_id").alias("id"), F.col(name).alias("payload"), F.lit(v).alias("var"))
            rows = one if rows is None else rows.unionByName(one)
        rows = rows.groupBy("id").agg(F.first("payload").alias("payload"), F.collect_set("var").alias("vars"))
        for v in targets:
            news = {p.key: value for p, value in m.assign if p.var == v}
            rows = rows.withColumn("payload", F.when(F.array_contains("vars", v), merged(F.col("payload"), news)).otherwise(F.col("payload")))
        return self._append_rows(log(rows, "payload", F.col("payload")))

    def _create(self, paths: tuple[Path, ...], known: dict[str, int]) -> int:
        known, n = dict(known), 0
        for path in paths:
            for node in path.nodes:
                if node.var not in known:
                    known[node.var] = self.insert([0.0] * self.dim, node.payload or {})
                    n += 1
            for a, edge, b in zip(path.nodes, path.edges, path.nodes[1:], strict=False):
                src, dst = (b, a) if edge.direction == "in" else (a, b)
                self._append("link", known[src.var], known[dst.var], edge.labels[0] if edge.labels else "related", edge.weight)
                n += 1
        return n

    # files
    def compact(self, path: str) -> str:
        """Writes the snapshot; the log is empty after it. Returns the version's folder."""
        version = f"{path}/v-{uuid.uuid4().hex}"
        nodes, edges = self.snapshot
        nodes.write.parquet(f"{version}/nodes")
        edges.write.partitionBy("label").parquet(f"{version}/edges")
        meta = self.spark.createDataFrame([(self.dim, self.next_id, self.seq, version)], "dim int, next_id bigint, seq bigint, version string")
        # pointers are numbered and never replaced: until the new one is whole, the one before it holds
        number = max(_pointers(self.spark, path, whole=False), default=0) + 1
        meta.coalesce(1).write.json(f"{path}/current-{number:012d}")
        self.__init__(self.spark, self.dim, *_read(self.spark, version), self.next_id, self.seq)
        return version

    @staticmethod
    def open(spark: SparkSession, path: str) -> GraphStore:
        """The newest version whose pointer was written to its end."""
        number = max(_pointers(spark, path), default=None)
        if number is None:
            raise CorruptedFile(f"{path} holds no store")
        meta = spark.read.schema("dim int, next_id bigint, seq bigint, version string").json(f"{path}/current-{number:012d}").first()
        return GraphStore(spark, meta["dim"], *_read(spark, meta["version"]), meta["next_id"], meta["seq"])

    def migrate(self, dim: int) -> GraphStore:
        """A store with the same ids, payloads and edges, and zero vectors of another dimension."""
        nodes, edges = self.snapshot
        return GraphStore(self.spark, dim, nodes.withColumn("vector", F.array_repeat(F.lit(0.0).cast("float"), dim)), edges, self.next_id, self.seq)


def _pointers(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """The numbers of a store's pointers; whole: only those that are written to their end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "current-*" + "/_SUCCESS" * whole)) or []
    names = [x.getPath().getParent().getName() if whole else x.getPath().getName() for x in found]
    return [int(n.rpartition("-")[2]) for n in names]


def _read(spark: SparkSession, version: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODES).parquet(f"{version}/nodes"), spark.read.schema(EDGES).parquet(f"{version}/edges").select("src", "dst", "label", "weight", "edge_id")


def planner_cut(df: DataFrame) -> DataFrame:
    from ..plans.storage import cut

    return cut(df)


def merged(payload: F.Column, news: dict[str, object]) -> F.Column:
    """A JSON object's text with some fields set."""
    kept = F.map_filter(F.from_json(payload, "map<string,variant>"), lambda k, _: ~k.isin(list(news)))
    body = F.concat_ws(",", F.transform(F.map_entries(kept), lambda e: F.concat(F.substring(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.to_json(e["value"]))))
    fresh = json.dumps(news)[1:-1]
    return F.concat(F.lit("{"), body, F.when((body != "") & F.lit(bool(fresh)), F.lit(",")).otherwise(F.lit("")), F.lit(fresh), F.lit("}"))


class Transaction:
    """Buffers changes, checks them all against the store as they would stand, and appends them at once."""

    def __init__(self, store: GraphStore) -> None:
        self.store, self.ops = store, []

    def _add(self, name: str, *args: object) -> None:
        self.ops.append((name, args))

    def insert(self, vector, payload):
        self._add("insert", vector, payload)

    def insert_with_id(self, id_, vector, payload):
        self._add("insert_with_id", id_, vector, payload)

    def link(self, src, dst, label="related", weight=1.0):
        self._add("link", src, dst, label, weight)

    def unlink(self, src, dst):
        self._add("unlink", src, dst)

    def delete(self, id_):
        self._add("delete", id_)

    def update_payload(self, id_, payload):
        self._add("update_payload", id_, payload)

    def update_vector(self, id_, vector):
        self._add("update_vector", id_, vector)

    def pending_count(self) -> int:
        return len(self.ops)

    def rollback(self) -> None:
        self.ops = []

    def commit(self) -> list[int]:
        """The ids of inserted nodes. If one change can't be made, none is."""
        s = self.store
        named = {x for name, args in self.ops if name not in ("insert",) for x in args[: 2 if name in ("link", "unlink") else 1]}
        live = {r[0] for r in s.snapshot[0].where(F.col("id").isin(list(named))).select("id").collect()} if named else set()
        next_id, made, rows = s.next_id, [], []
        need: Callable[[int], None]

        def need(i: int) -> None:
            if i not in live:
                raise NodeNotFound(str(i))

        for name, args in self.ops:
            if name in ("insert", "insert_with_id"):
                i = next_id if name == "insert" else args[0]
                if i in live:
                    raise NodeExists(str(i))
                vector, payload = args[-2:]
                rows.append(("insert", i, None, None, None, s._payload(payload), s._vector(vector)))
                live.add(i)
                next_id = max(next_id, i + 1)
                made.append(i)
            elif name == "link":
                need(args[0])
                need(args[1])
                rows.append(("link", args[0], args[1], args[2], float(args[3]), None, None))
            elif name == "unlink":
                need(args[0])
                rows.append(("unlink", args[0], args[1], None, None, None, None))
            else:
                need(args[0])
                if name == "delete":
                    live.discard(args[0])
                    rows.append(("delete", args[0], None, None, None, None, None))
                elif name == "update_payload":
                    rows.append(("payload", args[0], None, None, None, s._payload(args[1]), None))
                else:
                    rows.append(("vector", args[0], None, None, None, None, s._vector(args[1])))
        s.tx += 1
        for row in rows:
            s._append(*row)
        s.next_id, self.ops = next_id, []
        return made


__all__ = ["GraphStore", "Transaction", "fold_edges", "fold_nodes"]
