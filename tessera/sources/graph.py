"""A property graph over DataFrames.

nodes: id (bigint), payload fields, and vector (array of float) if there is one. Fields are typed columns, or all in one VARIANT column
`payload`. edges: src, dst, label, weight, edge_id (several edges between two nodes are several rows).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields
from ..functions.fields import Field
from ..functions.filters import Filter


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def from_json(nodes: DataFrame, edges: DataFrame) -> Graph:
        """From nodes (id, payload as JSON text, perhaps vector) and edges."""
        return Graph(nodes.withColumn("payload", F.parse_json("payload")), edges)

    @cached_property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.nodes.schema if f.name not in ("id", "vector")}

    @property
    def schemaless(self) -> bool:
        return isinstance(self.types.get("payload"), T.VariantType)

    def field(self, key: str, prefix: str = "") -> Field:
        """A payload field of nodes, whose columns begin with prefix."""
        if self.schemaless:
            return fields.variant(F.col(f"{prefix}payload"), key)
        if key not in self.types:
            return fields.missing()
        return fields.typed(F.col(f"{prefix}{key}"), self.types[key])

    def test(self, found: Filter, id_col: str | None = None) -> Column:
        """A filter on nodes; id_col: the column that the field `id` means. A schemaless payload is built and parsed once for all of the filter's tests: the
        tests are inside of a lambda, where the optimiser can't write the parsing out again for each."""
        own = lambda of: lambda key: fields.typed(F.col(id_col), T.LongType()) if key == "id" and id_col else of(key)
        if self.schemaless:
            return F.exists(F.array("payload"), lambda p: found.compile(own(lambda key: fields.variant(p, key))))
        return found.compile(own(self.field))

    def payload_json(self) -> Column:
        if self.schemaless:
            return F.to_json("payload")
        return F.to_json(F.struct(*sorted(self.types)))

    def columns_for(self, keys: set[str]) -> list[str]:
        """The payload columns that hold these fields."""
        return ["payload"] if self.schemaless and keys else sorted(k for k in keys if k in self.types)

    # scans and look-ups
    def ids(self) -> DataFrame:
        return self.nodes.select("id")

    def get(self, node_id: int) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def edges_of(self, node_id: int) -> DataFrame:
        return self.edges.where(F.col("src") == node_id)

    def edges_by_label(self, label: str) -> DataFrame:
        return self.edges.where(F.col("label") == label).select("src", "dst")

    def incoming(self, node_id: int) -> DataFrame:
        """The sources of edges into a node, once for each edge."""
        return self.edges.where(F.col("dst") == node_id).select("src")

    def by_field(self, key: str, value: object) -> DataFrame:
        return self.nodes.where(self.test(Filter.eq(key, value)))

    def in_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))

    def labelled(self, label: str | None) -> DataFrame:
        return self.edges if label is None else self.edges.where(F.col("label") == label)

    def migrate(self, dim: int) -> Graph:
        """The same ids, payloads and edges with zero vectors of another dimension."""
        return replace(self, nodes=self.nodes.withColumn("vector", F.array_repeat(F.lit(0.0).cast("float"), dim)))
