"""Turns statements into DataFrames.

A pattern is a left-deep chain of equi-joins of node and edge relations; predicates stay column expressions, so that Catalyst pushes them to
scans, prunes columns, and picks and re-plans joins. A node relation is left out where only its id is asked for.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import fields
from ..functions.fields import Field, no
from ..functions.filters import Filter
from ..functions.vectors import cosine
from ..sources.graph import Graph
from .ast import Bool, Compare, Edge, Item, Literal, Matches, Node, Path, Prop, Query, Search
from .parser import parse_query
from .storage import cut

#: Longest variable-length segment: paths, unlike reached nodes, multiply with each hop.
MAX_HOPS = 12
EPSILON = 2.220446049250313e-16
ROW_CAP = 5000  # of compat


def run(graph: Graph, query: str | Query, optional_outer: bool = False, compat: bool = False) -> DataFrame:
    """The rows of a query. optional_outer: OPTIONAL MATCH keeps start nodes without a match (else it is MATCH). compat: LIMIT, or 5000 rows,
    cuts rows before they are sorted or aggregated."""
    q = parse_query(query) if isinstance(query, str) else query
    return Planner(graph, q, optional_outer, compat).plan()


@dataclass
class Planner:
    graph: Graph
    query: Query
    optional_outer: bool = False
    compat: bool = False

    def __post_init__(self) -> None:
        q = self.query
        self.vars: list[str] = []
        if isinstance(q.entry, Path):
            self.vars = list(dict.fromkeys(n.var for n in q.entry.nodes))
        else:
            named = [i.expr.var for i in q.items or ()]
            self.vars = [named[0] if named else "_"]
        self.keys: dict[str, set[str]] = {v: set() for v in self.vars}
        self.whole: set[str] = set(self.vars) if q.items is None else set()
        for item in q.items or ():
            self._use(item.expr)
            if item.expr.key is None and item.func is None:
                self.whole.add(self._var(item.expr.var))
        self._used_by(q.where)
        for key, _ in q.order:
            if isinstance(key, Prop):
                self._use(key)
        self.parsed: dict[str, Column] = {}  # schemaless payloads that a predicate has at hand

    # analysis
    def _var(self, name: str | None) -> str:
        if not isinstance(self.query.entry, Path):
            return self.vars[0]  # one variable, whatever it is called
        name = self.vars[0] if name is None else name
        if name not in self.keys:
            raise QueryError(f"unknown variable {name}")
        return name

    def _use(self, p: Prop) -> None:
        var = self._var(p.var)
        if p.key is not None and p.key != "id":
            self.keys[var].add(p.key)

    def _used_by(self, where: object) -> None:
        match where:
            case Bool(_, parts):
                for p in parts:
                    self._used_by(p)
            case Compare(left, _, right):
                self._use(left)
                if isinstance(right, Prop):
                    self._use(right)
            case Matches(var, found):
                self.keys[self._var(var)].update(filter_keys(found))

    # columns
    def field(self, p: Prop) -> Field:
        var = self._var(p.var)
        if p.key == "id":
            return fields.typed(F.col(f"{var}__id"), T.LongType())
        return self._payload_field(var, p.key)

    def _payload_field(self, var: str, key: str) -> Field:
        return fields.variant(self.parsed[var], key) if var in self.parsed else self.graph.field(key, f"{var}__")

    def where(self, p: object) -> Column:
        """A predicate that looks each schemaless payload up once, not once for each field and test in it."""
        used = [v for v in self.vars if self.keys[v]] if self.graph.schemaless else []

        def nest(rest: list[str]) -> Column:
            if not rest:
                return self.predicate(p)

            def inside(payload: Column) -> Column:
                self.parsed[rest[0]] = payload
                return nest(rest[1:])

            return F.exists(F.array(F.col(f"{rest[0]}__payload")), inside)

        try:
            return nest(used)
        finally:
            self.parsed.clear()

    def nodes(self, node: Node, in_pattern: bool = True) -> DataFrame:
        """The node's relation, filtered, with the columns that the query needs, each begun with the variable."""
        df = self.graph.nodes
        if node.filter is not None:
            df = df.where(self.graph.test(node.filter, "id" if in_pattern else None))
        cols = [F.col("id").alias(f"{node.var}__id"), *(F.col(c).alias(f"{node.var}__{c}") for c in self.graph.columns_for(self.keys[node.var]))]
        if node.var in self.whole:
            cols.append(self.graph.payload_json().alias(f"{node.var}__json"))
        return df.select(*cols)

    def needs_node(self, node: Node) -> bool:
        return node.filter is not None or bool(self.keys[node.var]) or node.var in self.whole

    def steps(self, edge: Edge) -> DataFrame:
        """_from, _to of each step that an edge pattern allows; a step back and forth over one edge is two."""
        e = self.graph.edges
        if edge.labels:
            e = e.where(F.col("label").isin(list(edge.labels)))
        out = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
        back = e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"))
        return {"out": out, "in": back, "both": out.unionByName(back)}[edge.direction]

    # entries
    def match(self, path: Path) -> DataFrame:
        how = "left" if self.query.optional and self.optional_outer else "inner"
        df = self.nodes(path.nodes[0])
        bound = {path.nodes[0].var}
        for edge, prev, node in zip(path.edges, path.nodes, path.nodes[1:], strict=False):
            here = F.col(f"{prev.var}__id")
            again = node.var in bound
            steps = self.steps(edge) if edge.hops is None else simple_paths(df.select(here.alias("_start")).distinct(), self.steps(edge), *edge.hops).select(F.col("start").alias("_from"), F.col("last").alias("_to"))
            # a variable that is met again must be the same node
            to = f"{node.var}__id" if not again else "_again"
            steps = steps.withColumnRenamed("_to", to)
            if again:
                if node.filter is not None:
                    steps = steps.join(self.nodes(Node(node.var, node.filter)).select(F.col(f"{node.var}__id").alias("_again")), "_again", "left_semi")
                df = df.join(steps, (here == F.col("_from")) & (F.col("_again") == F.col(f"{node.var}__id")), how).drop("_from", "_again")
                continue
            if self.needs_node(node):
                steps = steps.join(self.nodes(node), to)
            df = df.join(steps, here == F.col("_from"), how).drop("_from")
            bound.add(node.var)
        return df

    def search(self, s: Search) -> DataFrame:
        """The top nodes by cosine, those that expansion reaches, each with its own cosine as _score."""
        if not s.vector:
            raise QueryError("an empty vector")
        var = self.vars[0]
        q = F.array(*(F.lit(float(x)) for x in s.vector))
        near = self.graph.nodes.where(F.size("vector") == len(s.vector)).withColumn("_score", cosine(F.col("vector"), q))
        top = near.select("id", "_score").orderBy(F.desc("_score"), "id").limit(s.top)
        if s.expand is not None:
            lo, hi = s.expand.hops
            reach = hops(top.select("id"), self.steps(s.expand), hi)
            ids = top.select("id").unionByName(reach.where((F.col("distance") >= lo) & (F.col("distance") > 0)).select("id")).distinct()
        else:
            ids = top.select("id")
        df = self.nodes(Node(var), in_pattern=False).join(ids.select(F.col("id").alias(f"{var}__id")), f"{var}__id")
        scores = near.select(F.col("id").alias(f"{var}__id"), "_score")
        return df.join(scores, f"{var}__id", "left")

    # predicates
    def predicate(self, p: object) -> Column:
        match p:
            case Bool("and", parts):
                return reduce(lambda a, b: a & b, map(self.predicate, parts))
            case Bool("or", parts):
                return reduce(lambda a, b: a | b, map(self.predicate, parts))
            case Bool("not", (part,)):
                return ~self.predicate(part)
            case Matches(var, found):
                return found.compile(lambda key: self._payload_field(self._var(var), key))
            case Compare(left, op, right):
                return compare(self.field(left), op, literal(right.value) if isinstance(right, Literal) else self.field(right))
        raise QueryError(f"unknown predicate {p}")

    # the rest
    def plan(self) -> DataFrame:
        q = self.query
        if q.explain:
            return self.explain()
        if isinstance(q.entry, Path):
            df = self.match(q.entry)
        elif isinstance(q.entry, Search):
            df = self.search(q.entry)
        else:
            df = self.nodes(Node(self.vars[0], q.entry), in_pattern=False)
        if q.where is not None:
            df = df.where(self.where(q.where))
        if self.compat:
            df = df.limit(ROW_CAP if q.limit is None else q.limit)
        items = q.items or ()
        if any(i.func for i in items):
            df, order = self.aggregate(df, items)
        else:
            df, order = self.project(df, items)
        if order:
            df = df.orderBy(*order)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*(c for c in df.columns if not c.startswith("_o_") and "__" not in c))

    def order_columns(self, names: dict[Prop, str] | None = None) -> tuple[list[Column], list[Column]]:
        """Columns to sort by, and as what: values of one key, numbers before texts before booleans, missing last (first if descending)."""
        made, keys = [], []
        for n, (key, down) in enumerate(self.query.order):
            if isinstance(key, Literal):
                continue
            if names is not None:
                if key not in names:
                    raise QueryError(f"{key.var}.{key.key} is not a group key")
                parts = [F.col(names[key])]
            else:
                f = self.field(key)
                rank = F.when(f.kind == "number", 0).when(f.kind == "string", 1).when(f.kind == "boolean", 2)
                parts = []
                for k, part in enumerate((rank, f.number, f.text, f.flag)):
                    made.append(part.alias(f"_o_{n}_{k}"))
                    parts.append(F.col(f"_o_{n}_{k}"))
            keys += [p.desc_nulls_first() if down else p.asc_nulls_last() for p in parts]
        return made, keys

    def project(self, df: DataFrame, items: tuple[Item, ...]) -> tuple[DataFrame, list[Column]]:
        out: list[Column] = []
        distinct: list[str] = []
        for item in items or tuple(Item(Prop(v)) for v in self.vars):
            var = self._var(item.expr.var)
            if item.expr.key is None:
                name = item.alias or var.strip("_") or "node"
                out += [F.col(f"{var}__id").alias(f"{name}_id"), F.col(f"{var}__json").alias(name)]
                distinct += [f"{name}_id"] * item.distinct
            else:
                name = item.alias or f"{var}_{item.expr.key}".strip("_")
                out.append(self.field(item.expr).value.alias(name))
                distinct += [name] * item.distinct
        made, keys = self.order_columns()
        if isinstance(self.query.entry, Search):
            made.append(F.col("_score").alias("_o_score"))
            keys = keys or [F.desc("_o_score")]
        ids = [F.col(f"{v}__id").alias(f"_o_id_{v}") for v in self.vars]
        df = df.select(*out, *made, *ids)
        by = [f"_o_id_{v}" for v in self.vars]
        if distinct:
            rest = [c for c in df.columns if c not in distinct]
            first = df.groupBy(*distinct).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_f"))
            df = first.select(*distinct, *(F.col(f"_f.{c}").alias(c) for c in rest)).select(*df.columns)
        sort = bool(keys) or self.query.limit is not None or self.query.offset > 0
        return df, [*keys, *by] if sort else []

    def aggregate(self, df: DataFrame, items: tuple[Item, ...]) -> tuple[DataFrame, list[Column]]:
        groups: list[Column] = []
        names: dict[Prop, str] = {}
        made: list[Column] = []
        for item in items:
            var = self._var(item.expr.var)
            if item.func is None:
                if item.expr.key is None:
                    name, col = (item.alias or var) + "_id", F.col(f"{var}__id")
                else:
                    name = item.alias or f"{var}_{item.expr.key}"
                    col = self.field(item.expr).value
                groups.append(col.alias(name))
                names[item.expr] = name
                continue
            field = None if item.expr.key is None else self.field(item.expr)
            node = F.col(f"{var}__id")
            match item.func:
                case "count":
                    col = F.count(node)
                case "sum":
                    col = F.count(node).cast("double") if field is None else F.coalesce(F.sum(field.number), F.lit(0.0))
                case "avg" | "min" | "max":
                    number = node.cast("double") if field is None else field.number
                    col = {"avg": F.avg, "min": F.min, "max": F.max}[item.func](number)
                case "collect":
                    col = F.sort_array(F.collect_list(node)) if field is None else F.sort_array(F.collect_list(F.when(field.present, field.json)))
            made.append(col.alias(item.alias or item.func))
        df = df.groupBy(*groups).agg(*made, F.count("*").alias("_o_rows")).where("_o_rows > 0")  # of no rows, no group
        df = df.select(*(c for c in df.columns if c in (*names.values(), *(i.alias or i.func for i in items if i.func))))
        _, keys = self.order_columns(names)
        sort = bool(keys) or self.query.limit is not None or self.query.offset > 0
        return df, [*keys, *(F.col(n) for n in names.values())] if sort else []

    def explain(self) -> DataFrame:
        q = self.query
        inner = Planner(self.graph, Query(q.entry, q.where, q.items, q.order, q.limit, q.offset, False, q.optional), self.optional_outer).plan()
        strategy, detail = "full_scan", ""
        tricks: list[str] = []
        if isinstance(q.entry, Path):
            first = q.entry.nodes[0]
            ids = first.filter is not None and "id" in filter_keys(first.filter)
            labels = q.entry.edges[0].labels if q.entry.edges else ()
            strategy = "id_filter" if ids else "filter_scan" if first.filter else f"label_scan {'|'.join(labels)}" if labels else "full_scan"
            arrows = {"out": "-[{}]->", "in": "<-[{}]-", "both": "-[{}]-"}
            detail = f"({first.var})" + "".join(arrows[e.direction].format("|".join(e.labels)) + f"({n.var})" for e, n in zip(q.entry.edges, q.entry.nodes[1:], strict=True))
            tricks += ["node join left out"] * any(not self.needs_node(n) for n in q.entry.nodes[1:])
        elif isinstance(q.entry, Search):
            strategy, detail = "exact_vector_scan", f"top {q.entry.top}"
        entry = "MATCH" if isinstance(q.entry, Path) else "SEARCH" if isinstance(q.entry, Search) else "FIND"
        plan = {
            "entry": entry, "detail": detail, "candidate_strategy": strategy, "predicate": q.where is not None, "return": inner.columns, "optimizations": tricks,
            "total_nodes": self.graph.nodes.count(), "limit": q.limit, "offset": q.offset, "order_by_count": len(q.order),
            "physical": inner._jdf.queryExecution().simpleString(),
        }
        return self.graph.nodes.sparkSession.createDataFrame([(json.dumps(plan),)], "plan string")


def filter_keys(f: Filter) -> set[str]:
    return {f.key} - {""} | {k for p in f.parts for k in filter_keys(p)}


def literal(value: object) -> Field:
    f = fields.missing()
    if isinstance(value, bool):
        f.flag = F.lit(value)
    elif isinstance(value, (int, float)):
        f.number = F.lit(float(value))
    elif isinstance(value, str):
        f.text = F.lit(value)
    return f


def compare(a: Field, op: str, b: Field) -> Column:
    """Numbers with numbers, texts with texts, booleans by == and != only; any other pair is false, for != too."""
    test = {
        "==": lambda x, y: x == y, "!=": lambda x, y: x != y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y,
    }[op]
    numbers = F.abs(a.number - b.number) < EPSILON if op == "==" else F.abs(a.number - b.number) >= EPSILON if op == "!=" else test(a.number, b.number)
    out = F.coalesce(numbers, no()) | F.coalesce(test(a.text, b.text), no())
    return out | F.coalesce(test(a.flag, b.flag), no()) if op in ("==", "!=") else out


def simple_paths(starts: DataFrame, steps: DataFrame, lo: int, hi: int) -> DataFrame:
    """start, last, path (ids) of all paths of lo to hi steps from starts (_start) that meet no node twice; one row for each path."""
    if hi > MAX_HOPS:
        raise QueryError(f"more than {MAX_HOPS} hops")
    level = starts.select(F.col("_start").alias("start"), F.col("_start").alias("last"), F.array("_start").alias("path"))
    found = level if lo == 0 else None
    for n in range(1, hi + 1):
        level = level.join(steps, level["last"] == steps["_from"]).where(~F.array_contains("path", F.col("_to")))
        level = level.select("start", F.col("_to").alias("last"), F.concat("path", F.array("_to")).alias("path"))
        if n >= 2 and n < hi:
            level = cut(level)  # else each longer level would walk the shorter ones again
        if n >= lo:
            found = level if found is None else found.unionByName(level)
    return found


def hops(starts: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """id, distance of all nodes within `most` steps of any of starts (id), each with its smallest distance. Each level is written, so that the plan of
    a level is one join and one anti join whatever came before; no new node ends the search."""
    front = cut(starts.select("id").distinct().select("id", F.lit(0).alias("distance")))
    seen = front
    for n in range(1, most + 1):
        met = front.join(steps, front["id"] == steps["_from"]).select(F.col("_to").alias("id")).distinct()
        front = cut(met.join(seen.select("id"), "id", "left_anti").select("id", F.lit(n).alias("distance")))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen
