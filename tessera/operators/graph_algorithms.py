"""Graph algorithms over nodes (id) and edges (src, dst, label, ...). Iterations are joins and aggregates; each round is checkpointed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.planner import hops, simple_paths
from ..plans.storage import cut, ranked
from ..session import ship

#: Edges up to which an algorithm may hold the whole adjacency in each task.
ADJACENCY_EDGES = 20_000_000


def _steps(edges: DataFrame, label: str | None = None) -> DataFrame:
    e = edges if label is None else edges.where(F.col("label") == label)
    return e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))


def k_hop(edges: DataFrame, source: int, k: int, label: str | None = None) -> DataFrame:
    """id, distance of all nodes within k steps, source at 0."""
    return hops(_start(edges, source).select(F.col("_start").alias("id")), _steps(edges, label), k)


def neighbors(edges: DataFrame, source: int, depth: int = 1) -> DataFrame:
    return k_hop(edges, source, depth).where(F.col("id") != source).select("id")


def _start(edges: DataFrame, source: int) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(source).cast("bigint").alias("_start"))


def variable_paths(edges: DataFrame, source: int, lo: int, hi: int, label: str | None = None, limit: int | None = None) -> DataFrame:
    """id (the path's last node), path: simple paths of lo to hi steps."""
    found = simple_paths(_start(edges, source), _steps(edges, label), lo, hi).select(F.col("last").alias("id"), "path")
    return found.orderBy(F.size("path"), "path").limit(limit) if limit else found


def all_paths(edges: DataFrame, source: int, target: int, max_depth: int, label: str | None = None, limit: int | None = None) -> DataFrame:
    """path: simple paths that end at target, which no path passes."""
    steps = _steps(edges, label)
    level = _start(edges, source).select(F.col("_start").alias("last"), F.array("_start").alias("path"))
    found = None
    for n in range(1, max_depth + 1):
        level = level.where(F.col("last") != target).join(steps, F.col("last") == F.col("_from")).where(~F.array_contains("path", F.col("_to")))
        level = level.select(F.col("_to").alias("last"), F.concat("path", F.array("_to")).alias("path"))
        if 2 <= n < max_depth:
            level = cut(level)  # else each longer level would walk the shorter ones again
        done = level.where(F.col("last") == target).select("path")
        found = done if found is None else found.unionByName(done)
    if found is None:
        return level.where(F.lit(False)).select("path")
    return found.orderBy(F.size("path"), "path").limit(limit) if limit else found


def shortest_path(edges: DataFrame, source: int, target: int, max_depth: int, label: str | None = None) -> list[int] | None:
    """A shortest path by steps, the smallest by ids; None if none is within max_depth. A node is reached once, by its smallest path."""
    if source == target:
        return [source]
    steps = _steps(edges, label)
    front = _start(edges, source).select(F.col("_start").alias("id"), F.array("_start").alias("path"))
    seen = front.select("id")
    for _ in range(max_depth):
        reached = front.join(steps, F.col("id") == F.col("_from")).select(F.col("_to").alias("to"), F.concat("path", F.array("_to")).alias("path"))
        reached = reached.groupBy(F.col("to").alias("id")).agg(F.min("path").alias("path"))
        front = cut(reached.join(seen, "id", "left_anti"))
        hit = front.where(F.col("id") == target).select("path").first()
        if hit:
            return list(hit["path"])
        if not front.limit(1).count():
            return None
        seen = seen.unionByName(front.select("id"))
    return None


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id of the weakly connected component. In each round every id with a smaller neighbour hooks to its smallest, chains of
    hooks are followed by doubling, and only the edges between different roots go on, once each; two rounds leave half of the linked ids at most."""
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
    ends = e.select(F.col("hi").alias("id")).unionByName(e.select(F.col("lo").alias("id"))).distinct()
    strangers = cut(ends.join(nodes.select("id"), "id", "left_anti"))
    if strangers.limit(1).count():  # an end that is no node links nothing
        for end in ("hi", "lo"):
            e = e.join(strangers.withColumnRenamed("id", end), end, "left_anti")
    rounds = []
    while True:
        up = cut(e.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("up")))
        if not up.limit(1).count():
            break
        while True:
            above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            higher = cut(up.select("up").distinct().join(above, "up"))
            if not higher.limit(1).count():
                break
            up = cut(up.join(higher, "up", "left").select("id", F.coalesce("top", "up").alias("up")))
        rounds.append(up)
        root = lambda end: up.select(F.col("id").alias(end), F.col("up").alias("root"))
        e = e.join(root("hi"), "hi").select(F.col("root").alias("hi"), "lo").where("hi <> lo").distinct()
        e = e.join(root("lo"), "lo", "left").select("hi", F.coalesce("root", "lo").alias("lo")).where("hi <> lo")
        e = cut(e.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
    if not rounds:
        return nodes.select("id", F.col("id").alias("component"))
    tops = rounds.pop()
    while rounds:  # what hooked in an earlier round goes where its root went later
        later = tops.select(F.col("id").alias("up"), F.col("up").alias("top"))
        tops = rounds.pop().join(later, "up", "left").select("id", F.coalesce("top", "up").alias("up")).unionByName(tops)
    return nodes.select("id").join(tops, "id", "left").select("id", F.coalesce("up", "id").alias("component"))


def components_by_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return connected_components(nodes, edges).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, total, normalized (total / (N - 1)). Parallel edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    n = nodes.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    out, into = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    d = nodes.select("id").join(sums, "id", "left").crossJoin(F.broadcast(n))  # one row
    return d.select("id", out.cast("bigint").alias("out_degree"), into.cast("bigint").alias("in_degree"), (out + into).cast("bigint").alias("total"), ((out + into) / F.col("n")).alias("normalized"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tol: float | None = 1e-6, label: str | None = None) -> DataFrame:
    """id, rank. Uniform teleport; dangling nodes spread their rank evenly; parallel edges count; a label leaves other edges out."""
    e = _steps(edges, label)
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = e.groupBy(F.col("_from").alias("f")).agg(F.count("*").alias("deg"))
    # one row for each pair of nodes, with the share of rank that it carries
    links = cut(e.groupBy("_from", "_to").agg(F.count("*").alias("m")).join(out, F.col("_from") == F.col("f")).select("_from", "_to", (F.col("m") / F.col("deg")).alias("share")))
    base = cut(nodes.select("id").join(out.select(F.col("f").alias("id"), F.lit(1).alias("linked")), "id", "left").select("id", F.isnull("linked").alias("dangling")))
    ranks = base.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    lost = n and float(base.where("dangling").count()) / n
    for _ in range(iterations):
        gain = ranks.join(links, F.col("id") == F.col("_from")).groupBy(F.col("_to").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        new = (1 - damping) / n + damping * (F.coalesce("gain", F.lit(0.0)) + F.lit(lost / n))
        after = cut(ranks.join(gain, "id", "left").select("id", "dangling", F.col("rank").alias("old"), new.alias("rank")))
        moved = after.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d"), F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost")).first()
        ranks, lost = after.select("id", "dangling", "rank"), moved["lost"]
        if tol is not None and moved["d"] < tol:
            break
    return ranks.select("id", "rank")


def betweenness(nodes: DataFrame, edges: DataFrame, sample: int | None = None, label: str | None = None, normalized: bool = True) -> DataFrame:
    """id, betweenness: Brandes over directed, unweighted edges; parallel edges multiply path counts. sample: from that many sources only (the smallest
    ids), scaled up. Sources are spread over tasks; the adjacency is sent to all, so edges are limited."""
    spark = nodes.sparkSession
    ship(spark)
    e = _steps(edges, label)
    if (m := e.count()) > ADJACENCY_EDGES:
        raise QueryError(f"{m} edges; betweenness takes {ADJACENCY_EDGES}")
    if (m := nodes.count()) > ADJACENCY_EDGES:
        raise QueryError(f"{m} nodes; betweenness takes {ADJACENCY_EDGES}")
    pairs = e.toPandas()
    ids = np.sort(nodes.select("id").toPandas()["id"].to_numpy())
    n = len(ids)
    src, dst = np.searchsorted(ids, pairs["_from"]), np.searchsorted(ids, pairs["_to"])
    order = np.argsort(src, kind="stable")
    start = np.searchsorted(src[order], np.arange(n + 1))
    sent = spark.sparkContext.broadcast((ids, start, dst[order]))
    k = n if sample is None else min(sample, n)
    factor = n / k if k else 1.0
    if normalized and n > 2:
        factor /= (n - 1) * (n - 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, start, to = sent.value
        total = np.zeros(len(ids))
        for batch in batches:
            for s in batch["id"].to_numpy():
                total += _dependencies(int(s), start, to)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids[hit], "part": total[hit]})

    parts = spark.range(k).repartition(min(max(k, 1), spark.sparkContext.defaultParallelism)).mapInPandas(run, "id bigint, part double")
    sums = parts.groupBy("id").agg(F.sum("part").alias("part"))
    return nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * factor).alias("betweenness"))


def _dependencies(s: int, start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """What each node adds to paths from s, level by level."""
    n = len(start) - 1
    dist, sigma = np.full(n, -1), np.zeros(n)
    dist[s], sigma[s] = 0, 1
    front, levels = np.array([s]), []
    while len(front):
        sizes = start[front + 1] - start[front]
        u = np.repeat(front, sizes)
        v = to[np.repeat(start[front] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] if len(front) else front
        new = np.unique(v[dist[v] < 0])
        dist[new] = dist[front[0]] + 1
        along = dist[v] == dist[front[0]] + 1
        np.add.at(sigma, v[along], sigma[u[along]])
        levels.append((u[along], v[along]))
        front = new
    delta = np.zeros(n)
    for u, v in reversed(levels):
        np.add.at(delta, u, sigma[u] / sigma[v] * (1 + delta[v]))
    delta[s] = 0
    return delta


def label_propagation(nodes: DataFrame, edges: DataFrame, iterations: int = 15, min_size: int = 3) -> DataFrame:
    """id, community (1, 2, ... by the smallest id in it). Votes are weights along out-edges; all nodes move at once to the label with most votes, ties to
    the smallest; in odd rounds a node moves only to a smaller label, which ends swings. Communities below min_size are left out."""
    labels = nodes.select("id", F.col("id").alias("label"))
    e = cut(edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    for n in range(iterations):
        votes = e.join(labels, e["dst"] == labels["id"]).groupBy("src", "label").agg(F.sum("w").alias("v"))
        best = votes.groupBy("src").agg(F.max(F.struct("v", (-F.col("label")).alias("m"))).alias("b")).select(F.col("src").alias("id"), (-F.col("b.m")).alias("new"))
        new = F.least("new", "label") if n % 2 else F.coalesce("new", "label")
        after = cut(labels.join(best, "id", "left").select("id", F.col("label").alias("old"), new.alias("label")))
        labels = after.select("id", "label")
        if not after.where("old <> label").limit(1).count():
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_size)
    # a community's number is how many others begin before it
    numbered = ranked(sizes, F.col("first"), name="n_before").select("label", (F.col("n_before") + 1).alias("community"))
    return labels.join(numbered, "label").select("id", "community")


def centroids(vectors: DataFrame, communities: DataFrame) -> DataFrame:
    """community, centroid (array of double), size: mean vectors (id, vector)."""
    rows = vectors.join(communities, "id").select("community", F.posexplode("vector").alias("i", "x"))
    means = rows.groupBy("community", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    packed = means.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p"), F.max("n").alias("size"))
    return packed.select("community", F.transform("p", lambda s: s["m"]).alias("centroid"), "size")
