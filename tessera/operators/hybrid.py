"""Hybrid retrieval: text and keyword recall, vector recall, residual search, fusion, spreading activation, diversity, with hooks between."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidVector
from ..functions.cognitive import dpp_select, fista
from ..functions.text import bm25, keyword_recall
from ..plans.storage import cut
from .activation import Fatigue, spread
from .vector_search import exact_topk, routed_topk


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 5
    expand_depth: int = 0
    min_score: float = 0.1
    teleport: float = 0.0
    advanced: bool = False
    sparse_residual: bool = False
    fista_lambda: float = 0.1
    fista_threshold: float = 0.3
    dpp: bool = False
    dpp_weight: float = 1.0
    text: bool = False
    text_boost: float = 1.5
    inverse_inhibition: bool = False
    lateral: int = 0
    refractory: bool = False
    coarse: bool = False
    coarse_ratio: float = 0.05
    force_exact: bool = False
    where: Column | None = None

    def clamped(self) -> SearchConfig:
        clip = lambda x, lo, hi: min(max(x, lo), hi)
        return replace(
            self, top_k=max(self.top_k, 1), fista_lambda=clip(self.fista_lambda, 1e-5, 100.0), teleport=clip(self.teleport, 0.0, 1.0),
            dpp_weight=clip(self.dpp_weight, 0.0, 10.0), coarse_ratio=clip(self.coarse_ratio, 0.0, 1.0), fista_threshold=max(self.fista_threshold, 0.0),
        )

    @staticmethod
    def hybrid(alpha: float = 0.7, **other: object) -> SearchConfig:
        """alpha is the vector's part; text counts max(1 - alpha, 0.1) * 3."""
        return SearchConfig(text=True, text_boost=max(1 - alpha, 0.1) * 3, **other)


@dataclass
class HookContext:
    data: dict = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)
    abort: bool = False

    def timed(self, name: str, call: Callable[[], object]) -> object:
        began = time.perf_counter()
        try:
            return call()
        finally:
            self.timings[name] = self.timings.get(name, 0.0) + time.perf_counter() - began


class SearchHook:
    """Override what is needed. Hits are DataFrames of id, score."""

    def on_pre_search(self, vector: list[float] | None, config: SearchConfig, ctx: HookContext) -> tuple[list[float] | None, SearchConfig]:
        return vector, config

    def on_custom_recall(self, vector: list[float] | None, config: SearchConfig, ctx: HookContext) -> DataFrame | None:
        return None

    def on_post_recall(self, hits: DataFrame, ctx: HookContext) -> DataFrame:
        return hits

    def on_pre_graph_expand(self, seeds: DataFrame, ctx: HookContext) -> DataFrame:
        return seeds

    def on_rerank(self, hits: DataFrame, ctx: HookContext) -> DataFrame | None:
        return None

    def on_post_search(self, hits: DataFrame, ctx: HookContext) -> DataFrame:
        return hits


class CompositeHook(SearchHook):
    """Several hooks in order; the first answer wins for recall and rerank, and an abort stops what follows before the search."""

    def __init__(self, *hooks: SearchHook) -> None:
        self.hooks = hooks

    def on_pre_search(self, vector, config, ctx):
        for h in self.hooks:
            vector, config = h.on_pre_search(vector, config, ctx)
            if ctx.abort:
                break
        return vector, config

    def _first(self, name, *args):
        return next((x for h in self.hooks if (x := getattr(h, name)(*args)) is not None), None)

    def _all(self, name, hits, ctx):
        for h in self.hooks:
            hits = getattr(h, name)(hits, ctx)
        return hits

    def on_custom_recall(self, vector, config, ctx):
        return self._first("on_custom_recall", vector, config, ctx)

    def on_post_recall(self, hits, ctx):
        return self._all("on_post_recall", hits, ctx)

    def on_pre_graph_expand(self, seeds, ctx):
        return self._all("on_pre_graph_expand", seeds, ctx)

    def on_rerank(self, hits, ctx):
        return self._first("on_rerank", hits, ctx)

    def on_post_search(self, hits, ctx):
        return self._all("on_post_search", hits, ctx)


def fuse(*channels: DataFrame) -> DataFrame:
    """id, score: the sum over channels."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out.groupBy("id").agg(F.sum("score").alias("score"))


def text_channel(docs: DataFrame, query: str, boost: float) -> DataFrame:
    return bm25(docs, query).select("id", (F.least(F.greatest(F.col("score") / 10, F.lit(0.0)), F.lit(1.0)) * boost).alias("score"))


def shadow_channel(vectors: DataFrame, seeds: DataFrame, vector: list[float], config: SearchConfig) -> DataFrame | None:
    """What a LASSO fit of the query on the seeds leaves, searched again at 0.8 of its score. Seeds are at most a few top-k lists."""
    rows = vectors.join(seeds.orderBy(F.desc("score"), "id").limit(max(config.top_k, 15) * 4).select("id"), "id").select("vector").collect()
    _, residual, norm = fista(np.array(vector), np.array([r[0] for r in rows], float).reshape(len(rows), len(vector)), config.fista_lambda)
    if norm <= config.fista_threshold:
        return None
    return exact_topk(vectors, residual.tolist(), config.top_k, config.min_score, config.where).withColumn("score", F.col("score") * 0.8)


def diversify(hits: DataFrame, vectors: DataFrame, k: int, weight: float) -> DataFrame:
    """k of the 3 k best hits by a determinantal point process, in order of score."""
    pool = hits.orderBy(F.desc("score"), "id").limit(3 * k).join(vectors.select("id", "vector"), "id").collect()
    pool.sort(key=lambda r: (-r["score"], r["id"]))
    chosen = dpp_select(np.array([r["vector"] for r in pool], float), np.array([r["score"] for r in pool]), k, weight)
    return hits.where(F.col("id").isin([pool[i]["id"] for i in chosen]))


@dataclass
class Retriever:
    """A session of searches over nodes (id, vector and whatever where uses), edges, texts (id, text) and keywords (keyword, id)."""

    nodes: DataFrame
    edges: DataFrame | None = None
    texts: DataFrame | None = None
    keywords: DataFrame | None = None
    hook: SearchHook = field(default_factory=SearchHook)
    fatigue: Fatigue = field(default_factory=Fatigue)

    def search(self, vector: list[float] | None = None, text: str | None = None, config: SearchConfig | None = None, ctx: HookContext | None = None) -> DataFrame:
        """id, score of the top hits."""
        ctx, hook, spark = ctx or HookContext(), self.hook, self.nodes.sparkSession
        config = (config or SearchConfig()).clamped()
        empty = spark.createDataFrame([], "id bigint, score double")
        if vector is not None:
            if not all(map(math.isfinite, vector)):
                raise InvalidVector("a vector holds NaN or infinity")
            first = self.nodes.select(F.size("vector")).where("vector is not null").first()
            if first and first[0] != len(vector):
                raise DimensionMismatch(f"{len(vector)}, not {first[0]}")
        vector, config = ctx.timed("hook_pre_search", lambda: hook.on_pre_search(vector, config, ctx))
        if ctx.abort:
            return empty
        hits = ctx.timed("hook_custom_recall", lambda: hook.on_custom_recall(vector, config, ctx))
        if hits is None:
            hits = self._recall(vector, text, config)
            hits = empty if hits is None else cut(hits)  # seeds, expansion and counts read what was found, not the recall again
        hits = ctx.timed("hook_post_recall", lambda: hook.on_post_recall(hits, ctx))
        allowed = self.nodes if config.where is None else self.nodes.where(config.where)
        seeds = hits.where(F.col("score") >= config.min_score).join(allowed.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(max(config.top_k, 15))
        seeds = cut(seeds)
        seeds = ctx.timed("hook_pre_graph_expand", lambda: hook.on_pre_graph_expand(seeds, ctx))
        found = ctx.timed("graph_expand", lambda: self._expand(seeds, config))
        reranked = ctx.timed("hook_rerank", lambda: hook.on_rerank(found, ctx))
        found = found if reranked is None else reranked
        if config.advanced and config.dpp and found.count() > config.top_k:
            found = diversify(found, self.nodes, config.top_k, config.dpp_weight)
        found = found.orderBy(F.desc("score"), "id").limit(config.top_k)
        return ctx.timed("hook_post_search", lambda: hook.on_post_search(found, ctx))

    def _recall(self, vector: list[float] | None, text: str | None, config: SearchConfig) -> DataFrame | None:
        channels = []
        if text and config.text:
            if self.keywords is not None:
                channels.append(keyword_recall(self.keywords, text).withColumn("score", F.col("score") * config.text_boost))
            if self.texts is not None:
                channels.append(text_channel(self.texts, text, config.text_boost))
        if vector is not None:
            near = routed_topk(self.nodes, vector, config.top_k, config.min_score, config.where, config.force_exact, config.coarse, config.coarse_ratio)
            channels.append(near)
        if channels and vector is not None and config.advanced and config.sparse_residual:
            shadow = shadow_channel(self.nodes, fuse(*channels), vector, config)
            channels += [] if shadow is None else [shadow]
        return fuse(*channels) if channels else None

    def _expand(self, seeds: DataFrame, config: SearchConfig) -> DataFrame:
        if not config.expand_depth or self.edges is None:
            return seeds
        tired = self.fatigue.tired if config.refractory else None
        found = spread(self.edges, seeds, config.expand_depth, config.teleport, config.inverse_inhibition, config.lateral, tired)
        if config.refractory:
            top = [r["id"] for r in found.orderBy(F.desc("score"), "id").limit(15 + len(self.fatigue.tired)).collect()]
            self.fatigue.after(top)
        return found
