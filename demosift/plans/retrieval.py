"""Retrieval strategies by name, each one plan over all queries.

An ``Index`` holds what strategies share and builds it when a strategy first needs it.  Corpora have
``row_id, source_text``, queries ``query_id, text``; both may have ``type`` and ``length``, and vectors in
tables of their own (``embedding`` beside the id).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demosift.operators import bm25, dense, diversity, graph, rank, sampling
from demosift.operators.packed_graph import PackedGraph
from demosift.sources.storage import stored

# fixed values: names of backends, strategies and prompt modes
BACKENDS = ("dense", "bm25", "graph")
GRAPH_STRATEGIES = ("graph_common", "graph_ppr", "hybrid_graph", "graph_ppr_bm25_dense")
STRATEGIES = ("zero", "static", "random", "similarity", "diversity", *GRAPH_STRATEGIES)
PROMPT_MODES = ("standard", "dipmt_plus")


class Index:
    def __init__(self, corpus: DataFrame, queries: DataFrame, backend: str = "bm25", vectors: DataFrame | None = None, asked: DataFrame | None = None, static: DataFrame | None = None, seed: int = 42, candidate_n: int = 40, ppr_steps: int = graph.STEPS, restart_prob: float = graph.RESTART, normalised: bool = False, derived: bool = False, read: bool = False):
        if backend not in BACKENDS:
            raise ValueError(f"no backend is called {backend}")
        self.corpus, self.queries, self.backend = corpus, queries, backend
        self._vectors, self._asked, self.static = vectors, asked, static
        self.seed, self.candidate_n, self.ppr_steps, self.restart_prob = seed, candidate_n, ppr_steps, restart_prob
        # of the graph: rows get the type that follows from their tokens; the corpus is a table as it is read
        self.normalised, self.derived, self.read = normalised, derived, read

    @cached_property
    def vectors(self) -> DataFrame:
        if self._vectors is None or self._asked is None:
            raise ValueError("this strategy needs vectors of rows and queries")
        return self._vectors

    @cached_property
    def features(self) -> tuple[DataFrame, DataFrame]:
        raw, known = graph.known_features(self.corpus, normalised=self.normalised)
        return raw, stored(known, "known-features")

    @cached_property
    def asked_features(self) -> DataFrame:
        return stored(graph.query_features(self.queries, self.features[1].select("feature", "idf"), normalised=self.normalised), "query-features")

    @cached_property
    def common_scores(self) -> DataFrame:
        return stored(graph.common_scores(graph.weights(*self.features), self.asked_features), "common")

    @cached_property
    def _packed(self) -> dict[bool, PackedGraph]:
        return {}

    def packed(self, walked: bool) -> PackedGraph:
        """The graph as arrays; one that can be walked also serves where nothing walks."""
        for held, found in self._packed.items():
            if held >= walked:
                return found
        summed = ("weight", "square", "alone") if walked else ("square",)
        return self._packed.setdefault(walked, PackedGraph(self.corpus, self.queries, normalised=self.normalised, walked=walked, summed=summed, derived=self.derived, read=self.read))

    def blended(self, name: str, k: int) -> DataFrame:
        weights = rank.BLENDS[name]
        more = {}
        if "dense" in weights:
            more["dense"] = stored(self.vectors.select("row_id", "embedding"), "row-vectors")
            more["dense_asked"] = stored(self._asked.select("query_id", "embedding"), "query-vectors")
        if "bm25" in weights:
            more["bm25"] = stored(bm25.packed(self.corpus, self.queries), "bm25-scores")
        return self.packed(True).scored(k, tuple(weights), weights, self.ppr_steps, self.restart_prob, more)

    def ranked(self, strategy: str, k: int) -> DataFrame:
        """``query_id, row_id, score, rank`` of a strategy that ranks by score."""
        if strategy in rank.BLENDS:
            return rank.top_k(self.blended(strategy, k), k)
        if strategy in ("graph_common", "graph_ppr"):
            # a query without a known feature falls back to the cosine, which is then zero everywhere, as the walk's scores are
            found = self.packed(strategy == "graph_ppr").scored(k, (strategy,), steps=self.ppr_steps, alpha=self.restart_prob)
            return rank.top_k(found, k)
        if self.backend == "dense":
            return dense.similarity(self.vectors, self._asked, k)
        return bm25.similarity(self.corpus, self.queries, k)

    def retrieve(self, strategy: str, k: int) -> DataFrame:
        """``query_id, row_id, score, rank`` of any strategy; the score is null where nothing is scored."""
        strategy = strategy.strip().lower()
        if strategy not in STRATEGIES:
            raise ValueError(f"no strategy is called {strategy}")
        none = F.lit(None).cast("double")
        if strategy == "zero":
            return self.queries.select("query_id").limit(0).crossJoin(self.corpus.select("row_id").limit(0)).select("query_id", "row_id", none.alias("score"), F.lit(0).alias("rank"))
        if strategy == "static":
            if self.static is None:
                raise ValueError("static retrieval needs static examples")
            first = sampling.first_rows(self.static, k).select("row_id").agg(F.array_sort(F.collect_list("row_id")).alias("rows"))
            found = self.queries.select("query_id").crossJoin(F.broadcast(first)).select("query_id", F.posexplode("rows").alias("rank", "row_id"))
            return found.select("query_id", "row_id", none.alias("score"), (F.col("rank") + 1).alias("rank"))
        if strategy == "random":
            position = "test_index" if "test_index" in self.queries.columns else "query_id"
            drawn = sampling.random_rows(self.queries, self.corpus.count(), k, self.seed, position=position)
            return drawn.select("query_id", F.col("place").alias("row_id"), none.alias("score"), "rank")
        if strategy in GRAPH_STRATEGIES and self.backend != "graph":
            raise ValueError(f"{strategy} needs the backend graph")
        if strategy == "diversity":
            candidates = self.ranked("similarity", max(self.candidate_n, k) if self.backend == "bm25" else self.candidate_n)
            if self.backend == "dense":
                return diversity.dense_diversity(candidates, self.vectors, k, self.seed)
            return diversity.lexical_diversity(candidates, self.corpus, k)
        return self.ranked(strategy, k)

    def examples(self, strategy: str, k: int) -> DataFrame:
        """Retrieved rows with their texts."""
        corpus = self.static if strategy == "static" else self.corpus
        columns = [c for c in ("source_text", "target_text", "target_lang", "type") if c in corpus.columns]
        return rank.with_rows(self.retrieve(strategy, k), corpus.select("row_id", *columns))
