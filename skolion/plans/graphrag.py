"""Graph-guided question answering over passages, for all questions at once.

Four stages: a hybrid search finds seed papers, the graph around them is scored, passages of its papers are
added, and passages are reranked and quoted. Modes leave stages out; a filter may drop passages before reranking.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, dense, fusion, graph
from ..operators.lexical import Bm25, best
from ..session import materialise

MODES = ("vector_only", "hybrid", "graph_hybrid")


@dataclass(frozen=True)
class Settings:
    """first: passages of the first stage; seeds: papers the graph starts from; around: papers it adds; final:
    passages of an answer; pool: candidates of either side; lam: weight of the lexical side."""

    first: int = 30
    seeds: int = 6
    around: int = 6
    final: int = 5
    pool: int = 100
    lam: float = 0.5


@dataclass
class GraphRag:
    """passages (id, paper_id, text), questions (qid, question), papers and similar as in operators.graph.

    Passages of unknown papers are found but lend no seeds. Null texts match nothing.

    embed: from (rows, key, text) to (key, embedding); rerank: from the candidates (qid, question, id, rank, score,
    prior, text) and a number to as many (qid, id, score, rank); answer: from contexts (qid, question, id, rank,
    text) to (qid, answer, sources). vectors_of: given vectors (id, embedding) in place of the passages' own.
    """

    passages: DataFrame
    questions: DataFrame
    papers: DataFrame
    similar: DataFrame
    settings: Settings = Settings()
    keep: Callable[[DataFrame], DataFrame] | None = None
    embed: Callable[[DataFrame, str, str], DataFrame] = dense.hash_embed
    rerank: Callable[[DataFrame, int], DataFrame] | None = None
    answer: Callable[[DataFrame], DataFrame] = answers.extractive
    vectors_of: DataFrame | None = None

    @cached_property
    def vectors(self) -> DataFrame:
        if self.vectors_of is not None:
            return self.vectors_of.select("id", "embedding")
        return materialise(self.embed(self.passages.where("text IS NOT NULL"), "id", "text"))

    @cached_property
    def asked(self) -> DataFrame:
        return materialise(self.embed(self.questions, "qid", "question"))

    @cached_property
    def lexical(self) -> DataFrame:
        return materialise(best(Bm25(self.passages, "id", "text").scores(self.questions, "qid", "question"), self.settings.pool).where("score > 0").drop("rank"))

    @cached_property
    def dense(self) -> DataFrame:
        return materialise(dense.dense_topk(self.vectors, self.asked, self.settings.pool, exclude_self=False).drop("rank"))

    def search(self, lam: float, k: int) -> DataFrame:
        """(qid, id, score, rank)."""
        if lam == 0:
            return best(fusion.minmax(self.dense), k)
        return best(fusion.fuse(fusion.minmax(self.lexical), fusion.minmax(self.dense), lam), k)

    @cached_property
    def seeds(self) -> DataFrame:
        found = self.search(self.settings.lam, self.settings.first).join(self.passages.select("id", "paper_id"), "id").where("paper_id IS NOT NULL")
        return materialise(fusion.first_occurrences(found, "paper_id").where(F.col("rank") <= self.settings.seeds).select("qid", "paper_id"))

    @cached_property
    def around(self) -> DataFrame:
        return materialise(graph.weighted_subgraph(self.papers, self.similar, self.seeds, self.settings.around))

    def candidates(self, mode: str) -> DataFrame:
        """(qid, id, score, rank, prior) before reranking."""
        s = self.settings
        if mode == "vector_only":
            return self.search(0, s.first).withColumn("prior", F.lit(0.0))
        found = self.search(s.lam, s.first)
        if mode == "hybrid":
            return found.withColumn("prior", F.lit(0.0))
        # passages of the papers around, by their vectors alone
        inside = self.around.select("qid", "paper_id").unionByName(self.seeds).distinct().join(self.passages.select("id", "paper_id"), "paper_id").select("qid", "id")
        vectors = inside.join(self.vectors, "id").join(self.asked.withColumnRenamed("embedding", "question"), "qid")
        near = F.aggregate(F.zip_with("embedding", "question", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        more = best(vectors.select("qid", "id", F.round(near, 6).alias("score")), s.first)
        merged = fusion.merge_pools(found, more)
        top = self.around.groupBy("qid").agg(F.max("score").alias("top"))
        prior = self.around.join(top, "qid").select("qid", "paper_id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("prior"))
        prior = prior.unionByName(self.seeds.withColumn("prior", F.lit(1.0))).groupBy("qid", "paper_id").agg(F.max("prior").alias("prior"))
        placed = merged.join(self.passages.select("id", "paper_id"), "id").join(prior, ["qid", "paper_id"], "left")
        return placed.select("qid", "id", "score", "rank", F.coalesce("prior", F.lit(0.0)).alias("prior"))

    def ranked(self, mode: str) -> DataFrame:
        """(qid, id, score, rank): the passages of the answer."""
        rows = self.candidates(mode)
        if self.keep:
            rows = self.keep(rows)
        if self.rerank:
            texts = rows.join(self.passages.select("id", "text"), "id").join(self.questions, "qid")
            return self.rerank(texts.select("qid", "question", "id", "rank", "score", "prior", "text"), self.settings.final)
        if mode == "vector_only":
            return fusion.merge_pools(rows.drop("prior"), rows.drop("prior").limit(0)).where(F.col("rank") <= self.settings.final)
        withv = rows.join(self.vectors, "id", "left").join(self.asked.select("qid", F.col("embedding").alias("question")), "qid")
        return answers.mmr(withv.select("qid", "question", "id", "rank", "embedding", "prior"), self.settings.final)

    def contexts(self, mode: str) -> DataFrame:
        return self.ranked(mode).join(self.passages, "id").join(self.questions, "qid").select("qid", "question", "id", "paper_id", "rank", "score", "text")

    def ask(self, mode: str = "graph_hybrid") -> DataFrame:
        """(qid, mode, answer, sources, retrieved, contexts) of every question; where nothing was retrieved, the answer
        says so and the lists are empty."""
        c = materialise(self.contexts(mode))
        held = c.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "paper_id", "text"))).alias("x"))
        got = held.select("qid", F.array_distinct(F.transform("x", lambda x: x["paper_id"])).alias("retrieved"), F.transform("x", lambda x: x["text"]).alias("contexts"))
        told = self.answer(c.select("qid", "question", "id", "rank", "text")).join(got, "qid")
        every = self.questions.select("qid").distinct().join(told, "qid", "left")
        none = lambda c: F.coalesce(c, F.array().cast(dict(told.dtypes)[c])).alias(c)
        return every.select("qid", F.lit(mode).alias("mode"), F.coalesce("answer", F.lit(answers.NOTHING)).alias("answer"), none("sources"), none("retrieved"), none("contexts"))
