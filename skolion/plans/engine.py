"""One object with what a service would offer: search, ask, related papers, graph, statistics, ingest, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, fusion, graph, metrics, safety
from ..sources import stores
from .graphrag import GraphRag, Settings


@dataclass(frozen=True)
class Collection:
    """papers (paper_id, title, authors array, venue, year, topic), chunks (chunk_id, paper_id, text, page_start,
    page_end, ...), similar (src, dst, score), pages (paper_id, page_number, text, char_start, char_end)."""

    papers: DataFrame
    chunks: DataFrame
    similar: DataFrame
    pages: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.papers.sparkSession

    def stats(self) -> DataFrame:
        e = graph.edges(self.papers, self.similar)
        run = stores.run_record(self.chunks, self.pages)
        counts = run.select(F.explode(F.create_map(*[x for c in run.columns for x in (F.lit(c), F.col(c))])).alias("name", "n")).select(F.lit("store").alias("what"), "name", "n")
        return graph.stats(graph.nodes(self.papers), e).unionByName(counts)

    def ingest(self, pages: DataFrame, papers: DataFrame, windows: chunking.Windows = chunking.Windows()) -> Collection:
        """The collection with these papers' pages, chunks and rows in place of any earlier ones."""
        fresh = chunking.chunk_pages(pages, windows)
        shared = [c for c in self.chunks.columns if c in fresh.columns]
        return replace(
            self, pages=stores.replace_by(self.pages, pages.select(*self.pages.columns), "paper_id"), papers=stores.replace_by(self.papers, papers.select(*self.papers.columns), "paper_id"),
            chunks=stores.replace_by(self.chunks.select(*shared), fresh.select(*shared), "paper_id"),
        )

    def rag(self, questions: DataFrame, settings: Settings = Settings(), trusted: DataFrame | None = None) -> GraphRag:
        """An executor over the chunks; with trusted sources, untrusted and injected passages are dropped first."""
        out = GraphRag(self.chunks.select(F.col("chunk_id").alias("id"), "paper_id", "text"), questions, self.papers, self.similar, settings)
        if trusted is not None:
            ok = safety.judged(self.chunks.select("chunk_id", "paper_id", "text"), trusted, self.chunks).where("reason IS NULL").select(F.col("chunk_id").alias("id"))
            out.keep = lambda rows: rows.join(ok, "id", "left_semi")
        return out

    def search(self, questions: DataFrame, k: int = 5, lam: float = 0.5) -> DataFrame:
        """Citations of the k best chunks of every question (qid, question)."""
        return fusion.citations(self.rag(questions).search(lam, k), self.chunks, self.papers)

    def ask(self, questions: DataFrame, mode: str = "graph_hybrid", trusted: DataFrame | None = None) -> DataFrame:
        return self.rag(questions, trusted=trusted).ask(mode)

    def subgraph(self, seeds: DataFrame, limit: int = 6) -> DataFrame:
        return graph.weighted_subgraph(self.papers, self.similar, seeds, limit)

    def related(self, starts: DataFrame, limit: int = 10) -> DataFrame:
        return graph.related_via_topic(self.papers, starts, limit)

    def evaluate(self, questions: DataFrame, relevant: DataFrame, k: int = 5, lam: float = 0.5) -> DataFrame:
        """(qid, recall, ndcg, ndcg_truncated) of papers."""
        found = self.rag(questions).search(lam, 20).join(self.chunks.select(F.col("chunk_id").alias("id"), "paper_id"), "id")
        return metrics.ranking_metrics(fusion.first_occurrences(found, "paper_id").withColumnRenamed("paper_id", "id"), relevant, k)
