"""Provenance and injection filtering of passages, and signals of an attack in answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def trusted(papers: DataFrame, poisoned: list[str]) -> DataFrame:
    """Ids of known papers without the poisoned ones."""
    return papers.select("paper_id").distinct().where(~F.col("paper_id").isin(poisoned))


def judged(passages: DataFrame, sources: DataFrame, stored: DataFrame | None = None, scrub: bool = True) -> DataFrame:
    """Passages (chunk_id, paper_id, text) with a reason to drop them, null for none.

    A passage of an unknown source, or one that the chunk store lacks, is untrusted; injections are looked for in
    trusted passages only. A null source is unknown.
    """
    known = sources.select("paper_id").distinct().withColumn("known", F.lit(True))
    rows = passages.join(known, "paper_id", "left")
    ok = F.col("known").isNotNull()
    if stored is not None:
        rows = rows.join(stored.select("chunk_id").distinct().withColumn("present", F.lit(True)), "chunk_id", "left")
        ok = ok & F.col("present").isNotNull()
    reason = F.when(~ok, F.lit("untrusted_source"))
    if scrub:
        reason = reason.when(T.injected("text"), F.lit("injection_pattern"))
    return rows.withColumn("reason", reason).select(*passages.columns, "reason")


def dropped(judgement: DataFrame) -> DataFrame:
    """(chunk_id, reason) of the passages that a filter drops."""
    return judgement.where("reason IS NOT NULL").select("chunk_id", "reason")


def report(judgement: DataFrame) -> DataFrame:
    """(n_in, n_kept, n_dropped) of a filter."""
    return judgement.agg(F.count("*").alias("n_in"), F.count_if(F.col("reason").isNull()).alias("n_kept"), F.count_if(F.col("reason").isNotNull()).alias("n_dropped"))


def attack_signals(answers: DataFrame, poison: str, markers: list[str]) -> DataFrame:
    """answers (qid, retrieved, citations, answer, contexts): whether a poisoned paper or a marker shows up."""
    said = F.lower(F.concat_ws(" ", "answer", F.array_join("contexts", " ")))
    marked = F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(said, m))
    return answers.select("qid", F.array_contains("retrieved", poison).alias("retrieved"), F.array_contains("citations", poison).alias("cited"), marked.alias("marked"))
