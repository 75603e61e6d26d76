"""Reranking by marginal relevance, extractive answers and groundedness, a bounded list of candidates a query."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import spread
from .dense import hash_vector

if TYPE_CHECKING:
    import pandas as pd


def mmr_order(question: np.ndarray, vectors: list[np.ndarray | None], prior: list[float], k: int, weight: float = 0.7, prior_weight: float = 0.15) -> list[tuple[int, float]]:
    """(place, relevance) of the k picked candidates: each maximises weight * relevance less the rest times the
    largest cosine to those picked. Candidates without a vector have their prior only and no penalty; the first
    of equal ones wins."""
    unit = [None if v is None or not np.any(v) else np.asarray(v, float) / np.linalg.norm(v) for v in vectors]
    q = question / np.linalg.norm(question) if np.any(question) else question
    rel = [prior_weight * p + (0.0 if u is None else float(q @ u)) for u, p in zip(unit, prior)]
    picked: list[int] = []
    left = list(range(len(vectors)))
    while left and len(picked) < k:
        def gain(i: int) -> float:
            near = [float(unit[i] @ unit[j]) for j in picked if unit[i] is not None and unit[j] is not None]
            return round(weight * rel[i] - (1 - weight) * max(near, default=0.0), 12)

        best = max(left, key=lambda i: (gain(i), -i))
        picked.append(best)
        left.remove(best)
    return [(i, round(rel[i], 6)) for i in picked]


def mmr(candidates: DataFrame, k: int, weight: float = 0.7, prior_weight: float = 0.15) -> DataFrame:
    """(qid, id, score, rank) out of (qid, question ARRAY, id, rank, embedding ARRAY, prior).

    Candidates are a bounded list a query, gathered in the order of their rank.
    """
    kinds = dict(candidates.dtypes)
    rows = candidates.groupBy("qid").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", "id", "embedding", F.coalesce("prior", F.lit(0.0)).alias("prior")))).alias("c"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            out = []
            for qid, question, cands in zip(b["qid"], b["question"], b["c"]):
                order = mmr_order(np.asarray(question, float), [c["embedding"] for c in cands], [c["prior"] for c in cands], k, weight, prior_weight)
                out += [(qid, cands[i]["id"], s, r + 1) for r, (i, s) in enumerate(order)]
            yield pd.DataFrame(out, columns=["qid", "id", "score", "rank"])

    return spread(rows).mapInPandas(pick, f"qid {kinds['qid']}, id {kinds['id']}, score double, rank int")


#: What is told where nothing was retrieved.
NOTHING = "No relevant passage was retrieved."


def overlaps(contexts: DataFrame) -> DataFrame:
    """(qid, id, rank, pos, sentence, overlap) of every quotable sentence of (qid, question, id, rank, text) that
    shares a word of content with the question."""
    s = contexts.select("qid", "id", "rank", T.content_words("question").alias("asked"), F.posexplode(T.answer_sentences("text")).alias("pos", "sentence"))
    return s.select("qid", "id", "rank", "pos", "sentence", F.size(F.array_intersect("asked", T.content_words("sentence"))).alias("overlap")).where("overlap > 0")


def compose(sentences: list, most: int = 4, per_source: int = 2) -> tuple[str, list]:
    """Text with citation marks, and the sources in order of first mention.

    sentences: (rank, pos, id, sentence, overlap), any order. The best by overlap + 1 / rank are taken, no text
    twice and at most per_source of a source; they are told in the order of their ranks.
    """
    order = sorted(sentences, key=lambda s: (-(s[4] + 1.0 / s[0]), s[0], s[1]))
    picked, used, said = [], {}, set()
    for s in order:
        if len(picked) == most:
            break
        if s[3] in said or used.get(s[2], 0) >= per_source:
            continue
        used[s[2]] = used.get(s[2], 0) + 1
        said.add(s[3])
        picked.append(s)
    sources: list = []
    out = []
    for s in sorted(picked, key=lambda s: s[0]):
        if s[2] not in sources:
            sources.append(s[2])
        out.append(f"{s[3]} [{sources.index(s[2]) + 1}]")
    return " ".join(out), sources


def extractive(contexts: DataFrame) -> DataFrame:
    """(qid, answer, sources) from (qid, question, id, rank, text), a bounded list of contexts a query.

    Where nothing overlaps, the first context's first two sentences or 240 characters stand with mark 1. Queries
    without contexts aren't listed.
    """
    kinds = dict(contexts.dtypes)
    marks = overlaps(contexts).groupBy("qid").agg(F.collect_list(F.struct("rank", "pos", "id", "sentence", "overlap")).alias("s"))
    lead = F.when(F.size(T.answer_sentences("text")) > 0, F.array_join(F.slice(T.answer_sentences("text"), 1, 2), " ")).otherwise(F.substring("text", 1, 240))
    first = contexts.groupBy("qid").agg(F.min_by(F.struct(F.col("id").alias("id"), lead.alias("lead")), "rank").alias("first"))
    rows = first.join(marks, "qid", "left").select("qid", "first", "s")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            out = []
            for qid, top, s in zip(b["qid"], b["first"], b["s"]):
                found = [(x["rank"], x["pos"], x["id"], x["sentence"], x["overlap"]) for x in s] if s is not None else []
                text, sources = compose(found) if found else (f"{top['lead']} [1]", [top["id"]])
                out.append((qid, text, sources))
            yield pd.DataFrame(out, columns=["qid", "answer", "sources"])

    return rows.mapInPandas(write, f"qid {kinds['qid']}, answer string, sources array<{kinds['id']}>")


def text_similarity(rows: DataFrame, key: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """key and, for every name of pairs, the cosine of the hash embeddings of two text columns."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            out = {key: b[key]}
            for name, (x, y) in pairs.items():
                out[name] = [round(float(hash_vector(s) @ hash_vector(t)), 6) for s, t in zip(b[x], b[y])]
            yield pd.DataFrame(out)

    columns = sorted({c for p in pairs.values() for c in p} | {key})
    return rows.select(*columns).mapInPandas(measure, f"`{key}` {dict(rows.dtypes)[key]}, " + ", ".join(f"{n} double" for n in pairs))


def faithfulness(answers: DataFrame, contexts: DataFrame, least: float = 0.60) -> DataFrame:
    """(qid, n_sentences, faithfulness): share of answer sentences that come near one of the query's contexts.

    answers (qid, answer), contexts (qid, text): a bounded list a query. Answers without sentences have 0.
    """
    told = answers.select("qid", T.metric_sentences("answer").alias("s"))
    given = contexts.groupBy("qid").agg(F.collect_list("text").alias("c"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            out = []
            for qid, s, c in zip(b["qid"], b["s"], b["c"]):
                m = np.array([hash_vector(t) for t in c]) if c is not None and len(c) else np.zeros((1, 384))
                near = [round(float((m @ hash_vector(x)).max()), 6) >= least for x in s]
                out.append((qid, len(near), round(sum(near) / len(near), 6) if near else 0.0))
            yield pd.DataFrame(out, columns=["qid", "n_sentences", "faithfulness"])

    return told.join(given, "qid", "left").select("qid", "s", "c").mapInPandas(judge, f"qid {dict(answers.dtypes)['qid']}, n_sentences int, faithfulness double")
