"""Test questions made from a collection: broad ones, ones with a term, and titles, a row a relevant paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .sampling import per_group


def gold_set(corpus: DataFrame, broad: DataFrame, terms: DataFrame, titles: int = 6, seed: int = 7) -> DataFrame:
    """(topic, query_type, query, id), each once: which papers answer which question.

    corpus (id, topic, title, text), any number of rows a paper; broad (topic, query), answered by every paper of the
    topic; terms (topic, term), answered by those whose text mentions the term, in any case. A term that nothing
    mentions gives no question. titles: papers of each topic, drawn by hash, whose title without its connecting words
    is a question that they alone answer. Null topics and ids take no part, null texts mention nothing.
    """
    rows = corpus.where("topic IS NOT NULL AND id IS NOT NULL")
    asked = rows.select("topic", "id").distinct().join(broad, "topic").select("topic", F.lit("broad").alias("query_type"), "query", "id")
    said = rows.join(terms, "topic").where(F.contains(F.lower("text"), F.lower("term")))
    said = said.select("topic", F.lit("targeted").alias("query_type"), F.concat("term", F.lit(" "), F.replace("topic", F.lit("_"), F.lit(" "))).alias("query"), "id")
    named = rows.groupBy("topic", "id").agg(F.min("title").alias("title"))
    drawn = per_group(named, "topic", "id", titles, seed).select("topic", F.lit("title").alias("query_type"), T.title_query("title").alias("query"), "id")
    return asked.unionByName(said).unionByName(drawn).distinct()
