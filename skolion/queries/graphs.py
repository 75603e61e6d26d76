"""The graph of papers, authors, topics and venues, from the kept ingest requests and paper vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, graph
from ..session import table
from . import Registry
from . import sql as S
from .corpus import CITING, cites_extract
from .records import delivery_log
from .retrieval import _FIRST, paper_ranks

R = Registry()

_R = """r AS (SELECT paper_id, title, authors, venue, nullif(year, 0) AS year, nullif(topic, 'unknown') AS topic FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY received_at, delivery_id) rn FROM ingest_requests) WHERE rn = 1),
wrote AS (SELECT DISTINCT paper_id, author FROM (SELECT paper_id, unnest(string_split(authors, '; ')) AS author FROM r) WHERE author <> '')"""
_E = """v AS (SELECT paper_id AS id, min(embedding)::DOUBLE[] AS v FROM paper_vectors WHERE embedding IS NOT NULL GROUP BY 1 HAVING list_sum(list_transform(min(embedding), lambda x: abs(x))) > 0),
c AS (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.id <> b.id),
e AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM c) WHERE n <= 8 AND score >= 0.30)"""


def papers(spark: SparkSession, sf: str) -> DataFrame:
    kept = delivery_log(spark, sf, "ingest_requests").kept(["paper_id", "title", "authors", "venue", "year", "topic"])
    return kept.select("paper_id", "title", F.split("authors", "; ").alias("authors"), "venue", F.nullif("year", F.lit(0)).alias("year"), F.nullif("topic", F.lit("unknown")).alias("topic"))


def similar(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "paper_vectors").where("embedding IS NOT NULL AND exists(embedding, x -> x <> 0)")
    return dense.similar_edges(v.groupBy(F.col("paper_id").alias("id")).agg(F.min("embedding").alias("embedding")))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that cite parts."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@R.add(sql=f"WITH {_E} SELECT * FROM e")
def similar_to_knn(spark: SparkSession, sf: str) -> DataFrame:
    return similar(spark, sf)


@R.add(
    sql=f"""WITH {_R}, {_E} SELECT 'node' AS what, 'Paper' AS name, count(*) AS n FROM r UNION ALL SELECT 'node', 'Topic', count(DISTINCT topic) FROM r UNION ALL SELECT 'node', 'Venue', count(DISTINCT venue) FROM r
UNION ALL SELECT 'node', 'Author', count(DISTINCT author) FROM wrote UNION ALL SELECT 'edge', 'ABOUT', count(topic) FROM r UNION ALL SELECT 'edge', 'PUBLISHED_IN', count(venue) FROM r UNION ALL SELECT 'edge', 'WROTE', count(*) FROM wrote
UNION ALL SELECT 'edge', 'SIMILAR_TO', count(*) FROM e WHERE src IN (SELECT paper_id FROM r) AND dst IN (SELECT paper_id FROM r)"""
)
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf)
    return graph.stats(graph.nodes(p), graph.edges(p, similar(spark, sf)))


@R.add(sql=f"WITH {_R} SELECT topic, paper_id, title, place FROM (SELECT topic, paper_id, title, row_number() OVER (PARTITION BY topic ORDER BY paper_id, title) AS place FROM r WHERE topic IS NOT NULL) WHERE place <= 10")
def papers_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return graph.listing(papers(spark, sf).where("topic IS NOT NULL").select("topic", "paper_id", "title"), "topic", ["paper_id", "title"], 10)


@R.add(sql=f"WITH {_R} SELECT author, paper_id, place FROM (SELECT author, paper_id, row_number() OVER (PARTITION BY author ORDER BY paper_id) AS place FROM wrote) WHERE place <= 10")
def papers_by_author(spark: SparkSession, sf: str) -> DataFrame:
    return graph.listing(graph.wrote(papers(spark, sf)), "author", ["paper_id"], 10)


@R.add(sql=f"WITH {_R} SELECT a.author, b.author AS coauthor, count(*) AS n FROM wrote a JOIN wrote b USING (paper_id) WHERE a.author <> b.author GROUP BY 1, 2")
def coauthors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.coauthors(papers(spark, sf))


@R.add(sql=f"WITH {_R} SELECT venue, year, paper_id, title FROM r WHERE venue IS NOT NULL AND year >= 2015")
def papers_by_venue_year(spark: SparkSession, sf: str) -> DataFrame:
    return papers(spark, sf).where("venue IS NOT NULL AND year >= 2015").select("venue", "year", "paper_id", "title")


@R.add(
    sql=f"""WITH {_R}, st AS (SELECT DISTINCT p AS start FROM (SELECT unnest(relevant) AS p FROM gold_qa)),
j AS (SELECT start, b.paper_id, b.title, a.topic AS via_topic FROM st JOIN r a ON a.paper_id = start JOIN r b ON b.topic = a.topic WHERE b.paper_id <> start)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY paper_id, title) AS place FROM j) WHERE place <= 10"""
)
def related_via_topic(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "gold_qa").select(F.explode("relevant").alias("paper_id"))
    return graph.related_via_topic(papers(spark, sf), starts)


_SUB = f"""seeds AS (SELECT qid, id AS seed FROM papers_ranked WHERE rank <= 6),
sim AS (SELECT qid, dst AS paper_id, score AS s, 'similar' AS why FROM seeds JOIN e ON src = seed),
tp AS (SELECT s.qid, b.paper_id, 0.5 * count(*) AS s, 'topic' AS why FROM seeds s JOIN r a ON a.paper_id = s.seed JOIN r b ON a.topic = b.topic GROUP BY 1, 2),
au AS (SELECT qid, paper_id, 0.5 * count(*) AS s, 'author' AS why FROM (SELECT DISTINCT s.qid, s.seed, b.paper_id FROM seeds s JOIN wrote a ON a.paper_id = s.seed JOIN wrote b ON a.author = b.author) GROUP BY 1, 2),
u AS (SELECT * FROM sim UNION ALL SELECT * FROM tp UNION ALL SELECT * FROM au),
t AS (SELECT qid, paper_id, round(sum(s), 6) AS score, array_to_string(list_sort(list(DISTINCT why)), '+') AS via FROM u WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.qid = u.qid AND z.seed = u.paper_id) GROUP BY 1, 2),
sub AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, paper_id) AS place FROM t) WHERE place <= 6)"""


def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    seeds = paper_ranks(spark, sf).where("rank <= 6").select("qid", F.col("id").alias("paper_id"))
    return graph.weighted_subgraph(papers(spark, sf), similar(spark, sf), seeds)


@R.add(sql=f"WITH {_R}, {_E}, {S.bm25()}, {_FIRST}, {_SUB} SELECT * FROM sub")
def weighted_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return subgraph(spark, sf)


@R.add(sql=f"WITH {_E} SELECT src, dst, score, place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS place FROM e) WHERE place <= 5")
def semantic_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph.listing(similar(spark, sf), "src", [F.desc("score"), "dst"], 5)


@R.add(sql=f"WITH {_E} SELECT a.src, b.dst, round(max(a.score * b.score), 6) AS score FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM e d WHERE d.src = a.src AND d.dst = b.dst) GROUP BY 1, 2")
def two_hop_similar(spark: SparkSession, sf: str) -> DataFrame:
    return graph.two_hop(similar(spark, sf))


@R.add(
    sql="""WITH c AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), p AS (SELECT a.dst AS start, b.dst AS other, count(*) AS n FROM c a JOIN c b USING (src) WHERE a.dst % 20 = 0 AND a.dst <> b.dst GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, other) AS place FROM p) WHERE place <= 10"""
)
def co_citation(spark: SparkSession, sf: str) -> DataFrame:
    """Parts ordered together, for every part whose key is divisible by 20, against all."""
    return graph.co_citation(lines(spark, sf), table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id")))


@R.add(
    sql=f"""WITH RECURSIVE {_R}, s AS (SELECT min(author) AS a FROM wrote), b(author, hops) AS (SELECT a, 0 FROM s UNION SELECT y.author, hops + 1 FROM b JOIN wrote x ON x.author = b.author JOIN wrote y ON y.paper_id = x.paper_id WHERE hops < 12)
SELECT author, min(hops) AS hops FROM b GROUP BY 1"""
)
def collab_path(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf)
    first = graph.wrote(p).agg(F.min("author")).collect()[0][0]
    return graph.hops_from(p, first).select("author", "hops")


def _ranks(iterations: int, source: str = "e") -> str:
    steps = ", ".join(
        f"r{i} AS MATERIALIZED (SELECT i.id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + l.lost / n) AS rank FROM ids i CROSS JOIN nn CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM sh)) l"
        f" LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r{i - 1} JOIN sh ON src = id GROUP BY 1) g ON g.dst = i.id)" for i in range(1, iterations + 1))  # fmt: skip
    return f"sh AS (SELECT src, dst, score / sum(score) OVER (PARTITION BY src) AS share FROM {source}), ids AS (SELECT src AS id FROM {source} UNION SELECT dst FROM {source}), nn AS (SELECT count(*) AS n FROM ids), r0 AS (SELECT id, 1.0 / n AS rank FROM ids, nn), {steps}"


@R.add(sql=f"WITH {_E}, {_ranks(20)} SELECT id, round(rank, 6) AS rank FROM r20")
def pagerank_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(similar(spark, sf).select("src", "dst", F.col("score").alias("weight")), 20, tolerance=0).select("id", F.round("rank", 6).alias("rank"))


_BOTH = "both_ AS (SELECT src, dst, sum(score) AS score FROM (SELECT * FROM e UNION ALL SELECT src, dst, 1.0 FROM cites) GROUP BY 1, 2)"


@R.add(sql=f"WITH {_E}, {CITING}, {_BOTH}, {_ranks(20, 'both_')} SELECT id, round(rank, 6) AS rank FROM r20")
def pagerank_cites(spark: SparkSession, sf: str) -> DataFrame:
    """Over similarity and citations, a citation of weight 1."""
    cited = cites_extract(spark, sf).select("src", "dst", F.lit(1.0).alias("weight"))
    both = similar(spark, sf).select("src", "dst", F.col("score").alias("weight")).unionByName(cited)
    return graph.pagerank(both, 20, tolerance=0).select("id", F.round("rank", 6).alias("rank"))
