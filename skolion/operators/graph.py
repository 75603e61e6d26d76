"""A property graph as two tables, and its queries as joins.

papers: one row a paper with paper_id, title, authors (a list column), venue, year, topic. Edges are
(src_kind, src, rel, dst_kind, dst, score). All queries take sets of starting points at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def wrote(papers: DataFrame) -> DataFrame:
    """(author, paper_id), distinct."""
    return papers.select("paper_id", F.explode("authors").alias("author")).where(F.col("author") != "").distinct()


def nodes(papers: DataFrame) -> DataFrame:
    one = lambda kind, c: papers.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")).where("key IS NOT NULL AND key <> ''").distinct()
    authors = wrote(papers).select(F.lit("Author").alias("kind"), F.col("author").alias("key")).distinct()
    return one("Paper", "paper_id").unionByName(one("Topic", "topic")).unionByName(one("Venue", "venue")).unionByName(authors)


def edges(papers: DataFrame, similar: DataFrame | None = None, cites: DataFrame | None = None) -> DataFrame:
    """All relations of the papers; similar (src, dst, score) and cites (src, dst) only between known papers."""
    none = F.lit(None).cast("double")

    def to(rel: str, kind: str, column: str) -> DataFrame:
        rows = papers.where(F.col(column).isNotNull() & (F.col(column) != ""))
        return rows.select(F.lit("Paper").alias("src_kind"), F.col("paper_id").alias("src"), F.lit(rel).alias("rel"), F.lit(kind).alias("dst_kind"), F.col(column).alias("dst"), none.alias("score"))

    out = to("ABOUT", "Topic", "topic").unionByName(to("PUBLISHED_IN", "Venue", "venue"))
    out = out.unionByName(wrote(papers).select(F.lit("Author").alias("src_kind"), F.col("author").alias("src"), F.lit("WROTE").alias("rel"), F.lit("Paper").alias("dst_kind"), F.col("paper_id").alias("dst"), none.alias("score")))
    known = papers.select("paper_id")
    for rel, rows in (("SIMILAR_TO", similar), ("CITES", cites)):
        if rows is not None:
            inside = rows.join(known.withColumnRenamed("paper_id", "src"), "src", "left_semi").join(known.withColumnRenamed("paper_id", "dst"), "dst", "left_semi")
            score = F.col("score") if "score" in rows.columns else none
            out = out.unionByName(inside.select(F.lit("Paper").alias("src_kind"), "src", F.lit(rel).alias("rel"), F.lit("Paper").alias("dst_kind"), "dst", score.alias("score")))
    return out


def stats(n: DataFrame, e: DataFrame) -> DataFrame:
    """(what, name, n): nodes by kind and edges by relation."""
    return n.groupBy(F.col("kind").alias("name")).count().select(F.lit("node").alias("what"), "name", F.col("count").alias("n")).unionByName(
        e.groupBy(F.col("rel").alias("name")).count().select(F.lit("edge").alias("what"), "name", F.col("count").alias("n")))


def listing(rows: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= limit)


def coauthors(papers: DataFrame) -> DataFrame:
    """(author, coauthor, n): papers written together. Pairs arise within papers only, never within an author."""
    w = wrote(papers)
    pairs = w.join(w.withColumnRenamed("author", "coauthor"), "paper_id").where("author <> coauthor")
    return pairs.groupBy("author", "coauthor").agg(F.count("*").alias("n"))


def related_via_topic(papers: DataFrame, starts: DataFrame, limit: int = 10) -> DataFrame:
    """(start, paper_id, title, via_topic, place): the first papers of a start's topic, without itself.

    Each topic's first limit + 1 papers are enough for any start, so a topic is never joined with itself.
    """
    first = listing(papers.where("topic IS NOT NULL").select("topic", "paper_id", "title"), "topic", ["paper_id", "title"], limit + 1).drop("place")
    asked = starts.select(F.col("paper_id").alias("start")).distinct().join(papers.select(F.col("paper_id").alias("start"), "topic"), "start")
    near = asked.join(first, "topic").where("start <> paper_id").withColumnRenamed("topic", "via_topic")
    return listing(near, "start", ["paper_id", "title"], limit)


def weighted_subgraph(papers: DataFrame, similar: DataFrame, seeds: DataFrame, limit: int = 6, w_similar: float = 1.0, w_topic: float = 0.5, w_author: float = 0.5) -> DataFrame:
    """(qid, paper_id, score, via, place): papers next to each query's seeds (qid, paper_id).

    Every seed adds its similarity edge, a share for the same topic and one for a common author. Seeds are
    counted by topic and author before they meet the papers.
    """
    seeds = materialise(seeds.select("qid", F.col("paper_id").alias("seed")).distinct())
    sim = seeds.join(similar.withColumnRenamed("src", "seed"), "seed").select("qid", F.col("dst").alias("paper_id"), (w_similar * F.col("score")).alias("s"), F.lit("similar").alias("why"))
    papers = materialise(papers.select("paper_id", "authors", "topic"))
    topics = papers.where("topic IS NOT NULL AND topic <> ''").select("paper_id", "topic")
    by_topic = seeds.join(topics.withColumnRenamed("paper_id", "seed"), "seed").groupBy("qid", "topic").agg((F.count("*") * w_topic).alias("s"))
    w = wrote(papers)
    shared = seeds.join(w.withColumnRenamed("paper_id", "seed"), "seed").join(w, "author").select("qid", "seed", "paper_id").distinct()
    author = shared.groupBy("qid", "paper_id").agg((F.count("*") * w_author).alias("s")).select("qid", "paper_id", "s", F.lit("author").alias("why"))
    # of the papers that only share a topic, as many as could be listed, first by id, stand for a topic; the others
    # get their topic's share where they are met anyway
    near = materialise(sim.unionByName(author))
    most = limit + (seeds.groupBy("qid").count().agg(F.max("count")).first()[0] or 0)
    head = listing(topics.distinct(), "topic", ["paper_id"], most).select("topic", "paper_id")
    met = near.select("qid", "paper_id").distinct().join(topics.distinct(), "paper_id").join(by_topic, ["qid", "topic"]).select("qid", "paper_id", "topic", "s")
    topic = by_topic.join(head, "topic").select("qid", "paper_id", "topic", "s").unionByName(met).distinct().select("qid", "paper_id", "s", F.lit("topic").alias("why"))
    every = near.unionByName(topic).join(seeds.withColumnRenamed("seed", "paper_id"), ["qid", "paper_id"], "left_anti")
    total = every.groupBy("qid", "paper_id").agg(F.round(F.sum("s"), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("why")), "+").alias("via"))
    return listing(total, "qid", [F.desc("score"), "paper_id"], limit)


def two_hop(similar: DataFrame) -> DataFrame:
    """(src, dst, score): the strongest path of two edges to a paper that isn't next to src itself."""
    a, b = similar.select("src", F.col("dst").alias("mid"), F.col("score").alias("s1")), similar.select(F.col("src").alias("mid"), "dst", F.col("score").alias("s2"))
    far = a.join(b, "mid").where("src <> dst").join(similar.select("src", "dst"), ["src", "dst"], "left_anti")
    return far.groupBy("src", "dst").agg(F.round(F.max(F.col("s1") * F.col("s2")), 6).alias("score"))


def co_citation(cites: DataFrame, starts: DataFrame, limit: int = 10) -> DataFrame:
    """(start, other, n, place): what the citers of a start also cite, counted per edge."""
    asked = cites.join(starts.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("start"), "src")
    both = asked.join(cites.withColumnRenamed("dst", "other"), "src").where("start <> other")
    return listing(both.groupBy("start", "other").agg(F.count("*").alias("n")), "start", [F.desc("n"), "other"], limit)


def hops_from(papers: DataFrame, start: str, most: int | None = None, goal: str | None = None) -> DataFrame:
    """(author, hops, path): fewest shared papers between an author and any other, with a goal the row of that one
    alone, or none. Steps end when nobody new is reached, or at `most` papers.

    path is the smallest of the shortest ones. Every step joins the frontier only; it is written out each time,
    so lineage doesn't grow and a lost executor costs one step.
    """
    w = materialise(wrote(papers))
    seen = w.where(F.col("author") == start).select("author").distinct().withColumn("hops", F.lit(0)).withColumn("path", F.col("author"))
    seen = frontier = materialise(seen)
    hop = 0
    while most is None or hop < most:
        if goal is not None and not (met := seen.where(F.col("author") == goal)).isEmpty():
            return met
        hop += 1
        on = frontier.join(w, "author").select("paper_id", "path").groupBy("paper_id").agg(F.min("path").alias("path"))
        new = on.join(w, "paper_id").groupBy("author").agg(F.min(F.concat_ws(" > ", "path", "paper_id")).alias("path")).join(seen.select("author"), "author", "left_anti")
        frontier = materialise(new.select("author", F.lit(hop).alias("hops"), F.concat_ws(" > ", "path", "author").alias("path")))
        if frontier.isEmpty():
            break
        seen = materialise(seen.unionByName(frontier))
    return seen if goal is None else seen.where(F.col("author") == goal)


def pagerank(weighted: DataFrame, iterations: int = 100, damping: float = 0.85, keep: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank) over (src, dst, weight); parallel edges add up, nodes without out-edges give to all alike.

    Only nodes with an edge have a rank. Lineage is cut every `keep` iterations; they end there once the last one
    has changed ranks by less than `tolerance` a node in all, and after `iterations` at the latest.
    """
    e = materialise(weighted.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    e = materialise(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    ids = materialise(ids.join(out.select(F.col("src").alias("id"), F.lit(True).alias("gives")), "id", "left"))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    ranks = ids.select("id", "gives", F.lit(1.0 / n).alias("rank"))
    for i in range(iterations):
        lost = ranks.where("gives IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        got = ranks.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        ranks = ranks.join(got, F.col("id") == F.col("to"), "left").crossJoin(F.broadcast(lost)).select("id", "gives", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
        if (i + 1) % keep == 0:
            ranks = materialise(ranks)
            if tolerance and ranks.agg(F.sum("change")).first()[0] < tolerance * n:
                break
    return ranks.select("id", "rank")
