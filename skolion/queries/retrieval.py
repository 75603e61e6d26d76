"""Lexical, dense and hybrid retrieval over the documents, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import dense, fusion, gold, metrics
from ..operators.lexical import Bm25, TfIdf, best
from ..session import materialise, table
from . import Registry
from . import sql as S

R = Registry()
K, POOL, LAMBDA = 10, 100, 0.5


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gold_qa")


def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return Bm25(docs(spark, sf), "doc_id", "text").scores(questions(spark, sf), "item_id", "question")


def dense_pool(spark: SparkSession, sf: str, k: int = POOL) -> DataFrame:
    rows = dense.hash_embed(docs(spark, sf), "doc_id", "text").withColumnRenamed("doc_id", "id")
    asked = dense.hash_embed(questions(spark, sf), "item_id", "question").withColumnRenamed("item_id", "qid")
    return dense.dense_topk(rows, asked, k, exclude_self=False)


_HASHED = S.hashed("dv", "documents", "doc_id", "text") + "," + S.hashed("qv", "gold_qa", "item_id", "question")
# every pair needs a score, so absent buckets count as 0
_DENSE = f"""{_HASHED},
shared AS (SELECT q.id AS qid, d.id, sum(q.w * d.w) AS s FROM qv q JOIN dv d USING (bucket) GROUP BY 1, 2),
dense AS (SELECT q.item_id AS qid, d.doc_id AS id, round(coalesce(s, 0), 6) AS score FROM gold_qa q CROSS JOIN documents d LEFT JOIN shared s ON s.qid = q.item_id AND s.id = d.doc_id)"""


@R.add(sql=f"WITH {S.bm25()} {S.top('bm25', K)}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return best(bm25_scores(spark, sf), K)


@R.add(sql=f"WITH {S.bm25()} SELECT term, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    return Bm25(docs(spark, sf), "doc_id", "text").idf().select("term", F.round("idf", 6).alias("idf"))


def _tfidf(name: str, rows: str, key: str, text: str) -> str:
    return f"""
{name}_t AS (SELECT {key} AS id, {S.terms(text)} AS t FROM {rows}),
{name}_g AS (SELECT id, unnest(t) AS term FROM {name}_t UNION ALL SELECT id, t[i] || ' ' || t[i + 1] FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM {name}_t)),
{name}_f AS (SELECT id, term, count(*) AS tf FROM {name}_g GROUP BY 1, 2)"""


_TFIDF = f"""{_tfidf("d", "documents", "doc_id", "text")}, {_tfidf("q", "gold_qa", "item_id", "question")},
n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM d_f GROUP BY 1),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n WHERE df <= 0.95 * n),
dw AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM d_f JOIN idf USING (term)),
qw AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM q_f JOIN idf USING (term)),
s AS (SELECT q.id AS qid, d.id, round(sum(q.w * d.w), 6) AS score FROM qw q JOIN dw d USING (term) GROUP BY 1, 2)"""


@R.add(sql=f"WITH {_TFIDF} {S.top('s', K)}")
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return best(TfIdf(docs(spark, sf), "doc_id", "text").scores(questions(spark, sf), "item_id", "question"), K)


@R.add()
def latent_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of the manifest in 16 latent dimensions; sizes only, as signs are free."""
    papers = table(spark, sf, "papers").groupBy("paper_id").agg(F.min("title").alias("title"))
    out = dense.svd_projection(TfIdf(papers, "paper_id", "title").weights(), 16)
    return out.select("id", F.round(V.norm(F.col("embedding")), 6).alias("size"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _dense_query(metric: str, expression: str):
    sql = f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id AS qid, b.id, round({expression}, 6) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0) {S.top('s', K)}"""

    @R.add(sql=sql, name=f"dense_{metric}_topk")
    def query(spark: SparkSession, sf: str) -> DataFrame:
        v = _vectors(spark, sf)
        return dense.dense_topk(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding"), K, metric)

    return query


_dense_query("cosine", "list_cosine_similarity(a.v, b.v)")
_dense_query("dot", "list_inner_product(a.v, b.v)")
_dense_query("euclidean", "-list_distance(a.v, b.v)")


@R.add(sql="SELECT vec_id, round(list_inner_product(u, u), 6) AS size, round(list_sum(u), 6) AS total FROM (SELECT vec_id, list_transform(v, lambda x: coalesce(x / nullif(sqrt(list_inner_product(v, v)), 0), 0)) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    u = dense.normalised_vectors(table(spark, sf, "embeddings"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return u.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("size"), F.round(total, 6).alias("total"))


@R.add(sql=f"WITH {S.hashed('qv', 'gold_qa', 'item_id', 'question')} SELECT id AS item_id, bucket, round(w, 6) AS weight FROM qv")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return dense.hash_weights(questions(spark, sf), "item_id", "question")


@R.add(sql=f"WITH {_DENSE} {S.top('dense', K)}")
def hashed_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense_pool(spark, sf, K)


@R.add(sql=f"WITH {S.bm25()}, m AS ({S.minmax('bm25')}) SELECT qid, id, round(score, 6) AS score FROM m")
def minmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.minmax(bm25_scores(spark, sf)).select("qid", "id", F.round("score", 6).alias("score"))


_POOLS_OF = f"""{S.bm25()}, {_DENSE}, lp AS (SELECT qid, id, score FROM ({S.top('{0}', POOL)}) WHERE score > 0), dp AS (SELECT qid, id, score FROM ({S.top('{1}', POOL)})),
lm AS ({S.minmax('lp')}), dm AS ({S.minmax('dp')})"""
_POOLS = _POOLS_OF.replace("{0}", "bm25").replace("{1}", "dense")


@R.add(sql=f"WITH {_POOLS}, f AS ({S.fuse('lm', 'dm', '0.5')}) {S.top('f', K)}")
def hybrid_pool(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.hybrid_pool(bm25_scores(spark, sf), dense_pool(spark, sf), LAMBDA, POOL, K)


@R.add(sql=f"WITH {S.bm25()}, {_DENSE}, lm AS ({S.minmax('bm25', '0')}), dm AS ({S.minmax('dense')}), f AS ({S.fuse('lm', 'dm', '0.3944')}) {S.top('f', K)}")
def hybrid_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = dense.hash_embed(docs(spark, sf), "doc_id", "text").withColumnRenamed("doc_id", "id")
    asked = dense.hash_embed(questions(spark, sf), "item_id", "question").withColumnRenamed("item_id", "qid")
    lexical = materialise(bm25_scores(spark, sf))
    every, ranges = dense.dense_over(rows, asked, lexical.select("qid", "id"), 4 * K)
    return fusion.hybrid_full(lexical, every, ranges, 0.3944, K)


_ALLOWED = "allowed AS (SELECT DISTINCT item_id AS qid, doc_id AS id FROM (SELECT item_id, unnest(relevant) AS paper_id FROM gold_qa) JOIN documents USING (paper_id))"


def _pin(source: str, name: str) -> str:
    return f"{name} AS (SELECT s.* FROM {source} s WHERE s.qid NOT IN (SELECT qid FROM allowed) OR EXISTS (SELECT 1 FROM allowed a WHERE a.qid = s.qid AND a.id = s.id))"


@R.add(sql=f"WITH {_ALLOWED}, {S.bm25()}, {_DENSE}, {_pin('bm25', 'bp')}, {_pin('dense', 'dq')}, lp AS (SELECT qid, id, score FROM ({S.top('bp', POOL)}) WHERE score > 0), dp AS (SELECT qid, id, score FROM ({S.top('dq', POOL)})), lm AS ({S.minmax('lp')}), dm AS ({S.minmax('dp')}), f AS ({S.fuse('lm', 'dm', '0.5')}) {S.top('f', K)}")
def hybrid_pinned(spark: SparkSession, sf: str) -> DataFrame:
    """Both pools are restricted to the documents of the item's papers, before they are cut."""
    every, allowed = _dense_of_allowed(spark, sf)
    return fusion.hybrid_pool(fusion.pinned(bm25_scores(spark, sf), allowed), fusion.pinned(every, allowed), LAMBDA, POOL, K)


def _dense_of_allowed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asked_of = questions(spark, sf)
    allowed = metrics.relevance(asked_of, "item_id", "relevant").withColumnRenamed("id", "paper_id").join(docs(spark, sf).select("doc_id", "paper_id"), "paper_id").select("qid", F.col("doc_id").alias("id")).distinct()
    rows = dense.hash_embed(docs(spark, sf), "doc_id", "text").withColumnRenamed("doc_id", "id")
    asked = dense.hash_embed(asked_of, "item_id", "question").withColumnRenamed("item_id", "qid")
    allowed = materialise(allowed)
    return dense.dense_over(rows, asked, allowed, POOL)[0], allowed


@R.add(sql=f"WITH {_ALLOWED}, {_POOLS_OF.replace('{0}', 'bm25').replace('{1}', 'dq')}, f AS ({S.fuse('lm', 'dm', '0.5')}) {S.top('f', K)}".replace("dp AS (", _pin("dense", "dq") + ", dp AS (", 1))
def hybrid_pinned_dense(spark: SparkSession, sf: str) -> DataFrame:
    """As the second layer pins: the dense pool alone is restricted, the lexical one isn't."""
    every, allowed = _dense_of_allowed(spark, sf)
    return fusion.hybrid_pool(bm25_scores(spark, sf), fusion.pinned(every, allowed), LAMBDA, POOL, K)


_FIRST = f"""fr AS ({S.top('bm25', POOL)}), pf AS (SELECT qid, paper_id, min(rank) AS first FROM fr JOIN documents ON id = doc_id WHERE paper_id IS NOT NULL GROUP BY 1, 2),
papers_ranked AS (SELECT qid, paper_id AS id, row_number() OVER (PARTITION BY qid ORDER BY first, paper_id) AS rank FROM pf)"""


def _papers_of(ranked: DataFrame, d: DataFrame) -> DataFrame:
    with_paper = ranked.join(d.select(F.col("doc_id").alias("id"), "paper_id"), "id").where("paper_id IS NOT NULL")
    return fusion.first_occurrences(with_paper, "paper_id").withColumnRenamed("paper_id", "id")


@R.add(sql=f"WITH {S.bm25()}, {_FIRST} SELECT qid, id AS paper_id, rank FROM papers_ranked")
def dedupe_first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return _papers_of(best(bm25_scores(spark, sf), POOL), docs(spark, sf)).withColumnRenamed("id", "paper_id")


_RELEVANT = "rel AS (SELECT DISTINCT item_id AS qid, id FROM (SELECT item_id, unnest(relevant) AS id FROM gold_qa) WHERE id IN (SELECT paper_id FROM papers))"
_METRICS = """sz AS (SELECT qid, count(*) AS n FROM rel GROUP BY 1),
h AS (SELECT r.qid, count(*) AS hits, sum(1 / log2(p.rank + 1)) AS gain FROM ranked p JOIN rel r ON r.qid = p.qid AND r.id = p.id WHERE p.rank <= 5 GROUP BY 1),
g AS (SELECT qid, count(*) AS got FROM ranked WHERE rank <= 5 GROUP BY 1),
m AS (SELECT qid, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg,
  round(CASE WHEN least(n, coalesce(got, 0), 5) > 0 THEN coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, coalesce(got, 0), 5) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_truncated
  FROM sz LEFT JOIN h USING (qid) LEFT JOIN g USING (qid))"""


def paper_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _papers_of(best(bm25_scores(spark, sf), POOL), docs(spark, sf))


def gold_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.relevance(questions(spark, sf), "item_id", "relevant", table(spark, sf, "papers"))


@R.add(sql=f"WITH {S.bm25()}, {_FIRST}, {_RELEVANT}, ranked AS (SELECT * FROM papers_ranked), {_METRICS} SELECT * FROM m")
def recall_ndcg_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ranking_metrics(paper_ranks(spark, sf), gold_relevance(spark, sf), 5)


@R.add(
    sql=f"""WITH {S.bm25()}, {_FIRST}, {_RELEVANT}, ranked AS (SELECT * FROM papers_ranked), {_METRICS}, t AS (SELECT m.*, query_type FROM m JOIN gold_qa ON qid = item_id)
SELECT query_type, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(quantile_cont(ndcg, 0.95), 6) AS p95, grouping(query_type) AS overall FROM t GROUP BY GROUPING SETS ((query_type), ())"""
)
def recall_ndcg_by_type(spark: SparkSession, sf: str) -> DataFrame:
    per = recall_ndcg_per_query(spark, sf).join(questions(spark, sf).select(F.col("item_id").alias("qid"), "query_type"), "qid")
    return metrics.summary(per, "query_type", ["recall", "ndcg"])


LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0)
_LAM = ", ".join(f"({x})" for x in LAMBDAS)


@R.add(
    sql=f"""WITH {_POOLS}, {_RELEVANT}, lam AS (SELECT * FROM (VALUES {_LAM}) v(lam)),
f AS (SELECT lam, qid, id, round(lam * a + (1 - lam) * b, 6) AS score FROM (SELECT coalesce(l.qid, e.qid) AS qid, coalesce(l.id, e.id) AS id, coalesce(l.score, 0) AS a, coalesce(e.score, 0) AS b FROM lm l FULL JOIN dm e ON l.qid = e.qid AND l.id = e.id), lam),
t AS (SELECT *, row_number() OVER (PARTITION BY lam, qid ORDER BY score DESC, id) AS rank FROM f),
pf AS (SELECT lam, qid, paper_id, min(rank) AS first FROM t JOIN documents ON id = doc_id WHERE paper_id IS NOT NULL GROUP BY 1, 2, 3),
pr AS (SELECT lam, qid, paper_id AS id, row_number() OVER (PARTITION BY lam, qid ORDER BY first, paper_id) AS rank FROM pf),
sz AS (SELECT qid, count(*) AS n FROM rel GROUP BY 1), h AS (SELECT lam, r.qid, count(*) AS hits FROM pr p JOIN rel r ON r.qid = p.qid AND r.id = p.id WHERE p.rank <= 5 GROUP BY 1, 2)
SELECT lam.lam::DOUBLE AS lam, round(avg(coalesce(hits, 0) / n), 6) AS recall FROM sz CROSS JOIN lam LEFT JOIN h ON h.qid = sz.qid AND h.lam = lam.lam GROUP BY 1"""
)
def lambda_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of papers at 5 for every mixing weight, all weights in one job."""
    lex = fusion.minmax(best(bm25_scores(spark, sf), POOL).where("score > 0").drop("rank")).select("qid", "id", F.col("score").alias("a"))
    den = fusion.minmax(dense_pool(spark, sf).drop("rank")).select("qid", "id", F.col("score").alias("b"))
    zero = F.lit(0.0)
    both = lex.join(den, ["qid", "id"], "full_outer").select("qid", "id", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"), F.explode(F.array(*[F.lit(x) for x in LAMBDAS])).alias("lam"))
    fused = both.select(F.struct("lam", "qid").alias("qid"), "id", F.round(F.col("lam") * F.col("a") + (1 - F.col("lam")) * F.col("b"), 6).alias("score"))
    ranked = _papers_of(best(fused, 2 * POOL), docs(spark, sf)).select("qid.lam", "qid.qid", "id", "rank")
    rel = gold_relevance(spark, sf)
    sizes = rel.groupBy("qid").agg(F.count("*").alias("n")).withColumn("lam", F.explode(F.array(*[F.lit(x) for x in LAMBDAS])))
    hits = ranked.where("rank <= 5").join(rel, ["qid", "id"]).groupBy("lam", "qid").agg(F.count("*").alias("hits"))
    return sizes.join(hits, ["lam", "qid"], "left").groupBy("lam").agg(F.round(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")), 6).alias("recall"))


@R.add(sql=f"WITH {_RELEVANT} SELECT qid, array_to_string(list_sort(list(id)), ' ') AS relevant FROM rel GROUP BY qid")
def relevance_in_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return gold_relevance(spark, sf).groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list("id")), " ").alias("relevant"))


def _one_paper() -> str:
    return "(SELECT paper_id, min(title) AS title, min(venue) AS venue, min(year) AS year FROM papers GROUP BY 1)"


_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOP)


@R.add(sql=f"SELECT paper_id, array_to_string(list_filter({S.words('lower(title)')}, lambda w: w NOT IN ({_STOP})), ' ') AS query FROM {_one_paper()}")
def gold_title_queries(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "papers").groupBy("paper_id").agg(F.min("title").alias("title"))
    return one.select("paper_id", T.title_query("title").alias("query"))


_TARGETS = ("drift", "retrieval", "policy")
_TOPIC_TERMS = " UNION ALL ".join(f"SELECT topic, '{t}' AS term, doc_id FROM documents WHERE topic IS NOT NULL AND contains(lower(text), '{t}')" for t in _TARGETS)


@R.add(sql=_TOPIC_TERMS)
def gold_targeted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each topic that mention a term, a row each; a term no document of a topic has gives none."""
    d = docs(spark, sf).where("topic IS NOT NULL").select("topic", "doc_id", F.explode(F.array(*[F.lit(t) for t in _TARGETS])).alias("term"), F.lower("text").alias("low"))
    return d.where(F.contains("low", F.col("term"))).select("topic", "term", "doc_id")


@R.add(
    sql=f"""WITH c AS (SELECT paper_id AS id, topic, lower(text) AS t, title FROM documents JOIN {_one_paper()} USING (paper_id) WHERE topic IS NOT NULL),
tm AS (SELECT DISTINCT topic, term FROM (SELECT topic, unnest(string_split(topic, ' ')) AS term FROM c) WHERE length(term) > 3),
tt AS (SELECT topic, id, min(title) AS title, row_number() OVER (PARTITION BY topic ORDER BY md5('7:' || id), id) AS n FROM c GROUP BY 1, 2)
SELECT DISTINCT topic, 'broad' AS query_type, 'recent work on ' || topic AS query, id FROM c UNION ALL SELECT DISTINCT topic, 'targeted', term || ' ' || topic, id FROM c JOIN tm USING (topic) WHERE contains(t, term)
UNION ALL SELECT topic, 'title', array_to_string(list_filter({S.words('lower(title)')}, lambda w: w NOT IN ({_STOP})), ' '), id FROM tt WHERE n <= 6"""
)
def gold_set(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about every topic of the documents: one broad one, one for each longer word of its name, six titles."""
    one = table(spark, sf, "papers").groupBy("paper_id").agg(F.min("title").alias("title"))
    corpus = docs(spark, sf).join(one, "paper_id").select(F.col("paper_id").alias("id"), "topic", "title", "text")
    topics = corpus.select("topic").where("topic IS NOT NULL").distinct()
    terms = topics.select("topic", F.explode(F.split("topic", " ")).alias("term")).where(F.length("term") > 3).distinct()
    return gold.gold_set(corpus, topics.select("topic", F.concat(F.lit("recent work on "), "topic").alias("query")), terms)


@R.add(sql="SELECT topic, query_type, count(*) AS n FROM gold_qa GROUP BY 1, 2")
def gold_counts(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).groupBy("topic", "query_type").agg(F.count("*").alias("n"))


@R.add(
    sql=f"""WITH ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY received_at, delivery_id) rn FROM chunks) WHERE rn = 1), {S.bm25('ck', 'chunk_id')}, t AS ({S.top('bm25', 5)}), p AS (SELECT paper_id, min(title) AS title FROM papers GROUP BY 1),
m AS (SELECT t.qid, t.rank, t.score, t.id AS chunk_id, coalesce(c.paper_id, '?') AS paper_id, coalesce(p.title, c.paper_id, '?') AS title, coalesce(page_start, 0) AS a, coalesce(page_end, page_start, 0) AS b, text FROM t JOIN ck c ON c.chunk_id = t.id LEFT JOIN p ON p.paper_id = c.paper_id),
g AS (SELECT *, CASE WHEN a = b THEN 'p.' || a ELSE 'pp.' || a || '-' || b END AS page_range FROM m)
SELECT qid, rank, chunk_id, paper_id, title, score, page_range, CASE WHEN length(text) > 280 THEN left(text, 280) || '…' ELSE text END AS snippet, title || ' (' || paper_id || '), ' || page_range AS label FROM g"""
)
def batch_search(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of the best chunks for every question: lexical pool over chunks, joined with their papers."""
    hits = Bm25(chunk_table(spark, sf), "chunk_id", "text").top(questions(spark, sf), "item_id", "question", 5, ["paper_id", "page_start", "page_end", "text"])
    return fusion.cited(hits, table(spark, sf, "papers").groupBy("paper_id").agg(F.min("title").alias("title")))


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    from .records import delivery_log

    return delivery_log(spark, sf, "chunks").kept(["chunk_id", "paper_id", "text", "page_start", "page_end"], apart=True)



_GRID = [(w, p) for w in LAMBDAS for p in (20, 100)]


@R.add(
    sql=f"""WITH {S.bm25()}, {_DENSE}, cfg AS (SELECT * FROM (VALUES {", ".join(f"({i}, {w}::DOUBLE, {p})" for i, (w, p) in enumerate(_GRID))}) v(trial, lam, pool)), {_RELEVANT},
rd AS (SELECT DISTINCT qid, doc_id AS id FROM rel JOIN documents ON paper_id = id), lr AS (SELECT * FROM ({S.top('bm25', POOL)}) WHERE score > 0), dr AS ({S.top('dense', POOL)}),
a AS (SELECT trial, qid, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM lr, cfg WHERE rank <= pool WINDOW w AS (PARTITION BY trial, qid)),
b AS (SELECT trial, qid, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM dr, cfg WHERE rank <= pool WINDOW w AS (PARTITION BY trial, qid)),
fz AS (SELECT trial, qid, id, round(lam * coalesce(a.s, 0) + (1 - lam) * coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b USING (trial, qid, id) JOIN cfg USING (trial)),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial, qid ORDER BY score DESC, id) AS rank FROM fz) WHERE rank <= 5),
g AS (SELECT trial, qid, sum(1 / log2(rank + 1)) AS gain FROM rk JOIN rd USING (qid, id) GROUP BY 1, 2), sz AS (SELECT qid, count(*) AS n FROM rd GROUP BY 1),
nd AS (SELECT trial, qid, round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM sz CROSS JOIN cfg LEFT JOIN g USING (trial, qid)),
o AS (SELECT trial, round(avg(ndcg), 6) AS objective FROM nd GROUP BY 1)
SELECT trial, lam, pool, objective, max(objective) OVER (ORDER BY trial) AS best_so_far FROM cfg JOIN o USING (trial)"""
)
def settings_search(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of mixing weights and pool sizes by mean NDCG over the documents of relevant papers."""
    from ..plans import tuning

    d = docs(spark, sf)
    rel = gold_relevance(spark, sf).withColumnRenamed("id", "paper_id").join(d.select("doc_id", "paper_id"), "paper_id").select("qid", F.col("doc_id").alias("id")).distinct()
    lex = best(bm25_scores(spark, sf), POOL).where("score > 0")
    return tuning.trials(lex, dense_pool(spark, sf), tuning.grid(spark, list(LAMBDAS), [20, 100]), rel)


@R.add(
    sql="""WITH f AS (SELECT paper_id, posn, avg(x) AS x FROM (SELECT paper_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS posn FROM paper_vectors WHERE embedding IS NOT NULL) GROUP BY 1, 2)
SELECT paper_id, round(sqrt(sum(x * x)), 6) AS size, round(sum(x), 6) AS total FROM f GROUP BY 1"""
)
def paper_meanpool(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of every paper over its rows, by its length and sum."""
    pooled = dense.mean_pool(table(spark, sf, "paper_vectors"), "paper_id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return pooled.select("paper_id", F.round(V.norm(F.col("embedding")), 6).alias("size"), F.round(total, 6).alias("total"))
