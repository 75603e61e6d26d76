"""Chunking, stores, sampling and text functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, sampling
from ..sources import stores
from ..session import table
from . import Registry
from . import sql as S

R = Registry()

_CHUNKS = r"""
WITH p AS (SELECT DISTINCT paper_id, page_number, coalesce(text, '') AS text, char_start, char_end FROM paper_pages),
f AS (SELECT paper_id, string_agg(text, chr(10) ORDER BY page_number) AS t, max(page_number) AS last_page, sum(length(text)) AS letters FROM p GROUP BY 1),
w AS (SELECT paper_id, t, last_page, length(t) AS n, unnest(range(0, length(t), 750)) AS s FROM f WHERE letters >= 120),
e AS (SELECT *, least(s + 900, n) AS full_end, length(regexp_extract(substr(t, least(s + 900, n) - 199, 200), '(?s)^(.*[.!?]\s)', 1)) AS snap FROM w),
c AS (SELECT *, CASE WHEN full_end < n AND snap > 0 THEN full_end - 200 + snap ELSE full_end END AS e FROM e),
k AS (SELECT *, regexp_replace(regexp_replace(substr(t, s + 1, e - s), '^\s+', ''), '\s+$', '') AS text FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY s) - 1 AS chunk_index FROM k WHERE length(text) >= 120),
g AS (SELECT i.paper_id, chunk_index, i.text, s, e, last_page, (SELECT min(page_number) FROM p WHERE p.paper_id = i.paper_id AND p.char_start <= s AND s < p.char_end) AS ps,
  (SELECT min(page_number) FROM p WHERE p.paper_id = i.paper_id AND p.char_start <= greatest(s, e - 1) AND greatest(s, e - 1) < p.char_end) AS pe FROM i)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_pages(table(spark, sf, "paper_pages"))


@R.add(sql=f"{_CHUNKS} SELECT paper_id, chunk_index::INT AS chunk_index, paper_id || '::' || chunk_index AS chunk_id, substr(sha256(text), 1, 16) AS sha256, s::INT AS char_start, e::INT AS char_end, len({S.words('text')})::INT AS n_tokens FROM g")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("paper_id", "chunk_index", "chunk_id", "sha256", "char_start", "char_end", "n_tokens")


@R.add(sql=f"{_CHUNKS} SELECT paper_id, chunk_index::INT AS chunk_index, coalesce(ps, last_page)::INT AS page_start, coalesce(pe, last_page)::INT AS page_end FROM g")
def chunk_page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("paper_id", "chunk_index", "page_start", "page_end")


@R.add(
    sql=r"""WITH p AS (SELECT DISTINCT paper_id, page_number, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM paper_pages)
SELECT paper_id, page_number, (coalesce(sum(length(text) + 1) OVER (PARTITION BY paper_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS char_start, length(text)::INT AS size FROM p"""
)
def page_offsets(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.page_offsets(chunking.distinct_pages(table(spark, sf, "paper_pages")))
    return out.select("paper_id", "page_number", "char_start", (F.col("char_end") - F.col("char_start")).alias("size"))


_REQUEST = "paper_id, title, authors, venue, topic, delivery_id"


@R.add(sql=f"SELECT {_REQUEST} FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY received_at DESC NULLS LAST, delivery_id DESC) rn FROM ingest_requests) WHERE rn = 1")
def doc_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return stores.upsert_latest(table(spark, sf, "ingest_requests").select(*_REQUEST.split(", "), "received_at"), "paper_id", ["received_at", "delivery_id"]).drop("received_at")


_CUT = "2024-03-01 00:00:00"


@R.add(sql=f"WITH i AS (SELECT chunk_id, paper_id, delivery_id FROM chunks WHERE received_at >= TIMESTAMP '{_CUT}'), s AS (SELECT chunk_id, paper_id, delivery_id FROM chunks WHERE received_at < TIMESTAMP '{_CUT}') SELECT * FROM i UNION ALL SELECT * FROM s WHERE paper_id NOT IN (SELECT paper_id FROM i WHERE paper_id IS NOT NULL)")
def chunk_replace(spark: SparkSession, sf: str) -> DataFrame:
    """A later delivery of a paper's chunks replaces what was stored before a day."""
    rows = table(spark, sf, "chunks").select("chunk_id", "paper_id", "delivery_id", "received_at")
    late = F.col("received_at") >= F.lit(_CUT).cast("timestamp")
    return stores.replace_by(rows.where(~late).drop("received_at"), rows.where(late).drop("received_at"), "paper_id")


@R.add(sql="SELECT chunk_id, min(delivery_id) AS delivery_id FROM chunks GROUP BY 1")
def rehydrate_first(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import rehydrated

    return rehydrated(spark, f"{sf}/chunks.parquet", "chunk_id", ["delivery_id"]).kept(["chunk_id", "delivery_id"])


@R.add(sql="SELECT DISTINCT paper_id FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM ingest_requests WHERE paper_id IS NOT NULL)")
def ingest_todo(spark: SparkSession, sf: str) -> DataFrame:
    return stores.missing(table(spark, sf, "papers").select("paper_id").distinct(), table(spark, sf, "ingest_requests"), "paper_id")


@R.add(sql="SELECT v.paper_id, title, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM (SELECT DISTINCT * FROM paper_vectors) v JOIN (SELECT paper_id, min(title) AS title FROM papers GROUP BY 1) USING (paper_id)")
def vectors_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "papers").groupBy("paper_id").agg(F.min("title").alias("title"))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    return stores.with_metadata(table(spark, sf, "paper_vectors").distinct(), one, "paper_id").select("paper_id", "title", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("bigint")).alias("size"), total.alias("total"))


@R.add(sql="SELECT chunk_id, min(paper_id) AS paper_id, min(length(text)) AS n FROM chunks WHERE chunk_id IN (SELECT paper_id || '::0' FROM papers) OR chunk_id IN (SELECT paper_id || '::2' FROM papers) GROUP BY 1")
def chunks_of_list(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "papers").select(F.explode(F.array(F.concat("paper_id", F.lit("::0")), F.concat("paper_id", F.lit("::2")))).alias("chunk_id"))
    found = stores.chosen(table(spark, sf, "chunks"), wanted, "chunk_id")
    return found.groupBy("chunk_id").agg(F.min("paper_id").alias("paper_id"), F.min(F.char_length("text")).cast("bigint").alias("n"))


@R.add(sql="SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7")
def document_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return stores.one(table(spark, sf, "documents"), "doc_id", 7).select("doc_id", "lang", "n_chars")


@R.add(sql="SELECT chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) AS place FROM (SELECT DISTINCT paper_id, chunk_id FROM chunks)")
def chunks_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return stores.ordered(table(spark, sf, "chunks").select("paper_id", "chunk_id").distinct(), "paper_id", "chunk_id").select("chunk_id", "place")


@R.add(
    sql=f"""WITH i AS (SELECT chunk_id, delivery_id, produced_at IS NULL AS late, sha1(from_hex('{T.NAMESPACE.replace("-", "")}') || encode(chunk_id)) AS h FROM chunks),
p AS (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, * FROM i)
SELECT point_id, coalesce(max(delivery_id) FILTER (late), max(delivery_id)) AS payload FROM p GROUP BY 1"""
)
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the chunks, of which those without a time of production come in again and replace the others."""
    rows = table(spark, sf, "chunks").select(T.point_id("chunk_id").alias("point_id"), F.col("delivery_id").alias("payload"), F.col("produced_at").isNull().alias("late"))
    stored, new = (rows.where(c).groupBy("point_id").agg(F.max("payload").alias("payload")) for c in (~F.col("late"), F.col("late")))
    return stores.replace_by(stored, new, "point_id")


@R.add(
    sql="""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), a AS (SELECT doc_id // 4096 AS r1, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM h GROUP BY 1),
b AS (SELECT r1 // 4096 AS r2, sha256(string_agg(h, '' ORDER BY r1)) AS h FROM a GROUP BY 1) SELECT substr(sha256(string_agg(h, '' ORDER BY r2)), 1, 16) AS fingerprint FROM b"""
)
def corpus_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return stores.fingerprint(table(spark, sf, "documents"), "doc_id", "text")


@R.add(
    sql="""WITH f AS (SELECT paper_id, min((topic, doc_id)) AS m FROM documents WHERE topic IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1)
SELECT * FROM (SELECT paper_id, m[1] AS topic, m[2] AS doc_id, row_number() OVER (PARTITION BY m[1] ORDER BY m[2], paper_id) AS place FROM f) WHERE place <= 5"""
)
def scan_first_topic(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("topic IS NOT NULL AND paper_id IS NOT NULL").select("paper_id", "topic", "doc_id")
    return stores.first_topic_wins(rows, "paper_id", "topic", "doc_id", 5)


@R.add(sql="SELECT topic, paper_id, title, place FROM (SELECT topic, paper_id, title, row_number() OVER (PARTITION BY topic ORDER BY paper_id, title, delivery_id) AS place FROM ingest_requests) WHERE place <= 3")
def head_per_topic(spark: SparkSession, sf: str) -> DataFrame:
    return stores.head_per_group(table(spark, sf, "ingest_requests").select("topic", "paper_id", "title", "delivery_id"), "topic", ["paper_id", "title", "delivery_id"], 3).drop("delivery_id")


@R.add(sql="SELECT count(DISTINCT c.paper_id) AS n_docs, count(DISTINCT chunk_id) AS n_chunks, (SELECT count(*) FROM (SELECT DISTINCT paper_id, page_number FROM paper_pages)) AS n_pages FROM chunks c")
def run_record(spark: SparkSession, sf: str) -> DataFrame:
    return stores.run_record(table(spark, sf, "chunks"), table(spark, sf, "paper_pages"))


@R.add(sql="SELECT topic, doc_id, place FROM (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY md5('7:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 6")
def sample_per_topic(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.per_group(table(spark, sf, "documents").select("topic", "doc_id"), "topic", "doc_id", 6)


@R.add(sql="SELECT item_id, CASE WHEN row_number() OVER (ORDER BY substr(md5('42:' || item_id), 1, 13)) <= floor(count(*) OVER () * 0.6) THEN 'train' ELSE 'validation' END AS part FROM gold_qa")
def split_gold(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split(table(spark, sf, "gold_qa").select("item_id"), "item_id", 0.6)


@R.add(sql=f"SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS tokens, len({S.words('text')})::INT AS n_tokens, substr(sha256(coalesce(text, '')), 1, 16) AS sha256 FROM documents")
def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.bm25_tokens("text"), " ").alias("tokens"), T.token_count("text").alias("n_tokens"), T.short_hash("text").alias("sha256"))


@R.add(sql=f"SELECT doc_id, unnest(list_filter({S.sentences('text')}, lambda s: length(s) > 25 AND NOT {S.boilerplate('s')})) AS sentence FROM documents")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(T.answer_sentences("text")).alias("sentence"))


@R.add(sql=rf"SELECT doc_id, unnest(list_transform(list_filter({S.sentences('text')}, lambda s: length(s) > 20), lambda s: regexp_replace(regexp_replace(s, '^[ \[\]0-9]+', ''), '[ \[\]0-9]+$', ''))) AS sentence FROM documents")
def metric_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(T.metric_sentences("text")).alias("sentence"))


@R.add(sql=f"SELECT DISTINCT paper_id, authors, part FROM (SELECT paper_id, authors, regexp_replace(regexp_replace(unnest(string_split(authors, ',')), '^{S.BLANK}', ''), '{S.BLANK}$', '') AS part FROM papers) WHERE part <> ''")
def comma_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Author fields cut at commas alone."""
    return table(spark, sf, "papers").select("paper_id", "authors", F.explode(T.listed("authors")).alias("part")).distinct()


@R.add(sql=f"SELECT item_id, array_to_string(list_sort({S.content('question')}), ' ') AS content FROM gold_qa")
def question_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gold_qa").select("item_id", F.array_join(F.sort_array(T.content_words("question")), " ").alias("content"))


@R.add(sql="SELECT chunk_id, delivery_id, CASE WHEN page_start = page_end THEN 'p.' || page_start ELSE 'pp.' || page_start || '-' || page_end END AS page_range, CASE WHEN length(text) > 280 THEN left(text, 280) || '…' ELSE text END AS snippet, split_part(chunk_id, 'v', 1) AS plain_id FROM chunks")
def citation_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_id", "delivery_id", T.page_range("page_start", "page_end").alias("page_range"), T.snippet("text").alias("snippet"), T.without_version("chunk_id").alias("plain_id"))


#: No page of the test tables cites; this adds a text a paper that cites the first one of its year and one of no year.
CITING = r"""citing AS (SELECT paper_id, text FROM paper_pages UNION ALL SELECT paper_id, 'This builds on arXiv:' || min(paper_id) OVER (PARTITION BY year) || 'v2 and (9999.99999).' FROM (SELECT DISTINCT paper_id, year FROM papers)),
cites AS (SELECT DISTINCT d.paper_id AS src, r AS dst FROM (SELECT paper_id, unnest(regexp_extract_all(text, '\b(\d{4}\.\d{4,5})(?:v\d+)?\b', 1)) AS r FROM citing) d WHERE r IN (SELECT paper_id FROM papers) AND r <> d.paper_id)"""


def citing(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "papers").select("paper_id", "year").distinct()
    first = known.groupBy("year").agg(F.min("paper_id").alias("first"))
    added = known.join(first, known["year"].eqNullSafe(first["year"])).select("paper_id", F.concat(F.lit("This builds on arXiv:"), "first", F.lit("v2 and (9999.99999).")).alias("text"))
    return table(spark, sf, "paper_pages").select("paper_id", "text").unionByName(added)


@R.add(sql=f"WITH {CITING} SELECT * FROM cites")
def cites_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = citing(spark, sf).select(F.col("paper_id").alias("src"), F.explode(T.paper_ids("text")).alias("dst")).where("src <> dst").distinct()
    return found.join(table(spark, sf, "papers").select(F.col("paper_id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


@R.add(sql="SELECT doc_id, topic FROM documents WHERE topic = 'stream adaptation' AND contains(lower(text), lower('Drift'))")
def substring_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where((F.col("topic") == "stream adaptation") & F.contains(F.lower("text"), F.lower(F.lit("Drift")))).select("doc_id", "topic")


@R.add(
    sql=f"""WITH h AS (SELECT delivery_id, sha1(from_hex('{T.NAMESPACE.replace("-", "")}') || encode(chunk_id)) AS h FROM chunks)
SELECT delivery_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h"""
)
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("delivery_id", T.point_id("chunk_id").alias("point_id"))

