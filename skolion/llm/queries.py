"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries import Registry
from ..queries.records import author_values
from ..session import table
from . import leakage, names, packing, residue, scans, similar, splitting

R = Registry()


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = author_values(table(spark, sf_dir, "papers")).select(F.col("item_value").alias("name"))
    requests = table(spark, sf_dir, "ingest_requests").select(F.explode(F.split("authors", "; ")).alias("name"))
    return names.entities(packed.unionByName(requests))


@R.add()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(_entities(spark, sf_dir))


@R.add()
def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)


@R.add()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noisy_records(table(spark, sf_dir, "paper_pages"), table(spark, sf_dir, "chunks"))


@R.add()
def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "paper_pages"), table(spark, sf_dir, "chunks"))


@R.add(sql="SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 900")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "chunks")).select("chunk_id").distinct()


@R.add()
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = splitting.pieces(table(spark, sf_dir, "chunks"))
    return splitting.located(parts, table(spark, sf_dir, "paper_pages"))


@R.add(
    sql=r"""
WITH f AS (SELECT paper_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page_number) AS t FROM (SELECT DISTINCT paper_id, page_number, text FROM paper_pages) GROUP BY paper_id),
c AS (SELECT chunk_id, paper_id, arg_min(text, (received_at, delivery_id)) AS text, arg_min(char_start, (received_at, delivery_id)) AS cs FROM chunks WHERE length(text) > 900 GROUP BY chunk_id, paper_id),
l AS (SELECT chunk_id, c.paper_id, cs + length(regexp_extract(substr(t, (cs + 1)::BIGINT), '^[\s\p{Z}]*')) AS char_start, length(text) AS n FROM c JOIN f USING (paper_id)),
p AS (SELECT DISTINCT paper_id, page_number, char_start AS lo, char_end AS hi FROM paper_pages WHERE char_end > char_start)
SELECT chunk_id, l.char_start::INT AS char_start, (l.char_start + n)::INT AS char_end, min(a.page_number) AS page_start, min(b.page_number) AS page_end
FROM l LEFT JOIN p a ON a.paper_id = l.paper_id AND l.char_start >= a.lo AND l.char_start < a.hi
LEFT JOIN p b ON b.paper_id = l.paper_id AND l.char_start + n - 1 BETWEEN b.lo AND b.hi GROUP BY chunk_id, l.char_start, n"""
)
def p4_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pieces of every oversized chunk begin and end in its paper."""
    found = p4_pieces(spark, sf_dir)
    return found.groupBy("chunk_id").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min_by("page_start", "piece_no").alias("page_start"), F.max_by("page_end", "piece_no").alias("page_end"))


@R.add(
    sql="""
WITH v AS (SELECT paper_id, min(embedding)::DOUBLE[] AS e FROM paper_vectors WHERE embedding IS NOT NULL GROUP BY paper_id),
u AS (SELECT paper_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v WHERE list_sum(list_transform(e, lambda x: abs(x))) > 0),
s AS (SELECT a.paper_id AS a, b.paper_id AS b, round(list_inner_product(a.e, b.e), 12) AS c FROM u a JOIN u b ON a.paper_id <> b.paper_id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s)
SELECT DISTINCT least(a, b) AS paper_a, greatest(a, b) AS paper_b FROM r WHERE n <= 8"""
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(similar.neighbours(table(spark, sf_dir, "paper_vectors")))


@R.add(
    sql="""
SELECT count(DISTINCT paper_id) AS papers, true AS reached
FROM paper_vectors WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0"""
)
def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search through many small leaves against the comparison of all vectors with all."""
    vectors = table(spark, sf_dir, "paper_vectors")
    config = similar.SearchConfig(leaf=24, sample=64)
    found, exact = (similar.neighbours(vectors, config=c).select("paper_id", "neighbour", F.lit(1).alias(name)) for c, name in ((config, "found"), (similar.SearchConfig(leaf=1 << 30), "true")))
    each = exact.join(found, ["paper_id", "neighbour"], "left")
    return each.agg(F.count_distinct("paper_id").alias("papers"), (F.sum("found") >= 0.95 * F.sum("true")).alias("reached"))


@R.add()
def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def _words(column: str) -> str:
    # this engine's \s knows ASCII blanks only
    plain = f"regexp_replace({column}, '[\u00a0\u2000-\u200a\u202f\u3000]', ' ', 'g')"
    joined = rf"regexp_replace({plain}, '([\p{{L}}\p{{N}}_])[-\x{{2010}}\x{{2011}}\x{{2013}}¬\x{{00ad}}]\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return rf"list_filter(string_split_regex(regexp_replace(lower({joined}), '[^\p{{L}}\p{{N}}\s]+', '', 'g'), '\s+'), lambda x: x <> '')"


def _windows(key: str, source: str, column: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS p FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {_words(column)} AS w FROM {source}))"


@R.add(
    sql=f"""
WITH d AS ({_windows("doc_id", "documents", "text")}),
q AS ({_windows("item_id", "gold_qa", "question")} UNION {_windows("item_id", "gold_qa", "reference_answer")})
SELECT DISTINCT doc_id, item_id FROM d JOIN q USING (p)"""
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "gold_qa"))


@R.add()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))
