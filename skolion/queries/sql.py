"""Pieces of SQL that the twins of several queries share. DuckDB's regular expressions know no look-behind."""

from __future__ import annotations

from ..functions import text as T

BLANK = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"


def tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({c}, '')), '{BLANK}'), lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]+$') OR contains(x, '-'))"


def words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{BLANK}'), lambda x: x <> '')"


def terms(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"


def sentences(c: str) -> str:
    """Trimmed sentences of a text."""
    return rf"list_transform(string_split(regexp_replace(replace(coalesce({c}, ''), chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^{BLANK}', ''), '{BLANK}$', ''))"


def boilerplate(x: str) -> str:
    w = words(x)
    return rf"(contains({x}, '@') OR regexp_matches({x}, 'https?://') OR len({w}) < 4 OR len(list_filter({w}, lambda y: regexp_matches(y, '^\p{{Lu}}'))) / len({w}) > 0.6)"


def content(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.CONTENT_STOP)
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z][a-z0-9-]+'), lambda w: length(w) > 2 AND w NOT IN ({stop})))"


def top(scores: str, k: int, query: str = "qid", key: str = "id") -> str:
    """Best k rows of (query, key, score)."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, {key}) AS rank FROM {scores}) WHERE rank <= {k}"


def bm25(docs: str = "documents", key: str = "doc_id", text: str = "text", queries: str = "gold_qa", qid: str = "item_id", question: str = "question") -> str:
    """CTEs ending in bm25(qid, id, score)."""
    return f"""
d AS (SELECT {key} AS id, {tokens(text)} AS toks FROM {docs}),
n AS (SELECT count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS mean_len FROM d),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, n),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT qid, term, count(*) AS m FROM (SELECT {qid} AS qid, unnest({tokens(question)}) AS term FROM {queries}) GROUP BY 1, 2),
bm25 AS (SELECT qid, id, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / mean_len))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN d USING (id), n GROUP BY 1, 2)"""


def hashed(name: str, rows: str, key: str, text: str) -> str:
    """A CTE name(key, bucket, w): the sparse hash embedding, and its helpers."""
    half = lambda a: f"('0x' || substr(md5(t), {a}, 16))::UBIGINT"
    return f"""
{name}_t AS (SELECT {key} AS id, unnest({words(f"lower({text})")}) AS t FROM {rows}),
{name}_b AS (SELECT id, ((({half(1)} % 384) * 256 + {half(17)} % 384) % 384)::INT AS bucket, count(*) AS n FROM {name}_t GROUP BY 1, 2),
{name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}_b)"""


def minmax(source: str, low: str | None = None) -> str:
    lo, hi = "min(score) OVER (PARTITION BY qid)", "max(score) OVER (PARTITION BY qid)"
    if low is not None:
        lo, hi = f"least({lo}, {low})", f"greatest({hi}, {low})"
    return f"SELECT qid, id, CASE WHEN {hi} - {lo} < 1e-12 THEN 0.0 ELSE (score - {lo}) / ({hi} - {lo}) END AS score FROM {source}"


def fuse(a: str, b: str, lam: str) -> str:
    return f"SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round({lam} * coalesce(a.score, 0) + (1 - {lam}) * coalesce(b.score, 0), 6) AS score FROM {a} a FULL JOIN {b} b ON a.qid = b.qid AND a.id = b.id"
