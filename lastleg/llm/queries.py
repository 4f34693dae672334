"""The operators over the driver's tables, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lastleg.llm import byte_bpe, html_text, media, near_dedup, packing, quality, substrings, token_counts, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), width=13, with_text=False)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def queries() -> dict[str, Query]:
    made = (op1_media_columns, op2_substring_dedup, op3_minhash_near_dedup, op4_exact_topk, op5_token_counts, op6_html_extraction, op7_packing, op8_toxicity, op9_quality_classifier, op10_byte_bpe)
    return {f.__name__: f for f in made}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, s, hash(w[s:s + 12]) AS h, sha256(array_to_string(w[s:s + 12], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
first AS (SELECT h, k, min(doc_id) AS f FROM win GROUP BY h, k),
flag AS (SELECT doc_id, s FROM win JOIN first USING (h, k) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM flag, (SELECT unnest(range(0, 13)) AS i)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, x FROM (
         SELECT doc_id, w[s] || ' ' || w[s + 1] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS s FROM d)
         UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT x, b FROM reach JOIN both_ways ON y = a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(y) AS component_id, d.doc_id = min(y) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON x = d.doc_id GROUP BY d.doc_id, n.n
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# The driver's pages have one article each, whose blocks are h1 and p, and use these references only.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(replace(x, '<br>', ' '), '</?(?:p|h1)>') AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(
        replace(replace(replace(replace(replace(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '&amp;?', chr(1), 'g'),
          '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), chr(1), '&'), '\s+', ' ', 'g'))) AS parts FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda p: p <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_minhash_near_dedup": OP3_SQL, "op4_exact_topk": OP4_SQL, "op6_html_extraction": OP6_SQL}
