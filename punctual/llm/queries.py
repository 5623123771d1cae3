"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import (op1_projected_neighbours, op2_secrets, op3_sharding, op4_packing, op5_near_duplicates, op6_language_id,
                          op7_pivot_search, op8_token_files, op9_html, op10_transducer_bpe, op11_ranked_search, op12_pii,
                          op13_source_audit)
from punctual.llm.common import documents
from punctual.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


@query("op1_projected_neighbours")
def projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return op1_projected_neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query("op2_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secrets.secret_spans(documents(spark, sf_dir))


@query("op3_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_sharding.shard(read_table(spark, sf_dir, "documents"))


@query("op4_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_near_duplicates.near_duplicates(documents(spark, sf_dir))


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_language_id.identify(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


TOP_PRODUCTS_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op7_pivot_search", TOP_PRODUCTS_SQL)
def pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return op7_pivot_search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query("op8_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_token_files.token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_html")
def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_html.main_text(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


@query("op10_transducer_bpe")
def transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_transducer_bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


RANKED_SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
     x AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
     total AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(n) AS BIGINT) AS n_words FROM x),
     q AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
     o AS (SELECT doc_id, n, unnest(w) AS term FROM x),
     p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM o SEMI JOIN q USING (term) GROUP BY ALL),
     t AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
           FROM p, total GROUP BY term),
     s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // n_words)))) AS BIGINT) AS score
           FROM q JOIN p USING (term) JOIN t USING (term), total GROUP BY item_id, doc_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


@query("op11_ranked_search", RANKED_SEARCH_SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_ranked_search.search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


@query("op12_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_pii.personal_data(documents(spark, sf_dir))


SOURCE_AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
     kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 10),
     c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
     g AS (SELECT d.lang, d.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) d
           LEFT JOIN c USING (lang, source) GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.v) AS p,
                  1 + 1000000000 * (k.n + 2) // (v.total + 2 * v.v) AS q
           FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               WHERE a.lang NOT IN (SELECT lang FROM v)),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
     a AS (SELECT * FROM pairs UNION ALL SELECT * FROM every UNION ALL SELECT * FROM terms),
     r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


@query("op13_source_audit", SOURCE_AUDIT_SQL)
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_source_audit.divergence(read_table(spark, sf_dir, "documents", ["lang", "source", "text"]))
