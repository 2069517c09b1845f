"""One query per training-data operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import language_model, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, repeats, tokens, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_token_counts(spark, sf_dir):
    return tokens.length_histogram(documents(spark, sf_dir))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keeper AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM f GROUP BY 1
""")
def op2_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ \t\n\v\f\r]+', 'x', 'g'), '[ \t\n\v\f\r]+', '', 'g')) AS size,
    -ln((('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / (1 / (1 + (20 * (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))))::DOUBLE / greatest(length(text), 1))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2 * source_size::DOUBLE AS full_size FROM s),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(full_size, coalesce((SELECT level FROM v WHERE level * weight <= full_size ORDER BY full_size / weight, source NULLS LAST LIMIT 1) * weight, full_size)) AS target FROM v),
p AS (SELECT d.*, source_size, target, round(target)::BIGINT // greatest(source_size, 1) AS epochs, round(target)::BIGINT % greatest(source_size, 1) AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM p
""")
def op8_mixing(spark, sf_dir):
    return mixing.allot(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op9_quality_rules(spark, sf_dir):
    return quality_rules.verdicts(documents(spark, sf_dir))


@query()
def op3_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query("""
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op4_exact_topk(spark, sf_dir):
    vectors = topk.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query()
def op7_ngram_join(spark, sf_dir):
    return ngram_join.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query()
def op6_language_model(spark, sf_dir):
    return language_model.score_all(documents(spark, sf_dir))


@query()
def op5_repeats(spark, sf_dir):
    found = repeats.remove_repeats(documents(spark, sf_dir), with_kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
