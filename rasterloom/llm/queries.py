"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, line_dedup, mixing, ngram_join, pii, simhash, substring_dedup, topk, toxicity
from .bpe import tokenizer_path
from .common import table, write_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out(F.col("_id")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (non-blank, before), n_removed, kept_sha256 of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: line_dedup.trimmed(x) != "")).cast("long")
    out = line_dedup.dedup_lines(docs.withColumn("n_lines", F.coalesce(lines, F.lit(0).cast("long"))), dropped="n_removed")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = write_table(simhash.compare_with_edits(table(spark, sf_dir, "documents")))
    near = simhash.near_copies(rows.select("doc_id", "fingerprint"))
    return rows.join(near, "fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(text) AS hash,
         CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda w: w <> '')) END::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS left_,
                sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_
      FROM w WINDOW o AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(left_::DOUBLE / open_) AS level FROM r WHERE 3 * source_size >= weight * (left_::DOUBLE / open_)),
t AS (SELECT source, source_size, least(3 * source_size::DOUBLE, coalesce(weight * level, 3 * source_size::DOUBLE)) AS target FROM w, l),
z AS (SELECT d.source, d.size, count(*) AS n, floor(sqrt(d.size::DOUBLE))::BIGINT AS g FROM d WHERE size > 0 GROUP BY ALL),
m AS (SELECT z.source, z.size, z.g, t.target, sum(n * size) OVER (PARTITION BY z.source) AS words,
             sum(n * size) OVER u AS words_up, sum(n * size * g) OVER u AS mass_up
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source
      WINDOW u AS (PARTITION BY z.source ORDER BY z.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, (target - 3 * (words - words_up)::DOUBLE) / mass_up::DOUBLE AS c FROM m),
f AS (SELECT source, arg_max(c, size) AS c FROM c WHERE c > 0 AND c * g <= 3 GROUP BY source),
e AS (SELECT d.doc_id, d.source, d.hash, d.size, t.source_size, t.target,
             CASE WHEN d.size = 0 THEN 0.0 ELSE least(3.0, coalesce(f.c * floor(sqrt(d.size::DOUBLE)), 3.0)) END::DOUBLE AS copies
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source),
q AS (SELECT *, floor(copies)::BIGINT AS certain, copies - floor(copies) AS p,
             (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(hash, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM e),
k AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank_,
             target - sum(certain * size) OVER (PARTITION BY source) AS rest FROM q),
x AS (SELECT *, sum(CASE WHEN rank_ IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank_ NULLS LAST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM k)
SELECT doc_id, size, source_size, target,
       ((certain + CASE WHEN rank_ IS NOT NULL AND run - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (certain + CASE WHEN rank_ IS NOT NULL AND run - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM x
"""


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_classes(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the root script, which itself imports operators from here."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pii_skip_chain": op2_pii_skip_chain,
        "op3_line_dedup": op3_line_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_html_text": op5_html_text,
        "op6_simhash": op6_simhash,
        "op7_exact_topk": op7_exact_topk,
        "op8_source_mixing": op8_source_mixing,
        "op9_bpe_roundtrip": op9_bpe_roundtrip,
        "op10_ngram_join": op10_ngram_join,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": OP7_SQL, "op8_source_mixing": OP8_SQL}
