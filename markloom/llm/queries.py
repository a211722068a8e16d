"""The queries of the corpus operators: thin digests over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fmindex, lines, minhash, packing, quality, rules, topk, warc


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file: under $MARKLOOM_TOKENIZERS, or in the installed package."""
    if folder := os.environ.get("MARKLOOM_TOKENIZERS"):
        return str(Path(folder, name))
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.dedup_digest(table(spark, sf_dir, "documents"), 50)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts of all conversations, parsed without a look at the role column."""
    out = chat.canonical_turns(chat.raw_transcripts(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", F.get("line_roles", F.lit(0)).alias("first_role"), F.size("line_roles").cast("long").alias("n_lines"), F.size("turn_starts").cast("long").alias("n_starts"), "rendered")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), 0).drop("payload", "url")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), 2048)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.3)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_digest(table(spark, sf_dir, "documents"), 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_top_k, op2_substring_dedup, op3_chat_formatting, op4_warc, op5_quality_rules, op6_circulant_minhash, op7_best_fit_packing, op8_bpe, op9_quality_classifier, op10_line_dedup)}
SQL: dict[str, str] = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op10_line_dedup": r"""
WITH line AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
two AS (SELECT a.doc_id, a.o, a.x AS x, b.x AS y FROM line a JOIN line b ON a.doc_id = b.doc_id AND b.o = a.o + 1),
late AS (SELECT doc_id, o FROM (SELECT doc_id, o, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, o) AS r FROM two) WHERE r > 1),
gone AS (SELECT doc_id, o FROM late UNION SELECT doc_id, o + 1 FROM late),
gone_i AS (SELECT doc_id, i FROM gone JOIN line USING (doc_id, o)),
every AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
kept AS (SELECT e.doc_id, string_agg(e.x, chr(10) ORDER BY e.i) AS text FROM every e ANTI JOIN gone_i g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM line GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS r FROM gone GROUP BY 1) USING (doc_id)
""",
}
