"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.llm.common import prepare, table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.topk import exact_topk
    return exact_topk(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 100 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.decontaminate import contained_items
    return contained_items(table(spark, sf_dir, "documents", "doc_id", "text"),
                           table(spark, sf_dir, "benchmark", "item_id", "text")).drop("key")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.jaccard_join import linked_components
    return linked_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.toxicity import score
    return score(table(spark, sf_dir, "documents", "doc_id", "text"),
                 table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.katz import score
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.html_text import extract
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.pii import report, sanitise
    return report(sanitise(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.langid import identify
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.warc import archive_round_trip
    return archive_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def bpe_digests(docs: DataFrame, **cache) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 with the multilingual byte-level ranks."""
    import public_tokenizers

    from marketlens.llm.bpe import encode
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, **cache)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.dialogue import repair
    return repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.lexical import ranked
    return ranked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.repeats import without_repeats
    out = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


OPERATORS = (op1_exact_topk, op2_decontamination, op3_jaccard_join, op4_toxicity, op5_katz_lm, op6_html_extraction, op7_pii,
             op8_language_id, op9_warc, op10_byte_bpe, op11_conversation_repair, op12_lexical_search, op13_repeated_bytes)


def _ready(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    return run


def queries() -> dict:
    return {fn.__name__: _ready(fn) for fn in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from marketlens.llm import decontaminate, lexical, repeats
    return {"op1_exact_topk": OP1_SQL, "op2_decontamination": decontaminate.SQL, "op12_lexical_search": lexical.SQL,
            "op13_repeated_bytes": repeats.SQL}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
