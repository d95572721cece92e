"""The registered queries of the corpus operators, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import audit, bpe, decontaminate, exact, forest, jaccard, langid, lines, lm, mixing, negatives, urls, warc
from tidemark.llm.common import table

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_line_dedup(spark, sf_dir):
    cut = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_bpe(spark, sf_dir):
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, round_trip=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark, sf_dir):
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc(spark, sf_dir):
    index = warc.write_bundles(table(spark, sf_dir, "pages"))
    page = F.col("page").cast("long").alias("page_id")
    return warc.read_records(index).select(page, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op7_lm_score(spark, sf_dir):
    scored = lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op8_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op10_url_filter(spark, sf_dir):
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op11_decontamination(spark, sf_dir):
    judged, sets = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = sets.select("item_set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    rows = decontaminate.with_items(judged, named)
    digest = F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


def op13_filter_audit(spark, sf_dir):
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import oracles

    return oracles.SQL
