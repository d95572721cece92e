"""The corpus pipeline: from raw documents to token ids, stage by stage.

Every stage works on all rows that the stage before kept and returns the columns of ``documents``, the last one
the encoded rows. Stages are written as Parquet in between, so a lost executor repeats one stage's tasks at most."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact, jaccard, langid, mixing
from tidemark.llm.common import table, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: without text or a letter, or, by the cross-parse, in none of the languages that
    labelled documents teach. Names the language of unlabelled documents, and corrects labels that the prediction
    contradicts clearly. Where no document is labelled, documents with letters stay as they are.

    Null ids, repeated rows and ties make no difference; an empty text counts as without a letter; very long texts are
    parsed whole; further columns, whatever their names, pass unread; no documents give none."""
    return langid.keep_known_languages(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text, the one with the largest id.

    Null and empty texts are one text; a null id ranks below every other; rows that agree in id and text stay once;
    further columns, whatever their names, pass unread; no documents give none."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8, the one with the smallest id.

    Null, empty and blank texts link with nothing and stay; a shorter text is one shingle; rows with equal ids share a
    verdict, and rows without an id stay; further columns, whatever their names, pass unread; no documents give none."""
    return jaccard.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights, no document more than three times.

    Null and empty texts have no words and appear as often as the certain copies of their source; a null source is a
    source, the last one; rows with equal ids and sources appear as often as the most repeated of them; the draw depends
    on ids alone, so reruns agree; further columns, whatever their names, pass unread; no documents give none."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit integers), and digests of ids and of the text
    they decode to.

    Null and empty texts have no tokens; a row of the result for each row, whatever its id; very long texts are encoded
    whole; further columns are not read; no documents give none."""
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, round_trip=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("bpe", encode)]

#: Language identification is not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
