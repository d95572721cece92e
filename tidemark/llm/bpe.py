"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

1. Texts are split by the tokenizer's pattern; each block of documents keeps its pre-tokens as numbers in
   document order and lists its distinct pre-tokens once (``blocks``).
2. The distinct pre-tokens of all blocks meet by hash part; each is merged into token ids once per part (again where
   a part has more than ``KNOWN`` words, so that a task's memory has a bound).
3. The ids go back to their blocks, and every document is put together by position.
4. Decoding joins ids with the token-byte table. Its size is the vocabulary's, never the corpus's, so it is broadcast
   and joined inside each Arrow batch: no row leaves its task for it.

Defined cases: null and empty texts have no tokens; special tokens are ordinary text; repeated rows and equal
ids give a row each; other columns are not read."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm.blocks import blocks, pack, unpack, unpack_ascending, unpack_tokens, unpack_words
from tidemark.llm.common import bound_batches, fields_of_row, partitions, release, whole_row

KNOWN = 1_000_000
LONG = 1 << 22  # characters from which a text's pre-tokens are not held all at once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _encoding(pattern: str, ranks: tuple):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})


def split_text(pattern: str):
    """A function that gives a text's pre-tokens."""
    import regex

    found = regex.compile(pattern)

    def split(text: str | None):
        if not text:
            return ()
        return found.findall(text) if len(text) < LONG else (m.group() for m in found.finditer(text))

    return split


def _by_id(ranks: dict[bytes, int]) -> list[bytes]:
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("token ids must run from 0 without gaps")
    return [piece for _, piece in sorted((rank, piece) for piece, rank in ranks.items())]


def _token_bytes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, where each token's start, how many they are."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size


def _look_up(ids: np.ndarray, doc_ends: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of documents whose ids end at doc_ends."""
    ends = np.concatenate([[0], np.cumsum(size[ids])])
    where = np.repeat(start[ids] - ends[:-1], size[ids]) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(doc_ends) - 1, [None, pa.py_buffer(ends[doc_ends]), pa.py_buffer(data[where])]).cast(pa.binary())


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, round_trip: bool = False) -> DataFrame:
    """Per row of docs: its id, n_tokens, ids (little-endian unsigned 32-bit integers). round_trip adds ``decoded``, what
    ``decode`` gives for the ids, in the same pass: a step of its own would keep a second Python worker in every task."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = parts or 2 * partitions(spark)
    made = blocks(docs, id_col, text_col, split_text(pattern), parts, "bpe-blocks", str.encode)
    vocabulary_ranks = read_ranks(vocabulary)
    ranks = spark.sparkContext.broadcast(tuple(vocabulary_ranks.items()))  # the vocabulary's size
    pieces = spark.sparkContext.broadcast(_by_id(vocabulary_ranks)) if round_trip else None

    def merge(batches):
        coder, held, known = _encoding(pattern, ranks.value), None, {}
        for batch in batches:
            out = []
            for block, part, blob, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != held:
                    held, known = part, {}
                if len(known) >= KNOWN:
                    known = {}
                words = unpack_words(blob)
                for word in words:
                    if word not in known:
                        known[word] = np.array(coder.encode_ordinary(word.decode()), "<u4").tobytes()
                ids = [known[word] for word in words]
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append((block, numbers, pack(counts), pack(np.frombuffer(b"".join(ids), "<u4"))))
                if len(out) >= 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)
        del known
        release()

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "numbers", "counts", "ids"])

    words = made.filter("kind = 1").select("block", "part", "blob", "numbers").repartition(parts, "part").sortWithinPartitions("part")
    merged = words.mapInArrow(merge, "block long, numbers binary, counts binary, ids binary")

    def assemble(chunks: pa.Table, words: pa.Table) -> pa.Table:
        numbers = np.concatenate([np.zeros(0, np.int64), *map(unpack_ascending, words["numbers"].to_pylist())])
        counts = np.concatenate([np.zeros(0, np.uint32), *map(unpack, words["counts"].to_pylist())])
        flat = np.concatenate([np.zeros(0, np.uint32), *map(unpack, words["ids"].to_pylist())])
        size, start = np.zeros(len(numbers), np.int32), np.zeros(len(numbers), np.int64)
        size[numbers] = counts
        start[numbers] = np.cumsum(counts, dtype=np.int64) - counts
        out = []
        for doc_ids, lens, blob in zip(*(chunks[c].to_pylist() for c in ("doc_ids", "lens", "blob")), strict=True):
            tokens = unpack_tokens(blob)
            ends = np.concatenate([[0], np.cumsum(size[tokens], dtype=np.int64)])
            where = np.repeat(start[tokens] - ends[:-1], size[tokens]) + np.arange(ends[-1])
            doc_ends = ends[np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])]
            binary = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(doc_ends * 4), pa.py_buffer(flat[where].astype("<u4"))])
            columns = {"id": pa.array(doc_ids, chunks.schema.field("doc_ids").type.value_type), "n_tokens": np.diff(doc_ends), "ids": binary.cast(pa.binary())}
            if pieces is not None:
                columns["decoded"] = _look_up(flat[where], doc_ends, *_token_bytes(pieces.value))
            out.append(pa.table(columns))
        del numbers, counts, flat, size, start
        release()
        return pa.concat_tables(out)

    chunks = made.filter("kind = 0").select("block", F.col("ids").alias("doc_ids"), "lens", "blob")
    return chunks.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(assemble, f"id {id_type}, n_tokens long, ids binary" + ", decoded binary" * round_trip).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """encoded plus ``decoded`` (which replaces a column of this name), the bytes that the ids stand for; null ids
    decode to null."""
    spark = encoded.sparkSession
    bound_batches(spark)
    pieces = spark.sparkContext.broadcast(_by_id(read_ranks(vocabulary)))

    def look_up(batches):
        table = _token_bytes(pieces.value)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            ids = batch.column(0).field(at_ids)
            full = [x or b"" for x in ids.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in full], dtype=np.int64)])
            decoded = _look_up(np.frombuffer(b"".join(full), "<u4"), ends, *table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.if_else(ids.is_valid(), decoded, None)], names=["row", "decoded"])
        release()

    at_ids = encoded.columns.index(ids_col)
    rows = encoded.select(whole_row(encoded))
    schema = StructType([rows.schema["row"], StructField("decoded", BinaryType())])
    return rows.mapInArrow(look_up, schema).select(*fields_of_row(encoded.columns, ("decoded",)), "decoded")
