"""Blocks: a task's documents as numbers into a small vocabulary of their own.

Splitting 100 TB into words and shuffling every occurrence costs several times the corpus. Instead each task
numbers the distinct words of a block of its documents in order of appearance and writes two kinds of rows:

* kind 0, *tokens*: up to about ``CHUNK`` word numbers in document order, with the documents' ids and lengths;
* kind 1, *words*: the block's words that fall into hash part ``part``, with their numbers.

Both are compressed. The rows go to a table in the shared folder, so every text is split once and a lost
executor costs no more than the rows it was making. The table is bucketed by block: what comes back to a block
meets its tokens without shuffling them again. A block is bounded in tokens and in words; a document is never
divided."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, new_path, partitions, release

CHUNK, BLOCK_TOKENS, BLOCK_WORDS = 1 << 18, 2 << 20, 300_000


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_ascending(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers.astype(np.int64), prepend=0))


def unpack_ascending(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.int64)


def pack_tokens(numbers: np.ndarray, known: int) -> bytes:
    """Word numbers in order of first appearance, after ``known`` words: a first appearance is written as 0."""
    numbers = numbers.astype(np.int64)
    top = np.maximum.accumulate(np.concatenate([[known - 1], numbers]))
    return known.to_bytes(4, "little") + pack(np.where(numbers > top[:-1], 0, numbers + 1))


def unpack_tokens(blob: bytes) -> np.ndarray:
    numbers = unpack(blob[4:]).astype(np.int64) - 1
    new = numbers < 0
    numbers[new] = int.from_bytes(blob[:4], "little") + np.arange(int(new.sum()))
    return numbers


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = [4 * (n + 1), *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


class _Block:
    def __init__(self, parts: int, id_type: pa.DataType, most: int):
        self.parts, self.id_type, self.most, self.serial = parts, id_type, most, 0
        self.clear()

    def clear(self) -> None:
        self.numbers: dict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.tokens = 0
        self.clear_chunk()

    def clear_chunk(self) -> None:
        self.ids, self.lens, self.arrays, self.held, self.known = [], [], [], 0, len(self.numbers)

    def add(self, doc_id, words: Iterator) -> None:
        n, words = 0, iter(words)
        while piece := list(islice(words, CHUNK)):
            self.arrays.append(np.fromiter(map(self.numbers.__getitem__, piece), np.uint32, len(piece)))
            n += len(piece)
        self.ids.append(doc_id)
        self.lens.append(n)
        self.held += n
        self.tokens += n

    @property
    def full(self) -> bool:
        return self.tokens >= self.most or len(self.numbers) >= BLOCK_WORDS

    @property
    def chunk_full(self) -> bool:
        return self.held >= CHUNK or len(self.ids) >= CHUNK

    def name(self) -> int:
        return (TaskContext.get().partitionId() << 24) + self.serial

    def chunk(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            numbers = np.concatenate(self.arrays) if self.arrays else np.zeros(0, np.uint32)
            yield self.rows([(0, self.name(), -1, self.ids, self.lens, pack_tokens(numbers, self.known), None)])
            self.clear_chunk()

    def finish(self, encode: Callable[[object], bytes]) -> Iterator[pa.RecordBatch]:
        yield from self.chunk()
        words = [encode(word) for word in self.numbers]
        self.numbers.clear()
        part = np.fromiter(map(crc32, words), np.int64, len(words)) % self.parts
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for at, to in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            own = order[at:to]
            yield self.rows([(1, self.name(), int(part[own[0]]), None, None, pack_words([words[k] for k in own.tolist()]), pack_ascending(own))])
        self.serial += 1
        self.clear()

    def rows(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(self.id_type), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "block", "part", "ids", "lens", "blob", "numbers"])


def blocks(docs: DataFrame, id_col: str, text_col: str, split: Callable[[str | bytes | None], Iterator], parts: int, name: str, encode: Callable[[object], bytes] = bytes, most: int = BLOCK_TOKENS) -> DataFrame:
    """The written table of blocks. split gives a text's words, encode a word's bytes; null texts come as None."""
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        block = None
        for batch in batches:
            block = block or _Block(parts, batch.schema.field(0).type, most)
            for at in range(0, batch.num_rows, 512):  # few texts are Python strings at a time
                ids, texts = batch.slice(at, 512).columns
                for doc_id, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
                    block.add(doc_id, split(text))
                    if block.full:
                        yield from block.finish(encode)
                    elif block.chunk_full:
                        yield from block.chunk()
        if block and block.tokens + len(block.ids):
            yield from block.finish(encode)
        del block
        release()

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = rows.mapInArrow(cut, f"kind int, block long, part int, ids array<{id_type}>, lens array<int>, blob binary, numbers binary")
    path = new_path(docs.sparkSession, name)
    stored = path.rpartition("/")[2].replace("-", "_")
    made.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(partitions(docs.sparkSession), "block").saveAsTable(stored)
    table = docs.sparkSession.table(stored)
    table.schema  # resolved: the catalogue entry is needed no longer, the files stay
    docs.sparkSession.sql(f"DROP TABLE {stored}")
    return table
