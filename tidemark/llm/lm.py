"""Language-model scores by stupid backoff, from n-gram count tables of the whole corpus.

``score_rows`` says it with a row for each n-gram: exploded n-grams meet count tables by hash and are summed per
document. ``score`` is the same join with its rows packed: what a block of documents asks of a hash range is one row.
It moves an order of magnitude less (README), and the query runs it.

1. Documents become blocks of word numbers (``blocks``); every text is split once.
2. Each block counts its n-grams of order 1 to ``order`` and posts the sorted hashes with their counts to hash
   ranges: the n-gram count tables, partitioned by hash. A common n-gram is one entry a block.
3. Each range adds up its n-grams' counts and sends the totals back to the blocks that asked, in their order, so
   the answer carries no keys.
4. Each block looks up the n-grams of its documents, backs off where a count is missing and sums per document.

A document is scored by the rest of the corpus: its own occurrences are taken off every count. With c the counts
left, S(w | u v) = c(u v w) / c(u v) where c(u v w) > 0, else backoff * S(w | v), and so on; a single word has
c(w) / N, with N the words of the other documents; a word that no other document has gets backoff / N.

Hashes have 64 bits. Ranges number with the corpus, so none outgrows a task. Nothing is collected but the
number of words.

Defined cases: a null, empty or blank text has no words, a sum of 0 and no mean; repeated rows and rows with equal
ids are documents of their own; with no other words in the corpus N counts as 1; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import blocks, pack, unpack, unpack_ascending, unpack_tokens, unpack_words
from tidemark.llm.common import ascii_lower, partitions, release, with_groups, written

BLOCK, PER_PART = 2 << 20, 4_000_000


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Text:
    """A block's documents: word hashes in order, ids, and where documents start."""

    def __init__(self, rows: pa.Table):
        import xxhash

        kinds = rows["kind"].to_numpy()
        words, chunks = rows.filter(pa.array(kinds == 1)), rows.filter(pa.array(kinds == 0))
        hashes = [np.fromiter(map(xxhash.xxh64_intdigest, unpack_words(b)), np.uint64) for b in words["blob"].to_pylist()]
        numbers = [unpack_ascending(b) for b in words["numbers"].to_pylist()]
        table = np.zeros(sum(map(len, numbers)), np.uint64)
        if numbers:
            table[np.concatenate(numbers)] = np.concatenate(hashes)
        tokens = [unpack_tokens(b) for b in chunks["blob"].to_pylist()]
        self.words = table[np.concatenate(tokens)] if tokens else np.zeros(0, np.uint64)
        self.ids = [x for ids in chunks["ids"].to_pylist() for x in ids]
        self.lens = np.array([x for lens in chunks["lens"].to_pylist() for x in lens], np.int64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the n-grams that end at each word with n - 1 words of its document before it."""
        total = np.full(max(0, len(self.words) - n + 1), n, np.uint64)
        for k in range(n):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + self.words[k : k + len(total)])
        return total[self.place[n - 1 :] >= n - 1]


def _pack64(sorted_keys: np.ndarray) -> bytes:
    steps = np.diff(sorted_keys, prepend=np.uint64(0))
    high, low = pack((steps >> np.uint64(32)).astype(np.uint32)), pack((steps & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return len(high).to_bytes(4, "little") + high + low


def _unpack64(blob: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(blob[:4], "little")
    steps = (unpack(blob[4:cut]).astype(np.uint64) << np.uint64(32)) | unpack(blob[cut:]).astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Range of each key; ranges follow the order of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def score(docs: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_words, log_score (natural logarithm, summed), mean_log_score."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    made = blocks(docs, id_col, text_col, split_words, 1, "lm-blocks", bytes, BLOCK).select("kind", "block", "ids", "lens", "blob", "numbers")
    total = made.filter("kind = 0").agg(F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    parts = max(2 * partitions(spark), total // PER_PART)

    def count(rows: pa.Table) -> pa.Table:
        text, out = _Text(rows), []
        for n in range(1, order + 1):
            keys, counts = np.unique(text.grams(n), return_counts=True)
            part = _part(keys, parts)
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            out += [(int(part[at]), n, rows["block"][0].as_py(), _pack64(keys[at:to]), pack(counts[at:to])) for at, to in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
        del text, keys, counts, part
        release()
        columns = zip(*out, strict=True) if out else ([],) * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "n", "block", "keys", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        keys = [_unpack64(b) for b in rows["keys"].to_pylist()]
        counts = np.concatenate([unpack(b) for b in rows["counts"].to_pylist()])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.minimum(np.bincount(where, counts)[where], 0xFFFFFFFF).astype(np.uint32)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"part": rows["part"], "n": rows["n"], "block": rows["block"], "totals": pa.array([pack(t) for t in np.split(totals, ends)], pa.binary())})

    def assemble(rows: pa.Table, answers: pa.Table) -> pa.Table:
        text = _Text(rows)
        size = len(text.words)
        answers = answers.sort_by([("n", "ascending"), ("part", "ascending")])
        n_of, blobs = answers["n"].to_numpy(), answers["totals"].to_pylist()
        left = []  # per order: counts left of the n-gram that ends at each word, -1 where there is none
        for n in range(1, order + 1):
            keys, where = np.unique(text.grams(n), return_inverse=True)
            totals = np.concatenate([np.zeros(0, np.uint32), *[unpack(b) for b, m in zip(blobs, n_of, strict=True) if m == n]]).astype(np.int64)
            if len(totals) != len(keys):
                raise ValueError("the answers of a block do not match its n-grams")
            at = np.flatnonzero(text.place >= n - 1)
            own_key, own_at, own = np.unique(text.doc[at] * max(1, len(keys)) + where, return_inverse=True, return_counts=True)
            full = np.full(size, -1, np.int64)
            full[at] = totals[where] - own[own_at]
            left.append(full)
        words_left = np.maximum(1, total - text.lens)[text.doc].astype(np.float64)
        value = np.where(left[0] > 0, left[0], backoff) / words_left
        for n in range(2, order + 1):
            context = np.full(size, 0, np.int64)
            context[1:] = left[n - 2][:-1]  # the (n - 1)-gram that ends one word before
            seen = left[n - 1] > 0
            value = np.where(seen, left[n - 1] / np.maximum(context, 1), np.where(text.place >= n - 1, backoff * value, value))
        sums = np.bincount(text.doc, np.log(value), len(text.lens)) if size else np.zeros(len(text.lens))
        del left, value, keys, where, totals, own_key, own_at, own, full
        release()
        return pa.table({"id": pa.array(text.ids, rows.schema.field("ids").type.value_type), "n_words": text.lens, "log_score": sums})

    counted = made.groupBy("block").applyInArrow(count, "part int, n int, block long, keys binary, counts binary")
    added = counted.groupBy("part", "n").applyInArrow(add, "part int, n int, block long, totals binary")
    scored = made.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(assemble, f"id {id_type}, n_words long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"))


def score_rows(docs: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``score`` returns, in DataFrame operators with a row for each n-gram of each document.

    n-grams are keyed by 128 bits. A document's own counts, the corpus's counts and the occurrences meet by n-gram;
    common n-grams are dealt to several tasks."""
    spark = docs.sparkSession
    blank = F.trim(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(blank == "", F.array().cast("array<string>")).otherwise(F.split(blank, r"[\x20\x09-\x0D]+"))
    rows = docs.select(F.monotonically_increasing_id().alias("d"), F.col(f"`{id_col}`").alias("id"), words.alias("w"))
    texts = written(rows.withColumn("n_words", F.size("w").cast("long")), "lm-texts")

    def gram(i, n: int):
        some = F.array_join(F.slice("w", i - n + 2, n), "\n")
        return F.when(i >= n - 1, F.struct(F.lit(n).alias("n"), F.xxhash64(some).alias("h"), F.xxhash64(F.lit(1), some).alias("g")))

    places = F.transform(F.col("w"), lambda w, i: F.array_compact(F.array(*[gram(i, n) for n in range(1, order + 1)])))
    spots = texts.select("d", F.posexplode(places).alias("p", "grams")).select("d", "p", F.explode("grams").alias("x")).select("d", "p", "x.*")
    own = written(spots.groupBy("d", "n", "h", "g").agg(F.count("*").alias("own")), "lm-own")
    counts = own.groupBy("n", "h", "g").agg(F.sum("own").alias("total"), F.count("*").alias("n_docs"))
    left = with_groups(own, counts, ["n", "h", "g"], "n_docs", own.count(), ["d"]).select("d", "n", "h", "g", (F.col("total") - F.col("own")).alias("left"))
    seen = spots.join(left, ["d", "n", "h", "g"]).groupBy("d", "p").agg(*[F.max(F.when(F.col("n") == n, F.col("left"))).alias(f"c{n}") for n in range(1, order + 1)])
    total = texts.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    before = Window.partitionBy("d").orderBy("p")
    seen = seen.join(texts.select("d", "n_words"), "d").withColumns({f"b{n}": F.lag(f"c{n}").over(before) for n in range(1, order)})
    value = F.when(F.col("c1") > 0, F.col("c1")).otherwise(F.lit(backoff)) / F.greatest(F.lit(1), F.lit(total) - F.col("n_words"))
    for n in range(2, order + 1):
        value = F.when(F.col(f"c{n}") > 0, F.col(f"c{n}") / F.col(f"b{n - 1}")).when(F.col("p") >= n - 1, backoff * value).otherwise(value)
    sums = seen.groupBy("d").agg(F.sum(F.log(value)).alias("s"))
    out = texts.join(sums, "d", "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("s", F.lit(0.0)).alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
