"""N-gram Jaccard self-join of documents, with set-relation skipping.

Documents become sets of word n-gram hashes; two link when 100 * |A and B| >= threshold * |A or B|.

1. *Sets.* A set's fingerprint stands for all documents with equal sets, so copies cost one row.
2. *Order.* n-grams are ordered by how common they are, rare first. Commonness comes from a counting sketch of
   fixed size over all documents; any order gives the same links, a good one short lists.
3. *Index.* Each set posts the n-grams of its prefix (two linked sets share one of them) with set size and
   position. What has no set of a near enough size in its list goes at once.
4. *Leaders.* For a few rounds every set is compared with a few leaders of the lists it shares, if they are not
   yet connected. A list's first leader is the set with the fewest n-grams of its own, so in a group of near copies
   this connects nearly all that can be with a few comparisons a set.
5. *Completion.* Lists that still hold several components are joined in full between components. A list is
   ordered by size and position, and blocks of equal size and position whose bound is too low are skipped whole
   (index-level skipping). A pair whose members were compared with the same leader L gets bounds from those two
   overlaps: |A and B| >= oA + oB - |L| and <= min(oA, oB) + min(|A| - oA, |B| - oB). If a bound decides, the
   sets themselves are not compared (answer-level skipping). Of the rest, hashes counted by range (a tenth of a
   set) rule out most; what is left is verified.

Comparing needs whole sets, which are computed again for sets of shared lists only and written once, bucketed by
fingerprint. No step groups a component's sets in one task or sends links to the driver; what the driver sees is
the sketch (fixed size) and a Bloom bitmap of at most ``max_bits`` bits. A list, component or group of equal sets of
more than a task's share is dealt to several tasks. In full, such a list is joined in blocks: its largest component in
blocks of its own, which never meet each other, and the other sets in blocks that meet all.

Words, n-grams and sets are compared by hashes of 64 bits. Within two sets this does not show; among 10**10 different
sets about three pairs are expected to share a fingerprint, which would make the two sets of such a pair one.

Defined cases: a null, empty or blank text has an empty set and links with nothing; a text of fewer than n words
is one n-gram; repeated rows and equal texts are one component; a null id has a null component unless its set has
a row with an id; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import pack, unpack
from tidemark.llm.common import bound_batches, new_path, partitions, release, scratch, with_groups, written
from tidemark.llm.components import components

SKETCH_BITS, CHUNK_BITS, MERGE_SALTS = 22, 16, 256
BITMAP = 32768
CACHE = 1_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _random(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of concatenated texts (ASCII white space between them, A-Z lower-cased), and
    where each text's words end."""
    low = np.arange(256)
    low[65:91] += 32
    value, blank = _random(256, 1)[low], np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
    gap = blank[data]
    opens = ~gap
    opens[1:] &= gap[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    opens[begins] = ~gap[begins]
    letters = np.flatnonzero(~gap)
    starts = np.flatnonzero(opens)
    first = np.searchsorted(letters, starts)
    size = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, size)
    factor = _random(int(size.max(initial=0)), 2) | np.uint64(1)
    sums = np.add.reduceat(value[data[letters]] * factor[place], first) if len(first) else np.zeros(0, np.uint64)
    return _mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, ends)


def _sets(data: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; of a text of fewer than n words, one hash of all of them."""
    words, word_ends = _words(data, ends)
    factor = _random(n + 1, 3) | np.uint64(1)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams += words[k : k + len(grams)] * factor[k]
    grams, out, at = _mix(grams), [], 0
    for to in word_ends.tolist():
        if to - at >= n:
            s = grams[at : to - n + 1]
            s.sort()
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        else:
            w = words[at:to]
            out.append(_mix((w * factor[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w))) if len(w) else w)
        at = to
    return out


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def _set_batches(batches, n: int, most: int = 1 << 19) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets) of runs of texts of about ``most`` bytes; batches have columns id and text (binary)."""
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        texts = pa.compute.fill_null(texts, b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
            yield ids.slice(at, to - at), _sets(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], n)
            at = to
    release()


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: (id, size, f) of every document; kind 1: this task's part of the counting sketch."""
    id_type = docs.schema["id"].dataType.simpleString()

    def count(batches):
        counts, ids_type, names = np.zeros(1 << SKETCH_BITS, np.int32), None, ["kind", "id", "size", "f", "chunk", "salt", "counts"]
        for ids, sets in _set_batches(batches, n):
            ids_type, k = ids.type, len(sets)
            np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            prints = [fingerprint(s) if len(s) else None for s in sets]
            none = pa.nulls(k, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), none, none, pa.nulls(k, pa.binary())], names=names)
        if ids_type is not None:
            chunks = counts.reshape(-1, 1 << CHUNK_BITS)
            k = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, ids_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, TaskContext.get().partitionId() % MERGE_SALTS, np.int32)), pa.array([pack(c) for c in chunks], pa.binary())], names=names)

    return written(docs.mapInArrow(count, f"kind int, id {id_type}, size long, f long, chunk int, salt int, counts binary"), "sets")


def _levels(nodes: DataFrame) -> np.ndarray:
    """Commonness of each sketch cell: 0 within four standard deviations of the mean, then twice the logarithm of
    what is above it. Fixed size."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.minimum(sum(unpack(x).astype(np.int64) for x in rows["counts"].to_pylist()), 0xFFFFFFFF)
        return pa.table({"chunk": rows["chunk"][:1].combine_chunks(), "salt": pa.array([0], pa.int32()), "counts": pa.array([pack(total)], pa.binary())})

    parts = nodes.filter("kind = 1").select("chunk", "salt", "counts")
    for keys in (("chunk", "salt"), ("chunk",)):
        parts = parts.groupBy(*keys).applyInArrow(add, "chunk int, salt int, counts binary")
    counts = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS))
    for r in parts.collect():
        counts[r["chunk"]] = unpack(r["counts"])
    over = (counts.ravel() - counts.mean()) / (4 * max(1.0, counts.mean()) ** 0.5)
    return np.where(over <= 1, 0, 1 + (2 * np.log2(np.maximum(over, 1))).astype(np.int64)).astype(np.uint8)


def _least(size, threshold: int):
    """Least overlap of a linked set with one of this size."""
    return -(-size * threshold // 100)


def _pair_least(a, b, threshold: int):
    """Least overlap of two linked sets of these sizes."""
    return -(-(a + b) * threshold // (100 + threshold))


def _shared_lists(docs: DataFrame, n: int, threshold: int, levels: np.ndarray) -> DataFrame:
    """(token, size, pos, f) of prefix n-grams, for sets with another set in the list that is near enough in size."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(levels)

    def post(batches):
        rank, seen = held.value, set()
        for _, sets in _set_batches(batches, n):
            out: list[tuple] = []
            for s in sets:
                if not len(s) or (f := fingerprint(s)) in seen:
                    continue
                if len(seen) >= CACHE:
                    seen.clear()
                seen.add(f)
                take = len(s) - int(_least(len(s), threshold)) + 1
                level = rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                out.append((f, len(s), s[np.argsort(level, kind="stable")[:take]]))
            if out:
                k = [len(x[2]) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[2] for x in out]).view(np.int64)), pa.array(np.repeat([x[1] for x in out], k)), pa.array(np.concatenate([np.arange(x) for x in k])), pa.array(np.repeat(np.array([x[0] for x in out], np.int64), k))], names=["token", "size", "pos", "f"])

    def shared(batches):
        last = None  # the last row that may yet turn out to share its list: (row, already known to)
        for batch in batches:
            if not batch.num_rows:
                continue
            token, size, pos, f = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("token", "size", "pos", "f"))
            if last:
                token, size, pos, f = (np.concatenate([[a], b]) for a, b in zip(last[0], (token, size, pos, f), strict=True))
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (f[1:] != f[:-1])
            token, size, pos, f = token[fresh], size[fresh], pos[fresh], f[fresh]
            near = (token[1:] == token[:-1]) & (size[:-1] * 100 >= size[1:] * threshold)  # lists are sorted by size
            like = np.concatenate([[bool(last and last[1])], near, [False]])
            keep = like[:-1] | like[1:]
            last = ((token[-1], size[-1], pos[-1], f[-1]), bool(like[-2]))
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, size, pos, f)], names=["token", "size", "pos", "f"])
        if last and last[1]:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last[0]], names=["token", "size", "pos", "f"])
        release()

    schema = "token long, size long, pos long, f long"
    posted = docs.mapInArrow(post, schema).repartition(2 * partitions(spark), "token").sortWithinPartitions("token", "size", "f")
    return written(posted.mapInArrow(shared, schema), "lists")


def _bloom(keys: DataFrame, max_bits: int) -> np.ndarray:
    """Bits of the distinct keys' low ends, one table of at most max_bits."""
    n, bits = keys.count(), BITMAP
    while bits < 16 * n and bits < max_bits:
        bits *= 2
    slot = F.col("f").bitwiseAND(bits - 1)
    rows = keys.groupBy(F.expr(f"(f & {bits - 1}) div {BITMAP}").alias("chunk")).agg(F.bitmap_construct_agg(slot % BITMAP).alias("bitmap")).collect()
    out = np.zeros((bits // BITMAP, BITMAP // 8), np.uint8)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["bitmap"], np.uint8)
    return out.ravel()


def _write_sets(docs: DataFrame, n: int, lists: DataFrame, max_bits: int) -> DataFrame:
    """(f, size, tokens, signature) once for each set of the lists (and some more), in a table bucketed by f."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(_bloom(lists.select("f").distinct(), max_bits))

    def collect(batches):
        bits, seen = held.value, set()
        mask, press = len(bits) * 8 - 1, zstandard.ZstdCompressor(level=1)
        for _, sets in _set_batches(batches, n):
            out = []
            for s in sets:
                if not len(s):
                    continue
                f = fingerprint(s)
                slot = f & mask
                if f in seen or not bits[slot >> 3] >> (slot & 7) & 1:
                    continue
                if len(seen) >= CACHE:
                    seen.clear()
                seen.add(f)
                out.append((f, len(s), press.compress(np.diff(s, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()), signature(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["f", "size", "tokens", "signature"])

    once = docs.mapInArrow(collect, "f long, size long, tokens binary, signature binary").groupBy("f").agg(*[F.first(c).alias(c) for c in ("size", "tokens", "signature")])
    path = new_path(spark, "tokens")
    name = path.rpartition("/")[2].replace("-", "_")
    once.write.format("parquet").option("path", path).bucketBy(partitions(spark), "f").saveAsTable(name)
    table = spark.table(name)
    table.schema
    spark.sql(f"DROP TABLE {name}")
    return table


def signature(s: np.ndarray) -> bytes:
    """How many hashes fall into each of about len(s) / 2 even ranges, a byte each; empty where one holds more."""
    bits = max(3, min(30, len(s).bit_length() - 2))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _most(x: bytes, y: bytes) -> int:
    """No two sets with these signatures overlap in more hashes."""
    if not x or not y:
        return 1 << 62
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    ranges = min(len(a), len(b))
    return int(np.minimum(a.reshape(ranges, -1).sum(axis=1), b.reshape(ranges, -1).sum(axis=1)).sum())


def _possible(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that signatures do not rule out; they are a tenth of the sets' size."""

    def test(batches):
        for batch in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
            column = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("both", "x", "y")}
            keep = [_most(x, y) >= _pair_least(both, 0, threshold) for both, x, y in zip(*column.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])
        release()

    side = lambda k, c: sets.select(F.col("f").alias(k), F.col("size").alias(f"size_{k}"), F.col("signature").alias(c))
    both = pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("both"), "x", "y")
    return both.mapInArrow(test, "a long, b long")


def _unpress(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) plus size_a, size_b and overlap, from the sets themselves."""

    def compare(batches):
        for batch in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "size_a", "size_b", "tokens_a", "tokens_b")}
            blobs = column["tokens_a"].to_pylist(), column["tokens_b"].to_pylist()
            held = {x: _unpress(x) for x in {*blobs[0], *blobs[1]}}
            out = [len(np.intersect1d(held[x], held[y], assume_unique=True)) for x, y in zip(*blobs, strict=True)]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in ("a", "b", "size_a", "size_b")), pa.array(out, pa.int64())], names=["a", "b", "size_a", "size_b", "overlap"])
        release()

    side = lambda k: sets.select(F.col("f").alias(k), F.col("size").alias(f"size_{k}"), F.col("tokens").alias(f"tokens_{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "tokens_a", "tokens_b")
    return both.mapInArrow(compare, "a long, b long, size_a long, size_b long, overlap long")


def _links(compared: DataFrame, threshold: int) -> DataFrame:
    return compared.filter(F.col("overlap") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("overlap")) * threshold)


def _dealt(lists: DataFrame) -> DataFrame:
    """lists plus ``salts``, how many tasks' shares a row's list has, and ``salt``, the one the row is in. Lists of more
    than one share are at most twice as many as there are partitions."""
    share = max(64, lists.count() // (2 * partitions(lists.sparkSession)))
    large = lists.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > share)
    large = written(large.select("token", F.ceil(F.col("n") / share).cast("int").alias("_salts")), "large-lists")
    rows = lists.join(F.broadcast(large), "token", "left").withColumn("salts", F.coalesce("_salts", F.lit(1))).drop("_salts")
    return rows.withColumn("salt", F.pmod(F.xxhash64("f"), F.col("salts")).cast("int"))


def _told(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows of lists joined with what ``per`` (token, salts, ...) says of their list."""
    dealt = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return rows.join(dealt, ["token", "salt"])


def _connected(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, with the component ``comp`` of each set."""
    found = components(links, "a", "b").select(F.col("node").alias("f"), "root")
    rows = lists.join(found, "f", "left").withColumn("comp", F.coalesce("root", "f")).drop("root")
    split = rows.groupBy("token").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.max("salts").alias("salts"))
    return written(_told(rows, split.filter("_low != _high").select("token", "salts")), "open")


def _to_leaders(rows: DataFrame, threshold: int, turn: int, most: int) -> DataFrame:
    """For each set of the lists up to ``most`` leaders to compare it with, those that most of its lists name.

    A list's leader is first the set with the fewest n-grams before this one: of a group of near copies, the one
    with the fewest of its own. Later turns choose more and more freely."""
    h = F.xxhash64("f", F.lit(turn))
    place = {0: F.col("pos"), 1: F.floor(F.col("pos") / 4)}.get(turn, F.lit(0).cast("long"))
    leader = rows.groupBy("token").agg(F.min(F.struct(place.alias("place"), h.alias("h"), F.col("f").alias("lf"), F.col("size").alias("ls"), F.col("pos").alias("lp"), F.col("comp").alias("lc"))).alias("l"), F.max("salts").alias("salts"))
    both = _told(rows, leader.select("token", "salts", "l.lf", "l.ls", "l.lp", "l.lc")).filter("comp != lc")
    low, high = F.least("size", "ls"), F.greatest("size", "ls")
    could = (low * 100 >= high * threshold) & (F.least(F.col("size") - F.col("pos"), F.col("ls") - F.col("lp")) * (100 + threshold) >= (low + high) * threshold)
    votes = both.filter(could).groupBy("f", "lf").agg(F.count("*").alias("n"))
    best = votes.groupBy("f").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "lf")), asc=False), 1, most).alias("best"))
    best = best.select("f", F.explode("best.lf").alias("lf"))
    return best.select(F.least("f", "lf").alias("a"), F.greatest("f", "lf").alias("b")).distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """rows of open lists as (token, i, j, size, pos, f, comp, own), once for each pair of blocks they are needed in.

    A list within a task's share is one block. Of a larger one, the sets of its largest component go to blocks that meet
    the others only, as pairs within a component are not asked for."""
    share = max(64, rows.count() // (2 * partitions(rows.sparkSession)))
    parts = rows.groupBy("token", "comp").agg(F.count("*").alias("n"))
    large = parts.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).filter(F.col("n") > share)
    main, others = F.ceil(F.col("top.n") / share), F.ceil((F.col("n") - F.col("top.n")) / share)
    large = written(large.select("token", F.col("top.comp").alias("top"), main.cast("int").alias("main"), others.cast("int").alias("others")), "large-open")
    tagged = rows.join(F.broadcast(large), "token", "left")  # at most twice as many rows as there are partitions
    top, last = F.col("comp") == F.col("top"), F.col("main") + F.col("others") - 1
    place = lambda n: F.pmod(F.xxhash64("f", F.lit(3)), F.col(n)).cast("int")
    own = F.when(F.col("main").isNull(), F.lit(0)).when(top, place("main")).otherwise(F.col("main") + place("others"))
    meets = F.when(F.col("main").isNull(), F.array(F.lit(0))).when(top, F.sequence("main", last)).otherwise(F.sequence(F.lit(0), last))
    placed = tagged.withColumn("own", own).withColumn("other", F.explode(meets))
    return placed.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "size", "pos", "f", "comp", "own")


def _in_full(rows: DataFrame, threshold: int) -> DataFrame:
    """All pairs between components of each list that size and position allow."""
    keys = ["token", "i", "j"]

    def pairs(batches):
        key, held, seen = None, [], set()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (*keys, "size", "pos", "f", "comp", "own")]
            cuts = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if at == to:
                    continue
                if (now := tuple(c[at] for c in columns[:3])) != key and held:
                    yield from _list_pairs(held, key[1] == key[2], threshold, seen)
                    held = []
                key = now
                held.append([c[at:to] for c in columns[3:]])
        if held:
            yield from _list_pairs(held, key[1] == key[2], threshold, seen)
        release()

    ordered = _blocks(rows).repartition(2 * partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "size", "pos", "f")
    return ordered.mapInArrow(pairs, "a long, b long").distinct()


def _list_pairs(held: list, one_block: bool, threshold: int, seen: set) -> Iterator[pa.RecordBatch]:
    size, pos, f, comp, own = (np.concatenate(c) for c in zip(*held, strict=True))
    starts = np.flatnonzero(np.diff(size, prepend=-1) | np.diff(pos, prepend=-1))  # runs of equal size and position
    ends = np.append(starts[1:], len(size))
    bsize, left = size[starts], size[starts] - pos[starts]
    out: list[tuple[int, int]] = []
    for k, (at, to) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        last = np.searchsorted(bsize, bsize[k] * 100 // threshold, side="right")
        could = k + np.flatnonzero(np.minimum(left[k], left[k:last]) >= _pair_least(bsize[k], bsize[k:last], threshold))
        if not len(could):
            continue
        others = np.concatenate([np.arange(starts[j], ends[j]) for j in could])
        for i in range(at, to):
            mine = others[(others > i) & (comp[others] != comp[i]) & (one_block | (own[others] != own[i]))]
            if len(mine):
                a, b = np.minimum(f[i], f[mine]), np.maximum(f[i], f[mine])
                if len(seen) >= CACHE:
                    seen.clear()
                new = [p for p in zip(a.tolist(), b.tolist(), strict=True) if p not in seen]
                seen.update(new)
                out += new
                if len(out) >= 1 << 14:
                    yield _pair_batch(out)
                    out = []
    if out:
        yield _pair_batch(out)


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])


def _derived(pairs: DataFrame, compared: DataFrame, threshold: int) -> DataFrame:
    """pairs plus ``low`` and ``high``, what overlaps with the leader both are closest to say of theirs (null:
    nothing), and the least overlap that links them."""
    ways = compared.select(F.col("a").alias("x"), F.struct("overlap", F.col("b").alias("l"), F.col("size_b").alias("sl"), F.col("size_a").alias("s")).alias("w"))
    ways = ways.unionByName(compared.select(F.col("b").alias("x"), F.struct("overlap", F.col("a").alias("l"), F.col("size_a").alias("sl"), F.col("size_b").alias("s")).alias("w")))
    home = ways.groupBy("x").agg(F.max("w").alias("w"))
    side = lambda k: home.select(F.col("x").alias(k), F.col("w.l").alias(f"l{k}"), F.col("w.s").alias(f"s{k}"), F.col("w.sl").alias(f"sl{k}"), F.col("w.overlap").alias(f"o{k}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    same = F.col("la") == F.col("lb")
    low = F.when(same, F.col("oa") + F.col("ob") - F.col("sla"))
    high = F.when(same, F.least("oa", "ob") + F.least(F.col("sa") - F.col("oa"), F.col("sb") - F.col("ob")))
    return both.select("a", "b", low.alias("low"), high.alias("high"), F.ceil((F.col("sa") + F.col("sb")) * threshold / (100 + threshold)).alias("need"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80, rounds: int = 3, leaders: int = 3, max_bits: int = 1 << 27) -> DataFrame:
    """Per row of docs: its id, n_shingles, component_id (smallest id of its component)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    with scratch(docs.sparkSession):
        nodes = _nodes(docs, n)
        lists = _dealt(_shared_lists(docs, n, threshold, _levels(nodes)))
        sets = _write_sets(docs, n, lists, max_bits)
        tried = compared = None
        rows = lists.withColumn("comp", F.col("f"))
        for turn in range(rounds):
            pairs = _to_leaders(rows, threshold, turn, leaders)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = written(pairs, "pairs")
            new = written(_overlaps(_possible(pairs, sets, threshold), sets), "compared")
            tried, compared = (pairs, new) if tried is None else (tried.unionByName(pairs), compared.unionByName(new))
            links = _links(compared, threshold)
            rows = _connected(lists, links)
        rest = written(_in_full(rows, threshold).join(tried, ["a", "b"], "left_anti"), "rest")
        rest = written(_derived(rest, compared, threshold), "derived")
        sure = rest.filter("low >= need").select("a", "b")
        unsure = rest.filter("low IS NULL OR low < need AND high >= need").select("a", "b")
        links = links.select("a", "b").unionByName(sure).unionByName(_links(_overlaps(_possible(unsure, sets, threshold), sets), threshold).select("a", "b"))
        roots = components(links, "a", "b").select(F.col("node").alias("f"), "root")
        found = _component_of(nodes.filter("kind = 0").select("id", "size", "f"), roots)
        return written(found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id"), "near", keep=True)


def _component_of(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, size, component_id): per class of equal sets first, then per component, then back to the documents."""
    total = nodes.count()
    some = nodes.filter("f IS NOT NULL")
    classes = some.groupBy("f").agg(F.min("id").alias("class_first"), F.count("*").alias("n_docs"))
    classes = classes.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    classes = written(classes, "classes")
    per = classes.groupBy("root").agg(F.min("class_first").alias("first"), F.count("*").alias("n_classes"))
    first = with_groups(classes, per, ["root"], "n_classes", total, ["f"]).select("f", "n_docs", "first")
    found = with_groups(some, first, ["f"], "n_docs", total, ["id"]).select("id", "size", F.coalesce("first", "id").alias("component_id"))
    return found.unionByName(nodes.filter("f IS NULL").select("id", "size", F.col("id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """docs with one document of each component, that with the smallest id; columns as they were. Rows with equal
    ids share a verdict: they stay if one of them does. Rows without an id stay."""
    with scratch(docs.sparkSession):
        found = jaccard_components(docs, id_col, text_col, n, threshold).select(F.col(id_col).alias("gone"), F.col(id_col).eqNullSafe(F.col("component_id")).alias("stays"))
        gone = found.filter("gone IS NOT NULL").groupBy("gone").agg(F.max("stays").alias("stays")).filter("NOT stays").select("gone")
        gone = written(gone, "gone", keep=True)
    return docs.join(gone, docs[f"`{id_col}`"] == gone["gone"], "left_anti")
