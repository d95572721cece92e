"""Benchmark decontamination by winnowing: the words of documents that lie inside passages of benchmark items.

A passage is ``span`` consecutive words of an item, or a shorter item as a whole. Documents and items are fingerprinted
alike: of the hashes of ``gram`` words in a passage the smallest one is its fingerprint. Equal passages have equal
fingerprints, so every shared passage is found: joined by fingerprint, then extended to all its words and compared.

What shuffles is small. A bit table of the items' fingerprints goes to all tasks (of at most MAX_BITS bits, whatever the
items), and only passages whose bits are set leave their row; with more items than the table holds well, more of them do,
and the join decides all the same. Its other side, the distinct passages of all items, is broadcast only below
BROADCAST_BYTES, and merged by sorting beyond. A passage that many items share is one row there, and the lists of items
are put together once for each distinct set of them, not for each document.

Everything is built from DataFrame functions.

Defined cases: A-Z is lower-cased, words are runs of digits, a-z and everything beyond ASCII; null and empty texts have no
words and are clean; rows with equal or null ids are judged one by one; items without words have no passages; items of
equal ids are one item, and an item with a null id marks words but is not named; other columns are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, with_groups, written

#: Fixed values of the contract: what ends a word.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PROBES, MAX_BITS, BROADCAST_BYTES = 3, 1 << 21, 8 << 20
PASSAGE = "array<struct<size:int,start:int,fingerprint:bigint,passage:string>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _hashed(rows: DataFrame, sizes: list[int], gram: int) -> DataFrame:
    """rows (with ``words``) plus, for each size of passages, ``_f<size>``: the fingerprint at each place where one starts.

    Columns are added one after the other, each used at least twice by the next: Spark then computes an array once a row,
    not once for each element of the next."""
    rows = rows.withColumn("n_words", F.size("words")).withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))

    def over(column: str, count: int, f) -> Column:
        """f of each ``count`` neighbours of an array."""
        last = F.size(column) - count
        found = F.transform(F.sequence(F.lit(0), last), lambda i: f(*[F.get(F.col(column), i + j) for j in range(count)]))
        return F.when(last >= 0, found).otherwise(F.array().cast("array<bigint>"))

    for k in sorted({min(gram, s) for s in sizes}):
        rows = rows.withColumn(f"_g{k}", over("_h", k, F.xxhash64) if k > 1 else F.col("_h"))
    for s in sizes:
        k = min(gram, s)
        mixed = F.transform(f"_g{k}", lambda g: F.xxhash64(g))
        rows = rows.withColumn(f"_f{s}", over(f"_g{k}", s - k + 1, lambda *g: F.xxhash64(F.least(*g))) if s > k else mixed)
    return rows


def _passages(size: int, places: Column) -> Column:
    """The passages at these places (start, fingerprint), with all their words."""
    whole = lambda i: F.concat_ws(" ", *[F.get(F.col("words"), i + j) for j in range(size)])
    return F.transform(places, lambda x: F.struct(F.lit(size).alias("size"), x["start"].alias("start"), x["fingerprint"].alias("fingerprint"), whole(x["start"]).alias("passage")))


def _places(size: int) -> Column:
    starts = F.when(F.col("n_words") >= size, F.sequence(F.lit(0), F.col("n_words") - size)).otherwise(F.array().cast("array<int>"))
    return F.zip_with(starts, F.col(f"_f{size}"), lambda i, f: F.struct(i.alias("start"), f.alias("fingerprint")))


def benchmark_passages(items: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """(size, fingerprint, passage, items): the distinct passages of all items, with the sorted ids of their items."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("words")).filter(F.size("words") > 0)
    rows = _hashed(rows, list(range(1, span + 1)), gram)
    own = F.least(F.col("n_words"), F.lit(span))
    found = F.array().cast(PASSAGE)
    for s in range(1, span + 1):
        found = F.when(own == s, _passages(s, _places(s))).otherwise(found)
    each = rows.select("item", F.explode(found).alias("p")).select("item", "p.size", "p.fingerprint", "p.passage")
    return each.groupBy("size", "fingerprint", "passage").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _slot(fingerprint: Column, probe: int, bits: int) -> Column:
    return F.shiftrightunsigned(fingerprint, 21 * probe).bitwiseAND(F.lit(bits - 1).cast("long"))


def bit_table(passages: DataFrame, bits: int) -> DataFrame:
    """One row: ``bits`` as an array of longs in which every fingerprint has its PROBES bits set."""
    slots = passages.select(F.explode(F.array(*[_slot(F.col("fingerprint"), k, bits) for k in range(PROBES)])).alias("slot"))
    cells = slots.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("cell"))
    full = passages.sparkSession.range(bits // 64).join(cells, "id", "left").select("id", F.coalesce("cell", F.lit(0).cast("long")).alias("cell"))
    return full.agg(F.array_sort(F.collect_list(F.struct("id", "cell"))).alias("all")).select(F.transform("all", lambda x: x["cell"]).alias("_bits"))


def _set(fingerprint: Column, bits: int) -> Column:
    """All bits of this fingerprint are set."""
    test = F.lit(True)
    for k in range(PROBES):
        slot = _slot(fingerprint, k, bits)
        test = test & (F.getbit(F.get(F.col("_bits"), F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return test


def candidates(docs: DataFrame, text_col: str, keep: list[Column], table: DataFrame, bits: int, sizes: list[int], gram: int) -> DataFrame:
    """(keep, n_words, found): the passages of each document whose fingerprint an item may have."""
    rows = _hashed(docs.select(*keep, words_of(F.col(f"`{text_col}`")).alias("words")), sizes, gram)
    names = [c for c in rows.columns if c not in ("words", "n_words") and not c.startswith(("_h", "_g", "_f"))]
    rows = rows.select(*names, "words", "n_words", *[f"_f{s}" for s in sizes]).crossJoin(F.broadcast(table))  # one row
    for s in sizes:
        rows = rows.withColumn(f"_s{s}", F.filter(_places(s), lambda x: _set(x["fingerprint"], bits)))
    return rows.select(*names, "n_words", F.concat(*[_passages(s, F.col(f"_s{s}")) for s in sizes]).alias("found"))


def _stretches(hits: DataFrame) -> DataFrame:
    """Hits (_key, start, end, class) as disjoint spans and the classes of a document; a document's are no more than its
    words."""
    earlier = Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)), F.col("start"))
    rows = hits.withColumn("_open", opens).withColumn("_at", F.max("_open").over(so_far))
    per = rows.groupBy("_key", "_at").agg(F.max("end").alias("end"), F.collect_set("class").alias("_c"))
    span = F.struct(F.col("_at").alias("start"), "end")
    return per.groupBy("_key").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("_c")))).alias("_classes"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = 10, gram: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per row of docs: id, n_words, n_hit (words inside passages of items), spans (first word and the word after the last
    of each hit stretch, numbered from 0), item_set. And the sets: item_set, items (sorted ids)."""
    passages = written(benchmark_passages(benchmark, item_col, item_text, span, gram).withColumn("class", F.sha2(F.to_json("items"), 256)), "passages")
    count, size = passages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("passage") + 100), F.lit(0))).first()
    sizes = sorted(r[0] for r in passages.select("size").distinct().collect()) or [span]  # span values at most
    bits = 1 << 12
    while bits < min(MAX_BITS, 64 * count):
        bits *= 2
    table = written(bit_table(passages, bits), "bits")
    keep = [F.monotonically_increasing_id().alias("_key"), F.col(f"`{id_col}`").alias("_id")]
    rows = written(candidates(docs, text_col, keep, table, bits, sizes, gram), "candidates")
    found = rows.filter(F.size("found") > 0).select("_key", F.inline("found"))
    side = passages.select("size", "fingerprint", "passage", "class")
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side.hint("merge")
    hits = found.join(side, ["size", "fingerprint", "passage"]).select("_key", "class", "start", (F.col("start") + F.col("size")).alias("end"))
    per = written(_stretches(hits).withColumn("item_set", F.sha2(F.to_json("_classes"), 256)), "hits")
    sets = per.select("item_set", "_classes").dropDuplicates(["item_set"]).select("item_set", F.explode("_classes").alias("class"))
    lists = passages.select("class", "items").dropDuplicates(["class"])
    sets = sets.join(lists, "class").select("item_set", F.explode("items").alias("item")).groupBy("item_set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    clean = rows.filter(F.size("found") == 0).select("_id", "n_words", none.alias("spans"), F.lit(None).cast("string").alias("item_set"))
    some = rows.filter(F.size("found") > 0).select("_key", "_id", "n_words").join(per.select("_key", "spans", "item_set"), "_key", "left")
    some = some.select("_id", "n_words", F.coalesce("spans", none).alias("spans"), "item_set")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = clean.unionByName(some).select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), "spans", "item_set")
    out = written(out, "judged")
    return out, sets


def with_items(judged: DataFrame, sets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """judged with the columns of its set of items, null where it has none. Very many documents may have one set: they are
    dealt to several tasks."""
    some = judged.filter(F.col("item_set").isNotNull())
    groups = some.groupBy("item_set").agg(F.count("*").alias("_size")).join(sets, "item_set")
    joined = with_groups(some, groups, ["item_set"], "_size", some.count(), [id_col])
    return joined.drop("_size").unionByName(judged.filter(F.col("item_set").isNull()), allowMissingColumns=True)
