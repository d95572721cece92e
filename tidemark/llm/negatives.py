"""Hard negatives by inner products, found through an orthogonal rotation onto the principal components.

Vectors become integers (floor of 256 times a component) and are turned by the eigenvectors of their second moments, which
leaves products as they are and gathers most of their size in the first components. The product of the first components
plus or minus the product of what is left of both lengths, plus slack for rounding, bounds the whole product. Pairs that
the bounds rule out are discarded after a quarter, a half, or all of the components; what is left is computed in integers.

The anchors are the query set; they meet all rows in blocks. Rows are packed into blocks of a few megabytes once, without a
shuffle and whatever their labels, so a label or a vector that very many rows share is spread like any other. Anchor blocks
go to all tasks in groups of at most ``group_bytes``, a pass over the rows for each group. A task keeps the best few
partners of each anchor over all its blocks, so what shuffles is a few rows for each anchor and task.

Any orthogonal rotation gives the same result. It is fitted on all rows, for the ROTATED commonest lengths of vectors up to
LONGEST components; vectors of other lengths are taken unrotated.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do those whose
integer vector is 2^31 or longer (products would leave 64 bits); vectors of different lengths have no product; rows with
equal ids are rows of their own; a null id ranks as the largest; no rows give none; other columns are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, new_path, release, written

SCALE, ROTATED, LONGEST = 256, 4, 1024
BLOCK_BYTES, NO_ID, NONE = 2 << 20, np.iinfo("int64").max, np.iinfo("int64").min
EDGE = "d int, n int, ids binary, labels binary, ints binary, turned binary"
PACKED = EDGE + ", anchors binary"
ANCHORS = "ab long, ai int, d int, id long, label long, ints binary, turned binary"


def integer_vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, integer vectors) of the rows of a batch (label, vector) that take part, by length of their vectors."""
    import pyarrow.compute as pc

    batch = batch.filter(pc.and_(batch["label"].is_valid(), batch["vector"].is_valid()))
    lengths = batch["vector"].value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = batch.filter(pa.array(lengths == d))
        x = rows["vector"].flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, d)
        q = np.floor(SCALE * x)
        size = np.einsum("ij,ij->i", q, q)
        keep = np.isfinite(x).all(1) & (np.nan_to_num(size, nan=np.inf) < 2.0**62)
        if keep.any():
            yield int(d), rows.filter(pa.array(keep)), q[keep]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for d, rows, q in integer_vectors(batch):
            if 0 < d <= LONGEST and (d in sums or len(sums) < 4 * ROTATED):
                had = sums.setdefault(d, [0, np.zeros((d, d))])
                had[0] += rows.num_rows
                had[1] += q.T @ q
    for d, (n, gram) in sums.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "gram": [gram.tobytes()]})


def _added(key: tuple, table: pa.Table) -> pa.Table:
    gram = sum(np.frombuffer(x) for x in table["gram"].to_pylist())
    return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "gram": [gram.tobytes()]})


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes, largest first, of the commonest lengths of vectors."""
    part = rows.select("label", "vector").mapInArrow(_moments, "d int, n long, gram binary").withColumn("salt", F.spark_partition_id() % 64)
    sums = part.groupBy("d", "salt").applyInArrow(_added, "d int, n long, gram binary").groupBy("d").applyInArrow(_added, "d int, n long, gram binary")
    best = sums.orderBy(F.desc("n"), "d").limit(ROTATED).collect()
    return {r["d"]: np.linalg.eigh(np.frombuffer(bytes(r["gram"])).reshape(r["d"], r["d"]))[1][:, ::-1].copy() for r in best}


def _turn(q: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    return (q if axes is None else q @ axes).astype("float32")


def _packer(axes: dict[int, np.ndarray]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(d: int) -> pa.RecordBatch:
            ids, labels, anchors, q = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            order = np.argsort(ids, kind="stable")
            parts = {"ids": ids, "labels": labels, "ints": q.astype("int32"), "turned": _turn(q, axes.get(d)), "anchors": anchors}
            return pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([len(ids)], pa.int32()), **{k: [x[order].tobytes()] for k, x in parts.items()}}, schema=None)

        names = ["d", "n", "ids", "labels", "ints", "turned", "anchors"]
        for batch in batches:
            for d, rows, q in integer_vectors(batch):
                most = max(1, min(4096, BLOCK_BYTES // (8 * max(d, 1))))
                ids = rows["id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
                labels, anchors = rows["label"].to_numpy(zero_copy_only=False), rows["anchor"].fill_null(False).to_numpy(zero_copy_only=False)
                for at in range(0, len(q), most):
                    cut = slice(at, at + most)
                    held.setdefault(d, []).append((ids[cut], labels[cut], anchors[cut], q[cut]))
                    if sum(len(x[0]) for x in held[d]) >= most:
                        yield block(d).select(names)
                if len(held) > 64:  # very many lengths
                    yield from [block(k).select(names) for k in list(held)]
        yield from [block(d).select(names) for d in list(held)]

    return pack


def _array(row: dict, name: str, kind: str, d: int = 0) -> np.ndarray:
    flat = np.frombuffer(row[name], kind)
    return flat.reshape(row["n"], row["d"]) if d else flat


def _unpack_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(_array(row, "anchors", "bool"))
            if len(at):
                n, ids, labels = len(at), _array(row, "ids", "int64")[at], _array(row, "labels", "int64")[at]
                ints, turned = (np.frombuffer(row[k], t).reshape(row["n"], row["d"])[at] for k, t in (("ints", "int32"), ("turned", "float32")))
                columns = {"ab": pa.array([row["block"]] * n, pa.int64()), "ai": pa.array(at, pa.int32()), "d": pa.array([row["d"]] * n, pa.int32()), "id": pa.array(ids), "label": pa.array(labels)}
                yield pa.RecordBatch.from_pydict(columns | {"ints": [x.tobytes() for x in ints], "turned": [x.tobytes() for x in turned]})


def _pack_anchors(most: int):
    """Anchors as blocks of up to ``most``, each with the (score, id) of its positives as far as they are known."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(d: int) -> pa.RecordBatch:
            rows = held.pop(d)
            known = np.full((len(rows), max([1, *(len(r["known"] or ()) for r in rows)]), 2), NONE, "int64")
            for k, r in enumerate(rows):
                for j, p in enumerate(r["known"] or ()):
                    known[k, j] = p["score"], p["id"]
            numbers = {"ab": "int64", "ai": "int32", "id": "int64", "label": "int64"}
            out = {f"a_{c}": [np.array([r[c] for r in rows], t).tobytes()] for c, t in numbers.items()}
            out |= {f"a_{c}": [b"".join(r[c] for r in rows)] for c in ("ints", "turned")}
            return pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "a_n": pa.array([len(rows)], pa.int32()), "a_known": [known.tobytes()], **out})

        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["d"], []).append(row)
                if len(held[row["d"]]) >= most:
                    yield block(row["d"])
        yield from [block(d) for d in list(held)]

    return pack


ANCHOR_BLOCK = "d int, a_n int, a_known binary, a_ab binary, a_ai binary, a_id binary, a_label binary, a_ints binary, a_turned binary"


class _Side:
    """One side of a pair of blocks: integer and turned vectors, and what is left of their lengths at each cut."""

    def __init__(self, ints: bytes, turned: bytes, n: int, d: int):
        self.ints, self.turned = np.frombuffer(ints, "int32").reshape(n, d), np.frombuffer(turned, "float32").reshape(n, d)
        self.cuts = sorted({max(1, d // 4), max(1, d // 2), d}) if d else [0]
        squares = np.cumsum(self.turned[:, ::-1].astype("float64") ** 2, 1)[:, ::-1] if d else np.zeros((n, 0))
        self.length = np.sqrt(np.einsum("ij,ij->i", self.ints, self.ints, dtype="float64")) * (1 + 1e-6)
        self.left = [np.sqrt(squares[:, c]) * (1 + 1e-6) if c < d else np.zeros(n) for c in self.cuts]


def surviving(a: _Side, b: _Side, barred: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:
    """(columns of b, exact products with them): NONE where a pair is barred or was discarded.

    wanted(lower, upper) tells from bounds on the products which pairs are still of interest; barred pairs have bounds
    of minus infinity."""
    d = a.ints.shape[1]
    kept, sums, done = np.arange(b.ints.shape[0]), np.zeros(barred.shape, "float32"), 0
    slack = (d + 16) * 2.0**-23 * a.length
    alive = ~barred
    for level, cut in enumerate(a.cuts):
        sums = sums + a.turned[:, done:cut] @ b.turned[kept, done:cut].T
        done = cut
        room = (a.left[level][:, None] * b.left[level][kept] + slack[:, None] * b.length[kept] + 1e-3).astype("float32")
        lower, upper = np.where(alive, sums - room, -np.inf), np.where(alive, sums + room, -np.inf)
        alive &= wanted(lower, upper)
        some = alive.any(0)
        if not some.all():
            kept, sums, alive = kept[some], sums[:, some], alive[:, some]
    exact = np.full(alive.shape, NONE, "int64")
    if alive.size and float(a.length.max()) * float(b.length[kept].max(initial=0)) < 2.0**52 and alive.mean() > 0.02:
        # Products and sums of integers below 2^53 are exact in doubles.
        exact[alive] = (a.ints.astype("float64") @ b.ints[kept].astype("float64").T)[alive].astype("int64")
    elif alive.size:
        x, y = np.nonzero(alive)
        for at in range(0, len(x), 1 << 16):
            i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
            exact[i, j] = np.einsum("ij,ij->i", a.ints[i].astype("int64"), b.ints[kept[j]].astype("int64"))
    return kept, exact


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The kth largest of each row, the smallest possible value where a row has fewer."""
    least = NONE if values.dtype == np.int64 else -np.inf
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] >= k else np.full(values.shape[0], least, values.dtype)


class _Best:
    """The k largest scores of each of n slots, the smaller id first among equals."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.k = np.full((n, k), NONE, "int64"), np.full((n, k), NO_ID, "int64"), k

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each slot, NONE where there is none, in columns ordered by ids."""
        last = _kth(scores, self.k)[:, None]
        ties = (scores == last) & (scores > NONE)
        few = (scores > last) | (ties & (np.cumsum(ties, 1) <= self.k))
        x, y = np.nonzero(few)
        slot = np.concatenate([slots[x], np.repeat(slots, self.k)])
        score = np.concatenate([scores[x, y], self.scores[slots].ravel()])
        rows = np.concatenate([ids[y], self.ids[slots].ravel()])
        order = np.lexsort((rows, -score.astype("float64"), slot)) if not len(score) or np.abs(score[score > NONE]).max(initial=0) < 2**52 else np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -int(score[i]), rows[i])))
        slot, score, rows = slot[order], score[order], rows[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = rank < self.k
        self.scores[slot[top], rank[top]], self.ids[slot[top], rank[top]] = score[top], rows[top]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict, _Side, _Side]]:
    for batch in batches:
        for row in batch.to_pylist():
            d = row["d"]
            a = {c: np.frombuffer(row[f"a_{c}"], t) for c, t in (("ab", "int64"), ("ai", "int32"), ("id", "int64"), ("label", "int64"))}
            a["known"] = np.frombuffer(row["a_known"], "int64").reshape(row["a_n"], -1, 2)
            b = {"ids": np.frombuffer(row["ids"], "int64"), "labels": np.frombuffer(row["labels"], "int64"), "block": row["block"]}
            yield a | {"no": row["no"]}, b, _Side(row["a_ints"], row["a_turned"], row["a_n"], d), _Side(row["ints"], row["turned"], row["n"], d)


def _columns(**arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in arrays.items()})


POSITIVES = "ab long, ai int, score long, id long"


def _positives(k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[dict, _Best]] = {}
        for a, b, left, right in _pairs(batches):
            _, had = found.setdefault(a["no"], (a, _Best(len(a["ab"]), k)))
            barred = a["label"][:, None] != b["labels"]
            own = np.flatnonzero(a["ab"] == b["block"])
            barred[own, a["ai"][own]] = True

            def wanted(lower: np.ndarray, upper: np.ndarray, had=had) -> np.ndarray:
                least = np.maximum(_kth(lower, k), np.where(had.scores[:, -1] > NONE, had.scores[:, -1] - 0.5, -np.inf))
                return (upper >= least[:, None]) & (upper > -np.inf)

            kept, exact = surviving(left, right, barred, wanted)
            had.add(np.arange(len(a["ab"])), exact, b["ids"][kept])
        for a, had in found.values():
            x, y = np.nonzero(had.scores > NONE)
            yield _columns(ab=a["ab"][x], ai=a["ai"][x], score=had.scores[x, y], id=had.ids[x, y])
        release()

    return best


def _hundredths(scores: np.ndarray, share: int) -> np.ndarray:
    """share * scores // 100 without leaving 64 bits."""
    return share * (scores // 100) + share * (scores % 100) // 100


NEGATIVES = "ab long, ai int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _negatives(k: int, low: int, high: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[dict, _Best]] = {}
        for a, b, left, right in _pairs(batches):
            scores = a["known"][:, :, 0]
            n, places = scores.shape
            _, had = found.setdefault(a["no"], (a, _Best(n * places, k)))
            real = scores > NONE
            # 50 * positive <= 100 * negative <= 95 * positive, as bounds on whole numbers
            floor, roof = np.where(real, -_hundredths(-scores, low), 1), np.where(real, _hundredths(scores, high), 0)

            def wanted(lower: np.ndarray, upper: np.ndarray, had=had, floor=floor, roof=roof, n=n, places=places) -> np.ndarray:
                out = np.zeros(lower.shape, bool)
                for j in range(places):
                    lo, hi = floor[:, j, None], roof[:, j, None]
                    sure = np.where((lower >= lo) & (upper <= hi), lower, -np.inf)
                    last = had.scores.reshape(n, places, k)[:, j, -1]
                    least = np.maximum(_kth(sure, k), np.where(last > NONE, last - 0.5, -np.inf))[:, None]
                    out |= (lower <= hi) & (upper >= np.maximum(lo, least))
                return out & (upper > -np.inf)

            kept, exact = surviving(left, right, a["label"][:, None] == b["labels"], wanted)
            for j in range(places):
                inside = (exact >= floor[:, j, None]) & (exact <= roof[:, j, None]) & (exact > NONE)
                had.add(np.arange(n) * places + j, np.where(inside, exact, NONE), b["ids"][kept])
        for a, had in found.values():
            x, y = np.nonzero(had.scores > NONE)
            places = a["known"].shape[1]
            at, j = x // places, x % places
            yield _columns(
                ab=a["ab"][at], ai=a["ai"][at], place=j.astype("int32"), anchor_id=a["id"][at], positive_id=a["known"][at, j, 1],
                positive_score=a["known"][at, j, 0], negative_id=had.ids[x, y], negative_score=had.scores[x, y],
            )
        release()

    return best


def _met(blocks: DataFrame, anchors: DataFrame, most: int, group_bytes: int, function, schema: str, name: str) -> DataFrame:
    """What ``function`` makes of all pairs of blocks, a written table. anchors: rows of ANCHORS plus ``known``."""
    spark = blocks.sparkSession
    total, d = anchors.agg(F.count("*"), F.coalesce(F.max("d"), F.lit(0))).first()
    per = max(1, min(most, BLOCK_BYTES // (8 * d + 64)))
    packed = anchors.repartition(max(1, -(-total // per)), "ab", "ai").mapInArrow(_pack_anchors(per), ANCHOR_BLOCK)
    packed = written(packed.withColumn("made", F.monotonically_increasing_id()), f"{name}-anchors")
    order = packed.select("made", F.row_number().over(Window.orderBy("made")).alias("no"))  # a row a block of anchors
    packed = written(packed.join(order, "made").drop("made"), f"{name}-numbered")
    size, count = packed.agg(F.coalesce(F.sum(F.octet_length("a_ints") * 2 + 64 * F.col("a_n")), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-size // group_bytes))
    out = new_path(spark, name)
    for g in range(groups):
        some = packed.filter((F.col("no") - 1) * groups >= g * count).filter((F.col("no") - 1) * groups < (g + 1) * count)
        pairs = blocks.drop("anchors").join(F.broadcast(some), "d")  # at most group_bytes
        pairs.mapInArrow(function, schema).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchor_block: int = 1024, group_bytes: int = 64 << 20) -> DataFrame:
    """For every row where ``anchor`` holds and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of another label whose score lies between low and high hundredths of the positive's: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Scores are integer inner products; higher ones come
    first, then smaller ids."""
    spark = rows.sparkSession
    bound_batches(spark)
    read = rows.select(rows[f"`{id_col}`"].cast("long").alias("id"), rows[f"`{label_col}`"].cast("long").alias("label"), rows[f"`{vector_col}`"].cast("array<double>").alias("vector"), anchor.alias("anchor"))
    packed = read.mapInArrow(_packer(rotations(read)), PACKED)
    blocks = written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    anchors = written(blocks.mapInArrow(_unpack_anchors, ANCHORS), "anchors")
    unknown = F.lit(None).cast("array<struct<score:bigint,id:bigint>>")
    near = _met(blocks, anchors.withColumn("known", unknown), anchor_block, group_bytes, _positives(positives), POSITIVES, "positives")
    first = Window.partitionBy("ab", "ai").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    known = F.transform(F.array_sort(F.collect_list(F.struct("place", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id")))
    near = near.groupBy("ab", "ai").agg(known.alias("known"))
    found = _met(blocks, written(anchors.join(near, ["ab", "ai"]), "known"), anchor_block, group_bytes, _negatives(negatives, low, high), NEGATIVES, "negatives")
    rank = F.row_number().over(Window.partitionBy("ab", "ai", "place").orderBy(F.desc("negative_score"), "negative_id")).alias("rank")
    ids = [F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c) for c in ("anchor_id", "positive_id", "negative_id")]
    return found.select(ids[0], ids[1], rank, ids[2], "positive_score", "negative_score").filter(F.col("rank") <= negatives)
