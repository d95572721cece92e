"""Near-duplicate vectors by a forest of random-projection trees.

1. Vectors of equal label and components become one node each, so copies cost one row. Vectors of different lengths
   are never compared: label and length together are what a tree is grown for.
2. Every vector is projected on a bank of random directions in one pass. A tree node's own direction is a sum of
   the bank's with random signs, drawn from the tree and the node, so nodes split independently of each other.
3. Level by level, each tree node with more than ``leaf`` rows splits at the median of its projection. Rows within a
   band around the median go to both sides (spill), so a pair of linked vectors is seldom separated: the band is
   half the standard deviation of a linked pair's difference. A node whose rows lie as close together as linked
   vectors do is not split: nearly all of its pairs are links.
4. Vectors of a leaf are compared in double precision. A leaf of more than ``block`` rows is compared in blocks,
   every pair of blocks in a group of its own, so no group exceeds two blocks whatever the leaf's size.
5. Pairs are verified, counted and united inside the group: what leaves it is one row for each vector, with the number
   of its links and the smallest id it is connected to. A pair that shares several leaves is counted in the first of
   them: vectors carry the list of their leaves.

Every pair that shares a leaf in any tree is found, and nothing below the threshold is linked. What can be missed
is a pair that all trees separate. A linked pair at the threshold is separated by one tree level with a probability
of about one in a hundred where the data are spread as wide as random ones, up to one in ten where they barely are
wider than a linked pair; by all trees, that to the power of their number. Recall is measured in the tests.

Defined cases: a vector that is null, zero, empty or holds a null or non-finite number, or whose label is null, links
with nothing; repeated rows and copies link with each other; rows with equal ids and different vectors are vectors of
their own, and each of these rows gets the sum of their links and the smallest of their components; a null id links
with nothing; other columns are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, scratch, with_groups, written
from tidemark.llm.components import components

BANK = 48  # at most 63: a node's signs are the bits of one hash
SLICE = 512


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """members (id, h, g, copies) of all rows that may link, and nodes (h, g, rep, label, dim, v, copies): h and g
    are the 128 bits that name a node, rep is its smallest id."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.withColumns({"dim": F.size("v"), "h": F.xxhash64("label", "v"), "g": F.xxhash64(F.lit(1), "label", "v")})
    keys = written(rows.select("id", "h", "g"), "vector-keys")
    same = written(keys.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    twins = with_groups(keys, same.filter("copies > 1"), ["h", "g"], "copies", keys.count(), ["id"]).select("id", "h", "g", "copies")
    single = same.filter("copies = 1").select(F.col("rep").alias("id"), "h", "g", "copies")
    classes = same.select(F.col("h").alias("_h"), F.col("g").alias("_g"), "rep", "copies")
    first = rows.join(classes, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")) & (F.col("id") == F.col("rep")))
    nodes = first.select("h", "g", "rep", "label", "dim", "v", "copies").dropDuplicates(["h", "g"])
    return twins.unionByName(single).distinct(), written(nodes, "vectors")


def _project(nodes: DataFrame, seed: int) -> DataFrame:
    """(h, g, label, dim, p): each node's projections on the bank."""

    def project(batches):
        banks: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in banks:
                    directions = np.random.default_rng([seed, dim]).standard_normal((dim, BANK))
                    banks[dim] = directions / np.sqrt((directions**2).sum(axis=0))
                some = batch.filter(pa.array(dims == dim))
                p = (_matrix(some.column(4), dim) @ banks[dim]).astype(np.float32).reshape(-1)
                lists = pa.ListArray.from_arrays(np.arange(0, len(p) + 1, BANK, dtype=np.int32), pa.array(p))
                yield pa.RecordBatch.from_arrays([*some.columns[:4], lists], names=["h", "g", "label", "dim", "p"])

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("h", "g", "label", "dim", "v").mapInArrow(project, f"h long, g long, label {label}, dim int, p array<float>")


def _leaves(rows: DataFrame, trees: int, depth: int, leaf: int, threshold: float, seed: int) -> DataFrame:
    """(h, g, label, dim, tree, node, rows): the leaves each vector belongs to, and how many vectors each holds."""
    keys = ["label", "dim", "tree", "node"]
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(1).cast("long"))
    difference = F.sqrt(F.lit(2 - 2 * threshold) / F.col("dim"))
    signed = "aggregate(transform(p, (x, k) -> if(shiftright(way, k) & 1 = 0, x, -x)), 0D, (a, x) -> a + x)"
    done = None
    for level in range(depth + 1):
        rows = rows.withColumn("way", F.xxhash64("tree", "node", F.lit(seed))).withColumn("here", F.expr(signed) / math.sqrt(BANK)).drop("way")
        rows = written(rows, f"trees{level}")
        stats = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.percentile_approx("here", [0.35, 0.5, 0.65], 1000).alias("q"))
        both = written(rows.join(stats, keys), f"nodes{level}")
        spread = F.element_at("q", 3) - F.element_at("q", 1)
        rest = (F.col("rows") > leaf) & (spread > difference)
        ended = both.filter(~rest) if level < depth else both
        ended = ended.select("h", "g", *keys, "rows")
        done = ended if done is None else done.unionByName(ended)
        if level == depth or both.filter(rest).isEmpty():
            break
        middle, band = F.element_at("q", 2), F.least(difference / 2, spread * 0.35)
        low = F.when(F.col("here") <= middle + band, F.col("node") * 2)
        high = F.when(F.col("here") >= middle - band, F.col("node") * 2 + 1)
        sides = F.explode(F.array_compact(F.array(low, high))).alias("node")
        rows = both.filter(rest).select("h", "g", "label", "dim", "tree", sides, "p")
    return done


def _shared_before(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of vectors, given by the lists of their earlier leaves, share one."""
    out = np.zeros((len(left), len(right)), bool)

    def holders(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
        if not lists or not (flat := np.concatenate(lists)).size:
            return {}
        who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        codes, at = np.unique(flat[order], return_index=True)
        return dict(zip(codes.tolist(), np.split(who[order], at[1:]), strict=True))

    theirs = holders(right)
    for code, mine in holders(left).items():
        if code in theirs:
            out[np.ix_(mine, theirs[code])] = True
    return out


def _roots(linked: np.ndarray, across: bool) -> np.ndarray:
    """For each vector the first one it is connected to. linked: vectors by vectors, or, across, those of the left
    block by those of the right one, which are numbered after them."""
    n, m = linked.shape
    size = n + m if across else n
    root = np.full(size, -1)
    for start in range(size):
        if root[start] >= 0:
            continue
        front = np.array([start])
        root[start] = start
        while len(front):
            if across:
                a, b = front[front < n], front[front >= n] - n
                reached = np.concatenate([np.flatnonzero(linked[:, b].any(axis=1)), n + np.flatnonzero(linked[a].any(axis=0))])
            else:
                reached = np.flatnonzero(linked[front].any(axis=0))
            front = reached[root[reached] < 0]
            root[front] = start
    return root


def _linked(leaves: DataFrame, nodes: DataFrame, block: int, threshold: float) -> DataFrame:
    """(h, g, rep, links, root): for each group that a vector was compared in, its links that no earlier leaf has
    counted, copies of the other vector included, and the smallest rep that the group connects it to."""
    code = F.shiftleft(F.col("tree").cast("long"), 32) + F.col("node")
    held = leaves.groupBy("h", "g").agg(F.sort_array(F.collect_list(code)).alias("codes"))
    own = F.pmod(F.xxhash64("h", "g", F.lit(5)), F.col("blocks")).cast("int")
    spread = leaves.withColumn("code", code).withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")).withColumn("own", own)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["label", "dim", "code", "i", "j"]
    placed = spread.select("h", "g", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    full = placed.join(nodes.join(held, ["h", "g"]), ["h", "g"]).select(*keys, "own", "h", "g", "rep", "v", "copies", "codes")
    rep_type = nodes.schema["rep"].dataType.simpleString()

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rep", "ascending"), ("h", "ascending"), ("g", "ascending")]).combine_chunks()
        dim, code, i, j = (rows[c][0].as_py() for c in ("dim", "code", "i", "j"))
        copies, own = rows["copies"].to_numpy(), rows["own"].to_numpy()
        x = _matrix(rows["v"].combine_chunks(), dim)
        earlier = [c[c < code] for c in rows["codes"].to_numpy()]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        before = _shared_before([earlier[k] for k in left], [earlier[k] for k in right])
        linked, links = np.zeros(before.shape, bool), np.zeros(len(x), np.int64)
        for at in range(0, len(left), SLICE):
            some = left[at : at + SLICE]
            linked[at : at + SLICE] = x[some] @ x[right].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
            linked |= linked.T
        new = linked & ~before
        links[left] += new @ copies[right]
        if i != j:
            links[right] += copies[left] @ new
        order = left if i == j else np.concatenate([left, right])
        root = np.empty(len(x), np.int64)
        found = _roots(linked, i != j)
        least = np.full(len(order), len(x))
        np.minimum.at(least, found, order)  # rows are in order of rep
        root[order] = least[found]
        some = np.flatnonzero((links > 0) | (root != np.arange(len(x))))
        out = rows.select(["h", "g", "rep"]).take(pa.array(some))
        return out.append_column("links", pa.array(links[some])).append_column("root", rows["rep"].take(pa.array(root[some])))

    return written(full.groupBy(*keys).applyInArrow(compare, f"h long, g long, rep {rep_type}, links long, root {rep_type}"), "links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, trees: int = 6, leaf: int = 1000, depth: int = 24, seed: int = 11, block: int = 4096) -> DataFrame:
    """Per row: its id, n_links, component_id (smallest id reachable by links), kept."""
    bound_batches(vectors.sparkSession)
    with scratch(vectors.sparkSession):
        members, nodes = _nodes(vectors, id_col, vector_col, label_col)
        found = _linked(_leaves(_project(nodes, seed), trees, depth, leaf, threshold, seed), nodes, block, threshold)
        links = found.groupBy("h", "g").agg(F.sum("links").alias("others"))
        roots = components(found.select("rep", "root"), "rep", "root").select(F.col("node").alias("rep"), "root")
        classes = nodes.select("h", "g", "rep").join(links, ["h", "g"], "left").join(roots, "rep", "left")
        classes = classes.select("h", "g", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "rep").alias("component"))
        sized = classes.join(members.groupBy("h", "g").agg(F.count("*").alias("members")), ["h", "g"])
        per = with_groups(members, sized, ["h", "g"], "members", vectors.count(), ["id"])
        per = per.groupBy("id").agg(F.sum(F.col("others") + F.col("copies") - 1).alias("links"), F.min("component").alias("component"))
        ids = vectors.select(F.col(f"`{id_col}`").alias("_id"))
        out = ids.join(per, F.col("_id") == F.col("id"), "left")
        component = F.coalesce("component", "_id")
        out = out.select(F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
        return written(out, "vector-links", keep=True)
