"""Small cases with results derived by hand or from the definitions."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import intervals, reads
from tidemark.operators import annotation, duplicates, joins, overlay, recurrence, segment, sequence, signal, simulate, spectral, stats, windows

FRAGMENTS = [("1", 100, 260), ("1", 150, 270), ("1", 300, 420), ("1", 300, 419)]


@pytest.fixture(scope="module")
def fragments(spark):
    return spark.createDataFrame(FRAGMENTS, "chrom string, s long, e long")


@pytest.fixture(scope="module")
def track(fragments):
    return {r["pos"]: r for r in signal.full_track(fragments, 1, 600).collect()}


def test_coverage_ends_score(track):
    cov = {99: 0, 100: 1, 200: 2, 260: 2, 261: 1, 300: 2, 419: 2, 420: 1, 421: 0}
    wps = {40: 0, 41: -1, 159: -2, 160: 0, 200: 0, 201: -2, 210: 0, 211: -2, 240: -2, 359: -2, 360: 0, 361: -2, 479: -1, 480: 0}
    ends = {100: 1, 150: 1, 260: 1, 270: 1, 300: 2, 419: 1, 420: 1}
    assert {p: track[p]["cov"] for p in cov} == cov
    assert {p: track[p]["wps"] for p in wps} == wps
    assert {p: r["ends"] for p, r in track.items() if r["ends"]} == ends
    assert sum(r["cov"] for r in track.values()) == sum(e - s + 1 for _, s, e in FRAGMENTS)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 60)), min_size=1, max_size=30), st.sampled_from([2, 16, 40]), st.sampled_from([16, 1000]))
def test_score_by_definition(spark, rows, protection, tile):
    frags = spark.createDataFrame([("1", s, s + n) for s, n in rows], "chrom string, s long, e long")
    fast = {r["pos"]: r["wps"] for r in signal.full_track(frags, 1, 400, protection, tile).collect()}
    positions = spark.range(1, 401).select(F.lit("1").alias("chrom"), F.col("id").alias("pos"))
    slow = {r["pos"]: r["wps"] for r in signal.score_literal(frags, positions, protection, 32).collect()}
    assert fast == slow


def test_savgol_weights():
    assert windows.savgol_weights() == pytest.approx([(329 - 5 * k * k) / 3059 for k in range(-10, 11)])


def median_at(values, size=1000):
    n, half = len(values), size // 2
    if n < size:
        return {}
    out = {i: float(np.median(values[(c := min(max(i, half), n - half)) - half : c + half])) for i in range(n)}
    if n == size:
        out.pop(0)
    return out


@pytest.mark.parametrize("n", [999, 1000, 1001, 2300])
def test_running_median(spark, n):
    values = [(k * 7919) % 1013 for k in range(n)]
    rows = spark.createDataFrame([("b", k + 5, v) for k, v in enumerate(values)], "block string, pos long, v long")
    for native in (False, True):
        out = windows.running_median(rows, "v", ["block"], tile=700, native=native)
        assert {r["pos"] - 5: r["median"] for r in out.collect()} == median_at(values)


def test_smooth_edges(spark):
    values = [float((k * k) % 17) for k in range(60)]
    rows = windows.placed(spark.createDataFrame([("b", k, v) for k, v in enumerate(values)], "block string, pos long, v double"), ["block"])
    got = {r["pos"]: r["smooth"] for r in windows.smooth(rows, "v", ["block"], tile=25).collect()}
    w = windows.savgol_weights()
    for i in range(60):
        left = [values[i] - abs(values[i + k] - values[i]) if i < 10 else values[i - k] for k in range(10, 0, -1)]
        right = [values[i] + abs(values[i - k] - values[i]) if i > 49 else values[i + k] for k in range(1, 11)]
        assert got[i] == pytest.approx(np.dot(w, [*left, values[i], *right]))


def test_runs_bridge_four(spark):
    rows = spark.createDataFrame([("1", p, 1.0) for p in (10, 15, 30, 36)], "chrom string, pos long, v double")
    for tile in (8, 1 << 16):
        out = segment.islands(rows, ["chrom"], "pos", 5, "run", tile)
        assert {r["pos"]: r["run"] for r in out.collect()} == {10: 10, 15: 10, 30: 30, 36: 36}
    dense = segment.runs(rows, "v", ["chrom"])
    assert [(r["pos"], r["v"]) for r in dense.filter("run = 10").orderBy("pos").collect()] == [(10, 1.0), (11, 0.0), (12, 0.0), (13, 0.0), (14, 0.0), (15, 1.0)]


def test_run_median_and_windows(spark):
    assert spark.range(1).select(segment.run_median(F.array(*[F.lit(float(x)) for x in (4, 1, 3, 2)]))).first()[0] == 3
    assert spark.range(1).select(segment.run_median(F.array(*[F.lit(float(x)) for x in (3, 1, 2)]))).first()[0] == 2.5

    def cut(pairs, compat):
        array = F.array(*[F.struct(F.lit(p).cast("long").alias("pos"), F.lit(float(v)).alias("v")) for p, v in pairs])
        return [tuple(w) for w in spark.range(1).select(segment._windows(array, compat)).first()[0]]

    assert cut([(1, 1), (2, 1), (3, 1), (5, 9), (7, 2), (8, 2)], True) == [(3, 1, 3, 1), (4, 7, 8, 2)]
    assert cut([(1, 1), (2, 1), (4, 5), (5, 6), (6, 7)], True) == [(2, 1, 2, 1), (13, 5, 6, 7)]
    assert cut([(1, 1), (2, 1), (4, 5), (5, 6), (6, 7)], False) == [(2, 1, 2, 1), (18, 4, 6, 7)]


def test_midpoint_and_buckets(spark):
    assert spark.range(1).select(intervals.peak_mid(F.lit(100), F.lit(151))).first()[0] == 126
    rows = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "v double")
    got = {r["v"]: r["percentile"] for r in stats.percentile_buckets(rows, "v").collect()}
    assert (got[10], got[20], got[50]) == (0, 25, 99)


def test_nearest_both_sides(spark):
    sites = spark.createDataFrame([(1, "1", 100), (2, "1", 90), (3, "2", 5), (4, "1", 3_000_000), (5, "1", 9_000_000)], "site long, chrom string, c long")
    peaks = spark.createDataFrame([("1", 90), ("1", 110), ("1", 8_000_000)], "chrom string, t long")
    got = {r["site"]: (r["before"], r["after"]) for r in joins.nearest(sites, peaks, "chrom", "c", "t").collect()}
    assert got == {1: (90, 110), 2: (90, 110), 3: (None, None), 4: (110, 8_000_000), 5: (8_000_000, None)}


def test_spacing_bins(spark):
    peaks = spark.createDataFrame([("1", p) for p in (100, 290, 500, 900, 100_000, 100_150)], "chrom string, pos long")
    lengths = spark.createDataFrame([("1", 150_000)], "chrom string, length long")
    got = [(r["start"], r["stop"], r["median"]) for r in stats.spacing_bins(peaks, lengths, "chrom", "pos", "length").orderBy("start").collect()]
    assert got == [(0, 100_000, 200.0), (100_000, 150_000, None)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 120), st.integers(1, 20)), min_size=1, max_size=40), st.sampled_from([10, 1 << 16]))
def test_merged_intervals_are_disjoint_and_cover(spark, rows, tile):
    frame = spark.createDataFrame([("k", s, s + n) for s, n in rows], "key string, start long, end long")
    out = sorted((r["start"], r["end"], r["n"]) for r in segment.merge_intervals(frame, ["key"], tile=tile).collect())
    assert all(a[1] <= b[0] for a, b in zip(out, out[1:], strict=False)) and sum(r[2] for r in out) == len(rows)
    cover = lambda spans: {x + 0.5 for s, e, *_ in spans for x in range(s, e)}
    assert cover(out) == cover([(s, s + n) for s, n in rows])


def test_gene_windows(spark):
    at = lambda s, e, strand: tuple(spark.range(1).select(intervals.body(F.lit(s), F.lit(e), F.lit(strand))).first()[0])
    assert at(5000, 9000, "+") == (4999, 14999) and at(20_000, 30_000, "-") == (19_999, 29_999)


def test_counted_ends(spark):
    cases = [("M_x", False, 50, False), ("T_x", False, 60, False), ("x", False, 50, False), ("x", True, 50, False), ("x", True, 50, True), ("T_x", False, 70, False)]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, name string, reverse boolean, qlen int, paired boolean")
    ends = reads.counted_ends(F.lit(1), F.lit(9), F.col("name"), F.col("reverse"), F.col("qlen"), F.col("paired"))
    assert [r[0] for r in frame.orderBy("k").select(ends).collect()] == [[1, 9], [1, 9], [1], [9], [1, 9], [1]]


def test_cigar_and_lengths(spark):
    frame = spark.createDataFrame([("5S90M2D3I1P", -1500), ("100M", 0), ("*", 167), (None, 1)], "c string, isize int")
    parsed = reads.parse_cigar(F.col("c"))
    rows = frame.select(reads.clipped(parsed), reads.reference_length(parsed), reads.query_length(parsed), reads.clamp_length(F.col("isize"))).collect()
    assert [tuple(r) for r in rows] == [(True, 93, 98, 1000), (False, 100, 100, 1000), (None, None, None, 167), (None, None, None, 1)]


def test_reverse_complement_and_names(spark):
    row = spark.range(1).select(reads.reverse_complement(F.lit("ACGN")), reads.chrom_name(F.lit("gi|1|ref|NC_000012.11|")), reads.chrom_name(F.lit("chr7")), intervals.cluster_label(F.lit("c12-T-box"), F.lit("12")), reads.valid_bases(F.lit("ACGT\n")))
    assert tuple(row.first()) == ("NCGT", "12", "7", "T-box", False)


def test_minus_strand_is_mirrored(spark):
    tracked = spark.createDataFrame([("1", p, p) for p in range(1, 60)], "chrom string, pos long, v long")
    sites = spark.createDataFrame([(1, "n", "1", 20, "+"), (2, "n", "1", 20, "-"), (3, "n", "1", 3, "+")], "site long, name string, chrom string, c long, strand string")
    out = {(r["site"], r["offset"]): r["v"] for r in overlay.around(sites, tracked, "v", 5, tile=16).collect()}
    assert [out[1, k] for k in range(-4, 6)] == list(range(16, 26))
    assert [out[2, k] for k in range(-4, 6)] == list(range(25, 15, -1)) and len(out) == 20


def test_leave_one_out(spark):
    rows = spark.createDataFrame([("n", b, 0, b * b) for b in range(10)], "name string, bin int, offset long, total long")
    out = overlay.leave_one_out(rows).collect()
    assert sum(r["rest"] for r in out) == 9 * sum(b * b for b in range(10))


def test_quantile_bins_keep_ties_together(spark):
    rows = spark.createDataFrame([(0.0,)] * 30 + [(float(k),) for k in range(1, 71)], "v double")
    sizes = {r["bin"]: r["count"] for r in stats.quantile_bins(rows, "v").groupBy("bin").count().collect()}
    assert sizes[1] == 30 and sum(sizes.values()) == 100 and 2 in sizes or sizes[1] >= 30


def test_spectrum_grid():
    freq, power = spectral.periodogram(np.sin(np.arange(10_001) * 2 * np.pi / 190))
    periods = 1 / freq
    inside = (periods >= 120) & (periods <= 280)
    assert spectral.smooth_length(int(10_001 * 1.3)) == 13_122 and inside.sum() == 63
    assert {193, 196, 199} <= set(np.round(periods[inside]).astype(int)) and abs(periods[inside][power[inside].argmax()] - 190) < 3


def test_recursive_filter():
    x, w = [1.0, 0.0, 0.0, 2.0], [0.5, 0.25]
    assert recurrence.recursive_filter(x, w).tolist() == [1.0, 0.5, 0.5, 2.375]
    many, weights = np.random.default_rng(3).normal(size=(3, 500)), spectral.FILTER
    for tile in (24, 31, 128, 700):
        got = recurrence.recursive_filter(many, weights, tile)
        for row, y in zip(many, got, strict=True):
            slow = []
            for v in row:
                slow.append(v + sum(a * b for a, b in zip(weights, reversed(slow), strict=False)))
            assert y == pytest.approx(slow, rel=1e-12, abs=1e-12)


def test_consensus_and_settle(spark):
    rows = [("g", 1, "ACGT", "IIII", 60), ("g", 2, "ACGA", "!!!#", 50), ("g", 3, "ACGT", "IIII", 40), ("h", 4, "AN", "5!", 9), ("n", 5, "NA", "#I", 9), ("n", 6, "NA", "#I", 8)]
    frame = spark.createDataFrame(rows, "key string, k long, seq string, qual string, mapq int")
    called = {r["key"]: r for r in duplicates.consensus(frame, ["key"], "seq", "qual").collect()}
    assert called["g"]["consensus"] == "ACGT" and called["h"]["consensus"] == "AN" and called["h"]["consensus_qual"] == "5!" and called["n"]["consensus"] == "NA"
    settled = {r["key"]: r for r in duplicates.settle(frame, duplicates.consensus(frame, ["key"], "seq", "qual"), ["key"], "seq", "k", "mapq").collect()}
    assert (settled["g"]["unmapped"], settled["g"]["min_mapq"], settled["g"]["first"]) == (False, 40, 1)


def test_simulation(spark):
    assert simulate.corrections(1.0, 8, 5) == (1.0, 1 / 64) and simulate.corrections(2.0, 8, 5) == (2.0, 1.0)
    lengths = spark.createDataFrame([(10, 1), (20, 2), (30, 1)], "length int, n long")
    rows = spark.createDataFrame([(0.0,), (0.25,), (0.26,), (0.75,), (0.99,)], "u double")
    assert [r["length"] for r in simulate.draw_length(rows, lengths, F.col("u")).orderBy("u").collect()] == [10, 10, 20, 20, 30]
    made = simulate.trials(spark.range(50).withColumnRenamed("id", "pos"), 30, F.array(F.lit("+"), F.lit("-")))
    assert made.count() == 50 * 30
    kept = simulate.sample(made, 0.3, simulate.hashed("pos", "strand", "trial")).count()
    assert 350 < kept < 550
    rates = spark.createDataFrame([("AC", 1.0)], "kmer string, rate double")
    assert simulate.accepted(spark.createDataFrame([("AC",), ("GT",)], "k string"), rates, "k", F.lit(0.5), 1.0).count() == 1


def test_motif_merge_keeps_the_first_offset(spark):
    hits = spark.createDataFrame([("1", 100, 110, "p1", "+"), ("1", 105, 120, "p1", "-"), ("1", 120, 130, "p1", "+"), ("1", 1, 9, "zz", "+")], "chrom string, start long, end long, pwm string, strand string")
    motifs = spark.createDataFrame([("p1", "T-box", "+", 3)], "pwm string, cluster string, motif_strand string, offset int")
    known, unknown = annotation.motif_hits(hits, motifs)
    assert sorted((r["start"], r["end"], r["offset"], r["strand"]) for r in annotation.unify_motifs(known).collect()) == [(100, 120, 3, "+"), (120, 130, 3, "+")]
    assert [r["pwm"] for r in unknown.collect()] == ["zz"]


def test_composition_grid_is_full(spark):
    rows = spark.createDataFrame([("x", "AACG")], "kind string, context string")
    out = {(r["base"], r["offset"]): r["share"] for r in sequence.composition(rows, "kind", "context", 2).collect()}
    assert len(out) == 16 and out["A", -2] == 1 and out["C", 1] == 1 and out["T", 2] == 0


def test_acceptance_scales_to_one(spark):
    seen = spark.createDataFrame([("AA", 8), ("AC", 2)], "kmer string, n long")
    genome = spark.createDataFrame([("AA", 16), ("AC", 1), ("GG", 5)], "kmer string, n long")
    assert {r["kmer"]: r["rate"] for r in sequence.acceptance(seen, genome).collect()} == {"AA": 0.25, "AC": 1.0}
