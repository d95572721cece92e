"""Repeated rows, tiles, streams and spectra against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import duplicates, joins, overlay, segment, signal, stats
from tidemark.plans import registry
from tidemark.plans.relations import relation
from tidemark.sources import text
from tidemark.streaming import collapse, peaks, streams
from tidemark.streaming.medians import CentredMedian

SF = "/root/testdata/sf0.001"


def test_overlap_keeps_repeated_rows(spark):
    left = [(1, "1", 5, 9), (1, "1", 5, 9), (2, "1", 100, 4000), (2, "1", 100, 4000), (3, "1", 7000, 7001), (4, "2", 5, 9), (5, None, 1, 2), (6, "1", None, 3), (7, "1", 1020, 1030), (7, "1", 1020, 1030)]
    right = [("1", 8, 3000), ("1", 8, 3000), ("2", 10, 20)]
    a, b = spark.createDataFrame(left, "k int, chrom string, a long, b long"), spark.createDataFrame(right, "chrom string, lo long, hi long")
    hit = lambda r: any(r[1] == c and r[2] is not None and lo <= r[3] and hi >= r[2] for c, lo, hi in right)
    for anti in (False, True):
        got = joins.overlapping(a, b, "chrom", ("a", "b"), ("lo", "hi"), anti=anti)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted((r for r in left if hit(r) != anti), key=repr)


def test_nearest_k_answers_every_repeated_point(spark):
    points = spark.createDataFrame([(1, "1", 100), (1, "1", 100), (2, "1", 100), (3, "1", 500)], "site int, chrom string, c long")
    targets = spark.createDataFrame([("1", t) for t in (101, 102, 103, 104, 90)], "chrom string, t long")
    got = joins.nearest_k(points, targets, "chrom", "c", "t", 2, 50).collect()
    assert sorted((r["site"], r["side"], r["rank"], r["target"], r["spacing"]) for r in got) == sorted(
        [(s, 1, 1, 101, 1) for s in (1, 1, 2)] + [(s, 1, 2, 102, 1) for s in (1, 1, 2)] + [(s, -1, 1, 90, None) for s in (1, 1, 2)], key=lambda r: tuple(-9 if x is None else x for x in r)
    )


def test_nearest_of_many_rows_in_one_tile(spark):
    points = spark.range(60_000).selectExpr("'1' AS chrom", "id * 7 % 100003 AS c")
    targets = spark.range(60_000).selectExpr("'1' AS chrom", "id * 11 % 99991 AS t")
    got = {r["c"]: (r["before"], r["after"]) for r in joins.nearest(points, targets, "chrom", "c", "t").collect()}
    known = np.unique([k * 11 % 99991 for k in range(60_000)])
    for c in list(got)[:3000]:
        at = int(np.searchsorted(known, c, side="right"))
        assert got[c] == (known[at - 1] if at else None, known[at] if at < len(known) else None)


@pytest.mark.parametrize("tile", [3, 1 << 16])
def test_run_lengths_across_tiles(spark, tile):
    rows = [(u, "abca"[(k * k // 5 + u) % 3], k) for u in (1, 2) for k in range(60)] + [(3, None, 5), (3, None, 9), (3, "a", 11)]
    frame = spark.createDataFrame(rows, "u int, kind string, k long")
    got = sorted((r["u"], r["start"], r["kind"], r["n"]) for r in duplicates.running_groups(frame, ["kind"], "k", ["u"], tile).collect())
    expected = []
    for u in (1, 2, 3):
        mine = sorted((k, kind) for x, kind, k in rows if x == u)
        for kind, group in itertools.groupby(mine, key=lambda r: r[1]):
            group = list(group)
            expected.append((u, group[0][0], kind, len(group)))
    assert got == sorted(expected)
    whole = duplicates.running_groups(frame.filter("u = 1"), ["kind"], "k", tile=tile)
    assert sorted((r["start"], r["kind"], r["n"]) for r in whole.collect()) == sorted(e[1:] for e in expected if e[0] == 1)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=2500), np.full(1500, 0.25), rng.integers(0, 4, 700)]).tolist()
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 20, "v double").repartition(5)
    points = [k / 100 for k in range(1, 101)]
    got = stats.quantiles(frame, "v", points).first()["q"]
    assert got == pytest.approx(np.quantile(values, points).tolist())
    assert stats.quantiles(frame.filter("v IS NULL"), "v", [0.5]).first()["q"] == [None]
    assert stats.quantile_bins(frame.filter("v IS NULL"), "v").count() == 20


def test_windows_meet_few_rows_of_the_track(spark):
    track = spark.range(1, 2001).selectExpr("1 AS chrom", "id AS pos", "id * id % 31 AS wps")
    sites = spark.createDataFrame([(1, "x", 1, 500, "+"), (2, "x", 1, 640, "-"), (3, "x", 1, 10, "+")], "site int, name string, chrom int, c long, strand string")
    got = {(r["site"], r["offset"]): r["wps"] for r in overlay.around(sites, track, "wps", 50).collect()}
    expected = {(1, o): (500 + o) ** 2 % 31 for o in range(-49, 51)} | {(2, o): (641 - o) ** 2 % 31 for o in range(-49, 51)}
    assert got == expected


def batch_peaks(spark, wave, size, first=1):
    medians = registry_medians(wave, size)
    adjusted = spark.createDataFrame([("1", first + k, float(v - m)) for k, (v, m) in enumerate(zip(wave, medians, strict=True))], "chrom string, pos long, adj double")
    return sorted((r["start"], r["end"], r["mid"], round(r["score"], 6)) for r in segment.peaks(adjusted, "adj", ["chrom"]).collect())


def noisy_wave(n, seed=5):
    return (12 * np.sin(np.arange(n) / 28) + np.random.default_rng(seed).normal(0, 2, n)).round(3)


@pytest.mark.parametrize("cuts", [(700, 1501), (1, 3, 401, 402, 1000, 1100, 2599), ()])
def test_stream_peaks_are_the_batch_peaks(spark, tmp_path, cuts):
    """Several arrivals of two contigs, with runs open and windows half full between them, to the end of input."""
    waves = {"1": noisy_wave(2600), "2": noisy_wave(2300, 6)}
    rows = spark.createDataFrame([(c, k + 1, float(v)) for c, w in waves.items() for k, v in enumerate(w)], "chrom string, pos long, v double")
    for lo, hi in zip((0, *cuts), (*cuts, 2600), strict=True):
        rows.filter((F.col("pos") > lo) & (F.col("pos") <= hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    peaks.end_marks(rows, "chrom", rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_once(peaks.peaks(stream, "chrom", "pos", "v", 400), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    for c, w in waves.items():
        got = sorted((r["start"], r["end"], r["mid"], round(r["score"], 6)) for r in out if r["chrom"] == c)
        assert len(got) > 5 and got == batch_peaks(spark, w, 400)


def test_a_silent_key_ends_by_its_timer(spark, tmp_path):
    wave = noisy_wave(1300)
    rows = [("1", k + 1, float(v), 1000.0 + k) for k, v in enumerate(wave)]
    for name, part in (("a", rows[:700]), ("b", rows[700:]), ("c", [("2", 1, 0.0, 99_999.0)]), ("d", [("2", 2, 0.0, 100_000.0)])):
        spark.createDataFrame(part, "chrom string, pos long, v double, t double").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema("chrom string, pos long, v double, t double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = peaks.peaks(stream.withWatermark("ts", "10 seconds"), "chrom", "pos", "v", 400, ts="ts", idle=60)
    out = streams.run_once(found, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted((r["start"], r["end"], r["mid"], round(r["score"], 6)) for r in out) == batch_peaks(spark, wave, 400)


@pytest.mark.parametrize("n", [19, 20, 21, 57])
def test_centred_medians(n):
    values = [round(math.sin(k * k) * 9) for k in range(n)]
    window, got = CentredMedian(20), []
    for k, v in enumerate(values):
        got += window.push(k, v)
        window = CentredMedian(20, window.state)
    got += window.close()
    centre = lambda k: min(max(k, 10), n - 10)
    want = [(k, values[k], float(np.median(values[centre(k) - 10 : centre(k) + 10]))) for k in range(n)] if n >= 20 else []
    assert got == (want[1:] if n == 20 else want) and window.close() == []


def test_stream_collapse_is_the_batch_collapse(spark, tmp_path):
    dice, rows = random.Random(12), []
    for k in range(1500):
        chrom, pos, paired, reverse = dice.randrange(1, 4), dice.randrange(0, 3000, 30), k % 3 > 0, dice.random() < 0.5
        base = {"grp": dice.choice(["u", "v", None]), "paired": paired, "reverse": reverse, "ref_len": dice.choice([50, 60]), "unmapped": k % 41 == 0, "mate_unmapped": k % 37 == 0, "qcfail": k % 29 == 0, "cigar": dice.choice(["50M", "48M2D", None]), "quality": 1}
        rows.append({"rid": k, "qname": f"{dice.choice(['M_', ''])}{k}", "chrom": chrom, "pos": pos, "is_read1": True, **base})
        if paired and k % 5:
            rows.append({"rid": 5000 + k, "qname": rows[-1]["qname"], "chrom": chrom, "pos": pos + 90, "is_read1": False, **base, "reverse": not reverse})
    schema = "rid long, grp string, paired boolean, reverse boolean, ref_len int, unmapped boolean, mate_unmapped boolean, qcfail boolean, cigar string, chrom int, pos long, qname string, is_read1 boolean, quality int"
    names = [c.split()[0] for c in schema.split(", ")]
    rows.sort(key=lambda r: (r["chrom"], r["pos"]))
    frame = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    for k in range(0, len(rows), 301):
        spark.createDataFrame([tuple(r[c] for c in names) for r in rows[k : k + 301]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    collapse.end_marks(spark, frame.schema, 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, options in (("a", {"keep": True}), ("b", {"merged": True, "include_failed": True})):
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = streams.run_once(collapse.collapse(stream, F.col("chrom") * 100_000, 500, **options), str(tmp_path / name), str(tmp_path / f"state-{name}"))
        want = duplicates.collapse(frame, **options)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.select(*out.columns).collect()), key=repr)
        assert {r[0] for r in out.select("kind").distinct().collect()} >= {"pair", "single"}


def registry_medians(values, size):
    n, half = len(values), size // 2
    return [float(np.median(values[(c := min(max(i, half), n - half)) - half : c + half])) for i in range(n)]


def test_spectra_by_definition(spark):
    """Filter, trend, taper, transform and smoothing of every region by sums over the terms, for the score."""
    from tidemark.plans.signals import the_track
    from tidemark.operators.signal import region_track

    rows = region_track(the_track(spark, SF), relation(spark, SF, "regions")).select("cid", "rank", "wps").collect()
    got = {}
    for r in registry.queries()["op_spectral_spectra"](spark, SF).collect():
        got.setdefault(r["cid"], []).append((r["freq"], 10 ** r["log_wps"]))
    series = {}
    for r in rows:
        series.setdefault(r["cid"], {})[r["rank"]] = float(r["wps"])
    assert set(got) == set(series) and len(got) > 3
    for cid in sorted(got)[:4]:
        x = [series[cid][k] for k in sorted(series[cid])]
        weights = [1 / k for k in range(5, 101, 4)]
        y = []
        for v in x[:300] + x:
            y.append(v + sum(w * y[-j - 1] for j, w in enumerate(weights) if j < len(y)))
        y = np.array(y[300:])
        cut = int(len(y) * 0.1)
        y = y - np.sort(y)[cut : len(y) - cut].mean()
        n = len(y)
        y = y - np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n))
        m = int(n * 0.3)
        for k in range(m):
            weight = 0.5 * (1 - math.cos(math.pi * (2 * k + 1) / (2 * m)))
            y[k] *= weight
            y[n - 1 - k] *= weight
        size = int(n * 1.3)
        while not smooth_number(size):
            size += 1
        t, f = np.arange(n), np.arange(size)
        power = np.abs(np.exp(-2j * np.pi * np.outer(f, t) / size) @ y) ** 2 / n
        power[0] = 0.5 * (power[1] + power[-1])
        flat = [0.25 * power[k - 1] + 0.5 * power[k] + 0.25 * power[(k + 1) % size] for k in range(size)]
        expected = [(round(size / k), flat[k] / (1 - 5 / 8 * 0.6)) for k in range(1, size // 2 + 1) if 120 <= size / k <= 280]
        assert [g[0] for g in sorted(got[cid])] == sorted(e[0] for e in expected)
        assert [g[1] for g in sorted(got[cid])] == pytest.approx([e[1] for e in sorted(expected)], rel=1e-5)


def smooth_number(n):
    for f in (2, 3, 5):
        while n % f == 0:
            n //= f
    return n == 1


def test_missing_files_are_left_out_with_a_warning(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t4\t9\tx\t0\t+\n")
    with pytest.warns(UserWarning, match="does not exist"):
        found = text.existing(spark, str(tmp_path / "a.bed"), str(tmp_path / "b.bed"))
    assert [tuple(r) for r in text.bed(spark, found).collect()] == [("1", 5, 9, "x", "0", "+")]
    with pytest.raises(ValueError):
        text.parse_region("1:0-5")


def test_first_rows_and_extent(spark):
    rows = spark.range(10).withColumnRenamed("id", "v")
    assert stats.first_rows(rows, 3).count() == 3 and stats.first_rows(rows, 30).count() == 10
    assert tuple(stats.extent(rows, "v", spark.createDataFrame([(-4,), (None,)], "v long")).first()) == (9, -4, 41)


def test_a_shared_folder_is_asked_for_on_a_cluster(spark):
    from tidemark.plans.shared import folder

    class Elsewhere:
        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="checkpoint"):
        folder(Elsewhere(), "x")


def test_small_functions(spark):
    from tidemark.functions import intervals, reads
    from tidemark.sources import sinks

    one = spark.range(1).select(
        intervals.cluster_label(F.lit("c12-T-box"), F.lit("12")), reads.base_id(F.lit("r7/1")), duplicates.quality_sum(F.lit("I!I")), intervals.merge_key(F.lit("Tp53")),
        reads.library_group(F.lit("rg1"), F.lit(None).cast("string"), F.lit("ACG")), reads.library_group(F.lit("rg1")), intervals.file_name(F.lit("a/b::c")),
    ).first()
    assert tuple(one) == ("T-box", "r7", 73 + 33 + 73, "TP53", "ACG", "rg1", "a-b-c")
    rows = spark.createDataFrame([("x", 10, True, 30), ("y", 12, False, 28)], "k string, pos long, reverse boolean, ref_len int")
    assert [(r["dup_pos"], r["dup_len"]) for r in duplicates.single_keys(rows).orderBy("k").collect()] == [(10, 30), (12, 28)]
    assert [(r["dup_pos"], r["dup_len"]) for r in duplicates.single_keys(rows, True).orderBy("k").collect()] == [(40, None), (12, None)]
    assert [(r["k"], r["line_no"]) for r in sinks.numbered(rows.withColumn("c", F.lit(1)), ["c"], "pos").orderBy("line_no").collect()] == [("x", 1), ("y", 2)]
    kept, lines = duplicates.route(spark.createDataFrame([("a", "AAC", "ABC", True, True), ("b", "AAC", "ABC", False, False)], "qname string, seq string, qual string, reverse boolean, unmapped boolean"))
    assert [r["qname"] for r in kept.collect()] == ["b"] and [r["line"] for r in lines.collect()] == ["@a\nGTT\n+\nCBA"]


def test_collapse_of_pairs_singles_and_kept_reads(spark):
    def read(rid, name, chrom, pos, first=True, **kw):
        row = {"rid": rid, "grp": "g", "qname": name, "chrom": chrom, "pos": pos, "reverse": False, "ref_len": 10, "cigar": "10M", "quality": 5, "is_read1": first, "paired": True, "unmapped": False, "mate_unmapped": False, "qcfail": False}
        return {**row, **kw}

    rows = [
        read(1, "a", "1", 5), read(2, "a", "1", 50, False, reverse=True), read(3, "b", "1", 5), read(4, "b", "1", 50, False, reverse=True),
        read(5, "c", "1", 5), read(6, "c", "2", 50, False), read(7, "d", "1", 5, paired=False), read(8, "e", "1", 5, paired=False, quality=9), read(9, "f", "1", 5, paired=False, ref_len=12),
        read(10, "g", "1", 5, paired=False, unmapped=True), read(11, "h", "1", 7, mate_unmapped=True), read(12, "i", "1", 5, paired=False, qcfail=True), read(13, "j", "1", 5), read(14, "M_k", "3", 5, paired=False, grp="u"),
    ]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "rid long, grp string, qname string, chrom string, pos long, reverse boolean, ref_len int, cigar string, quality int, is_read1 boolean, paired boolean, unmapped boolean, mate_unmapped boolean, qcfail boolean")
    got = sorted(map(tuple, duplicates.collapse(frame, keep=True).collect()), key=repr)
    expected = [("pair", "g", "1", "1", 5, 60, "a", 2), ("pair", "g", "1", "2", 5, 50, "c", 1), ("single", "g", "1", None, 5, None, "d", 2), ("single", "g", "1", None, 5, None, "f", 1)]
    expected += [("kept", "g", "1", None, 5, None, "g", 1), ("kept", "g", "1", None, 7, None, "h", 1), ("single", "u", "3", None, 5, None, "M_k", 1)]
    assert got == sorted(expected, key=repr)
    assert {r["kind"] for r in duplicates.collapse(frame, merged=True).collect()} == {"pair", "single"}


def test_overlaps_of_rows_with_maps_and_nulls(spark):
    dice = random.Random(8)
    left = [(dice.choice(["a", "b", None]), a := dice.randrange(3000) if k % 9 else None, None if a is None or k % 11 == 0 else a + dice.randrange(700), {"k": str(k % 5)}) for k in range(300)]
    right = [(dice.choice(["a", "b", None]), c := dice.randrange(3000) if k % 6 else None, None if c is None else c + dice.randrange(60)) for k in range(25)]
    x = spark.createDataFrame(left + left[:20], "chrom string, s long, e long, tags map<string,string>")
    y = spark.createDataFrame(right, "chrom string, lo long, hi long")
    meets = lambda r: None not in r[:3] and any(None not in g and g[0] == r[0] and g[1] <= r[2] and g[2] >= r[1] for g in right)
    for tile in (100, 1 << 20):
        for anti in (False, True):
            got = joins.overlapping(x, y, "chrom", ("s", "e"), ("lo", "hi"), tile, anti).collect()
            assert sorted((r[0], r[1], r[2], sorted(r[3].items())) for r in got if None not in r[:3]) == sorted((r[0], r[1], r[2], sorted(r[3].items())) for r in left + left[:20] if meets(r) != anti and None not in r[:3])
            assert sum(None in r[:3] for r in got) == (sum(None in r[:3] for r in left + left[:20]) if anti else 0)


def test_nulls_in_nearest_islands_and_merging(spark):
    points = spark.createDataFrame([("a", 10, {"x": "1"}), ("a", None, {}), (None, 10, None)], "chrom string, c long, tags map<string,string>")
    targets = spark.createDataFrame([("a", 7), ("a", 12), (None, 9), ("a", None)], "chrom string, t long")
    got = {(r["chrom"], r["c"]): (r["before"], r["after"]) for r in joins.nearest(points, targets, "chrom", "c", "t", 8).collect()}
    assert got == {("a", 10): (7, 12), ("a", None): (None, None), (None, 10): (None, None)}
    places = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), (None, 5), (None, 6), (None, 9), (None, None)], "chrom string, pos long")
    for tile in (2, 1 << 16):
        runs = sorted(((r["chrom"], r["pos"], r["island"]) for r in segment.islands(places, ["chrom"], "pos", 1, tile=tile).collect()), key=repr)
        assert runs == sorted([("a", 1, 1), ("a", 2, 1), ("a", None, None), (None, 5, 5), (None, 6, 5), (None, 9, 9), (None, None, None)], key=repr)
        spans = spark.createDataFrame([("a", 1, 5), (None, 1, 5), (None, 4, 8), (None, 9, 12), ("a", None, 3)], "chrom string, start long, end long")
        merged = sorted((tuple(r) for r in segment.merge_intervals(spans, ["chrom"], tile=tile).collect()), key=repr)
        assert merged == sorted([("a", 1, 5, 1), (None, 1, 8, 2), (None, 9, 12, 1)], key=repr)


def test_native_medians_are_the_sliding_ones(spark):
    from tidemark.operators import windows

    dice, rows = random.Random(14), []
    for block, n in (("a", 19), ("b", 20), ("c", 21), ("d", 60), ("e", 333)):
        rows += [(block, 100 + k, float(dice.randrange(-9, 9)) if n % 2 else dice.random(), k % 7) for k in range(n)]
    frame = spark.createDataFrame(rows, "block string, pos long, v double, more int")
    for tile in (7, 50, 1000):
        got = [sorted(map(tuple, windows.running_median(frame, "v", ["block"], 20, tile=tile, native=native).collect())) for native in (False, True)]
        assert got[0] == got[1] and len(got[0]) == 19 + 21 + 60 + 333
        plan = windows.running_median(frame, "v", ["block"], 20, tile=tile, native=True)._jdf.queryExecution().toString()
        assert "Arrow" not in plan and "Python" not in plan


def test_quantiles_by_key(spark):
    dice = random.Random(15)
    rows = [("hot", float(dice.randrange(300))) for _ in range(3000)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("none", None)] + [("few", dice.random()) for _ in range(7)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    points = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    got = {r["k"]: r["q"] for r in stats.keyed_quantiles(frame, "v", points, ["k"]).collect()}
    for k in ("hot", "one", "few", None):
        assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k], points))
    assert "none" not in got
    binned = stats.quantile_bins(frame, "v", 4, ["k"])
    assert binned.count() == len(rows) and {r["bin"] for r in binned.filter("k = 'hot'").collect()} == {1, 2, 3, 4}


def test_quantiles_between_equal_values_are_that_value(spark):
    rows = [(k, v) for k in ("a", "b") for v in (905.11, 1417.37, 72661.29, 151203.83, 382373.65, 451076.41) for _ in range(37)]
    frame = spark.createDataFrame(rows, "k string, v double")
    points = [k / 100.0 for k in range(1, 101)]
    values = sorted(v for k, v in rows if k == "a")
    spots = [(len(values) - 1) * p for p in points]
    want = [math.fma(values[int(s)], 1 - (s - int(s)), values[math.ceil(s)] * (s - int(s))) for s in spots]
    assert sum(values[int(s)] == values[math.ceil(s)] == q for s, q in zip(spots, want, strict=True)) > 90
    assert [r["q"] for r in stats.keyed_quantiles(frame, "v", points, ["k"]).collect()] == [want, want]
    assert stats.quantiles(frame.filter("k = 'a'"), "v", points).first()["q"] == want


def test_range_totals_are_those_of_the_pairs_without_pairing(spark):
    dice = random.Random(5)
    ranges = lambda n, most: [(k, dice.choice("xy"), lo := dice.randrange(-300, 300), lo + dice.randrange(most)) for k in range(n)]
    left = spark.createDataFrame([*ranges(60, 90), (60, "x", 5, 5), (61, "z", 1, 9), (62, None, 1, 9), (63, "x", None, 9)], "id long, k string, a long, b long")
    right = spark.createDataFrame([*ranges(400, 70), (7, "x", 5, 5), (8, "y", 1, None)], "v long, k string, c long, d long")
    pairs = joins.range_join(left, right, "k", ("a", "b"), ("c", "d"), 64).groupBy("id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    for tile in (16, 1 << 20):
        got = joins.range_totals(left, right, "k", ("a", "b"), ("c", "d"), ["id"], {"total": "v"}, tile)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    many = spark.range(3000).selectExpr("id", "1 AS k", "id % 10 AS a", "id % 10 + 5 AS b")  # nine million pairs
    plan = registry.queries()["op_joins_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "_bin" not in plan
    got = joins.range_totals(many, many, "k", ("a", "b"), ("a", "b"), ["k"], {})
    want = sum(x <= y + 5 and x + 5 >= y for x in range(10) for y in range(10)) * 300 * 300
    assert [tuple(r) for r in got.collect()] == [(1, want)]


def test_profile_counts_equal_windows_once(spark):
    track = spark.range(1, 401).selectExpr("'1' AS chrom", "id AS pos", "id * id % 17 AS wps")
    sites = spark.range(300).selectExpr("id AS site", "IF(id % 3 = 0, 'a', 'b') AS name", "'1' AS chrom", "id % 4 * 60 + 15 AS c", "IF(id % 2 = 0, '+', '-') AS strand")
    want = overlay.aggregate(overlay.around(sites, track, "wps", 20), "wps", 5)
    got = overlay.profile(sites, track, "wps", 20, 5)
    order = ["name", "bin", "offset", "total"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    asked = []
    around, overlay.around = overlay.around, lambda places, *rest: asked.append(places.count()) or around(places, *rest)
    try:
        registry.queries()["op_overlay_profile"](spark, "/root/testdata/sf0.01")
        overlay.profile(sites, track, "wps", 20, 5)
    finally:
        overlay.around = around
    assert asked[1] == 40


def test_demultiplexing_sends_the_sheet_to_the_rows(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 9 = 0 THEN 'B' ELSE 'A' END AS k", "id")
    sheet = spark.createDataFrame([("A", "x"), ("A", "y")], "k string, category string")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if both sides were large
    try:
        out = overlay.demultiplex(rows, sheet, "k")
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert out.count() == 2 * (5000 - 556)


def test_equal_fragments_meet_a_position_once(spark):
    frags = spark.range(20000).selectExpr("'1' AS chrom", "100 + id % 4 * 30 AS s", "300 + id % 2 * 50 AS e")
    places = spark.range(1, 501).selectExpr("'1' AS chrom", "id AS pos")
    ends = [(100 + k % 4 * 30, 300 + k % 2 * 50) for k in range(4)]
    want = {x: sum((-1 if s > x - 60 or e < x + 60 else 1) * 5000 for s, e in ends if e > x - 60 and s < x + 60) for x in range(1, 501)}
    met = []
    join, joins.range_join = joins.range_join, lambda windows, some, *rest, **more: met.append(some.count()) or join(windows, some, *rest, **more)
    try:
        assert {r["pos"]: r["wps"] for r in signal.score_literal(frags, places).collect()} == want
    finally:
        joins.range_join = join
    assert met == [4]
