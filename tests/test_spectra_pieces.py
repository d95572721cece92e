import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import spectral
from tidemark.operators.signal import region_pieces, region_track


def test_regions_are_put_together_from_pieces(spark):
    """Regions of several tiles, batches that end inside a region, both strands, gaps; short, empty and unnamed regions give nothing.
    Positions of regions are no rows on the way."""
    dice = np.random.default_rng(5)
    cells = [(c, p, int(dice.integers(1, 9)), int(dice.integers(0, 4)), int(dice.integers(-30, 30))) for c in "ab" for p in range(-50, 3000) if not 1100 <= p < 1180]
    tracked = spark.createDataFrame(cells, "chrom string, pos long, cov long, ends long, wps long")
    regions = [(k, "ab"[k % 2], 37 * k - 60, 37 * k - 61 + (700, 1000, 600)[k % 3], "+-"[k % 4 // 2]) for k in range(1, 40)]
    regions += [(50, "a", 100, 698, "+"), (51, "c", 1, 1000, "+"), (52, "a", 5000, 6000, "-"), (None, "a", 1, 1000, "+"), (53, "b", 2500, 3400, None)]
    frame = spark.createDataFrame(regions, "cid int, chrom string, lo long, hi long, strand string")
    series = {}
    for r in region_track(tracked, frame).select("cid", "rank", "cov", "wps").collect():
        series.setdefault(r["cid"], []).append(r[1:])
    want = {}
    for cid, rows in series.items():
        if len(rows) >= 600:
            freq, power = spectral.periodogram(spectral.prefilter(np.array(sorted(rows), float)[:, 1:].T))
            keep = (1 / freq >= 120) & (1 / freq <= 280)
            want |= {(cid, round(1 / f), k): (a, b) for k, (f, a, b) in enumerate(zip(freq[keep], *power[:, keep], strict=True))}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "3")
        out = spectral.spectra(region_pieces(tracked, frame, 256), "cid", "at", ["cov", "wps"], some="cov")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set(key, before)
    assert "FlatMapGroups" not in plan and out.schema["cid"].dataType == frame.schema["cid"].dataType
    assert {r["cid"] for r in got} == {c for c, *_ in want} == {*range(1, 40), 53}
    by = {}
    for r in got:
        by.setdefault(r["cid"], []).append((r["freq"], r["cov"], r["wps"]))
    for cid, rows in by.items():
        expected = [(f, *v) for (c, f, _), v in sorted(want.items()) if c == cid]
        assert np.allclose(sorted(rows), sorted(expected), rtol=1e-9)
    none = spectral.spectra(region_pieces(tracked, frame.filter("cid = 51"), 256), "cid", "at", ["cov"])
    assert {r["cov"] for r in none.collect()} == {0.0} and region_pieces(tracked, frame).filter(F.col("cid").isNull()).count() == 0
