from tidemark.operators.signal import region_track


def test_regions_across_tiles_and_gaps(spark):
    """Positions that the track lacks, tiles that it lacks, both strands, regions that end before they start; no window."""
    cells = {(c, p): (p % 3, p % 2, p % 7 - 3) for c in ("1", "2") for p in range(-20, 90) if p % 5 and not 30 <= p < 50}
    tracked = spark.createDataFrame([(c, p, *v) for (c, p), v in cells.items()], "chrom string, pos long, cov long, ends long, wps long")
    regions = [(1, "1", -25, 12, "+"), (2, "2", 3, 61, "-"), (3, "1", 32, 48, "-"), (4, "3", 1, 9, "+"), (5, "2", 10, 10, None), (6, "1", 9, 8, "+"), (7, "2", 85, 130, "-"), (8, None, 1, 5, "+"), (9, "1", 11, 11, "+")]
    frame = spark.createDataFrame(regions, "cid int, chrom string, lo long, hi long, strand string")
    for drop in (True, False):
        want = []
        for cid, chrom, lo, hi, strand in regions:
            rows = [(cid, (hi - p if strand == "-" else p - lo) + 1, chrom, p, *cells.get((chrom, p), (0, 0, 0))) for p in range(lo, hi + 1)]
            want += rows if not drop or sum(r[4] for r in rows) > 0 else []
        for tile in (16, 1 << 10):
            out = region_track(tracked, frame, drop, tile)
            assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "Window" not in out._jdf.queryExecution().toString()
