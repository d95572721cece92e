"""Registered queries do the whole of their job: checked by brute force, without filters."""

import bisect
import statistics
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import joins, simulate, stats
from tidemark.plans import registry
from tidemark.plans.relations import HI, LO, relation

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_simulation_gates_both_ends(spark):
    """Every position, strand and trial of a small contig against a loop as the reference has it."""
    size, left, right, longest, chunk = 90, 3, 2, 14, 16
    genome = "".join("ACGT"[zlib.crc32(b"%d" % k) % 4] for k in range(size))
    chunks = [("c", k, at + 1, genome[at : at + chunk + left]) for k, at in enumerate(range(0, size, chunk))]
    rate = lambda strand, kmer: zlib.crc32((strand + kmer).encode()) % 100 / 100
    words = lambda k: {genome[i : i + k] for i in range(size - k + 1)}
    tables = {k: spark.createDataFrame([(s, w, rate(s, w)) for s in "+-" for w in words(k) if w != "A" * k], "strand string, kmer string, rate double") for k in (left, right)}
    lengths = [(6, 2), (9, 5), (14, 1)]
    uniform = lambda draw: ((F.col("pos") * (7919, 104729, 1299709)[draw] + F.col("trial") * (31, 37, 41)[draw] + F.ascii("strand") * 53) % 997) / F.lit(997.0)
    positions = spark.range(1, size + 1).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"))
    strands = simulate.strands(F.col("pos") - 1, size + 1 - F.col("pos"), longest)
    made = simulate.fragments(positions, spark.createDataFrame(chunks, "chrom string, chunk_no int, chunk_start long, seq string"), spark.createDataFrame(lengths, "length int, n long"), tables[left], tables[right], uniform, 12, strands, 2.0, left, right, chunk)
    got = sorted(tuple(r) for r in made.select("pos", "strand", "trial", "length").collect())
    forward, reverse = simulate.corrections(2.0, left, right)
    cdf, expected = [2 / 8, 7 / 8, 1.0], []
    for pos in range(1, size + 1):
        plus, minus = pos + longest - 1 <= size, pos - 1 >= longest
        allowed = "+" if plus and not minus else "-" if minus and not plus else "+-"
        for strand in allowed:
            for trial in range(1, 12 // len(allowed) + 1):
                u = [((pos * a + trial * b + ord(strand) * 53) % 997) / 997.0 for a, b in ((7919, 31), (104729, 37), (1299709, 41))]
                at = pos - 1
                first = genome[at : at + left] if strand == "+" else genome[at - left + 1 : at + 1]
                if first == "A" * left or u[0] > rate(strand, first) * forward:
                    continue
                length = lengths[bisect.bisect_left(cdf, u[1])][0]
                last = genome[at + length - right : at + length] if strand == "+" else genome[at - length + 1 : at - length + 1 + right]
                if last != "A" * right and u[2] <= rate(strand, last) * reverse:
                    expected.append((pos, strand, trial, length))
    assert got == sorted(expected) and len(got) > 50


def test_simulation_runs_over_all_positions(spark, monkeypatch):
    seen = []
    real = simulate.fragments
    monkeypatch.setattr(simulate, "fragments", lambda positions, *a, **b: (seen.append(positions), real(positions, *a, **b))[1])
    out = run(spark, "op_simulate_fragments")
    contigs = relation(spark, SF, "fragments").select("chrom").distinct().count()
    assert seen[0].distinct().count() == contigs * (HI - LO + 1)
    assert len({r["length"] for r in out}) > 40 and {r["strand"] for r in out} == {"+", "-"}


def test_every_position_is_scored_by_definition(spark):
    track = registry.queries()["op_signal_wps_track"](spark, SF).select("chrom", "pos", "wps")
    scored = registry.queries()["op_signal_wps_by_definition"](spark, SF).select("chrom", "pos", "wps")
    assert scored.count() == 7 * (HI - LO + 1) and scored.exceptAll(track).count() == 0


def test_spacing_of_all_peaks(spark):
    frags = relation(spark, SF, "fragments").collect()
    peaks, length = {(r["chrom"], r["s"]) for r in frags if r["e"] - r["s"] >= 167}, {}
    for r in frags:
        length[r["chrom"]] = max(length.get(r["chrom"], 0), r["e"])
    expected = {(c, at): None for c, n in length.items() for at in range(0, n, 1500)}
    for c, at in expected:
        inside = sorted(p for k, p in peaks if k == c and at < p <= at + 1500)
        if gaps := [b - a for a, b in zip(inside, inside[1:]) if 120 <= b - a <= 280]:
            expected[c, at] = statistics.median(gaps)
    assert {(r["chrom"], r["start"]): r["median"] for r in run(spark, "op_stats_spacing_bins")} == expected


def test_wig_has_every_position(spark):
    counts = Counter((r["chrom"], r["s"]) for r in relation(spark, SF, "fragments").collect())
    lines = {(r["chrom"], r["at"]): r["line"] for r in run(spark, "op_sinks_wig_lines") if not r["line"].startswith("fixedStep")}
    assert lines == {k: str(n) for k, n in counts.items()}


def test_length_histogram_counts_every_read(spark):
    counts = Counter((r["rg"], min(110, abs(r["isize"]) or 110)) for r in relation(spark, SF, "reads").collect())
    assert {(r["rg"], r["length"]): r["reads"] for r in run(spark, "op_reads_length_histogram") if r["reads"]} == dict(counts)


def test_length_histogram_fills_gaps(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 5), ("b", 4)], "rg string, length long")
    filled = stats.fill_range(stats.length_histogram(rows, ["rg"], "length", F.lit(1)), ["rg"], "length", ["reads", "weighted"])
    assert sorted((r["rg"], r["length"], r["reads"]) for r in filled.collect()) == [("a", 3, 1), ("a", 4, 0), ("a", 5, 1), ("b", 4, 1)]


def test_lookup_uses_the_whole_table(spark):
    assert all(r["library"] != "none" for r in run(spark, "op_joins_lookup"))


def test_lookup_leaves_missing_keys_null(spark):
    rows, names = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, name string")
    assert sorted(tuple(r) for r in joins.look_up(rows, names, ["k"]).collect()) == [(1, "x"), (2, None)]
