"""The collapse in consensus mode against a plain loop over groups."""

import math
import random
from collections import defaultdict

import pytest

from tidemark.operators import collapse, duplicates

SCHEMA = "rid long, qname string, grp string, chrom string, pos long, reverse boolean, ref_len int, cigar string, seq string, qual string, mapq int, xp int, zq string, is_read1 boolean, paired boolean, unmapped boolean, mate_unmapped boolean, qcfail boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def made_reads(seed):
    dice, rows = random.Random(seed), []
    for k in range(700):
        paired, site = dice.random() < 0.6, dice.randrange(40)
        genome = random.Random(site)
        first, second = ("".join(genome.choice("ACGT") for _ in range(10)) for _ in range(2))
        noisy = lambda s: "".join(c if dice.random() < 0.93 else dice.choice("ACGTN") for c in s)  # noqa: B023, E731
        base = {"qname": f"{dice.choice(['M_', ''])}r{k}", "grp": dice.choice(["a", "b", None]) if not paired else dice.choice("ab"), "chrom": str(site % 3), "paired": paired, "unmapped": k % 31 == 0, "mate_unmapped": k % 37 == 0}
        for side in (1, 2) if paired else (1,):
            read = {"rid": 2 * k + side, "pos": site * 50 + 30 * (side == 2), "reverse": (side == 2) != (site % 2 == 0), "ref_len": 10, "cigar": dice.choice(["10M", "10M", "4M1I5M"]), "seq": noisy((first, second)[side - 1])}
            read |= {"qual": "".join(chr(33 + dice.randrange(0, 40)) for _ in range(10)) if k % 23 else None, "mapq": dice.randrange(60), "xp": dice.choice([None, None, 3]), "qcfail": dice.random() < 0.2, "zq": dice.choice(["Q", "C", None]), "is_read1": side == 1}
            rows.append(base | read)
    return rows


def consensus(reads):
    if len(reads) == 1:
        return reads[0]["seq"], reads[0]["qual"]
    seq = qual = ""
    for i in range(len(reads[0]["seq"])):
        votes = [(r["seq"][i], ord(r["qual"][i]) - 33) for r in reads]
        known = [(b, -0.1 if q == 0 else q / -10) for b, q in votes if b != "N"]
        if not known:
            seq, qual = seq + "N", qual + chr(33 + min(q for _, q in votes))
            continue
        sums = {b: round(sum(q if c == b else math.log10(1 - 10**q) - math.log10(3) for c, q in known), 10) for b in "ACGT"}
        total = math.log10(max(1e-9, sum(10**v for v in sums.values())))
        best = min((sums[b] - total, b) for b in "ACGT")
        seq, qual = (seq + best[1], qual + chr(33 + round(min(60, -10 * best[0])))) if best[0] < 0 else (seq + "N", qual + "!")
    return seq, qual


def brute(rows, merged=False, include=False, rescue=False, least=None):
    live = [r for r in rows if r["qual"] and not r["unmapped"] and not (r["paired"] and r["mate_unmapped"]) and (include or rescue or not r["qcfail"])]
    groups, outer = defaultdict(list), lambda r: r["pos"] + (r["ref_len"] if r["reverse"] else 0)
    mates = defaultdict(dict)
    for r in live:
        if r["paired"]:
            mates[r["grp"], r["qname"]][r["is_read1"]] = r
        elif not merged or r["qname"].startswith("M_"):
            groups["single", r["grp"], r["chrom"], r["reverse"], r["pos"], r["ref_len"]].append((r["rid"], r["cigar"], [(0, r)]))
    for pair in mates.values():
        if len(pair) == 2:
            a, b = pair[True], pair[False]
            groups["pair", a["grp"], a["chrom"], b["chrom"], outer(a), outer(b)].append((min(a["rid"], b["rid"]), f"{a['cigar']}|{b['cigar']}", [(1, a), (2, b)]))
    out = []
    for key, found in groups.items():
        counts = defaultdict(int)
        for _, cigar, _ in found:
            counts[cigar] += 1
        top = max((n, -len(c), c) for c, n in counts.items())[2]
        chosen = sorted((x for x in found if x[1] == top), key=lambda x: x[0])
        called = []
        for k in range(len(chosen[0][2])):
            reads = [x[2][k][1] for x in chosen]
            seq, qual = consensus(reads)
            same = [r for r in reads if r["seq"] == seq]
            r = dict(same[-1] if same else reads[0])
            called.append(r | {"side": chosen[0][2][k][0], "qname": reads[0]["qname"], "seq": seq, "qual": qual, "unmapped": not same, "mapq": r["mapq"] if same else min(x["mapq"] for x in reads), "xp": len(reads) + sum(x["xp"] or 0 for x in reads)})
        if len(chosen) > 1 and any(r["qcfail"] for r in called) and rescue:
            if any(r["qcfail"] and r["zq"] != "Q" for r in called):
                continue
            called = [r | {"qcfail": False} for r in called]
        elif any(r["qcfail"] for r in called) and not include:
            continue
        if least is None or all(r["xp"] >= least for r in called):
            out += [(key[0], r["side"], r["qname"], r["chrom"], r["pos"], r["reverse"], r["seq"], r["qual"], r["mapq"], r["unmapped"], r["qcfail"], r["xp"]) for r in called]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"rescue": True}, {"include": True, "merged": True}, {"rescue": True, "include": True, "least": 4}])
def test_against_a_loop(spark, options):
    rows = made_reads(3)
    frame = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA).repartition(5)
    called = collapse.consensus_collapse(frame, merged=options.get("merged", False), include_failed=options.get("include", False), rescue_failed=options.get("rescue", False), min_count=options.get("least"))
    got = called.select("kind", "side", "qname", "chrom", "pos", "reverse", "seq", "qual", "mapq", "unmapped", "qcfail", "xp").collect()
    want = brute(rows, **options)
    assert sorted(map(tuple, got)) == want and len(want) > 30
    ways = {k: v.collect() for k, v in collapse.routes(called).items()}
    again = {(r[0], r[2]) for r in want if r[9]}
    assert len(ways["alignments"]) == sum((r[0], r[2]) not in again for r in want)
    assert len(ways["r1"]) == len(ways["r2"]) == sum(k == "pair" for k, _ in again) and len(ways["sr"]) == sum(k == "single" for k, _ in again)
    for stream in ("r1", "r2"):
        assert all(r["line"].startswith(f"@{r['qname']}\n") and r["qname"].endswith(f"/{stream[1]}") for r in ways[stream])


def test_cells_are_summed_without_a_sort(spark):
    """What the sum holds for a position has a fixed width, so no row of a cell is kept or sorted; single reads keep any letter."""
    reads = [("a", "ACGN", "IIII"), ("a", "ACTN", "I5I#"), ("a", "ACTN", "IIII"), ("b", "aé.=€N", "I!5I#J"), ("c", "", "")]
    out = duplicates.consensus(spark.createDataFrame(reads, "g string, seq string, qual string"), ["g"], "seq", "qual")
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["g"]: (r["consensus"], r["consensus_qual"], r["reads"]) for r in out.collect()}
    assert got["b"] == ("aé.=€N", "I!5I#J", 1) and got["a"][0] == "ACTN" and got["a"][2] == 3 and got["c"][0] == ""


def test_first_and_last_of_equal_numbers(spark):
    """Reads of one number differ by name; rows without a number come first and are never last among numbered ones."""
    read = ("g", "single", "a", 0, "1", 5, False)
    rows = [(*read, 7, "y", "AC", "II", 3), (*read, 7, "x", "AC", "II", 4), (*read, 7, "z", "AC", "II", 5), (*read, 7, "zz", "AG", "##", 6), (*read, 6, "w", "AC", "II", 1), (*read, None, "v", "AC", "II", 2)]
    frame = spark.createDataFrame([(*r, None, False, None) for r in rows], "gid string, kind string, grp string, side int, chrom string, pos long, reverse boolean, order long, name string, seq string, qual string, mapq int, xp int, qcfail boolean, zq string")
    (got,) = collapse.call(frame).collect()
    assert (got["qname"], got["mapq"], got["seq"], got["n"], got["xp"], got["unmapped"]) == ("v", 5, "AC", 6, 6, False)
