import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from tests.test_bam import HEADER, reads
from tidemark.sources import bam, bam_arrow, bam_sink

NUMBERS, NAMES = {"1": 0, "2": 1, "3": 2}, ["chr1", "chr2", "chr3"]


def batch(rows):
    shown = [(*r[:5], [{"op": o, "len": n} for o, n in r[5]] if r[5] is not None else None, *r[6:11], list(r[11].items()) if r[11] is not None else None) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in shown], f.type) for k, f in enumerate(bam_arrow.ARROW)], schema=bam_arrow.ARROW)


def one_by_one(rows):
    names = bam_arrow.ARROW.names
    return [bam_sink.record(dict(zip(names, r, strict=True)), NUMBERS, {"XP", "NM"}) for r in rows]


def rows_of(got):
    return [tuple([(c["op"], c["len"]) for c in v] if k == 5 and v else (dict(v) if k == 11 else v) for k, v in enumerate(r.values())) for r in got.to_pylist()]


ODD = [
    ("n\u00e4me", 0, "1", 5, None, [], None, None, None, "acgtnX=", None, {"XP": "12x", "NM": "-7", "ZZ": ""}), (None, None, None, None, None, None, "3", 4, -9, "", None, None), ("", 4, "2", 0, 0, [(0, 1)], "2", 7, 1, "A", "!", {}),
]


@pytest.mark.parametrize("rows", [reads(900, 5), ODD, [*reads(40, 6), *ODD, ("u", 0, "1", 9, 1, None, None, -1, 0, "AC", "II", {"RG": "\u00fc"})]])
def test_batches_have_the_bytes_of_records(rows):
    """Whole, sliced and with missing columns, the bytes are those of the writer by record, and are read as by record."""
    want, whole = one_by_one(rows), batch(rows)
    for part, raws in ((whole, want), (whole.slice(1, len(rows) - 2), want[1:-1])):
        data, lengths = bam_arrow.packed(part, NUMBERS, {"XP", "NM"})
        assert data.tobytes() == b"".join(struct.pack("<i", len(r)) + r for r in raws) and lengths.tolist() == [len(r) + 4 for r in raws]
        at = bam_arrow.starts_of(lengths)[:-1]
        assert rows_of(bam_arrow.unpacked(data, at, bam_arrow.fixed_of(data, at), NAMES)) == [bam.alignment(r, NAMES) for r in raws]
    few = whole.select(["pos", "chrom"])
    assert bam_arrow.packed(few, NUMBERS, set())[0].tobytes() == b"".join(struct.pack("<i", len(r)) + r for r in (bam_sink.record({"chrom": r[2], "pos": r[3]}, NUMBERS, set()) for r in rows))


def test_tags_of_all_kinds():
    head, rows = bam_sink.record({"qname": "a", "seq": "ACG", "qual": "III"}, NUMBERS, set()), []
    kinds = [b"XAAq", b"Xcc" + b"\xfe", b"XCC\xfe", b"Xss\xff\xfe", b"XSS\xff\xfe", b"Xii" + struct.pack("<i", -5), b"XII" + struct.pack("<I", 2**32 - 5), b"Xff" + struct.pack("<f", 0.1), b"XZZtext\0", b"XHH1A\0"]
    dice = random.Random(3)
    for n in range(60):
        rows.append(head + b"".join(dice.sample(kinds, n % (len(kinds) + 1))))
    for more in ([], [head + b"XBBs" + struct.pack("<ihh", 2, -1, 7)], [head + b"XZZa\0XZZb\0"]):
        all_ = rows + more
        data = np.frombuffer(b"".join(struct.pack("<i", len(r)) + r for r in all_), np.uint8)
        at = bam_arrow.starts_of(np.array([len(r) + 4 for r in all_]))[:-1]
        assert rows_of(bam_arrow.unpacked(data, at, bam_arrow.fixed_of(data, at), NAMES)) == [bam.alignment(r, NAMES) for r in all_]


def test_same_file_and_index_as_by_record(tmp_path):
    """Files and indexes of both writers are equal byte by byte, in order or not, whatever the batches."""
    from pyarrow import fs

    key = lambda r: (r[2] or "9", r[3])
    for name, rows in (("sorted", sorted(reads(6000, 7), key=key)), ("mixed", reads(500, 8)), ("none", [])):
        made = []
        for cls, given in ((bam_sink.BamWriter, iter(rows)), (bam_arrow.BamArrowWriter, (batch(rows[k : k + 1700]) for k in range(0, len(rows), 1700)))):
            at = str(tmp_path / f"{name}-{cls.__name__}.bam")
            count, beside = cls(str(tmp_path), HEADER, bam_arrow.ARROW.names, False).fill(fs.LocalFileSystem(), at, given)
            made.append((count, beside, *[open(at + x, "rb").read() for x in ("", *beside)]))
        assert made[0] == made[1] and made[0][1] == [".bai"] * (name != "mixed")
