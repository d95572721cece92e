"""Alignments as BAM files: one for each partition of the frame, with an index beside it where its rows are in order.

Options: ``header`` (SAM text with the @SQ lines of all contigs), ``integerTags`` (comma-separated names of tags that are
written as integers, others are text; default INTEGER_TAGS). Modes: append and overwrite. Rows: the columns that reading
gives, any of which may be missing; order the frame by ``repartitionByRange(chrom, pos)`` and
``sortWithinPartitions`` for indexed files. A row on a contig without @SQ line, or with a read and qualities of different
lengths, fails the job."""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

from tidemark.sources.bam import BASES, FAR, LINEAR, place, smallest_bin
from tidemark.sources.bgzf import BgzfWriter
from tidemark.sources.commit import FolderWriter

INTEGER_TAGS = "NM,AS,XP,XJ,MQ,NH,HI"
CODES = {b: k for k, b in enumerate(BASES)}


def references(header: str) -> list[tuple[str, int]]:
    """(name, length) of the @SQ lines."""
    fields = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in header.splitlines() if line.startswith("@SQ\t")]
    return [(f["SN"], int(f["LN"])) for f in fields]


def head(header: str) -> bytes:
    text, refs = header.encode(), references(header)
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    return out + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in refs)


def tag_bytes(tags: dict[str, str], integers: set[str]) -> bytes:
    out = b""
    for key, value in tags.items():
        number = key in integers and re.fullmatch(r"-?\d{1,9}", value or "")
        out += key.encode() + (b"i" + struct.pack("<i", int(value)) if number else b"Z" + (value or "").encode() + b"\0")
    return out


def record(row: dict, numbers: dict[str, int], integers: set[str]) -> bytes:
    """The bytes of an alignment, without their number."""

    def contig(name: str | None) -> int:
        if name is not None and name not in numbers:
            raise ValueError(f"contig {name!r} of read {row.get('qname')!r} has no @SQ line in the header")
        return -1 if name is None else numbers[name]

    name, cigar, seq, qual = (row.get("qname") or "*").encode(), row.get("cigar") or [], row.get("seq") or "", row.get("qual")
    if len(name) > 254 or len(cigar) > 65535 or qual is not None and len(qual) != len(seq):
        raise ValueError(f"read {row.get('qname')!r} does not fit: a name over 254 bytes, over 65,535 operations, or other qualities than bases")
    get = lambda c, default: default if row.get(c) is None else row[c]
    ref, pos = contig(row.get("chrom")), get("pos", -1)
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, get("mapq", 255), 0, len(cigar), get("flag", 0), len(seq), contig(row.get("mate_chrom")), get("mate_pos", -1), get("isize", 0))
    codes = [CODES.get(b, 15) for b in seq.upper()] + [0] * (len(seq) % 2)
    bases = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    scores = b"\xff" * len(seq) if qual is None else bytes(ord(q) - 33 for q in qual)
    raw = fixed + name + b"\0" + struct.pack(f"<{len(cigar)}I", *[length << 4 | op for op, length in cigar]) + bases + scores + tag_bytes(row.get("tags") or {}, integers)
    _, start, end = place(raw)
    return raw[:10] + struct.pack("<H", smallest_bin(start, end) if start >= 0 else 4680) + raw[12:]


class Index:
    """Gathers the index of records that come in order; ``ordered`` turns false where they do not."""

    def __init__(self, count: int):
        self.bins, self.linear = [defaultdict(list) for _ in range(count)], [{} for _ in range(count)]
        self.last, self.ordered = (0, -1), True

    def add(self, raw: bytes, begin: int, end: int) -> None:
        ref, start, stop = place(raw)
        here = (ref if ref >= 0 else len(self.bins), start)
        self.ordered &= here >= self.last and stop <= FAR
        self.last = here
        if ref < 0 or start < 0 or not self.ordered:
            return
        chunks = self.bins[ref][smallest_bin(start, stop)]
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for window in range(start >> LINEAR, (stop - 1 >> LINEAR) + 1):
            self.linear[ref].setdefault(window, begin)

    def bytes(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, linear in zip(self.bins, self.linear, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *[x for c in chunks for x in c]))
            offsets, last = [], 0
            for window in range(max(linear, default=-1) + 1):
                last = linear.get(window, last)
                offsets.append(last)
            out.append(struct.pack(f"<i{len(offsets)}Q", len(offsets), *offsets))
        return b"".join(out)


class BamWriter(FolderWriter):
    ENDINGS = (".bam", ".bai")

    def __init__(self, path: str, header: str, names: list[str], overwrite: bool, integer_tags: str | None = None):
        super().__init__(path, overwrite)
        self.header, self.names, self.integers = header, names, set((INTEGER_TAGS if integer_tags is None else integer_tags).split(","))

    def fill(self, files, at: str, rows: Iterator) -> tuple[int, list[str]]:
        refs, count = references(self.header), 0
        numbers, index = {n.removeprefix("chr"): k for k, (n, _) in enumerate(refs)}, Index(len(refs))
        out = BgzfWriter(files.open_output_stream(at, compression=None))
        out.write(head(self.header))
        out.flush()
        for row in rows:
            raw = record(dict(zip(self.names, row, strict=True)), numbers, self.integers)
            begin = out.tell()
            out.write(struct.pack("<i", len(raw)) + raw)
            index.add(raw, begin, out.tell())
            count += 1
        out.close()
        if index.ordered:
            with files.open_output_stream(f"{at}.bai", compression=None) as stream:
                stream.write(index.bytes())
        return count, [".bai"] * index.ordered
