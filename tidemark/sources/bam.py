"""BAM: records, the index beside a file, and the reader of ``bam_source``."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.sources.bgzf import SPLIT, Blocks, found, split_offsets
from tidemark.sources.text import parse_region

#: Fixed values of the BAM format.
BASES, CIGAR_OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SCHEMA = "qname string, flag int, chrom string, pos long, mapq int, cigar array<struct<op:int,len:int>>, mate_chrom string, mate_pos long, isize int, seq string, qual string, tags map<string,string>"
SIZES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
ON_REFERENCE = {0, 2, 3, 7, 8}  # operations that use up the reference
ON_READ = {0, 1, 4, 7, 8}
CHAIN, FAR = 4, 1 << 29
PARTS = 2000  # beyond so many parts, parts grow up to SPLIT


def tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        key, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[key], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack("<I", raw[at + 1 : at + 5])[0]
            fmt = f"<{n}{SIZES[sub]}"
            out[key], at = ",".join(map(str, struct.unpack_from(fmt, raw, at + 5))), at + 5 + struct.calcsize(fmt)
        else:
            fmt = "<" + SIZES[kind]
            (value,) = struct.unpack_from(fmt, raw, at)
            out[key], at = value.decode() if kind == "A" else str(value), at + struct.calcsize(fmt)
    return out


def alignment(raw: bytes, names: list[str]) -> tuple:
    ref, pos, name_len, mapq, _, cigars, flag, length, mate_ref, mate_pos, isize = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    name = raw[at : at + name_len - 1].decode()
    at += name_len
    cigar = [(c & 15, c >> 4) for c in struct.unpack_from(f"<{cigars}I", raw, at)]
    at += 4 * cigars
    packed = raw[at : at + (length + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length]
    at += (length + 1) // 2
    qual = raw[at : at + length]
    text = None if not length or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    contig = lambda k: names[k].removeprefix("chr") if k >= 0 else None
    return name, flag, contig(ref), pos, mapq, cigar or None, contig(mate_ref), mate_pos, isize, seq or None, text, tags(raw[at + length :])


def place(raw: bytes) -> tuple[int, int, int]:
    """(reference, start, end) of a record, end excluded; a read without reference bases takes one."""
    ref, pos, name_len, _, _, cigars = struct.unpack_from("<iiBBHH", raw)
    covered = sum(c >> 4 for c in struct.unpack_from(f"<{cigars}I", raw, 32 + name_len) if c & 15 in ON_REFERENCE)
    return ref, pos, pos + max(1, covered)


class Stream:
    """Contents of the blocks from one on, with the virtual offset of every place."""

    def __init__(self, blocks: Blocks, block: int):
        self.blocks, self.next, self.data, self.at, self.marks = blocks, block, b"", 0, []

    def need(self, n: int) -> bool:
        """Makes n bytes from here on available, if the file has them."""
        while len(self.data) - self.at < n:
            got = self.blocks.at(self.next)
            if got is None:
                return False
            self.marks = [(p - self.at, o) for k, (p, o) in enumerate(self.marks) if k + 1 == len(self.marks) or self.marks[k + 1][0] > self.at]
            self.data, self.at = self.data[self.at :], 0
            if got[0]:
                self.marks.append((len(self.data), self.next))
                self.data += got[0]
            self.next = got[1]
        return True

    def tell(self) -> int:
        block, start = next((o, p) for p, o in reversed(self.marks) if p <= self.at)
        return (block << 16) + self.at - start

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError(f"{self.blocks.path} ends inside a record")
        self.at += n
        return self.data[self.at - n : self.at]


def header(stream: Stream) -> tuple[str, list[str], list[int]]:
    """(text, names, lengths) of the references; the stream goes on at the first record."""
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    if not stream.need(4) or stream.take(4) != b"BAM\1":
        raise ValueError(f"{stream.blocks.path} is not a BAM file")
    text, names, lengths = stream.take(number()).decode(), [], []
    for _ in range(number()):
        names.append(stream.take(number())[:-1].decode())
        lengths.append(number())
    return text.rstrip("\0"), names, lengths


def record_end(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the record that may begin at this place ends; None if none can, 0 if more data are needed to tell."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, name_len, _, _, cigars, _, length, mate_ref, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fixed = 32 + name_len + 4 * cigars
    if size < fixed or name_len < 1 or length < 0 or size < fixed + length + (length + 1) // 2:
        return None
    for k, p in ((ref, pos), (mate_ref, mate_pos)):
        if not -1 <= k < len(lengths) or not -1 <= p or k >= 0 and p > lengths[k]:
            return None
    name_end = at + 36 + name_len - 1
    if name_end < len(data) and (data[name_end] or not all(33 <= c <= 126 for c in data[at + 36 : name_end])):
        return None
    if at + 4 + size > len(data):
        return 0 if size < 1 << 28 else None
    parts = struct.unpack_from(f"<{cigars}I", data, name_end + 1)
    if any(c & 15 >= len(CIGAR_OPS) for c in parts) or parts and length and sum(c >> 4 for c in parts if c & 15 in ON_READ) != length:
        return None
    try:
        tags(data[at + 4 + fixed + length + (length + 1) // 2 : at + 4 + size])
    except (KeyError, ValueError, struct.error, IndexError, UnicodeDecodeError):
        return None
    return at + 4 + size


def first_record(stream: Stream, lengths: list[int]) -> bool:
    """Moves to the first place from here on where CHAIN records follow each other, or fewer up to the end of the file."""
    at = stream.at
    while True:
        place, good, more = at, 0, False
        while good < CHAIN:
            if place == len(stream.data) and good and not stream.need(place - stream.at + 1):
                break  # the file ends with a whole record
            end = record_end(stream.data, place, lengths)
            if end is None:
                good = -1
                break
            if end == 0:
                more = True
                break
            place, good = end, good + 1
        if more:
            gone = stream.at
            if stream.need(len(stream.data) - gone + 1):
                at += stream.at - gone
                continue
            good = -1  # cut off by the end of the file
        if good >= 0:
            stream.at = at
            return True
        at += 1
        if at >= len(stream.data):
            return False


def raw_records(stream: Stream, until: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, record) of the records that begin before a virtual offset."""
    while stream.need(1):
        here = stream.tell()
        if here >= until:
            return
        yield here, stream.take(struct.unpack("<i", stream.take(4))[0])


#: Fixed values of the index format: the size of a linear window, and (shift, first number) of the levels of bins.
LINEAR, LEVELS = 14, ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))


def smallest_bin(start: int, end: int) -> int:
    """The number of the smallest bin that holds [start, end)."""
    return next((first + (start >> shift) for shift, first in LEVELS if start >> shift == (end - 1) >> shift), 0)


def bins_of(start: int, end: int) -> set[int]:
    """Numbers of all bins that touch [start, end)."""
    return {0}.union(*(range(first + (start >> shift), first + ((end - 1) >> shift) + 1) for shift, first in LEVELS))


def read_index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """Per reference: chunks of virtual offsets by bin, and the linear index."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    with files.open_input_stream(at, compression=None) as stream:
        raw = stream.read()
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{path} is not an index")
    (n_ref,), at, out = struct.unpack_from("<i", raw, 4), 8, []
    for _ in range(n_ref):
        bins: dict[int, list] = {}
        (n_bin,), at = struct.unpack_from("<i", raw, at), at + 4
        for _ in range(n_bin):
            number, n = struct.unpack_from("<Ii", raw, at)
            ends = struct.unpack_from(f"<{2 * n}Q", raw, at + 8)
            bins[number], at = list(zip(ends[::2], ends[1::2], strict=True)), at + 8 + 16 * n
        (n,) = struct.unpack_from("<i", raw, at)
        out.append((bins, list(struct.unpack_from(f"<{n}Q", raw, at + 4))))
        at += 4 + 8 * n
    return out


def chunks_of(index: list, wanted: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges of virtual offsets that hold all records overlapping one of (reference, start, end)."""
    some = []
    for ref, start, end in wanted:
        if ref < len(index):
            bins, linear = index[ref]
            window = start >> LINEAR
            least = linear[window] if window < len(linear) else (linear[-1] if linear else 0)
            some += [(max(a, least), b) for k in bins_of(start, min(end, FAR)) for a, b in bins.get(k, ()) if b > least]
    out: list[tuple[int, int]] = []
    for a, b in sorted(some):
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class Chunk(InputPartition):
    """Records of a file that begin from one virtual offset on and before another. ``found``: the first is known to be the
    start of a record."""

    def __init__(self, path: str, start: int, stop: int, found: bool):
        self.path, self.start, self.stop, self.found = path, start, stop, found


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int = SPLIT, region: str | None = None):
        self.path, self.split, self.chroms, self.least, self.most = path, split, None, -1, FAR
        regions = [parse_region(x) for x in (region or "").split(";")]
        self.regions = None if None in regions else regions  # any that means all

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = isinstance(f.value, int) if f.attribute == ("pos",) and hasattr(f, "value") else False
            if f.attribute == ("chrom",) and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = some if self.chroms is None else self.chroms & some
            elif known and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            elif known and isinstance(f, (LessThan, LessThanOrEqual)):
                self.most = min(self.most, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _bounded(self) -> bool:
        return self.regions is not None or self.chroms is not None

    def _wanted(self, names: list[str], lengths: list[int]) -> list[tuple[int, int, int]]:
        """(reference, start, end) of what the filters let through, as far as they name contigs."""
        out = []
        for k, (name, length) in enumerate(zip(names, lengths, strict=True)):
            short = name.removeprefix("chr")
            if self.chroms is None or short in self.chroms:
                spans = [(0, max(length, 1))] if self.regions is None else [(s - 1, e) for c, s, e in self.regions if c == short]
                out += [(k, a, b) for a, b in spans]
        # A record that starts within bounds overlaps them.
        return [(k, max(a, self.least) if self.regions is None else a, min(b, max(self.most, self.least + 1))) for k, a, b in out]

    def partitions(self) -> list[InputPartition]:
        files, out = found(self.path, ".bam"), []
        indexed = {p for p, _ in found(self.path if len(files) != 1 or files[0][0] != self.path else self.path.rpartition("/")[0] or ".", ".bai")} if self._bounded() else set()
        part = max(self.split, min(SPLIT, sum(size for _, size in files) // PARTS))
        for path, size in files:
            if f"{path}.bai" in indexed:
                _, names, lengths = header(Stream(Blocks(path), 0))
                wanted = [w for w in self._wanted(names, lengths) if w[1] < w[2]]
                for a, b in chunks_of(read_index(f"{path}.bai"), wanted):
                    cuts = [a, *[k << 16 for k in range((a >> 16) + part, b >> 16, part)], b]
                    out += [Chunk(path, x, y, x == a) for x, y in zip(cuts, cuts[1:], strict=False)]
            else:
                out += [Chunk(path, a << 16, b << 16, a == 0) for a, b in split_offsets(size, part)]
        return out or [Chunk("", 0, 0, False)]

    def _opened(self, chunk: Chunk, blocks: Blocks, lengths: list, first: int) -> Stream | None:
        """A stream that stands at the first record of a chunk. first: the virtual offset of the file's first record."""
        if chunk.found or chunk.start <= first:
            start = max(chunk.start, first)
            stream = Stream(blocks, start >> 16)
            if stream.need((start & 0xFFFF) + 1):
                stream.at = start & 0xFFFF
            return stream
        block = blocks.next_start(chunk.start >> 16, (chunk.stop + 0xFFFF) >> 16)
        if block is None:
            return None
        stream = Stream(blocks, block)
        return stream if stream.need(1) and first_record(stream, lengths) else None

    def read(self, partition: Chunk) -> Iterator[tuple]:
        if not partition.path:
            return
        blocks = Blocks(partition.path)
        head = Stream(blocks, 0)
        _, names, lengths = header(head)
        if not head.need(1):
            return
        wanted = {}
        if self.regions is not None:
            for k, a, b in self._wanted(names, lengths):
                wanted.setdefault(k, []).append((a, b))
        stream = self._opened(partition, blocks, lengths, head.tell())
        for _, raw in raw_records(stream, partition.stop) if stream else ():
            ref, start, end = place(raw)
            if self.regions is not None and not any(start < b and end > a for a, b in wanted.get(ref, ())):
                continue
            if not self.least <= start < self.most:
                continue
            if self.chroms is not None and (names[ref].removeprefix("chr") if ref >= 0 else None) not in self.chroms:
                continue
            yield alignment(raw, names)
