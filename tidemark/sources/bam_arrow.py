"""BAM records as Arrow batches, for the reader and writer of ``bam_source``: whole columns are coded at once.

What whole columns do not cover (characters beyond ASCII, lists and repeated names among tags, rows that fail) goes record by
record through ``bam`` and ``bam_sink``, which define the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSourceArrowWriter

from tidemark.sources.bam import BASES, CIGAR_OPS, FAR, LEVELS, LINEAR, ON_REFERENCE, SIZES, BamReader, Chunk, Stream, alignment, header
from tidemark.sources.bam_sink import CODES, BamWriter, Index, head, record, references
from tidemark.sources.bgzf import Blocks, BgzfWriter

STEP = 1 << 20  # bytes of records that are coded at once

#: The 36 bytes before a read's name.
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("cigars", "<u2"), ("flag", "<u2"), ("length", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("isize", "<i4")])
CODE = np.full(256, 15, np.uint8)
for _base, _code in CODES.items():
    CODE[[ord(_base), ord(_base.lower())]] = _code
PAIRS = np.array([[ord(a), ord(b)] for a in BASES for b in BASES], np.uint8)
COVERS = np.isin(np.arange(16), list(ON_REFERENCE))

TEXT = pa.string()
CIGAR = pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))
ARROW = pa.schema([
    ("qname", TEXT), ("flag", pa.int32()), ("chrom", TEXT), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", CIGAR), ("mate_chrom", TEXT), ("mate_pos", pa.int64()), ("isize", pa.int32()), ("seq", TEXT), ("qual", TEXT),
    ("tags", pa.map_(TEXT, TEXT)),
])


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where pieces of these lengths begin, one behind the other, and where the last ends."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def spread(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of pieces that begin at ``at``."""
    begins = starts_of(lengths)
    return np.repeat(at - begins[:-1], lengths) + np.arange(begins[-1])


def texts(pieces: np.ndarray, lengths: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """ASCII strings whose bytes lie one behind the other; ``none`` marks those that are null."""
    mask = None if none is None or not none.any() else pa.py_buffer(np.packbits(~none, bitorder="little"))
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(starts_of(lengths).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pieces)), mask)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of strings; null is empty."""
    column = pc.fill_null(column.cast(TEXT), "")
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return (np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data else np.zeros(0, np.uint8)), np.diff(places).astype(np.int64)


def sums_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of pieces."""
    begins = starts_of(lengths)
    total = starts_of(values)
    return total[begins[1:]] - total[begins[:-1]]


def smallest_bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.int64)
    for shift, first in reversed(LEVELS):
        out = np.where(start >> shift == (end - 1) >> shift, first + (start >> shift), out)
    return out


class _Odd(Exception):
    """Rows that are coded one by one."""


def _tags(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Tags of records that end at ``ends``, as maps: each round takes the next tag of every record that has one."""
    count, row, turn, found = len(at), np.arange(len(at)), 0, []
    zeros = np.flatnonzero(data == 0)
    at, ends = at.copy(), ends.copy()
    while (more := at < ends).any():
        row, at, ends = row[more], at[more], ends[more]
        kind, start, width = data[at + 2], at + 3, np.zeros(len(at), np.int64)
        for k in np.unique(kind).tolist():
            here = np.flatnonzero(kind == k)
            begin = start[here]
            if chr(k) in "ZH":
                stop = zeros[np.searchsorted(zeros, begin)]
                width[here] = stop - begin + 1
                pieces = data[spread(begin, stop - begin)]
                if (pieces > 127).any():
                    raise _Odd
                values = texts(pieces, stop - begin)
            elif chr(k) in SIZES:
                kept = np.dtype({"A": "u1", "c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}[chr(k)])
                width[here] = kept.itemsize
                numbers = data[begin[:, None] + np.arange(kept.itemsize)].view(kept).ravel()
                if chr(k) == "f":
                    values = pa.array([str(x) for x in numbers.astype(float).tolist()], TEXT)
                elif chr(k) == "A":
                    values = texts(numbers, np.ones(len(numbers), np.int64))
                else:
                    values = pc.cast(pa.array(numbers.astype(np.int64)), TEXT)
            else:
                raise _Odd
            found.append((row[here], np.full(len(here), turn), data[at[here][:, None] + np.arange(2)], values))
        at, turn = start + width, turn + 1
    if not found:
        return pa.MapArray.from_arrays(np.zeros(count + 1, np.int32), pa.array([], TEXT), pa.array([], TEXT))
    rows, turns, keys = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((turns, rows))
    rows, keys = rows[order], keys[order]
    names = rows << 16 | keys[:, 0].astype(np.int64) << 8 | keys[:, 1]
    if (keys > 127).any() or turn > 1 and len(np.unique(names)) < len(names):
        raise _Odd
    values = pa.concat_arrays([f[3] for f in found]).take(pa.array(order))
    return pa.MapArray.from_arrays(starts_of(np.bincount(rows, minlength=count)).astype(np.int32), texts(keys.ravel(), np.full(len(keys), 2)), values)


def fixed_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[at[:, None] + np.arange(36)].view(FIXED).ravel()


def ends_of(data: np.ndarray, at: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Where the reads end on the reference, as ``bam.place`` has it."""
    cigars = fixed["cigars"].astype(np.int64)
    parts = data[spread(at + 36 + fixed["name"], 4 * cigars)].view("<u4").astype(np.int64)
    covered = sums_of(np.where(COVERS[parts & 15], parts >> 4, 0), cigars)
    return fixed["pos"].astype(np.int64) + np.maximum(1, covered)


def unpacked(data: np.ndarray, at: np.ndarray, fixed: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The records that begin at ``at``, with their number of bytes, as a batch of the columns of ``bam.SCHEMA``."""
    try:
        return _unpacked(data, at, fixed, names)
    except _Odd:
        rows = [alignment(data[a + 4 : a + 4 + n].tobytes(), names) for a, n in zip(at.tolist(), fixed["size"].tolist(), strict=True)]
        shown = [[{"op": o, "len": n} for o, n in r[5]] if r[5] else None for r in rows]
        columns = [shown if k == 5 else [list(r[11].items()) for r in rows] if k == 11 else [r[k] for r in rows] for k in range(len(ARROW))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _unpacked(data: np.ndarray, at: np.ndarray, fixed: np.ndarray, names: list[str]) -> pa.RecordBatch:
    contigs = pa.array([n.removeprefix("chr") for n in names] + [None], TEXT)
    contig = lambda k: contigs.take(pa.array(np.where(k < 0, len(names), k)))
    name, cigars, length = (fixed[c].astype(np.int64) for c in ("name", "cigars", "length"))
    place = at + 36
    called = data[spread(place, name - 1)]
    place = place + name
    parts = data[spread(place, 4 * cigars)].view("<u4")
    pairs = pa.StructArray.from_arrays([pa.array((parts & 15).astype(np.int32)), pa.array((parts >> 4).astype(np.int32))], ["op", "len"])
    cigar = pa.ListArray.from_arrays(pa.array(starts_of(cigars).astype(np.int32)), pairs, mask=pa.array(cigars == 0))
    place = place + 4 * cigars
    half = (length + 1) // 2
    both = PAIRS[data[spread(place, half)]].ravel()
    seq = both[spread(2 * starts_of(half)[:-1], length)]
    place = place + half
    qual, none = data[spread(place, length)], length == 0
    none[~none] = data[place[~none]] == 255
    if none.any():
        qual = qual[~np.repeat(none, length)]
    if (called > 127).any() or (qual > 94).any():
        raise _Odd
    tags = _tags(data, place + length, at + 4 + fixed["size"])
    columns = [
        texts(called, name - 1), fixed["flag"].astype(np.int32), contig(fixed["ref"]), fixed["pos"].astype(np.int64), fixed["mapq"].astype(np.int32), cigar, contig(fixed["mate_ref"]), fixed["mate_pos"].astype(np.int64),
        fixed["isize"].astype(np.int32), texts(seq, length, length == 0), texts(qual + 33, np.where(none, 0, length), none), tags,
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=ARROW)


def _whole_records(stream: Stream, until: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, places of records) of the records that begin before a virtual offset, about STEP bytes at a time. Blocks at
    the offset and behind it are only read for the rest of a record."""
    while stream.need(1) and stream.tell() < until:
        while len(stream.data) - stream.at < STEP and stream.next << 16 < until and stream.need(len(stream.data) - stream.at + 1):
            pass
        limit = len(stream.data)
        for k, (start, block) in enumerate(stream.marks):
            if block << 16 < until <= (block << 16) + 0xFFFF:
                follows = stream.marks[k + 1][0] if k + 1 < len(stream.marks) else len(stream.data)
                limit = min(limit, start + (until & 0xFFFF), follows)
            elif until <= block << 16:
                limit = min(limit, start)
        data, at, begins = stream.data, stream.at, []
        while at < limit and at + 4 <= len(data):
            end = at + 4 + int.from_bytes(data[at : at + 4], "little", signed=True)
            if end > len(data):
                break
            if end < at + 36:
                raise ValueError(f"{stream.blocks.path}: a record of {end - at} bytes")
            begins.append(at)
            at = end
        if not begins:  # a record that goes on behind what is there
            first = stream.take(4)
            data, begins = first + stream.take(int.from_bytes(first, "little")), [0]
        else:
            stream.at = at
        yield np.frombuffer(data, np.uint8), np.array(begins, np.int64)


class BamArrowReader(BamReader):
    """``BamReader`` that gives batches."""

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        blocks = Blocks(partition.path)
        first = Stream(blocks, 0)
        _, names, lengths = header(first)
        if not first.need(1):
            return
        wanted = {}
        for k, a, b in self._wanted(names, lengths) if self.regions is not None else ():
            wanted.setdefault(k, []).append((a, b))
        # Spans by their starts, with the furthest end up to each: one look tells whether a record overlaps any.
        wanted = {k: (np.array([a for a, _ in sorted(v)]), np.maximum.accumulate([b for _, b in sorted(v)])) for k, v in wanted.items()}
        chroms = None if self.chroms is None else np.array([n.removeprefix("chr") in self.chroms for n in names] + [None in self.chroms])
        stream = self._opened(partition, blocks, lengths, first.tell())
        for data, at in _whole_records(stream, partition.stop) if stream else ():
            fixed = fixed_of(data, at)
            ref, pos = fixed["ref"], fixed["pos"].astype(np.int64)
            keep = (pos >= self.least) & (pos < self.most)
            if chroms is not None:
                keep &= chroms[ref]  # the last stands for reads without contig
            if self.regions is not None:
                end, inside = ends_of(data, at, fixed), np.zeros(len(at), bool)
                for k, (begins, furthest) in wanted.items():
                    here = np.flatnonzero(ref == k)
                    before = np.searchsorted(begins, end[here])
                    inside[here] = (before > 0) & (furthest[before - 1] > pos[here])
                keep &= inside
            if keep.any():
                yield unpacked(data, at[keep], fixed[keep], names)


def packed(batch: pa.RecordBatch, numbers: dict[str, int], integers: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each record with its own) of the rows of a batch."""
    try:
        return _packed(batch, numbers, integers)
    except (_Odd, pa.ArrowInvalid, OverflowError):
        out = []
        for row in batch.to_pylist():
            row["cigar"] = [(c["op"], c["len"]) for c in row.get("cigar") or []]
            row["tags"] = dict(row.get("tags") or [])
            out.append(record(row, numbers, integers))
        lengths = np.array([len(raw) for raw in out], np.int64)
        return np.frombuffer(b"".join(len(raw).to_bytes(4, "little") + raw for raw in out), np.uint8), lengths + 4


def _packed(batch: pa.RecordBatch, numbers: dict[str, int], integers: set[str]) -> tuple[np.ndarray, np.ndarray]:
    n, there = batch.num_rows, set(batch.schema.names)

    def number(c: str, default: int, kind: str) -> np.ndarray:
        if c not in there:
            return np.full(n, default, np.int64)
        values = pc.fill_null(batch[c].cast(pa.int64()), default).to_numpy(zero_copy_only=False)
        if len(values) and not (np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max):
            raise _Odd
        return values

    def text(c: str) -> tuple[np.ndarray, np.ndarray]:
        data, lengths = bytes_of(batch[c]) if c in there else (np.zeros(0, np.uint8), np.zeros(n, np.int64))
        if (data > 127).any():
            raise _Odd
        return data, lengths

    known = pa.array(list(numbers), TEXT)
    codes = np.array([*numbers.values(), -1], np.int64)

    def contig(c: str) -> np.ndarray:
        if c not in there:
            return np.full(n, -1, np.int64)
        at = pc.index_in(batch[c].cast(TEXT), known)
        if at.null_count > batch[c].null_count:
            raise _Odd
        return codes[pc.fill_null(at, len(numbers)).to_numpy(zero_copy_only=False)]

    name, named = bytes_of(pc.replace_with_mask(batch["qname"], pc.equal(pc.fill_null(batch["qname"], ""), ""), "*")) if "qname" in there else (np.full(n, ord("*"), np.uint8), np.ones(n, np.int64))
    seq, length = text("seq")
    qual, scored = text("qual")
    bare = np.ones(n, bool) if "qual" not in there else pc.is_null(batch["qual"]).to_numpy(zero_copy_only=False)
    if (named > 254).any() or (scored != np.where(bare, 0, length)).any() or (qual < 33).any():
        raise _Odd
    if "cigar" in there:
        column = batch["cigar"]
        cigars = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        op, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        if flat.null_count or any(flat.field(k).null_count for k in range(2)) or (cigars > 65535).any() or len(op) and not (0 <= op.min() and op.max() < len(CIGAR_OPS) and 0 <= size.min() and size.max() < 1 << 28):
            raise _Odd
        parts = size.astype(np.uint32) << 4 | op.astype(np.uint32)
    else:
        cigars, parts, op, size = np.zeros(n, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    tagged, tag_data = _tag_bytes(batch["tags"], integers) if "tags" in there else (np.zeros(n, np.int64), np.zeros(0, np.uint8))

    half = (length + 1) // 2
    total = 36 + named + 1 + 4 * cigars + half + length + tagged
    begins = starts_of(total)
    at = begins[:-1]
    fixed = np.zeros(n, FIXED)
    pos = number("pos", -1, "i4")
    end = pos + np.maximum(1, sums_of(np.where(COVERS[op.astype(np.int64)], size, 0), cigars))
    for c, values in (
        ("size", total - 4), ("ref", contig("chrom")), ("pos", pos), ("name", named + 1), ("mapq", number("mapq", 255, "u1")), ("bin", np.where(pos >= 0, smallest_bins(pos, end), 4680)), ("cigars", cigars),
        ("flag", number("flag", 0, "u2")), ("length", length), ("mate_ref", contig("mate_chrom")), ("mate_pos", number("mate_pos", -1, "i4")), ("isize", number("isize", 0, "i4")),
    ):
        fixed[c] = values
    out = np.zeros(begins[-1], np.uint8)
    out[at[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(n, 36)
    place = at + 36
    out[spread(place, named)] = name
    place = place + named + 1
    out[spread(place, 4 * cigars)] = parts.astype("<u4").view(np.uint8)
    place = place + 4 * cigars
    coded = np.zeros(2 * int(half.sum()), np.uint8)
    coded[spread(2 * starts_of(half)[:-1], length)] = CODE[seq]
    out[spread(place, half)] = coded[::2] << 4 | coded[1::2]
    place = place + half
    out[spread(place[bare], length[bare])] = 255
    out[spread(place[~bare], length[~bare])] = qual - 33
    out[spread(place + length, tagged)] = tag_data
    return out, total


def _tag_bytes(tags: pa.MapArray, integers: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of bytes of a row's tags, the bytes of all), as ``bam_sink.tag_bytes`` has them."""
    counts = np.diff(np.asarray(tags.offsets)).astype(np.int64)
    first, last = tags.offsets[0].as_py(), tags.offsets[len(tags)].as_py()
    if tags.null_count:
        valid = pc.is_valid(tags).to_numpy(zero_copy_only=False)
        if counts[~valid].any():
            raise _Odd
    keys, values = tags.keys.slice(first, last - first), tags.items.slice(first, last - first)
    key, widths = bytes_of(keys)
    values = pc.fill_null(values.cast(TEXT), "")
    whole = pc.and_(pc.is_in(keys, pa.array(sorted(integers), TEXT)), pc.match_substring_regex(values, r"\A-?[0-9]{1,9}\z")).to_numpy(zero_copy_only=False)
    data, sizes = bytes_of(values)
    if (widths != 2).any() or (data > 127).any():
        raise _Odd
    numbers = pc.cast(values.filter(pa.array(whole)), pa.int32()).to_numpy(zero_copy_only=False)
    lengths = 3 + np.where(whole, 4, sizes + 1)
    begins = starts_of(lengths)
    at, out = begins[:-1], np.zeros(begins[-1], np.uint8)
    out[at[:, None] + np.arange(2)] = key.reshape(-1, 2)
    out[at + 2] = np.where(whole, ord("i"), ord("Z"))
    out[at[whole][:, None] + np.arange(3, 7)] = numbers.astype("<i4").view(np.uint8).reshape(-1, 4)
    kept = data if not whole.any() else data[~np.repeat(whole, sizes)]
    out[spread(at[~whole] + 3, sizes[~whole])] = kept
    return sums_of(lengths, counts), out


class BatchIndex(Index):
    def add_all(self, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Adds the records at ``at``, which begin and end at these virtual offsets."""
        fixed = fixed_of(data, at)
        start, stop = fixed["pos"].astype(np.int64), ends_of(data, at, fixed)
        ref = np.where(fixed["ref"] >= 0, fixed["ref"], len(self.bins)).astype(np.int64)
        here, last = ref << 32 | start + 1, (self.last[0] << 32) | self.last[1] + 1
        self.ordered = bool(self.ordered and here[0] >= last and (np.diff(here) >= 0).all() and (stop <= FAR).all())
        self.last = int(ref[-1]), int(start[-1])
        if not self.ordered:
            return
        placed = (fixed["ref"] >= 0) & (start >= 0)
        bins = np.where(placed, smallest_bins(np.maximum(start, 0), np.maximum(stop, 1)), -1)
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(ref) != 0) | (np.diff(bins) != 0)]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ref)], strict=True):
            if placed[a]:
                chunks = self.bins[ref[a]][int(bins[a])]
                if chunks and chunks[-1][1] == begin[a]:
                    chunks[-1][1] = int(end[b - 1])
                else:
                    chunks.append([int(begin[a]), int(end[b - 1])])
        first, count = start[placed] >> LINEAR, ((stop[placed] - 1) >> LINEAR) - (start[placed] >> LINEAR) + 1
        windows, some = np.unique(np.repeat(ref[placed] << 32, count) + spread(first, count), return_index=True)
        for window, offset in zip(windows.tolist(), np.repeat(begin[placed], count)[some].tolist(), strict=True):
            self.linear[window >> 32].setdefault(window & 0xFFFFFFFF, offset)


class BamArrowWriter(BamWriter, DataSourceArrowWriter):
    """``BamWriter`` that takes batches."""

    def fill(self, files, at: str, rows: Iterator[pa.RecordBatch]) -> tuple[int, list[str]]:
        refs, count, written = references(self.header), 0, 0
        numbers, index = {n.removeprefix("chr"): k for k, (n, _) in enumerate(refs)}, BatchIndex(len(refs))
        out = BgzfWriter(files.open_output_stream(at, compression=None))
        out.write(head(self.header))
        out.flush()
        first = len(out.starts) - 1
        for whole in rows:
            step = max(1, STEP * whole.num_rows // max(whole.nbytes, 1))
            for k in range(0, whole.num_rows, step):
                batch = pa.RecordBatch.from_arrays(whole.slice(k, step).columns, names=self.names)
                data, lengths = packed(batch, numbers, self.integers)
                out.write(data.tobytes())
                begins = starts_of(lengths)
                blocks, inside = np.divmod(begins + written, out.size)
                offsets = (np.array(out.starts[first + blocks[0] :], np.int64)[blocks - blocks[0]] << 16) + inside
                index.add_all(data, begins[:-1], offsets[:-1], offsets[1:])
                written, count = written + int(begins[-1]), count + batch.num_rows
        out.close()
        if index.ordered:
            with files.open_output_stream(f"{at}.bai", compression=None) as stream:
                stream.write(index.bytes())
        return count, [".bai"] * index.ordered
