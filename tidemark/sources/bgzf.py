"""Block-compressed files (BGZF) from any offset: blocks, virtual offsets, and text read in splits.

A virtual offset is the offset of a block in the file, shifted left by 16, plus a place inside its contents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.commit import FolderWriter

#: Fixed values of the format: how a block begins, the largest one, and the empty block at the end of a file.
MAGIC, LARGEST = b"\x1f\x8b\x08\x04", 1 << 16
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
WINDOW, SPLIT = 1 << 20, 32 << 20


def open_file(path: str):
    """(file open for reads at any place, its size). path: local, or a URI of a file system that Arrow knows."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    return files.open_input_file(at), files.get_file_info(at).size


def found(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of those in a folder with this ending, in order; hidden files (. and _) are left out."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    some = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    shown = [x for x in some if x is info or x.path.endswith(ending) and not x.base_name.startswith((".", "_"))]
    return sorted((head + x.path, x.size) for x in shown if x.type == fs.FileType.File)


def deflated(data: bytes, level: int = 6) -> bytes:
    """One block of up to 65,280 bytes."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    return MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<HHHH", 6, 0x4342, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """The blocks of a file, read through a window of WINDOW bytes. ``inflated`` counts those that were unpacked."""

    def __init__(self, path: str):
        self.file, self.size = open_file(path)
        self.path, self.start, self.window, self.inflated = path, 0, b"", 0

    def _read(self, at: int, n: int) -> bytes:
        if not self.start <= at or at + n > self.start + len(self.window):
            self.file.seek(at)
            self.start, self.window = at, self.file.read(max(n, WINDOW))
        return self.window[at - self.start : at - self.start + n]

    def _length(self, at: int) -> int | None:
        """Bytes of the block at this offset; None where no block begins."""
        head = self._read(at, 12)
        if len(head) < 12 or head[:4] != MAGIC:
            return None
        extra, k = self._read(at + 12, struct.unpack("<H", head[10:12])[0]), 0
        while k + 4 <= len(extra):
            tag, n = extra[k : k + 2], struct.unpack("<H", extra[k + 2 : k + 4])[0]
            if tag == b"BC" and n == 2 and k + 6 <= len(extra):
                return struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
            k += 4 + n
        return None

    def at(self, offset: int, sure: bool = True) -> tuple[bytes, int] | None:
        """(contents, offset of the next block); None at the end of the file or, unless sure, where no whole block is."""
        if offset >= self.size:
            return None
        length = self._length(offset)
        raw = self._read(offset, length) if length else b""
        try:
            if not length or len(raw) < length:
                raise ValueError("no block")
            body = 12 + struct.unpack("<H", raw[10:12])[0]
            data = zlib.decompress(raw[body:-8], -15)
            if struct.unpack("<II", raw[-8:]) != (zlib.crc32(data), len(data)):
                raise ValueError("wrong checksum")
        except (ValueError, zlib.error) as e:
            if sure:
                raise ValueError(f"{self.path}: not a BGZF block at {offset}: {e}") from e
            return None
        self.inflated += 1
        return data, offset + length

    def next_start(self, offset: int, before: int) -> int | None:
        """Offset of the first block from ``offset`` on that starts below ``before``: one whose contents have the size and
        the checksum that its end states."""
        at = offset
        while at < min(before, self.size):
            piece = self._read(at, min(WINDOW, self.size - at))
            k = piece.find(MAGIC)
            if k < 0:
                at += max(1, len(piece) - len(MAGIC) + 1)
            elif at + k >= before:
                return None
            elif self.at(at + k, sure=False) is not None:
                return at + k
            else:
                at += k + 1
        return None


def split_offsets(size: int, split: int) -> Iterator[tuple[int, int]]:
    for at in range(0, max(size, 1), split):
        yield at, min(size, at + split)


def text_lines(blocks: Blocks, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the lines that belong to the blocks of [start, stop): those whose line break before lies in
    them, and the file's first line. The last of them may end, or even begin, in blocks behind."""
    at = blocks.next_start(start, stop) if start else 0
    active, begun, parts = start == 0, None, []
    while at is not None and (got := blocks.at(at)) is not None:
        (data, after), place = got, 0
        while (cut := data.find(b"\n", place)) >= 0:
            if active:
                yield (at << 16) + place if begun is None else begun, b"".join([*parts, data[place:cut]])
            if at >= stop:
                return
            active, begun, parts, place = True, None, [], cut + 1
        if active and place < len(data):
            begun = (at << 16) + place if begun is None else begun
            parts.append(data[place:])
        at = after
        if at >= stop and not active:
            return
    if parts:
        yield begun, b"".join(parts)


class Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class BgzfText(DataSource):
    """``spark.read.format("bgzf_text").load(path)``: (file, at, value), the lines of block-compressed text.

    A file is read by as many tasks as it has splits (option ``splitBytes`` of compressed size, 32 MB): each finds the first
    block in its own, so no index is needed. ``at`` is the line's virtual offset, which orders the lines of a file. Also
    writes frames of one string column, a file for each partition that has rows; null is an empty line."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_text"

    def schema(self) -> str:
        return "file string, at long, value string"

    def writer(self, schema, overwrite: bool) -> BgzfTextWriter:
        return BgzfTextWriter(self.options["path"], overwrite)

    def reader(self, schema) -> BgzfTextReader:
        return BgzfTextReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


class BgzfTextReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        return [Split(p, a, b) for p, size in found(self.path, ".gz") for a, b in split_offsets(size, self.split)]

    def read(self, partition: Split) -> Iterator[tuple]:
        for at, line in text_lines(Blocks(partition.path), partition.start, partition.stop):
            yield partition.path, at, line.decode("utf-8", "replace").removesuffix("\r")


class BgzfWriter:
    """Bytes as BGZF: ``write`` them, then ``close``. ``starts`` has the offsets of the blocks, the next one's last."""

    def __init__(self, stream, size: int = 65280):
        self.stream, self.size, self.held, self.offset, self.starts = stream, size, bytearray(), 0, [0]

    def tell(self) -> int:
        """The virtual offset of what is written next."""
        return (self.offset << 16) + len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= self.size:
            self._block(bytes(self.held[: self.size]))
            del self.held[: self.size]

    def _block(self, data: bytes) -> None:
        block = deflated(data)
        self.stream.write(block)
        self.offset += len(block)
        self.starts.append(self.offset)

    def flush(self) -> None:
        """Ends the block."""
        if self.held:
            self._block(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.stream.write(END)
        self.stream.close()


class BgzfTextWriter(FolderWriter):
    ENDINGS = (".gz",)

    def fill(self, files, at: str, rows: Iterator) -> tuple[int, list[str]]:
        out, count = BgzfWriter(files.open_output_stream(at, compression=None)), 0
        for (line,) in rows:
            out.write((line or "").encode() + b"\n")
            count += 1
        out.close()
        return count, []
