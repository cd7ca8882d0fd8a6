"""BAM as a data source: ``spark.dataSource.register(BamSource)``, then ``spark.read.format("bam").load(path)``.

The header and the first block of each split are found by scanning for block headers, so a large
file is read by many tasks: a task takes the blocks that begin in its byte range and the records that begin in them.
Paths are read through pyarrow's file systems, which open whatever the executors can.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import READS

OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
#: A first record that could not be one: what a record's fixed fields may hold.
MOST_RECORD = 1 << 24


def blocks(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of compressed blocks that begin in [start, end)."""
    f.seek(start)
    at = start
    while at < end:
        f.seek(at)
        head = f.read(18)
        if len(head) < 18:
            return
        extra = struct.unpack("<H", head[10:12])[0]
        size = struct.unpack("<H", head[16:18])[0] + 1
        body = f.read(size - 18)
        yield at, zlib.decompress(body[extra - 6 : -8] if extra > 6 else body[:-8], -15)
        at += size


def is_block(data: bytes) -> bool:
    return data[:4] == b"\x1f\x8b\x08\x04" and data[12:16] == b"BC\x02\x00"


def header(data: bytes) -> tuple[str, list[tuple[str, int]], int] | None:
    """(text, contigs, length of the header in bytes); None if the data ends before it does."""
    if len(data) < 12:
        return None
    n = struct.unpack("<i", data[4:8])[0]
    at = 8 + n
    if len(data) < at + 4:
        return None
    text, count = data[8:at].rstrip(b"\0").decode(), struct.unpack("<i", data[at : at + 4])[0]
    at += 4
    contigs = []
    for _ in range(count):
        if len(data) < at + 4:
            return None
        size = struct.unpack("<i", data[at : at + 4])[0]
        if len(data) < at + 8 + size:
            return None
        contigs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack("<i", data[at + 4 + size : at + 8 + size])[0]))
        at += 8 + size
    return text, contigs, at


def record(data: bytes, number: int) -> tuple:
    """A record's fields in the order of ``schemas.READS``."""
    tid, pos, name_size, mapq, _, n_ops, flag, length, mtid, mpos, isize = struct.unpack("<iiBBHHHiiii", data[:32])
    at = 32 + name_size
    name = data[32 : at - 1].decode()
    cigar = [(OPS[x & 15], x >> 4) for x in struct.unpack(f"<{n_ops}I", data[at : at + 4 * n_ops])]
    at += 4 * n_ops
    packed = data[at : at + (length + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length]
    at += (length + 1) // 2
    quals = list(data[at : at + length])
    at += length
    group = None
    tags = data[at:]
    k = tags.find(b"RGZ")
    if k >= 0:
        group = tags[k + 3 : tags.index(b"\0", k)].decode()
    used = sum(n for op, n in cigar if op in "MDN=X")
    return (number, name, flag, tid, pos + 1, pos + max(used, 1), mapq, cigar, mtid, mpos + 1, isize, seq, quals, group)


class Split(InputPartition):
    """A byte range of a file; ``chunk`` is a range of virtual places that an index gave in its stead."""

    def __init__(self, path: str, start: int, end: int, chunk: tuple[int, int] | None = None):
        self.path, self.start, self.end, self.chunk = path, start, end, chunk


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inner


def head_of(system, inner: str) -> tuple[str, list[tuple[str, int]], int] | None:
    """(text, contigs, length of the header in bytes) of a file."""
    with system.open_input_file(inner) as f:
        data = b""
        for _, content in blocks(f, 0, f.size()):
            data += content
            if (known := header(data)) is not None:
                return known
    return None


def index_path(system, inner: str) -> str | None:
    """Where a file's index lies: beside it, with its suffix added or in place of the file's."""
    for name in (inner + ".bai", inner.removesuffix(".bam") + ".bai"):
        if system.get_file_info(name).is_file:
            return name
    return None


def make_index(path: str) -> None:
    """Writes the index of a sorted BAM file beside it."""
    from . import bai

    system, inner = _open(path)
    known = head_of(system, inner)
    found = []
    with system.open_input_file(inner) as f:
        buffer, places = b"", []  # bytes not yet used, and (offset in the buffer, place) of each block in it
        skip = known[2]
        for place, content in blocks(f, 0, f.size()):
            places.append((len(buffer), place))
            buffer += content
            at = 0
            if skip:
                at = min(skip, len(buffer))
                skip -= at
            while len(buffer) - at >= 4 and len(buffer) - at >= 4 + (n := struct.unpack("<i", buffer[at : at + 4])[0]):
                body = buffer[at + 4 : at + 4 + n]
                tid, pos, name_size, _, _, ops = struct.unpack("<iiBBHH", body[:14])
                cigar = struct.unpack(f"<{ops}I", body[32 + name_size : 32 + name_size + 4 * ops])
                used = sum(x >> 4 for x in cigar if OPS[x & 15] in "MDN=X")
                begin, end = _virtual(places, at), _virtual(places, at + 4 + n - 1) + 1
                found.append((tid, pos, pos + max(used, 1), begin, end))
                at += 4 + n
            buffer = buffer[at:]
            places = [(max(0, o - at), p) if o > at else (o - at, p) for o, p in places if o + 65536 * 4 > at]
    with system.open_output_stream(inner + ".bai") as sink:
        sink.write(bai.made(len(known[1]), found))


def _virtual(places: list[tuple[int, int]], at: int) -> int:
    offset, place = next(x for x in reversed(places) if x[0] <= at)
    return place << 16 | at - offset


class BamReader(DataSourceReader):
    """Splits by byte ranges; with regions and an index by the index's chunks, so that other blocks are never read."""

    def __init__(self, paths: list[str], split: int, regions: list[tuple[str | int, int, int]] | None = None):
        self.paths, self.split, self.regions = paths, split, regions

    def _spans(self, contigs: list[tuple[str, int]]) -> list[tuple[int, int, int]]:
        """Regions as (tid, start, end), 0-based and half-open."""
        number = {name: i for i, (name, _) in enumerate(contigs)}
        return [(c if isinstance(c, int) else number.get(c, -1), max(0, a - 1), b) for c, a, b in self.regions or []]

    def partitions(self) -> list[InputPartition]:
        from . import bai

        out: list[InputPartition] = []
        for path in self.paths:
            system, inner = _open(path)
            info = system.get_file_info(inner)
            if not info.is_file:
                raise FileNotFoundError(path)
            index = index_path(system, inner) if self.regions is not None else None
            if index is not None and (known := head_of(system, inner)) is not None:
                with system.open_input_file(index) as f:
                    chunks = bai.search(bai.parse(f.read()), self._spans(known[1]))
                out += [Split(path, a >> 16, b >> 16, (a, b)) for a, b in chunks]
            else:
                out += [Split(path, a, min(info.size, a + self.split)) for a in range(0, info.size, self.split)]
        return out or [Split(self.paths[0], 0, 0)]

    def read(self, part: Split) -> Iterator[tuple]:
        rows = self._chunk(part) if part.chunk else self._range(part) if part.end > part.start else iter(())
        if self.regions is None:
            yield from rows
            return
        system, inner = _open(part.path)
        known = head_of(system, inner)
        spans = self._spans(known[1]) if known else []
        for r in rows:  # a read that meets several regions is given once
            if any(t == r[3] and r[4] - 1 < b and r[5] > a for t, a, b in spans):
                yield r

    def _chunk(self, part: Split) -> Iterator[tuple]:
        """The records that begin between two virtual places."""
        begin, stop = part.chunk
        system, inner = _open(part.path)
        with system.open_input_file(inner) as f:
            buffer, places, at, number = b"", [], begin & 0xFFFF, begin
            for place, content in blocks(f, begin >> 16, f.size()):
                places.append((len(buffer), place))
                buffer += content
                while len(buffer) - at >= 4 and len(buffer) - at >= 4 + (n := struct.unpack("<i", buffer[at : at + 4])[0]):
                    if _virtual(places, at) >= stop:
                        return
                    yield record(buffer[at + 4 : at + 4 + n], number)
                    number += 1
                    at += 4 + n
                if place << 16 >= stop and len(buffer) - at == 0:
                    return
                keep = [x for x in places if x[0] <= at][-1:] + [x for x in places if x[0] > at]
                cut = min(at, keep[0][0]) if keep else 0
                buffer, at, places = buffer[cut:], at - cut, [(o - cut, p) for o, p in keep]

    def _range(self, part: Split) -> Iterator[tuple]:
        """Records whose first byte lies in a block that begins in the split."""
        system, inner = _open(part.path)
        with system.open_input_file(inner) as f:
            size = f.size()
            data, known = b"", None
            for _, block in blocks(f, 0, size):
                data += block
                if (known := header(data)) is not None:
                    break
            if known is None:
                return
            start = part.start
            while start < part.end and start > 0:  # the first block of this split
                f.seek(start)
                window = f.read(min(70_000, size - start))
                k = window.find(b"\x1f\x8b\x08\x04")
                while k >= 0 and not is_block(window[k : k + 18]):
                    k = window.find(b"\x1f\x8b\x08\x04", k + 1)
                if k >= 0:
                    start += k
                    break
                start += 65_000
            if start >= part.end:
                return
            stream = blocks(f, start, size)
            buffer, at, limit, number = b"", 0, None, part.start << 20
            skip = known[2] if part.start == 0 else None
            ended = False
            mine = 0  # bytes of the buffer from blocks of this split
            while True:
                while not ended and (len(buffer) - at < 4 or len(buffer) - at < 4 + struct.unpack("<i", buffer[at : at + 4])[0] or skip is not None or limit is None):
                    nxt = next(stream, None)
                    if nxt is None:
                        ended = True
                        break
                    buffer, mine = buffer[at:] + nxt[1], max(0, mine - at) + (len(nxt[1]) if nxt[0] < part.end else 0)
                    at = 0
                    if skip is not None:
                        if len(buffer) < skip:
                            continue
                        at, skip = skip, None
                    elif limit is None:
                        at = _first_record(buffer, len(known[1]))
                    limit = 1
                if at >= mine or len(buffer) - at < 4:
                    return
                n = struct.unpack("<i", buffer[at : at + 4])[0]
                if len(buffer) - at < 4 + n:
                    return
                yield record(buffer[at + 4 : at + 4 + n], number)
                number += 1
                at += 4 + n


class PushdownReader(BamReader):
    """A reader that takes filters on ``tid``, ``start`` and ``end`` as a region; Spark must have ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters):
        """Takes a contig's number and bounds of the start as a region; all filters are still applied behind the scan."""
        from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

        tid, least, most = None, 1, 1 << 29
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("tid",) and isinstance(f, EqualTo):
                tid = f.value
            elif name == ("start",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                most = min(most, f.value)
            elif name in (("end",), ("start",)) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                least = max(least, f.value)
            yield f
        if tid is not None and tid >= 0 and self.regions is None and least <= most:
            self.regions = [(int(tid), int(least), int(most))]


def _first_record(data: bytes, contigs: int) -> int:
    """The first offset at which a chain of plausible records begins.  Writers start blocks at records, so this is mostly 0."""

    def plausible(at: int) -> int:
        if len(data) - at < 36:
            return -1
        n, tid, pos, name, _, _, ops, _, length, mtid, mpos = struct.unpack("<iiiBBHHHiii", data[at : at + 32])
        good = 32 < n < MOST_RECORD and -1 <= tid < contigs and pos >= -1 and name > 1 and 0 <= length < MOST_RECORD and -1 <= mtid < contigs and mpos >= -1 and 32 + name + 4 * ops + (length + 1) // 2 + length <= n
        return at + 4 + n if good else -1

    for at in range(max(0, len(data) - 35)):
        nxt = plausible(at)
        hops = 0
        while 0 <= nxt < len(data) - 36 and hops < 3:
            nxt = plausible(nxt)
            hops += 1
        if nxt >= 0:
            return at
    return len(data)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        """Options: ``path`` (several by commas), ``split`` bytes, ``regions`` as name:start-end by semicolons, 1-based and closed; ``pushdown`` true."""
        text = self.options.get("regions")
        regions = None
        if text is not None:
            regions = [(name, *map(int, span.split("-"))) for name, _, span in (x.rpartition(":") for x in text.split(";") if x)]
        kind = PushdownReader if self.options.get("pushdown", "false").lower() == "true" else BamReader
        return kind(self.options["path"].split(","), int(self.options.get("split", 64 << 20)), regions)
