"""Blocked gzip: compressed parts that join into one file, its position index, and its checksum.

Each task compresses its own lines; the driver only appends finished parts and a few numbers for each block of lines.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .bai import LINEAR, bin_of

#: Fixed values of the format: the most content of a block, and the empty block that ends a file.
CONTENT = 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(content: bytes, level: int = 6) -> bytes:
    """One compressed block."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(content) + coder.flush()
    head = struct.pack("<4BI2BH2BHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content))


def compressed(lines: DataFrame, level: int = 6) -> DataFrame:
    """(part, number, data, size): the ordered lines as blocks, each of whole lines where they are short enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number, part = b"", 0, None
        for b in batches:
            rows = []
            for p, line in zip(b["part"], b["line"], strict=True):
                part, raw = p, line.encode() + b"\n"
                if held and len(held) + len(raw) > CONTENT:
                    rows.append((number, held))
                    held, number = b"", number + 1
                held += raw
                while len(held) > CONTENT:
                    rows.append((number, held[:CONTENT]))
                    held, number = held[CONTENT:], number + 1
            if rows:
                yield pd.DataFrame({"part": part, "number": [n for n, _ in rows], "data": [block(x, level) for _, x in rows], "size": [len(x) for _, x in rows]})
        if held:
            yield pd.DataFrame({"part": [part], "number": [number], "data": [block(held, level)], "size": [len(held)]})

    return lines.select(F.spark_partition_id().alias("part"), "line").mapInPandas(run, "part int, number int, data binary, size int")


def tabix(rows: Iterator[tuple[str, int, int, int, int]]) -> bytes:
    """The position index of a VCF from (name, start, end, virtual begin, virtual stop) in the file's order; 0-based, half-open."""
    names: list[str] = []
    bins: list[dict[int, list[list[int]]]] = []
    linear: list[dict[int, int]] = []
    for name, start, end, begin, stop in rows:
        if not names or names[-1] != name:
            names.append(name), bins.append(defaultdict(list)), linear.append({})
        chunks = bins[-1][bin_of(start, end)]
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = stop
        else:
            chunks.append([begin, stop])
        for window in range(start >> LINEAR, ((end - 1) >> LINEAR) + 1):
            linear[-1].setdefault(window, begin)
    joined = b"".join(n.encode() + b"\0" for n in names)
    # fixed values: the VCF preset, its columns of name and position, its comment sign
    out = [b"TBI\x01", struct.pack("<8i", len(names), 2, 1, 2, 0, ord("#"), 0, len(joined)), joined]
    for own, windows in zip(bins, linear, strict=True):
        out.append(struct.pack("<i", len(own)))
        for number in sorted(own):
            out.append(struct.pack("<Ii", number, len(own[number])))
            out += [struct.pack("<QQ", a, b) for a, b in own[number]]
        known, places = 0, []
        for window in range(max(windows, default=-1) + 1):
            known = windows.get(window, known)
            places.append(known)
        out.append(struct.pack(f"<i{len(places)}Q", len(places), *places))
    return b"".join(out)


def write_whole(ordered: DataFrame, path: str, level: int = 6, index: bool = True, md5: bool = False) -> None:
    """Ordered lines as one file: compressed with its index for ``.gz``, plain text else; ``md5`` writes the checksum beside it.

    Parts are compressed where they are and streamed to the file in order, a block of at most 64 KB at a time.
    """
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    packed = path.endswith(".gz")
    digest = hashlib.md5()

    def put(sink, data: bytes) -> None:
        sink.write(data)
        digest.update(data)

    with system.open_output_stream(inner, compression=None) as sink:
        if packed:
            blocks = stage(compressed(ordered, level), "blocks")
            rows, at, carry, held = [], 0, b"", 0
            for r in blocks.orderBy("part", "number").toLocalIterator(prefetchPartitions=True):
                data = bytes(r["data"])
                put(sink, data)
                if index:
                    content, offset = zlib.decompress(data[18:-8], -15), 0
                    while (end := content.find(b"\n", offset)) >= 0:
                        begin = held if carry else at << 16 | offset
                        line, offset = carry + content[offset:end], end + 1
                        carry = b""
                        if line[:1] != b"#":
                            rows.append((*_span(line), begin, at << 16 | offset))
                    if offset < len(content):
                        held, carry = held if carry else at << 16 | offset, carry + content[offset:]
                at += len(data)
            put(sink, END)
        else:
            for r in ordered.toLocalIterator(prefetchPartitions=True):
                put(sink, r["line"].encode() + b"\n")
    if packed and index:
        with system.open_output_stream(inner + ".tbi", compression=None) as sink:
            raw = tabix(iter(rows))
            for k in range(0, len(raw), CONTENT):
                sink.write(block(raw[k : k + CONTENT]))
            sink.write(END)
    if md5:
        with system.open_output_stream(inner + ".md5") as sink:
            sink.write(f"{digest.hexdigest()}  {inner.rpartition('/')[2]}\n".encode())


def _span(line: bytes) -> tuple[str, int, int]:
    fields = line.decode().split("\t", 8)
    start = int(fields[1]) - 1
    end = next((int(x[4:]) for x in fields[7].split(";") if x.startswith("END=")), start + len(fields[3]))
    return fields[0], start, max(end, start + 1)
