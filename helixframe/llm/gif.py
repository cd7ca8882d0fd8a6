"""GIF media columns: writing, reading and colour histograms of timed frames.

The reader decodes LZW code streams, applies global and local palettes, interlacing, transparency
and the disposal methods, and gives composed frames with their delays.  The writer stores bytes
without loss as 8-bit samples of frames ``WIDTH`` pixels wide and at most ``ROWS`` high over a
256-grey palette, so that the indices read back are the bytes.

Defined results: a null or empty text is 64 zero bytes; a repeated row or null id keeps its row; a
very long text makes as many frames as it fills; a truncated or damaged file raises ``ValueError``
in the library and gives a null frame list in ``frames_of``; no rows give no rows; other columns
are never looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, short_batches

WIDTH = 64
ROWS = 512
DELAY = 10
MAX_CODE = 4096
HISTOGRAM = 8


@dataclass
class Frame:
    """A composed frame: RGB of the whole screen, its delay in hundredths of a second, and its own indices."""

    rgb: np.ndarray
    delay: int
    indices: np.ndarray
    left: int
    top: int


def lzw_encode(data: bytes) -> bytes:
    """GIF's variable-width LZW of 8-bit samples."""
    clear, end = 256, 257
    codes: list[int] = [clear << 8]
    starts = [0]  # places of clear codes, after each of which widths start again
    table: dict[int, int] = {}  # a code shifted by 8, with the next sample -> the longer string's code, shifted
    emit, get = codes.append, table.get
    after, full = 258 << 8, MAX_CODE << 8
    now = data[0] << 8 if data else -1
    for b in data[1:]:
        key = now | b
        if known := get(key):
            now = known
            continue
        emit(now)
        if after < full:
            table[key] = after
            after += 256
        else:
            starts.append(len(codes))
            emit(clear << 8)
            table.clear()
            after = 258 << 8
        now = b << 8
    if now >= 0:
        emit(now)
    emit(end << 8)
    every = np.array(codes, np.uint32) >> 8
    widths = np.empty(len(every), np.int64)
    bounds = [*starts, len(every)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        # The reader has 258 entries at a clear and one more with each code from the second on.
        known = 256 + np.arange(b - a)
        known[:1] = 258
        widths[a:b] = np.minimum(12, np.maximum(9, np.ceil(np.log2(known + 1)).astype(np.int64)))
        if a:
            widths[a] = 12
    return _put_bits(every, widths)


def _put_bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    places = np.cumsum(widths) - widths
    size = int(places[-1] + widths[-1])
    out = np.zeros(size // 8 + 5, np.uint8)
    wide = codes.astype(np.uint64) << (places & 7).astype(np.uint64)
    at = places >> 3
    for k in range(3):  # a code of 12 bits touches three bytes at most; bits never overlap, so sums are unions
        part = (wide >> np.uint64(8 * k) & np.uint64(255)).astype(np.float64)
        sums = np.bincount(at + k, weights=part, minlength=len(out))
        out += sums[: len(out)].astype(np.uint8)
    return out[: (size + 7) // 8].tobytes()


def lzw_decode(data: bytes, least: int, pixels: int) -> bytes:
    """The samples of a code stream; ``least`` is the minimum code size."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(data, np.uint8)
    raw = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.uint32)
    triples = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    place, total, made = 0, 8 * len(data), 0
    out: list[bytes] = []
    table, before, width = first.copy(), None, least + 1
    while made < pixels:
        # Until the width changes, and past a full table, codes have equal widths: they are cut out at once.
        size = len(table)
        most = (1 << width) - size + (before is None) if size < MAX_CODE else 4096
        places = place + width * np.arange(min(max(most, 1), (total - place) // width))
        if not len(places):
            break
        codes = triples[places >> 3] >> (places & 7).astype(np.uint32) & np.uint32((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stops[0]) if len(stops) else len(codes)
        run = codes[:upto].tolist()
        words: list[bytes] = []
        keep, add = words.append, table.append
        if run and before is None:
            if run[0] >= size:
                raise ValueError("a code stream begins with an unknown code")
            before = table[run.pop(0)]
            keep(before)
        if size < MAX_CODE:
            for code in run:
                if code < size:
                    word = table[code]
                    add(before + word[:1])
                elif code == size:
                    word = before + before[:1]
                    add(word)
                else:
                    raise ValueError("a code is beyond the table")
                size += 1
                keep(word)
                before = word
        else:
            words += [table[code] for code in run]
            before = words[-1] if words else before
        joined = b"".join(words)
        out.append(joined)
        made += len(joined)
        place += width * upto
        if upto < len(codes):
            place += width
            if codes[upto] == end:
                break
            table, before, width = first.copy(), None, least + 1
        elif len(table) == 1 << width and width < 12:
            width += 1
    return b"".join(out)[:pixels]


def write_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold ``samples`` (a positive multiple of ``width``) row by row."""
    height = min(rows, len(samples) // width)
    grey = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), grey]
    for at in range(0, len(samples), width * rows):
        block = samples[at : at + width * rows]
        coded = lzw_encode(block)
        parts += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(block) // width, 0), b"\x08"]
        parts += [bytes([len(coded[k : k + 255])]) + coded[k : k + 255] for k in range(0, len(coded), 255)]
        parts.append(b"\x00")
    return b"".join([*parts, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("the file ends inside a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n


def read_gif(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """The frames of a GIF, one at a time; without ``compose`` only a frame's own indices are made."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    screen = np.zeros((height, width, 3), np.uint8) if compose else None
    delay, disposal, clear_index = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        colours = shared
        if flags & 0x80:
            colours, at = _palette(data, at, flags)
        least = data[at]
        coded, at = _blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(coded, least, w * h).ljust(w * h, b"\x00"), np.uint8).reshape(h, w)
        if flags & 0x40:  # interlaced: rows 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, ..
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(flat)
            straight[order] = flat
            flat = straight
        if compose and colours is None:
            raise ValueError("a frame has no palette")
        shown = None
        if compose:
            earlier = screen.copy() if disposal == 3 else None
            part = flat[: max(0, height - top), : max(0, width - left)]
            view = screen[top : top + part.shape[0], left : left + part.shape[1]]
            seen = part != clear_index
            view[seen] = colours[np.minimum(part[seen], len(colours) - 1)]
            shown = screen.copy()
        yield Frame(shown, delay, flat, left, top)
        if compose:
            if disposal == 2:
                screen[top : top + h, left : left + w] = 0
            elif disposal == 3:
                screen = earlier
        delay, disposal, clear_index = 0, 0, -1


def colour_histogram(rgb: np.ndarray, bins: int = HISTOGRAM) -> list[int]:
    """Counts of pixels by equal ranges of red, then of green, then of blue."""
    level = rgb.reshape(-1, 3).astype(np.int64) * bins // 256
    return np.bincount((level + bins * np.arange(3)).ravel(), minlength=3 * bins).tolist()


def timed(number: int, frame: Frame) -> dict:
    """What is kept of a composed frame."""
    return {"number": number, "delay": frame.delay, "width": frame.rgb.shape[1], "height": frame.rgb.shape[0], "histogram": colour_histogram(frame.rgb)}


def feature_of(frames: list[dict]) -> str:
    """The timed frames as text: 'delay:red|green|blue' of each, in order, joined by ';'."""
    parts = []
    for f in frames:
        h = [str(n) for n in f["histogram"]]
        parts.append(f"{f['delay']}:" + "|".join(",".join(h[k : k + HISTOGRAM]) for k in range(0, 3 * HISTOGRAM, HISTOGRAM)))
    return f"frames={len(frames)};" + ";".join(parts)


def frames_of(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per file: id and ``frames``, an array of (number, delay, width, height, histogram); null if it can't be read."""
    short_batches(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list = []
            for data in b["media"]:
                try:
                    found.append(None if data is None else [timed(n, f) for n, f in enumerate(read_gif(bytes(data)))])
                except (ValueError, struct.error, IndexError):
                    found.append(None)
            yield pd.DataFrame({"id": b["id"].array, "frames": found})

    narrow = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"id {kind}, frames array<struct<number:int,delay:int,width:int,height:int,histogram:array<long>>>").withColumnRenamed("id", id_col)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as a GIF."""
    short_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, media = [], []
            for t in b["text"]:
                n, payload = payload_of(t)
                sizes.append(n), media.append(write_gif(payload))
            yield pd.DataFrame({"id": b["id"].array, "n_bytes": np.array(sizes, np.int64), "media": media})

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_back(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: payload digests, and the delay and colour histogram of each composed frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, n, data in zip(b["id"].array, b["n_bytes"], b["media"], strict=True):
                data = bytes(data)
                frames, parts = [], []
                for number, f in enumerate(read_gif(data)):
                    frames.append(timed(number, f))
                    parts.append(f.indices.tobytes())
                payload, feature = b"".join(parts), feature_of(frames)
                rows.append((None if pd.isna(doc) else int(doc), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield out.astype({"doc_id": "Int64"})

    narrow = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return narrow.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return read_back(stored(documents(spark, sf_dir)))
