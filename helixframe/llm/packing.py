"""Packing documents into windows of a fixed length, bounded-space and online.

Each partition is packed as it streams by.  A document's ids (its tokens, then the end id) are
cut into whole windows and a rest.  A whole window is a sequence by itself.  A rest goes to the
open window with the least room that still holds it (best fit).  At most ``open_windows`` are
kept: when none fits and the limit is reached, the fullest is emitted and a new one is opened.  What is open at the
end of a partition is left over; leftovers of all partitions are merged at last: their pieces
are laid one after the other, each partition's ids being cut where a window is full, so that a
merging task ends with one partly filled window.  The end of that one is cut into powers of two,
which need no padding, as long as a part has at least ``least_part`` ids.

Memory: one Arrow batch of texts, a bounded cache of words, and ``open_windows`` windows.  The
only shuffle is that of the leftovers, at most ``open_windows`` windows for each partition.

Defined results: a null text counts as empty, so its document is the end id alone; a null id or
a repeated row is packed like any other; a very long text makes as many whole windows as it
fills; no rows give no rows; other columns are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import count, filterfalse, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, short_batches, slices, stage

WINDOW = 1024
OPEN_WINDOWS = 128
LEAST_PART = 64
#: Leftover pieces that one merging task lays out.
PIECES_A_TASK = 20_000
WORDS_KEPT = 200_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The pattern by which byte-level BPE vocabularies of this family cut a text, a published constant.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _fast_twin(path: str):
    """The same vocabulary as ranks for a faster encoder, and for each id whether it begins with a space; None for other kinds of tokenizer."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or model.get("dropout"):
        return None
    byte_of, special = _byte_of(), {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if made != sorted(set(made)) or (made and made[0] < 0):
        return None  # merges out of the ids' order
    starts = np.zeros(max(ranks.values()) + 1, bool)
    for token, i in ranks.items():
        starts[i] = token[:1] == b" "
    return tiktoken.Encoding("twin", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), starts


class WordCache:
    """Ids of a text as little-endian unsigned 32-bit bytes, word by word.

    The tokenizer's first step never joins characters across a single space that is followed by
    a non-space: the space goes with what follows.  So a text is cut before such spaces, and each
    distinct part is tokenized once.  A text in which white space follows a space, or one
    that may hold a special token, is tokenized as a whole by the tokenizer itself.  New words are encoded
    together by a faster encoder of the same vocabulary where the tokenizer is of a kind that has one; each
    cache first holds that one against the tokenizer on its first words, and drops it if any id differs.
    """

    wide = re.compile(r" \s")
    ascii_pairs = tuple(" " + c for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f")

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.known: dict[str, bytes] = {}  # of words after a space
        self.first: dict[str, bytes] = {}  # of words that begin a text
        self.twin, self.trusted = _fast_twin(path), False

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _after_space(self, words: list[str]) -> list[bytes]:
        if self.twin is None:
            return self._encode([" " + w for w in words])
        encoder, starts = self.twin
        ids = encoder.encode_to_numpy(" " + " ".join(words), disallowed_special=()).astype("<u4")
        bounds = np.flatnonzero(starts[ids]) * 4
        data = ids.tobytes()
        if len(bounds) != len(words):
            return self._encode([" " + w for w in words])
        found = [data[a:b] for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(data)], strict=True)]
        if not self.trusted:
            some = range(0, len(words), max(1, len(words) // 500))
            if self._encode([" " + words[i] for i in some]) != [found[i] for i in some]:
                self.twin = None
                return self._after_space(words)
            self.trusted = True
        return found

    def unsafe(self, text: str) -> bool:
        """Whether a text must be encoded as a whole."""
        if text[:1] == " " or text[-1:] == " " or "<|" in text:
            return True
        if text.isascii():
            return any(pair in text for pair in self.ascii_pairs)
        return self.wide.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for part in slices(texts) for ids in self._encode_slice(part)]

    def _encode_slice(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.kept:
            self.known = dict(islice(self.known.items(), self.kept // 2))  # the oldest words are the most frequent ones
        if len(self.first) > self.kept:
            self.first.clear()
        out, cut, whole = [b""] * len(texts), {}, []
        new: set[str] = set()
        begin: set[str] = set()
        for i, t in enumerate(texts):
            if self.unsafe(t):
                whole.append(i)
            elif t:
                words = t.split(" ")
                begin.add(words[0])
                cut[i] = words
                new.update(filterfalse(self.known.__contains__, islice(words, 1, None)))
        fresh = list(new)
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            self.known.update(zip(part, self._after_space(part), strict=True))
        fresh = [w for w in begin if w not in self.first]
        self.first.update(zip(fresh, self._encode(fresh), strict=True))
        get = self.known.__getitem__
        for i, words in cut.items():
            out[i] = self.first[words[0]] + b"".join(map(get, islice(words, 1, None)))
        for i, e in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = e
        return out


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """One cache for a tokenizer in each Python worker."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


class Packer:
    """Bounded-space best fit.  ``full`` are closed windows: lists of (document number, start, length)."""

    def __init__(self, window: int, most_open: int):
        self.window, self.most = window, most_open
        self.by_room: list[list[list]] = [[] for _ in range(window + 1)]
        self.open, self.full = 0, []

    def _room_from(self, least: int) -> int:
        for room in range(least, self.window + 1):
            if self.by_room[room]:
                return room
        return -1

    def add(self, piece: tuple[int, int, int]) -> None:
        length = piece[2]
        room = self._room_from(length)
        if room < 0:
            if self.open == self.most:
                self.full.append(self.by_room[self._room_from(0)].pop(0))
                self.open -= 1
            window: list = []
            room = self.window
            self.open += 1
        else:
            window = self.by_room[room].pop(0)
        window.append(piece)
        room -= length
        if room:
            self.by_room[room].append(window)
        else:
            self.full.append(window)
            self.open -= 1

    def rest(self) -> list[list]:
        return [w for ws in self.by_room for w in ws]


def _crc(ids: bytes, start: int, length: int) -> int:
    return zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])


def _rows(rows: list, columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({c: "Int64" for c in columns if c != "ids"})


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_part: int = LEAST_PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it comes from, and where it stands (sequence_id, offset)."""
    short_batches(docs.sparkSession)
    columns = [c.split()[0] for c in PIECE.split(", ")]
    end = np.asarray([end_id], "<u4").tobytes()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, packer, held = word_cache(tokenizer), Packer(window, open_windows), {}
        numbers, sequences = count(), count(TaskContext.get().partitionId() << 36)

        def closed(windows: list, left: bool) -> list:
            rows = []
            for pieces in windows:
                sequence, offset = None if left else next(sequences), 0
                for n, start, length in pieces:
                    doc, total, ids = held.pop(n)
                    rows.append((doc, start, length, zlib.crc32(ids), total, sequence, offset, ids if left else None))
                    offset += length
            return rows

        for b in batches:
            rows = []
            for doc, ids in zip(b["id"].array, cache.encode(b["text"].fillna("").tolist()), strict=True):
                ids += end
                total = len(ids) // 4
                doc = None if pd.isna(doc) else int(doc)
                whole = total // window * window
                for start in range(0, whole, window):
                    rows.append((doc, start, window, _crc(ids, start, window), total, next(sequences), 0, None))
                if whole < total:
                    n = next(numbers)
                    held[n] = (doc, total, ids[4 * whole :])
                    packer.add((n, whole, total - whole))
            rows += closed(packer.full, False)
            packer.full = []
            yield _rows(rows, [*columns, "ids"])
        yield _rows(closed(packer.rest(), True), [*columns, "ids"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequences = count(1 << 62 | TaskContext.get().partitionId() << 36)
        waiting: list[tuple] = []
        room = window

        def out(pieces: list[tuple]) -> list[tuple]:
            sequence, offset, rows = next(sequences), 0, []
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
                offset += len(ids) // 4
            return rows

        for b in batches:
            rows = []
            for doc, start, total, ids in zip(b["doc_id"].array, b["start"], b["doc_tokens"], b["ids"], strict=True):
                doc = None if pd.isna(doc) else int(doc)
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    waiting.append((doc, start, part, total))
                    start, room = start + len(part) // 4, room - len(part) // 4
                    if not room:
                        rows += out(waiting)
                        waiting, room = [], window
            yield _rows(rows, columns)
        rows, used = [], window - room
        while used:
            size = used if used < 2 * least_part or used & used - 1 == 0 else 1 << used.bit_length() - 1
            here: list[tuple] = []
            while size and waiting:
                doc, start, ids, total = waiting.pop(0)
                n = min(size, len(ids) // 4)
                here.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    waiting.insert(0, (doc, start + n, ids[4 * n :], total))
                size, used = size - n, used - n
            rows += out(here)
        yield _rows(rows, columns)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = stage(narrow.mapInPandas(first, PIECE + ", ids binary"), "packed")
    done = packed.filter("sequence_id is not null").drop("ids")
    left = packed.filter("sequence_id is null")
    tasks = max(1, left.count() // PIECES_A_TASK)
    order = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    merged = left.repartition(tasks, order).sortWithinPartitions("doc_id", "start", "ids_crc32", "doc_tokens").mapInPandas(merge, PIECE)
    return done.unionByName(merged)


def op3_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
