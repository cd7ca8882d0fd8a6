"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, a bit being 1 if it is set in over half of the XXH64 hashes of the
text's word shingles.  Fingerprints link when at most ``threshold`` bits differ.

Search.  The 64 bits are cut into blocks, of which at least one differs in few bits between two linked
fingerprints: with three blocks (22, 21 and 21 bits) one in at most ``threshold // 3 = 1``, with two of 32 in at
most 2.  In each block the anchors are a covering code: [15, 11] Hamming codes (covering radius 1) on 15 bits or
twice 15, and every word on the bits left over (radius 0).  A fingerprint is at home at the anchor nearest to its
block, and it is replicated to every other anchor that a block within the block's threshold of its own can call
home: those within the covering radius plus that threshold.  Every linked pair so meets at one's home anchor, and
each anchor is compared on its own, its home members against all its members.

Cost for n distinct fingerprints: with three blocks about 38 small rows each and 0.0004 * n * n comparisons of two
longs; with two blocks about 300 rows each and 0.00002 * n * n.  Two blocks are taken from ``TWO_BLOCKS_FROM``
fingerprints on, where the comparisons outweigh the rows; the result is the same.  Equal fingerprints are merged
before the search, so copies cost nothing.  Anchors where more than ``cell_rows`` rows are at home are split: their
homes are dealt over salts and the others are sent to each salt, which loses no pair.  Homes come first, at most
about ``cell_rows`` of them are held, and the others stream by.  Within an anchor only a spanning set of the links is
emitted, never all pairs.

Fingerprints are the nodes of the links; a group's name is the least id of all its documents.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other; a text
of fewer words than a shingle is hashed as a whole; documents with a null id are linked like others but never name
a group, and a group of such documents alone has a null component; repeated rows get the same answer; different texts
under one id are looked at one by one, and each row tells the group of its own text; no rows give no rows; other
columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents, keyed, short_batches, stage
from .components import components

SHINGLE = 4
THRESHOLD = 4
SEED = 42
CODE_BITS = 15
#: (first bit, width, bits that may differ, codes of 15 bits) of each block.
THREE_BLOCKS = ((0, 22, 1, 1), (22, 21, 1, 1), (43, 21, 1, 1))
TWO_BLOCKS = ((0, 32, 2, 2), (32, 32, 2, 2))
TWO_BLOCKS_FROM = 200_000_000
CELL_ROWS = 50_000
PAIRS_AT_ONCE = 1_000_000
#: Hash values turned into bits at once, which bounds the memory that a very long text needs.
HASHES_AT_ONCE = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= shingle:
        first, last = [0], [len(joined)]
    else:
        first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for k in range(0, len(first), HASHES_AT_ONCE):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[k : k + HASHES_AT_ONCE], last[k : k + HASHES_AT_ONCE], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[Column, ...] = ()) -> DataFrame:
    """(id, fp long, mark0, ..): the fingerprint's bits as a signed long, and longs that are carried along."""
    short_batches(docs.sparkSession)
    names = [f"mark{i}" for i in range(len(marks))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"id": b["id"], "fp": fps.view(np.int64), **{m: b[m] for m in names}})

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[m.alias(n) for m, n in zip(marks, names, strict=True)])
    return narrow.mapInPandas(run, ", ".join(["id long", "fp long", *[f"{m} long" for m in names]]))


@lru_cache(1)
def _code() -> list[np.ndarray]:
    """For 0, 1 and 2 bits: the codewords that words within so many bits of each 15-bit word call home (padded with -1)."""
    words = np.arange(1 << CODE_BITS)
    syndrome = np.zeros(len(words), np.int64)
    for i in range(CODE_BITS):
        syndrome ^= np.where(words >> i & 1, i + 1, 0)
    one = 1 << np.arange(CODE_BITS)
    home = words ^ np.concatenate(([0], one))[syndrome]
    found = []
    for bits in range(3):
        flips = [0, *[int(sum(c)) for k in range(1, bits + 1) for c in combinations(one, k)]]
        near = np.sort(home[words[:, None] ^ np.array(flips)], axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = -np.sort(-near, axis=1)
        found.append(near[:, : int((near >= 0).sum(axis=1).max())])
    return found


def _shares(bits: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to deal ``bits`` over ``parts``."""
    return [(bits,)] if parts == 1 else [(i, *rest) for i in range(bits + 1) for rest in _shares(bits - i, parts - 1)]


def anchor_rows(fps: np.ndarray, layout=THREE_BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) for an array of at most 2**20 unsigned fingerprints."""
    near = _code()
    out = []
    for b, (first, width, may, codes) in enumerate(layout):
        block = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        segments = [block >> CODE_BITS * k & ((1 << CODE_BITS) - 1) for k in range(codes)]
        spare = width - CODE_BITS * codes
        name = b << 40 | (block >> CODE_BITS * codes) << CODE_BITS * codes
        home = name.copy()
        for k, segment in enumerate(segments):
            home |= near[0][segment, 0] << CODE_BITS * k
        keys = []
        for *shares, spares in _shares(may, codes + 1):
            for flips in combinations(range(spare), spares):
                row, cell = np.arange(len(fps)), name ^ (sum(1 << i for i in flips) << CODE_BITS * codes)
                for k, (segment, share) in enumerate(zip(segments, shares, strict=True)):
                    options = near[share][segment[row]]
                    r, c = np.nonzero(options >= 0)
                    row, cell = row[r], cell[r] | options[r, c] << CODE_BITS * k
                keys.append(row << 42 | cell)
        key = np.unique(np.concatenate(keys))
        row, cell = key >> 42, key & ((1 << 42) - 1)
        out.append((row, cell, cell == home[row]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _replicas(layout):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy(np.int64)
            for k in range(0, len(b), 10_000):
                row, cell, home = anchor_rows(fps[k : k + 10_000].view(np.uint64), layout)
                yield pd.DataFrame({"cell": cell, "home": home, "fp": fps[k : k + 10_000][row]})

    return run


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member reachable from each of 0..n-1 by the links i-j."""
    lab = np.arange(n)
    while True:
        old = lab.copy()
        least = np.minimum(lab[i], lab[j])
        np.minimum.at(lab, i, least)
        np.minimum.at(lab, j, least)
        lab = lab[lab]
        if (lab == old).all():
            return lab


def cell_links(cell: np.ndarray, home: np.ndarray, fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (greater, lesser) between the fingerprints of whole cells."""
    order = np.lexsort((fp, cell))
    cell, home, fp = cell[order], home[order], fp[order]
    new = np.concatenate(([True], cell[1:] != cell[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(cell)))
    of = np.cumsum(new) - 1
    mine = np.flatnonzero(home & (size[of] > 1))
    found_i, found_j = [], []
    many = size[of[mine]]
    total = np.cumsum(many)
    k = 0
    while k < len(mine):
        upto = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS_AT_ONCE, "right")))
        who, count = mine[k:upto], many[k:upto]
        i = np.repeat(who, count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[of[who]], count)
        hit = (np.bitwise_count(fp[i] ^ fp[j]) <= threshold) & (i != j)
        found_i.append(i[hit]), found_j.append(j[hit])
        k = upto
        if sum(map(len, found_i)) > PAIRS_AT_ONCE:  # keep only a spanning set
            lab = _spanning(np.concatenate(found_i), np.concatenate(found_j), len(cell))
            moved = np.flatnonzero(lab != np.arange(len(cell)))
            found_i, found_j = [moved], [lab[moved]]
    if not found_i:
        return fp[:0], fp[:0]
    lab = _spanning(np.concatenate(found_i), np.concatenate(found_j), len(cell))
    moved = np.flatnonzero(lab != np.arange(len(cell)))
    return fp[moved], fp[lab[moved]]


def met_links(homes: np.ndarray, others: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between homes and others of one cell, for a slice of the homes at a time.

    Each slice is a table of hits through which the least label is passed on, by rows and by columns, until
    nothing changes.  What is kept of it are the labels, and a link wherever one label gave way to another.
    """
    names = np.concatenate((homes, others))
    labels = np.arange(len(homes), len(names), dtype=np.int32)
    far = np.int32(2**31 - 1)
    at_once = max(1, PAIRS_AT_ONCE // max(1, len(others)))
    links = [np.zeros((0, 2), np.int32)]
    for k in range(0, len(homes) if len(others) else 0, at_once):
        some = homes[k : k + at_once]
        hit = np.bitwise_count(some[:, None] ^ others[None, :]) <= threshold
        if not hit.any():
            continue
        own = np.arange(k, k + len(some), dtype=np.int32)
        row, column = own, labels
        while True:
            new_row = np.minimum(row, np.where(hit, column[None, :], far).min(axis=1))
            new_column = np.minimum(column, np.where(hit, new_row[:, None], far).min(axis=0))
            if (new_row == row).all() and (new_column == column).all():
                break
            row, column = new_row, new_column
        moved = np.stack((np.concatenate((own, labels)), np.concatenate((row, column))), axis=1)
        links.append(np.unique(moved[moved[:, 0] != moved[:, 1]], axis=0))
        labels = column
    every = np.concatenate(links)
    u, v = names[every[:, 0]], names[every[:, 1]]
    return u[u != v], v[u != v]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell, homes first.  Of the cell that a batch ends in only the homes are kept for the next batch."""
    open_cell, homes = None, np.zeros(0, np.uint64)

    def frame(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)}).drop_duplicates()

    def more(home: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        nonlocal homes
        fresh = fp[home]
        if len(fresh):
            before, homes = homes, np.concatenate((homes, fresh))
            yield frame(*met_links(before, fresh))
            yield frame(*met_links(fresh, fresh))
        yield frame(*met_links(homes, fp[~home]))

    for b in batches:
        if not len(b):
            continue
        cell, home, fp = b["cell"].to_numpy(), b["home"].to_numpy(bool), b["fp"].to_numpy(np.int64).view(np.uint64)
        first = int(np.searchsorted(cell, open_cell, "right")) if open_cell is not None else 0
        last = max(first, int(np.searchsorted(cell, cell[-1], "left")))
        if first:
            yield from more(home[:first], fp[:first])
        if first < last:
            yield frame(*cell_links(cell[first:last], home[first:last], fp[first:last]))
        if last < len(cell):
            open_cell, homes = cell[-1], homes[:0]
            yield from more(home[last:], fp[last:])


def near_pairs(prints: DataFrame, cell_rows: int = CELL_ROWS, layout=THREE_BLOCKS) -> DataFrame:
    """(fp), distinct -> (u, v): spanning links between linked fingerprints."""
    rows = prints.select("fp").mapInPandas(_replicas(layout), "cell long, home boolean, fp long")
    crowded = stage(rows.filter("home").groupBy("cell").count().filter(F.col("count") > cell_rows).select(F.col("cell").alias("crowd"), F.ceil(F.col("count") / cell_rows).cast("int").alias("salts")), "crowds")
    if not crowded.isEmpty():
        joined = rows.join(crowded, F.col("cell") == F.col("crowd"), "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))).cast("int"))
        dealt = joined.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        rows = dealt.select((F.col("cell") + F.col("salt").cast("long") * F.lit(1 << 42)).alias("cell"), (F.col("home") & (F.col("salt") == F.col("mine"))).alias("home"), "fp")
    return rows.repartition("cell").sortWithinPartitions("cell", F.col("home").desc()).mapInPandas(_compare, "u long, v long")


def _named(prints: DataFrame, cell_rows: int) -> DataFrame:
    """(key, n, node, component_id) for each distinct fingerprint of (id, fp): its rows, its group's least fingerprint and least id."""
    groups = stage(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "groups")
    layout = TWO_BLOCKS if groups.count() >= TWO_BLOCKS_FROM else THREE_BLOCKS
    found = components(near_pairs(groups, cell_rows, layout)).withColumnRenamed("node", "f_node")
    placed = stage(groups.join(found, F.col("fp") == F.col("f_node"), "left").select(F.col("fp").alias("key"), "n", "least", F.coalesce("component", "fp").alias("node")), "placed")
    names = placed.groupBy(F.col("node").alias("g_node")).agg(F.min("least").alias("component_id"))
    return stage(placed.join(names, F.col("node") == F.col("g_node")).select("key", "n", "node", "component_id"), "named")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the least id reachable)."""
    prints = stage(fingerprints(docs, id_col, text_col), "prints")
    out = keyed(prints, _named(prints, cell_rows), "fp", "key", "n")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row of each near-duplicate group: the one with the least id (null last), of equal ids the one with the least hash of its columns.

    Two hashes of all columns, 128 bits together, stand for a row; texts are shuffled once, by them.
    """
    marks = (F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns))
    prints = stage(fingerprints(docs, id_col, text_col, marks), "prints")
    out = keyed(prints, _named(prints, cell_rows), "fp", "key", "n")
    first = out.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark0", "mark1")).alias("x"))
    first = stage(first.select(F.col("x.mark0").alias("__kept0"), F.col("x.mark1").alias("__kept1")), "firsts")
    marked = docs.withColumns({"__mark0": marks[0], "__mark1": marks[1]})
    kept = marked.join(first, (F.col("__mark0") == F.col("__kept0")) & (F.col("__mark1") == F.col("__kept1")), "left_semi")
    return kept.dropDuplicates(["__mark0", "__mark1"]).drop("__mark0", "__mark1")


def op10_query(spark, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
