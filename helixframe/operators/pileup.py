"""Reads and reference to evidence, per-site sums and histograms.

CIGAR elements are cut at the edges of bins of the reference and joined with the reference's tile of
the bin on (tid, bin).  Bases are compared inside the joined row.  Sums are grouped by (tid, bin, pos),
for which the join's partitioning already serves, so that the exploded bases are never shuffled.

A histogram needs no row for a base: reads and reference are packed where they are read, sent to their
contig's block of ``BLOCK`` places, and laid and counted there in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phred
from ..functions.arrays import after, before, running_sum
from ..kernels import pileup as kernel

WIDTH = 1024
DELETION_QUALITY, CLIP_QUALITY, CLIP_LEAST = 30, 28, 11
REVERSE = 0x10
ALIGNED = ("M", "=", "X")
#: Places of a contig that are laid together; rows that are packed into one at most; packed rows that are laid at once.
BLOCK, PACKED, HELD = 1 << 16, 64, 1024


def tiles(reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """(t_tid, t_bin, tile): the reference's bases by bin from chunks (tid, start, bases); what no chunk holds is blank."""
    last = F.col("start") + F.length("bases") - 1
    reference = reference.filter(F.length("bases") > 0)  # an empty chunk would end the tile at its place
    spread = reference.withColumn("t_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))
    first = F.greatest(F.col("start").cast("long"), F.col("t_bin") * width)
    stop = F.least(last.cast("long"), (F.col("t_bin") + 1) * width - 1)
    part = F.substring("bases", (first - F.col("start") + 1).cast("int"), (stop - first + 1).cast("int"))
    pieces = spread.select(F.col("tid").alias("t_tid"), "t_bin", F.struct((first - F.col("t_bin") * width).cast("int").alias("at"), part.alias("b")).alias("p"))
    # a chunk is laid where it belongs, blanks filling what lies between
    laid = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(""), lambda acc, p: F.concat(F.rpad(acc, p["at"], F.lit(" ")), p["b"]))
    return pieces.groupBy("t_tid", "t_bin").agg(laid.alias("tile"))


def elements(reads: DataFrame, adaptor: Column, width: int = WIDTH) -> DataFrame:
    """One row for the part of an aligned or deleted CIGAR element in a bin, with its bases, qualities and neighbours."""
    ops = F.transform("cigar", lambda c: c["op"])
    on_ref = F.transform("cigar", lambda c: F.when(c["op"].isin("M", "D", "N", "=", "X"), c["len"]).otherwise(0))
    on_read = F.transform("cigar", lambda c: F.when(c["op"].isin("M", "I", "S", "=", "X"), c["len"]).otherwise(0))
    placed = reads.select("tid", "flag", "start", "seq", "qual", "cigar", adaptor.alias("adaptor"), before(running_sum(on_ref), F.lit(0)).alias("r"), before(running_sum(on_read), F.lit(0)).alias("q"), ops.alias("ops"))
    # high-quality bases of each soft clip
    clips = F.zip_with("cigar", "q", lambda c, q: F.when(c["op"] == "S", F.size(F.filter(F.slice("qual", q + 1, c["len"]), lambda x: x > CLIP_QUALITY))))
    placed = placed.withColumn("clips", clips)
    none = F.lit(None).cast("int")
    rows = F.arrays_zip(
        F.col("cigar").alias("c"), F.col("r").alias("r"), F.col("q").alias("q"), before(F.col("ops"), F.lit("")).alias("prev"), after(F.col("ops"), F.lit("")).alias("next"),
        before(F.col("clips"), none).alias("clip_before"), after(F.col("clips"), none).alias("clip_after"),
    )
    each = placed.select("tid", "flag", "adaptor", "start", "seq", "qual", F.explode(rows).alias("x")).filter(F.col("x.c.op").isin(*ALIGNED, "D") & (F.col("x.c.len") > 0))
    each = each.select("tid", "flag", "adaptor", "seq", "qual", (F.col("start") + F.col("x.r")).alias("ref"), F.col("x.c.op").alias("op"), F.col("x.c.len").alias("len"), "x.q", "x.prev", "x.next", "x.clip_before", "x.clip_after")
    each = each.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ref") / width), F.floor((F.col("ref") + F.col("len") - 1) / width))))
    skip = (F.greatest(F.col("ref").cast("long"), F.col("bin") * width) - F.col("ref")).cast("int")
    size = (F.least(F.col("ref") + F.col("len") - 1, (F.col("bin") + 1) * width - 1) - F.col("ref") + 1).cast("int") - skip
    each = each.withColumns({"skip": skip, "size": size})
    deleted = F.col("op") == "D"
    return each.select(
        "tid", "bin", "flag", "adaptor", "op", "prev", "next", "clip_before", "clip_after", "len", "ref", "skip", "size",
        F.when(~deleted, F.substring("seq", F.col("q") + F.col("skip") + 1, F.col("size"))).alias("part"),
        F.when(~deleted, F.slice("qual", F.col("q") + F.col("skip") + 1, F.col("size"))).alias("quals"),
    )


def evidence(reads: DataFrame, reference: DataFrame, adaptor: Column, width: int = WIDTH) -> DataFrame:
    """(tid, bin, pos, cls, qual, hq_clips): one row for each aligned or deleted base, cls 0 for variant evidence.

    ``adaptor`` is the first position of adaptor sequence (the last one, for a reverse read) or null.
    """
    met = elements(reads, adaptor, width).join(tiles(reference, width), (F.col("tid") == F.col("t_tid")) & (F.col("bin") == F.col("t_bin")))
    deleted = F.col("op") == "D"
    under = F.split(F.substring("tile", (F.col("ref") + F.col("skip") - F.col("bin") * width + 1).cast("int"), F.col("size")), "")
    bases = F.when(deleted, F.array_repeat(F.lit(""), F.col("size"))).otherwise(F.split("part", ""))
    quals = F.when(deleted, F.array_repeat(F.lit(DELETION_QUALITY), F.col("size"))).otherwise(F.col("quals"))
    each = met.select("tid", "bin", "flag", "adaptor", "op", "prev", "next", "clip_before", "clip_after", "len", "ref", "skip", F.posexplode(F.arrays_zip(bases.alias("b"), quals.alias("q"), under.alias("u"))).alias("k", "x"))
    each = each.filter(F.coalesce(F.col("x.u"), F.lit("")).rlike("^[^ ]$")).withColumn("i", F.col("skip") + F.col("k")).withColumn("pos", (F.col("ref") + F.col("i")).cast("int"))
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    each = each.filter(F.col("adaptor").isNull() | F.when(reverse, F.col("pos") > F.col("adaptor")).otherwise(F.col("pos") < F.col("adaptor")))
    first, last = F.col("i") == 0, F.col("i") == F.col("len") - 1
    by_clip = last & (F.col("len") > 1) & (F.col("next") == "S")
    edge = (first & F.col("prev").isin("S", "I", "D")) | (last & F.col("next").isin("I", "D")) | by_clip
    # a base that the read lacks is not the reference's
    variant = deleted | F.coalesce(F.col("x.b") != F.col("x.u"), F.lit(True)) | edge
    clips = F.when(~deleted & (F.col("x.q") >= CLIP_LEAST), F.when(first & (F.col("prev") == "S"), F.col("clip_before")).when(by_clip, F.col("clip_after")))
    return each.select("tid", "bin", "pos", F.when(variant, 0).otherwise(1).alias("cls"), F.col("x.q").alias("qual"), clips.alias("hq_clips"))


#: A packed row: its numbers and characters end to end, in machine order.  ``wide`` qualities take 8 bytes in place of 1.
NUMBERS = {"start": np.int64, "low": np.int64, "high": np.int64, "n_seq": np.int32, "n_qual": np.int32, "n_cigar": np.int32, "ops": np.uint8, "lens": np.int32}
FLAT = [*NUMBERS, "seq", "qual"]


def _numbers(column: pa.Array, null: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def _lengths(column: pa.Array, length) -> np.ndarray:
    return _numbers(length(column), -1)


def _flat(column: pa.Array, dtype=np.uint8) -> np.ndarray:
    """The bytes of all rows, end to end, as numbers."""
    if not len(column):
        return np.empty(0, dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype) if offsets[-1] > offsets[0] else np.empty(0, dtype)


def _text(column: pa.Array) -> np.ndarray:
    return kernel.points(_flat(pc.fill_null(column, "").cast(pa.string())))


def _changes(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before; nothing is null."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns], axis=0)
    return out


def _packed(kind: int, tid: pa.Array, block: np.ndarray, rows: dict[str, np.ndarray], texts: np.ndarray, quals: np.ndarray | None, names: list[str]) -> pa.RecordBatch:
    """Neighbouring rows of a block as one row."""
    begin = np.flatnonzero(_changes(tid, pa.array(block)) | (np.arange(len(block)) % PACKED == 0))
    wide = quals is not None and quals.dtype != np.uint8
    sums = {x: np.concatenate([[0], np.cumsum(np.maximum(rows[x], 0))]) for x in ("n_seq", "n_qual", "n_cigar")}
    each = np.arange(len(block) + 1)

    def binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
        offsets = np.append(at[begin], at[-1]) * values.dtype.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

    out = {n: binary(rows[n].astype(t), sums["n_cigar"] if n in ("ops", "lens") else each) for n, t in NUMBERS.items()}
    if texts.dtype == np.uint8:
        out["seq"] = binary(texts, sums["n_seq"])
    else:
        edges = np.append(sums["n_seq"][begin], sums["n_seq"][-1])
        out["seq"] = pa.array([kernel.utf8(texts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    out["qual"] = binary(np.empty(0, np.uint8) if quals is None else quals, sums["n_qual"])
    columns = [tid.take(pa.array(begin)), pa.array(block[begin]), pa.array(np.full(len(begin), kind, np.int32)), pa.array(np.full(len(begin), wide)), *[out[n] for n in FLAT]]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _valid(batch: pa.RecordBatch, *names: str) -> pa.RecordBatch:
    for name in names:
        if batch[name].null_count:
            batch = batch.filter(pc.is_valid(batch[name]))
    return batch


def _pack_reference(width: int, per: int, names: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _valid(batch, "tid", "start", "bases")
            start, n = _numbers(batch["start"], 0), _lengths(batch["bases"], pc.utf8_length)
            row, at, first, last = kernel.cut(start, start + n - 1, width)
            chars = _text(batch["bases"])
            size = last - first + 1
            zero, none = np.zeros(len(row), np.int64), np.empty(0, np.int64)
            rows = {"start": first, "low": zero, "high": zero, "n_seq": size, "n_qual": zero, "n_cigar": zero, "ops": none, "lens": none}
            yield _packed(0, batch["tid"].take(pa.array(row)), at // per, rows, chars[kernel.spread(kernel.starts(n)[row] + first - start[row], size)], None, names)

    return pack


def _bytes_if_narrow(quals: pa.Array) -> np.ndarray:
    """Qualities as bytes, 255 for null, or where some don't fit as 8 bytes each, ``NONE`` for null."""
    ends = pc.min_max(quals)
    fit = not ends["min"].is_valid or (ends["min"].as_py() >= 0 and ends["max"].as_py() < 255)
    return pc.fill_null(quals.cast(pa.uint8()), 255).to_numpy(zero_copy_only=False) if fit else _numbers(quals, kernel.NONE)


def _pack_reads(width: int, per: int, names: list[str]):
    def cigars(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ops = pc.index_in(batch["ops"].flatten(), value_set=pa.array(list(kernel.LETTERS)))
        return _lengths(batch["ops"], pc.list_value_length), _numbers(ops, -1) + 1, _numbers(batch["lens"].flatten(), 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _valid(batch, "tid", "start", "ops", "lens")
            start = _numbers(batch["start"], 0)
            n_cigar, ops, lens = cigars(batch)
            row, block, _, _ = kernel.cut(start, kernel.span(start, n_cigar, ops, lens), width * per)
            if not np.array_equal(row, np.arange(len(start))):
                batch = batch.take(pa.array(row))
                n_cigar, ops, lens = cigars(batch)
            rows = {
                "start": _numbers(batch["start"], 0), "low": _numbers(batch["low"], -(1 << 62)), "high": _numbers(batch["high"], 1 << 62),
                "n_seq": _lengths(batch["seq"], pc.utf8_length), "n_qual": _lengths(batch["qual"], pc.list_value_length), "n_cigar": n_cigar, "ops": ops, "lens": lens,
            }
            yield _packed(1, batch["tid"], block, rows, _text(batch["seq"]), _bytes_if_narrow(batch["qual"].flatten()), names)

    return pack


def _qualities(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(levels, qualities as places in them)."""
    wide = batch["wide"].to_pylist()
    if not any(wide):
        return np.append(np.arange(255), kernel.NONE), _flat(batch["qual"])
    parts = [np.frombuffer(x, np.int64 if w else np.uint8) for x, w in zip(batch["qual"].to_pylist(), wide, strict=True)]
    quals = np.concatenate([x if x.dtype == np.int64 else np.where(x == 255, kernel.NONE, x.astype(np.int64)) for x in parts])
    levels = np.unique(np.append(quals, DELETION_QUALITY))
    levels = np.append(levels[levels != kernel.NONE], kernel.NONE)
    return levels, np.where(quals == kernel.NONE, len(levels) - 1, np.searchsorted(levels[:-1], quals))


def _count(width: int, per: int, names: list[str]):
    """Packed rows in order of block and kind to sums; the reference of a block is held while its reads stream by."""

    def part(batch: pa.RecordBatch, group: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        flat = {n: _flat(batch[n], t) for n, t in NUMBERS.items()}
        counts = pc.binary_length(batch["start"]).to_numpy(zero_copy_only=False) // 8
        return {n: x if n == "ops" else x.astype(np.int64) for n, x in flat.items()}, kernel.points(_flat(batch["seq"])), np.repeat(group, counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (tid, block) of the last block, its pieces' places, lengths and characters
        for batch in (whole.slice(at, HELD) for whole in batches for at in range(0, whole.num_rows, HELD)):
            new = _changes(batch["tid"], batch["block"])
            group = np.cumsum(new) - 1
            tids = batch["tid"].filter(pa.array(new))
            blocks = batch["block"].to_numpy()[new]
            reference = pc.equal(batch["kind"], 0)
            r, chars, g = part(batch.filter(reference), group[reference.to_numpy(zero_copy_only=False)])
            at, size = r["start"], r["n_seq"]
            if held is not None and held[0] == (tids[0].as_py(), blocks[0]):
                g, at, size, chars = np.append(np.zeros(len(held[1]), np.int64), g), np.append(held[1], at), np.append(held[2], size), np.append(held[3], chars)
            origin = blocks * per
            keys, laid, seen = kernel.tiles(g * per + at // width - origin[g], at % width, size, chars, width)
            own = seen[g[seen] == len(tids) - 1]
            held = (tids[-1].as_py(), blocks[-1]), at[own], size[own], chars[kernel.spread(kernel.starts(size)[own], size[own])]
            rows = batch.filter(pc.invert(reference))
            r, chars, g = part(rows, group[~reference.to_numpy(zero_copy_only=False)])
            levels, quals = _qualities(rows)
            reads = kernel.Reads(g, r["start"], r["low"], r["high"], r["n_seq"], chars, r["n_qual"], quals, r["n_cigar"], r["ops"], r["lens"])
            for some in reads.slices():
                for g, cls, qual, n, places, hq, n_hq in kernel.counted(some, levels, origin, per, keys, laid, width, CLIP_QUALITY, CLIP_LEAST, DELETION_QUALITY):
                    columns = [tids.take(pa.array(g)), pa.array(cls.astype(np.int32)), pa.array(np.where(qual == kernel.NONE, 0, qual).astype(np.int32), mask=qual == kernel.NONE), pa.array(n), pa.array(places), pa.array(hq, mask=n_hq == 0)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return count


def histogram(reads: DataFrame, reference: DataFrame, adaptor: Column, width: int = WIDTH) -> DataFrame:
    """(tid, cls, qual, n, places, hq): counts and sums of ``pos`` and ``hq_clips`` of the ``evidence`` of contigs, without its rows.

    What is shuffled are reads and reference, packed in a few rows a block of about ``BLOCK`` places, and the sums of blocks.
    A task holds a batch and the reference of one block, all of whose reads it lays.
    """
    per = max(1, BLOCK // width)
    tid = reads.schema["tid"].dataType.simpleString()
    reverse = F.coalesce(F.col("flag").bitwiseAND(REVERSE) != 0, F.lit(False))
    placed = reads.select("tid", "start", F.when(reverse, adaptor).alias("low"), F.when(~reverse, adaptor).alias("high"), "seq", "qual", F.col("cigar")["op"].alias("ops"), F.col("cigar")["len"].alias("lens"))
    chunks = reference.select(F.col("tid").cast(tid).alias("tid"), "start", "bases")
    schema = f"tid {tid}, block long, kind int, wide boolean, " + ", ".join(f"{n} binary" for n in FLAT)
    names = ["tid", "block", "kind", "wide", *FLAT]
    rows = chunks.mapInArrow(_pack_reference(width, per, names), schema).unionByName(placed.mapInArrow(_pack_reads(width, per, names), schema))
    rows = rows.repartition("tid", "block").sortWithinPartitions("tid", "block", "kind")
    names = ["tid", "cls", "qual", "n", "places", "hq"]
    found = rows.mapInArrow(_count(width, per, names), f"tid {tid}, cls int, qual int, n long, places long, hq long")
    return found.groupBy("tid", "cls", "qual").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.sum("hq").alias("hq"))


def likelihood_sums(cls: Column, qual: Column, least: int) -> dict[str, Column]:
    """Aggregates over evidence of at least a quality: depth, and log10 likelihoods of hom-ref, het and hom-alt for ploidy 2."""
    used = qual >= least
    # qualities are held over 0 where they are not used, so that no logarithm of 0 is taken
    q = F.greatest(qual, F.lit(1))
    ok, wrong = phred.log10_correct(q), phred.log10_error(q) - phred.LOG10_3
    ref, alt = F.when(cls == 1, ok).otherwise(wrong), F.when(cls == 1, wrong).otherwise(ok)

    def total(x: Column) -> Column:
        return F.sum(F.when(used, x))

    return {"depth": F.count_if(used), "l0": total(ref), "l1": total(phred.jacobian_sum(ref, alt) - phred.LOG10_2), "l2": total(alt)}


def site_sums(found: DataFrame, least: int, confidence_least: int) -> DataFrame:
    """(tid, pos) with everything that activity and reference confidence need: the evidence is read once.

    depth, l0, l1, l2 of qualities from ``least``, ``clips`` the mean of high-quality clips; and c0, c1, c2, ref, other of qualities from ``confidence_least``.
    """
    cls, qual = F.col("cls"), F.col("qual")
    sums = likelihood_sums(cls, qual, least)
    more = likelihood_sums(cls, qual, confidence_least)
    enough = qual >= confidence_least
    out = found.groupBy("tid", "bin", "pos").agg(
        *[v.alias(k) for k, v in sums.items()],
        F.avg("hq_clips").alias("clips"),
        *[more[f"l{i}"].alias(f"c{i}") for i in range(3)],
        F.count_if(enough & (cls == 1)).alias("ref"),
        F.count_if(enough & (cls == 0)).alias("other"),
    )
    return out.drop("bin")
