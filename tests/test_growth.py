"""Steps whose cost must not grow faster than their input: results on odd rows, and what their plans may not hold."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
from helixframe.functions import special
from helixframe.kernels import kmers as kmer_kernel
from helixframe.operators import pileup
from helixframe.operators import reads as rd
from helixframe.operators import relational as rel
from helixframe.plans import catalog_more


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_covariates_are_counted_where_they_are_read(spark):
    texts = ["ACGTAC", "AC", "", None, "ACNGT\U0001f600ACG", "A" * 5000]
    rows = [(i if i < 5 else None, i % 2 == 1 if i < 5 else None, i % 3 == 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, rev boolean, sec boolean, s string")
    got = rel.covariates(df, ["rev"], F.col("s"), 3, F.col("rev"), F.col("sec"))
    assert "Generate" not in plan(got)  # no row a base, for which the text's length was worked out again
    want: dict = {}
    for _, rev, sec, t in rows:
        for i in range(len(t or "")):
            part = t[i - 2 : i + 1] if i >= 2 else ""
            key = (rev, part if part and set(part) <= set("ACGT") else None)
            want.setdefault(key, []).append((len(t) - i if rev else i + 1) * (-1 if sec else 1))
    assert {(r["rev"], r["context"]): (r["n"], r["min_cycle"], r["max_cycle"]) for r in got.collect()} == {k: (len(v), min(v), max(v)) for k, v in want.items()}


def test_pairs_of_a_region_are_summed_side_by_side(spark):
    reads = [(1, 3), (1, None), (1, 3), (2, 5), (None, 9), (3, None)]
    haps = [(1, 10), (1, None), (2, 7), (2, 7), (None, 1), (3, 4)]
    a, b = spark.createDataFrame(reads, "region long, c long"), spark.createDataFrame(haps, "region long, h long")
    got = rel.region_pair_sums(a, b, "region", F.col("c") * 7, F.col("h"))
    want: dict = {}
    for r, c in reads:
        for q, h in haps:
            if r is not None and r == q:
                n, mark = want.get(r, (0, None))
                want[r] = (n + 1, mark if c is None or h is None else (mark or 0) + c * 7 + h)
    assert {r["region"]: (r["n_pairs"], r["mark"]) for r in got.collect()} == want
    many = spark.range(0, 300_000).select((F.col("id") % 2).alias("region"), F.col("id").alias("c"))
    whole = rel.region_pair_sums(many, many.withColumnRenamed("c", "h"), "region", F.col("c"), F.col("h"))  # 4.5e10 pairs
    assert {r["n_pairs"] for r in whole.collect()} == {150_000**2}


def test_genotypes_of_a_site_are_summed_side_by_side(spark):
    rows = [(1, 10.0), (1, 20.0), (2, 3.0), (2, None), (None, 5.0)]
    df = spark.createDataFrame(rows, "site long, q double")
    got = rel.genotype_likelihoods(rel.spread(df, ["site"]), ["site"], [-0.1 * (F.col("q") + 3 * a) for a in range(3)])
    assert "Join" not in plan(got) and plan(got).count("Exchange") == 1  # no read met itself, no genotype was shuffled
    found = {(r["site"], r["j"], r["k"]): (r["genotype"], r["n_reads"], r["gl"]) for r in got.collect()}
    assert len(found) == 3 * 6 and {v[0] for v in found.values()} == set(range(6))
    for site, qs in ((1, [10.0, 20.0]), (2, [3.0]), (None, [5.0])):
        for (s, j, k), (_, n, gl) in found.items():
            if s == site:
                want = sum(math.log10((10 ** (-0.1 * (q + 3 * j)) + 10 ** (-0.1 * (q + 3 * k))) / 2) for q in qs)
                assert n == (2 if site else 1) and abs(gl - want) < 1e-3


TEXTS = [(1, "abcabcabc"), (2, "aaaa"), (2, "aaa"), (None, "xyzw"), (None, "xyz!"), (3, ""), (4, None), (5, "ab"), (6, "\U0001f600" * 5 + "é"), (7, "abcabc")]


def test_repeated_kmers_of_ids_in_several_rows(spark):
    for texts in (TEXTS, [x for x in TEXTS if x[0] not in (2, None)]):
        each: dict = {}
        for i, t in texts:
            for p in range(len(t or "") - 2):
                each.setdefault((i, t[p : p + 3]), []).append(p)
        want: dict = {}
        for (_, kmer), at in each.items():
            if len(at) > 1:
                want.setdefault(kmer, []).append(len(at))
        df = spark.createDataFrame(texts, "doc_id long, text string")
        got = rel.non_unique_kmers(df, "doc_id", F.col("text"), 3)
        assert {r["kmer"]: (r["n_sequences"], r["most"]) for r in got.collect()} == {k: (len(v), max(v)) for k, v in want.items()}
    assert "__key" not in plan(got) and "Generate" not in plan(got)  # with one row an id only k-mers and counts are shuffled


def test_edges_are_counted_where_they_are_read(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = rel.kmer_edges(df, F.col("text"), 2)
    assert "Generate" not in plan(got)
    want = Counter((t[p : p + 2], t[p + 1 : p + 3]) for _, t in TEXTS for p in range(len(t or "") - 2))
    assert {(r["source"], r["target"]): r["weight"] for r in got.collect()} == want


def test_kmers_of_any_number_of_letters():
    r = random.Random(1)
    for letters in (4, 1500, 60_000):
        texts = ["".join(chr(0x20000 + r.randrange(letters)) for _ in range(n)) for n in (0, 3, 6, 400, 5, 3000)] + ["abcdefgh" * 3]
        want = Counter(t[p : p + 6] for t in texts for p in range(len(t) - 5))
        assert dict(zip(*(list(x) for x in kmer_kernel.totals(texts, 6)), strict=True)) == want
        assert dict(zip(*(list(x) for x in kmer_kernel.repeated(texts, 6)[:2]), strict=True))["abcdef"] == 1


def test_special_functions_have_no_series_of_structs(spark):
    xs = [-7.0, -2.9, -1.3, -0.9, -1e-9, 0.0, 0.3, 0.84375, 1.0, 1.25, 2.0, 2.86, 3.5, 5.9, 6.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", special.erf(F.col("x")).alias("e"), special.erf_inverse(special.erf(F.col("x"))).alias("i"))
    assert "aggregate(" not in plan(got)
    for r in got.collect():
        assert abs(r["e"] - math.erf(r["x"])) < 1e-15
        assert abs(r["x"]) > 3 or abs(r["i"] - r["x"]) < 1e-11
    pairs = df.crossJoin(df.select(F.col("x").alias("m"))).filter("x >= 0 and m > 0.2").select("x", "m", special.deviance(F.col("x"), F.col("m")).alias("d"))
    assert "aggregate(" not in plan(pairs)
    for r in pairs.collect():
        want = (r["x"] * math.log(r["x"] / r["m"]) if r["x"] else 0) + r["m"] - r["x"]
        assert abs(r["d"] - want) < 1e-12 * max(1, r["m"], r["x"])


def test_recalibration_by_slices_is_that_by_joins(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice(["g", "h", "none", None]), r.choice([0, 16, 128, 144, None]), "".join(r.choice("ACGTNé") for _ in range(n)), [r.choice([3, 5, 6, 30, 93, 94, 120, None]) for _ in range(max(0, n + d))]) for i, (n, d) in enumerate((r.randrange(0, 30), r.choice([0, 0, 0, -2, 3])) for _ in range(200))]
    rows += [(900, "g", 0, None, [30]), (901, "g", 0, "AC", None)]
    reads = spark.createDataFrame(rows, "read_id long, rg string, flag int, seq string, qual array<int>")
    kept = [6, 30, 93]
    tables = {
        "base": spark.createDataFrame([(g, q, q - 1.5 - x) for x, g in enumerate("gh") for q in kept[1:]], "rg string, q int, value double"),
        "context": spark.createDataFrame([(g, q, a + b, r.uniform(-3, 3)) for g in "gh" for q in kept for a in "ACGT" for b in "ACGT"], "rg string, q int, key string, value double"),
        "cycle": spark.createDataFrame([(g, q, c, r.uniform(-3, 3)) for g, n in (("g", 9), ("h", 4)) for q in kept for c in range(-n, n + 1) if c], "rg string, q int, key int, value double"),
    }
    monkeypatch.setattr(rd, "SLICE", 100)
    quick = rd.recalibrated(reads, tables)
    assert "ArrowEvalPython" in plan(quick)  # no array expression a base
    monkeypatch.setattr(rd, "MOST_BROADCAST_GROUPS", 0)
    assert {x["read_id"]: x["qual"] for x in quick.collect()} == {x["read_id"]: x["qual"] for x in rd.recalibrated(reads, tables).collect()}


def odd_reads(seed: int, n: int = 600) -> list[tuple]:
    """(tid, flag, start, seq, qual, cigar, adaptor) of any shape: introns, no bases, null and great qualities, letters beyond ASCII."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        cigar = [(r.choice("MIDNSHP=X"), r.choice([0, 1, 1, 2, 5, 9, 30])) for _ in range(r.randint(0, 6))] + ([("N", r.choice([3, 200])), ("M", 4)] if r.random() < 0.3 else [])
        size = sum(k for op, k in cigar if op in "MIS=X")
        seq = "".join(r.choice("ACGTé\U0001f600 ") if r.random() < 0.1 else r.choice("ACGT") for _ in range(size))
        qual = [r.choice([None, 0, 254, 255, 300, -1]) if r.random() < 0.02 else r.randint(2, 40) for _ in range(size)]
        out.append((r.choice([0, 1, 2, 3, None]), r.choice([0, 16, None]), r.choice([None, -3, *range(-40, 700)]), r.choice([seq] * 9 + [None, seq[: size // 2], ""]), r.choice([qual] * 9 + [None, qual[: size // 2], []]), r.choice([cigar] * 20 + [None]), None if r.random() < 0.6 else r.randint(-20, 600)))
    return out


READ = "tid int, flag int, start int, seq string, qual array<int>, cigar array<struct<op:string,len:int>>, adaptor int"


def test_pileups_are_counted_without_a_row_a_base(spark, monkeypatch):
    r = random.Random(5)
    chunks = [(t, s, "".join(r.choice("ACGTN é"[: 5 if t else 7]) for _ in range(r.choice([1, 20, 37])))) for t in (0, 1, 2) for s in range(-30, 600, 37)]
    chunks += [(0, 7, "ACGTACGTAC"), (0, 7, "ACG"), (0, 7, "ACGTACGTAC"), (1, 12, ""), (1, 50, None), (None, 7, "ACGT"), (4, 1, "ACGT")]
    reference = spark.createDataFrame(chunks, "tid int, start int, bases string").repartition(3)
    reads = spark.createDataFrame(odd_reads(6), READ).repartition(3)
    for width, block, packed, held in ((16, 64, 2, 3), (16, 16, 64, 1), (1024, 1 << 16, 64, 1024)):
        monkeypatch.setattr(pileup, "BLOCK", block)
        monkeypatch.setattr(pileup, "PACKED", packed)
        monkeypatch.setattr(pileup, "HELD", held)
        got = pileup.histogram(reads, reference, F.col("adaptor"), width)
        assert "Generate" not in plan(got) and "Join" not in plan(got)
        want = pileup.evidence(reads, reference, F.col("adaptor"), width).groupBy("tid", "cls", "qual").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.sum("hq_clips").alias("hq"))
        found = {tuple(x) for x in got.collect()}
        assert found == {tuple(x) for x in want.collect()} and sum(x[3] for x in found) > 1000
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]


def test_pileup_of_many_batches(spark):
    whole = "ACGTTGCATC" * 2000
    reference = spark.createDataFrame([("c", 1 + s, whole[s : s + 900]) for s in range(0, len(whole), 900)] + [("d", 1, "A" * 90)], "tid string, start int, bases string")
    cigar = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(n).alias("len")) for op, n in (("S", 2), ("M", 8), ("D", 1), ("M", 7))])
    reads = spark.range(0, 50_000, 1, 3).select(F.lit("c").alias("tid"), F.lit(0).alias("flag"), (1 + 10 * (F.col("id") % 1900)).cast("int").alias("start"), F.lit("NNACGTTGCACACGTTG").alias("seq"), F.array_repeat(F.lit(30), 17).alias("qual"), cigar.alias("cigar"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {(x["tid"], x["cls"], x["qual"]): (x["n"], x["hq"]) for x in pileup.histogram(reads, reference, F.lit(None).cast("int")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(n for n, _ in got.values()) == 50_000 * 16 and set(got) == {("c", 0, 30), ("c", 1, 30)}
    assert got["c", 0, 30][1] == 2 * 50_000  # a clip of two good bases at each read's beginning


def test_query_of_pileups_makes_no_row_a_base(spark):
    got = plan(__spark_entry__.queries()["pileup_histogram"](spark, "/root/testdata/sf0.001"))
    assert got.count("Generate") == 2 and "Join" not in got  # of the reads and of the chunks


def test_bases_are_spelled_as_in_sql(spark):
    texts = ["", None, "Teén \U0001f600ACGT\nx", "aeiou", "é", None, "", "\x00hl\xa0rs" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = df.select("i", catalog_more._bases("ACGTACGTCA")("text").alias("b"), F.regexp_replace(F.translate("text", "etaoinsrhl", "ACGTACGTCA"), "[^ACGT]", "N").alias("want")).collect()
    assert len(got) == len(texts) and all(x["b"] == x["want"] for x in got)
