"""Sources, predicates, likelihoods, banding and joins on small literal tables."""

import gzip
import struct
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.operators import intervals as iv
from helixframe.operators import reads as rd
from helixframe.operators import relational as rel
from helixframe.plans import catalog, gvcf
from helixframe.sources import text
from helixframe.sources.bam import BamSource

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
SLOW = {"non_unique_kmers", "kmer_graph_degrees", "covariates"}


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df:
        if pd.api.types.is_numeric_dtype(df[k]) and not pd.api.types.is_bool_dtype(df[k]):
            df[k] = df[k].astype(float).round(9) + 0.0
        else:
            df[k] = df[k].map(lambda x: "" if x is None or x is pd.NA or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_query_equals_sql(spark, sql, name):
    got, want = plain(catalog.QUERIES[name](spark, FOLDER).toPandas()), plain(sql.execute(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("bases", "want"), [([(1, 32, 1)], (-2.741077772782652e-4, -0.3012127050374378, -3.677121254719663)), ([(1, 41, 7), (1, 37, 1), (1, 32, 1), (0, 22, 1), (0, 41, 3), (0, 12, 1)], (-18.08620853341253, -4.235384193484483, -39.92524846633521))])
def test_site_likelihoods(spark, bases, want):
    h = spark.createDataFrame([(1, c, q, n) for c, q, n in bases], "pos int, cls int, qual int, n long")
    row = rel.site_likelihoods(h, ["pos"]).first()
    assert (row["l0"], row["l1"], row["l2"]) == pytest.approx(want, abs=1e-8)


def test_kernel():
    w = rel.kernel()
    assert len(w) == 101 and sum(w) == pytest.approx(1) and w[50] == max(w) and w[0] == w[100]


def test_bands_cover_all_qualities(spark):
    rows = spark.range(0, 120).select("id", rel.band(F.col("id").cast("int")).alias("b")).collect()
    for r in rows:
        q = min(r["id"], 99)
        assert r["b"] == max(x for x in (0, *rel.BANDS) if x <= q)


def test_deletion_repair(spark):
    rows = [("m", 1, 5, True), ("m", 3, 72, False), ("m", 73, 82, True), ("m", 75, 77, False), ("m", 78, 80, False), ("m", 81, 92, False), ("m", 93, 102, True), ("m", 94, 96, False), ("m", 97, 98, False), ("m", 99, 120, False)]
    df = spark.createDataFrame(rows, "c string, s int, e int, d boolean")
    got = sorted((r["s"], r["e"]) for r in iv.repaired(df, ["c"], "s", "e", F.col("d"), ["s"]).collect())
    assert got == [(1, 5), (6, 72), (73, 82), (83, 92), (93, 102), (103, 120)]


def test_overlap_join_keeps_repeated_rows(spark):
    a = spark.createDataFrame([(1, 0, 50), (1, 0, 50), (1, 95, 130), (2, 5, 6)], "k int, s int, e int")
    b = spark.createDataFrame([(1, 10, 10, "x"), (1, 40, 200, "y"), (1, 120, 125, "z")], "k int, rs int, re int, name string")
    inner = iv.overlap_join(a, b, ["k"], ("s", "e"), ("rs", "re"), width=16)
    assert sorted((r["s"], r["name"]) for r in inner.collect()) == [(0, "x"), (0, "x"), (0, "y"), (0, "y"), (95, "y"), (95, "z")]
    assert iv.overlap_join(a, b, ["k"], ("s", "e"), ("rs", "re"), how="left_semi", width=16).count() == 3
    assert "NestedLoop" not in inner._jdf.queryExecution().toString()


def test_reservoir(spark):
    df = spark.range(0, 1000).select((F.col("id") % 5).alias("k"), F.concat(F.lit("r"), "id").alias("name"))
    out = rel.reservoir(df, ["k"], ["name"], 50)
    assert [r["count"] for r in out.groupBy("k").count().collect()] == [50] * 5
    assert sorted(out.collect()) == sorted(rel.reservoir(df.repartition(7), ["k"], ["name"], 50).collect())
    assert rel.reservoir(df, ["k"], ["name"], 0).count() == 1000


SAM = """@HD\tVN:1.6
@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:500
@RG\tID:g1\tSM:one
r0\t0\tchr1\t5\t60\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tRG:Z:g1
r1\t4\tchr1\t7\t60\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tRG:Z:g1
r2\t0\tchr1\t9\t10\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII
r3\t2048\tchr2\t20\t60\t3S5M2D2M\t=\t40\t30\tACGTACGTAC\tABCDEFGHIJ\tRG:Z:g1
"""


def test_sam(spark, tmp_path):
    path = tmp_path / "a.sam"
    path.write_text(SAM)
    contigs, groups = text.sam_header(spark, str(path))
    assert [r["name"] for r in contigs.orderBy("tid").collect()] == ["chr1", "chr2"] and groups.count() == 1
    reads = text.sam(spark, str(path)).cache()
    r3 = reads.filter("qname = 'r3'").first()
    assert (r3["tid"], r3["start"], r3["end"], r3["mtid"]) == (1, 20, 28, 1) and r3["qual"] == list(range(32, 42))
    assert [r["qname"] for r in rd.filtered(reads).orderBy("qname").collect()] == ["r0", "r3"]
    assert [r["qname"] for r in rd.well_formed(contigs)(reads).orderBy("qname").collect()] == ["r0", "r1", "r3"]
    table = [("10M", True), ("10S", False), ("1D10M", False), ("10M1D5S", False), ("3S3M3D3I1M", False), ("5M5N5M", False), ("5S5S", False), ("5S10M", True)]
    df = spark.createDataFrame(table, "c string, ok boolean").withColumn("got", rd.good_cigar(text.cigar_column(F.col("c"))))
    assert all(r["ok"] == r["got"] for r in df.collect())


def block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_record(name, tid, pos, n):
    seq = bytes([0x12] * (n // 2))
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 60, 0, 1, 0, n, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", n << 4) + seq + bytes([30] * n) + b"RGZg1\0"
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10**6)
    stream = b"".join(bam_record(f"read{i}", 0, 10 * i, 20 + 2 * (i % 40)) for i in range(5000))
    data = block(head) + b"".join(block(stream[k : k + 7000]) for k in range(0, len(stream), 7000)) + block(b"")
    path = tmp_path / "a.bam"
    path.write_bytes(data)
    spark.dataSource.register(BamSource)
    whole = spark.read.format("bam").load(str(path))
    split = spark.read.format("bam").option("split", 20_000).load(str(path))
    names = sorted(r["qname"] for r in split.select("qname", "start").collect())
    assert split.rdd.getNumPartitions() > 3 and names == sorted(f"read{i}" for i in range(5000))
    row = whole.filter("qname = 'read41'").first()
    assert (row["start"], row["end"], row["seq"][:4], row["qual"][0], row["rg"]) == (411, 432, "ACAC", 30, "g1")


def test_fasta_bed_vcf(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 x\nACGTR\nacg\n>chr2\nTTTT\n")
    rows = sorted((r["name"], r["start"], r["bases"]) for r in text.fasta(spark, str(tmp_path / "a.fa")).collect())
    assert rows == [("chr1", 1, "ACGTN"), ("chr1", 6, "ACG"), ("chr2", 1, "TTTT")]
    (tmp_path / "a.fa.fai").write_text("chr1\t8\t9\t5\t6\nchr2\t4\t20\t4\t5\n")
    assert [tuple(r) for r in text.fasta_index(spark, str(tmp_path / "a.fa.fai")).orderBy("tid").collect()] == [(0, "chr1", 8), (1, "chr2", 4)]
    (tmp_path / "a.bed").write_text("#x\nchr1\t2\t3\nchr1\t10\t20\nchr1\t15\t30\nchr1\t30\t40\nchr3\t10\t20\n")
    rows = sorted((r["name"], r["start"], r["end"]) for r in text.bed(spark, str(tmp_path / "a.bed")).collect())
    assert rows == [("chr1", 3, 3), ("chr1", 11, 30), ("chr1", 31, 40), ("chr3", 11, 20)]
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\nchr1\t5\trs1\tA\tC,T\t.\tPASS\tDP=3\n")
    r = text.vcf(spark, str(tmp_path / "a.vcf.gz")).first()
    assert (r["name"], r["start"], r["id"], r["alts"], r["qual"]) == ("chr1", 5, "rs1", ["C", "T"], None)


def test_recalibration(spark):
    reads = spark.createDataFrame([(1, "g", 0, "ACGT", [30, 30, 5, 30]), (2, "g", 16, "ACGT", [30, 30, 30, 30])], "read_id long, rg string, flag int, seq string, qual array<int>")
    tables = {
        "base": spark.createDataFrame([("g", 30, 28.0)], "rg string, q int, value double"),
        "context": spark.createDataFrame([("g", 30, "AC", 2.0)], "rg string, q int, key string, value double"),
        "cycle": spark.createDataFrame([("g", 30, 1, -3.0)], "rg string, q int, key int, value double"),
    }
    got = {r["read_id"]: r["qual"] for r in rd.recalibrated(reads, tables).collect()}
    assert got == {1: [25, 30, 5, 28], 2: [28, 28, 30, 25]}


def test_report(spark, tmp_path):
    (tmp_path / "r.txt").write_text("#:GATKReport.v1.1:1\n#:GATKTable:2:2:%s:%s:;\n#:GATKTable:Quantized:notes\nQ  N\n1  a\n2  b\n\n")
    tables = text.recal_report(spark, str(tmp_path / "r.txt"))
    assert sorted(map(tuple, tables["Quantized"].collect())) == [("1", "a"), ("2", "b")]


def test_reference_confidence(spark):
    rows = [(0, p, 1, 30, None) for p in range(1, 31) for _ in range(10)] + [(0, 15, 0, 30, None)] * 8
    ev = spark.createDataFrame(rows, "tid int, pos int, cls int, qual int, hq_clips int").withColumn("bin", F.lit(0))
    sites = gvcf.site_confidence(rd.locus_sums(ev)).cache()
    assert sites.filter("pos = 15").first()["gq"] == 0 and sites.filter("pos = 3").first()["dp"] == 10
    found = gvcf.blocks(sites).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in found] == [(1, 14), (15, 15), (16, 30)]
    calls = spark.createDataFrame([(0, 10, 19, ["ACGTACGTAC", "A"])], "tid int, start int, stop int, alleles array<string>")
    assert [(r["start"], r["end"]) for r in gvcf.blocks(sites, calls).orderBy("start").collect()] == [(1, 9), (20, 30)]
    # with targets each of their positions is in a block or a call, at any width of bins
    targets = spark.createDataFrame([(0, 5, 40), (0, 60, 70)], "tid int, start int, end int")
    for width in (7, 1 << 20):
        whole = [(r["start"], r["end"], r["dp"]) for r in gvcf.blocks(sites.filter("pos between 5 and 28"), calls, targets=targets, width=width).orderBy("start").collect()]
        assert whole == [(5, 9, 10), (20, 28, 10), (29, 40, 0), (60, 70, 0)]
