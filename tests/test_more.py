"""The command line end to end, recalibration steps, mates, indel evidence, streams."""

import random

import numpy as np
import pytest

from helixframe import cli
from helixframe.kernels.reads import mates_reconciled, rules_out_indels
from helixframe.operators import relational as rel
from helixframe.operators.recal import steps
from helixframe.streaming import activity

from . import simulate


def test_mates():
    got = mates_reconciled([("a", "ACGT", [40] * 4, 10), ("a", "GAAA", [30] * 4, 12), ("b", "AC", [9, 9], 10)])
    assert got == [[40, 40, 20, 0], [20, 0, 30, 30], [9, 9]]


def test_indels_are_ruled_out_outside_repeats():
    r = random.Random(1)
    ref = "".join(r.choice("ACGT") for _ in range(40)) + "A" * 20 + "".join(r.choice("ACGT") for _ in range(60))
    good = rules_out_indels(ref[:100], [30] * 100, ref)
    assert good[5] and good[70] and not good[95] and good[:30].all()
    assert not rules_out_indels("A" * 40, [30] * 40, "A" * 60).any()


def test_recalibration_steps(spark):
    zero = spark.createDataFrame([("g", "M", "30.0", "100000", "100")], "ReadGroup string, EventType string, EstimatedQReported string, Observations string, Errors string")
    one = spark.createDataFrame([("g", "M", "30", "100000", "100"), ("g", "M", "20", "50000", "5")], "ReadGroup string, EventType string, QualityScore string, Observations string, Errors string")
    two = spark.createDataFrame([("g", "30", "AC", "Context", "M", "50000", "500"), ("g", "30", "-3", "Cycle", "M", "50000", "50")], "ReadGroup string, QualityScore string, CovariateValue string, CovariateName string, EventType string, Observations string, Errors string")
    got = steps({"RecalTable0": zero, "RecalTable1": one, "RecalTable2": two})
    base = {r["q"]: r["value"] for r in got["base"].collect()}
    assert base[30] == 30 and 30 < base[20] <= 40
    assert got["context"].first()["value"] < -5 and got["cycle"].first()["key"] == -3 and abs(got["cycle"].first()["value"]) <= 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, p, p % 2, 20 + p % 9) for p in range(1, 30) for _ in range(5)]
    df = spark.createDataFrame(rows, "tid int, pos int, cls int, qual int")
    for i in range(3):
        df.filter(f"pos % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = activity.keep_histogram(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    want = rel.quality_histogram(df, ["tid", "pos"], df["cls"], df["qual"], 11)
    assert sorted(activity.kept_histogram(spark, str(tmp_path / "out")).select(*want.columns).collect()) == sorted(want.collect())


@pytest.mark.parametrize("mode", ["NONE", "GVCF"])
def test_command_line(spark, tmp_path, mode):
    ref = simulate.genome(1300, 11)
    truth = simulate.plant(ref, 4)
    (tmp_path / "r.fa").write_text(">c1\n" + "\n".join(ref[i : i + 60] for i in range(0, len(ref), 60)) + "\n")
    (tmp_path / "r.fa.fai").write_text(f"c1\t{len(ref)}\t4\t60\t61\n")
    lines = ["@SQ\tSN:c1\tLN:1300"]
    for r in simulate.reads(ref, truth):
        lines.append("\t".join([r[1], str(r[2]), "c1", str(r[4]), "60", "".join(f"{n}{op}" for op, n in r[7]), "*", "0", "0", r[11], "".join(chr(q + 33) for q in r[12]), "RG:Z:rg1"]))
    (tmp_path / "r.sam").write_text("\n".join(lines) + "\n")
    args = cli.parser().parse_args(["-I", str(tmp_path / "r.sam"), "-R", str(tmp_path / "r.fa"), "-O", str(tmp_path / "out"), "--emit-ref-confidence", mode, "--inspect-reads"])
    cli.run(spark, args)
    body = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "out")).collect() if not r["value"].startswith("#")]
    found = {(int(x[1]), x[3], x[4].split(",")[0]) for x in body}
    assert sum((t[0], t[1], t[2]) in found for t in truth) >= len(truth) - 1
    if mode == "GVCF":
        spans = sorted((int(x[1]), int(x[7].removeprefix("END="))) for x in body if x[7].startswith("END="))
        assert len(spans) > 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_targets_flags_and_whole_output(spark, tmp_path):
    ref = simulate.genome(1300, 11)
    truth = simulate.plant(ref, 4)
    (tmp_path / "r.fa").write_text(">c1\n" + "\n".join(ref[i : i + 60] for i in range(0, len(ref), 60)) + "\n")
    (tmp_path / "r.fa.fai").write_text(f"c1\t{len(ref)}\t4\t60\t61\n")
    body = ["\t".join([r[1], str(r[2]), "c1", str(r[4]), "60", "".join(f"{n}{op}" for op, n in r[7]), "*", "0", "0", r[11], "".join(chr(q + 33) for q in r[12]), "RG:Z:rg1"]) for r in simulate.reads(ref, truth)]
    (tmp_path / "r.sam").write_text("\n".join(["@SQ\tSN:c1\tLN:1300", *body]) + "\n")
    out = tmp_path / "o.vcf.gz"
    start = truth[0][0]
    args = ["-I", str(tmp_path / "r.sam"), "-R", str(tmp_path / "r.fa"), "-O", str(out), "-T", f"c1:{start - 30}-{start + 30}", "--whole", "--md5", "-Q", "20", "--assemble-output", str(tmp_path / "haps")]
    cli.run(spark, cli.parser().parse_args(args))
    import gzip

    lines = [x for x in gzip.decompress(out.read_bytes()).decode().splitlines() if not x.startswith("#")]
    assert {int(x.split("\t")[1]) for x in lines} == {start}
    assert (tmp_path / "o.vcf.gz.tbi").exists() and (tmp_path / "o.vcf.gz.md5").exists()
    assert spark.read.parquet(str(tmp_path / "haps")).filter("graph like 'digraph%'").count() >= 1
    (tmp_path / "w.sam").write_text("\n".join(["@SQ\tSN:c1\tLN:1301", *body]) + "\n")
    with pytest.raises(ValueError, match="contigs"):
        cli.run(spark, cli.parser().parse_args(["-I", str(tmp_path / "w.sam"), *args[2:]]))


def test_arguments():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["-I", "a", "-R", "b", "-O", "c", "-D", "-1"])
    assert cli.parser().parse_args(["-I", "a", "b", "-R", "b", "-O", "c", "-G", "10,20"]).gvcf_gq_bands == (10, 20)
    assert np.array(rel.BANDS).max() == 99
