from helixframe.plans import caller
from helixframe.schemas import READS

from . import simulate


def test_planted_variants_are_called(spark):
    ref = simulate.genome(3000)
    truth = simulate.plant(ref)
    reads = spark.createDataFrame(simulate.reads(ref, truth), READS)
    reference = spark.createDataFrame(simulate.chunks(ref), "tid int, start int, bases string")
    calls = caller.call(reads, reference).collect()
    found = {(c["start"], c["alleles"][0], c["alleles"][1]): c for c in calls}
    missed = [t for t in truth if (t[0], t[1], t[2]) not in found]
    assert len(missed) <= len(truth) // 5, (missed, sorted(found))
    assert len(found) - (len(truth) - len(missed)) <= 1, sorted(found)
    for start, was, now, copies in truth:
        if (start, was, now) in found:
            c = found[start, was, now]
            assert sorted(c["gt"]) == ([1, 1] if copies == 2 else [0, 1])
            assert min(c["pl"]) == 0 and sum(c["ad"]) <= c["dp"] and c["qual"] >= 30


def test_lines_and_known_ids(spark, tmp_path):
    ref = simulate.genome(1400, 9)
    truth = simulate.plant(ref, 3)
    reads = spark.createDataFrame(simulate.reads(ref, truth), READS)
    reference = spark.createDataFrame(simulate.chunks(ref), "tid int, start int, bases string")
    dbsnp = spark.createDataFrame([(0, t[0], "rs9", t[1], [t[2]], "PASS") for t in truth], "tid int, start int, id string, ref string, alts array<string>, filter string")
    calls = caller.call(reads, reference, dbsnp=dbsnp, mode="GVCF").cache()
    assert calls.filter("ids = 'rs9'").count() >= 1
    contigs = spark.createDataFrame([(0, "c1", 1400)], "tid int, name string, length long")
    caller.write_vcf(calls, contigs, str(tmp_path / "out"), gvcf=True)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    body = [x for x in lines if not x.startswith("#")]
    assert len(body) == calls.count() and all(len(x.split("\t")) == 10 for x in body)
    assert any("<NON_REF>" in x for x in body)


def test_ids_of_all_alternates(spark):
    rows = [(0, 100, ["CAA", "C", "CA"]), (0, 200, ["A", "G", "T"]), (0, 300, ["ACC", "GCC", "<NON_REF>"]), (0, 400, ["A", "*", "C"]), (0, 500, ["A", "<NON_REF>"]), (0, 600, ["GTA", "GTC"]), (0, 700, ["A", "C"]), (0, 200, ["A", "G", "T"])]
    calls = spark.createDataFrame(rows, "tid int, start int, alleles array<string>")
    known = [
        (0, 100, "rs1", "CA", ["C"], "PASS"), (0, 100, "rs2", "CAA", ["C"], "."), (0, 200, "rs4", "A", ["T"], "PASS"), (0, 200, "rs3", "A", ["G", "C"], "PASS"), (0, 200, "rs4", "AC", ["TC"], "PASS"),
        (0, 300, "rs5", "A", ["G"], "PASS"), (0, 400, "rs6", "A", ["*", "T"], "PASS"), (0, 500, "rs7", "A", ["<NON_REF>"], "PASS"), (0, 602, "rs8", "A", ["C"], "PASS"), (0, 700, "rs9", "A", ["C"], "q10"),
    ]
    got = caller.annotated(calls, spark.createDataFrame(known, "tid int, start int, id string, ref string, alts array<string>, filter string")).collect()
    assert sorted((x["start"], x["ids"] or "") for x in got) == [(100, "rs1;rs2"), (200, "rs3;rs4"), (200, "rs3;rs4"), (300, "rs5"), (400, ""), (500, ""), (600, "rs8"), (700, "")]
