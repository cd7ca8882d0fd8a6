"""Command line of the caller: ``python -m helixframe.cli -I reads.sam -R ref.fa -O out``.

Reads are SAM or BAM by their suffix; several inputs are merged.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.recal import steps
from .operators.relational import BANDS, dictionaries_agree
from .plans import caller, gvcf
from .sources import bam, text


def within(low: int, high: int):
    def check(value: str) -> int:
        n = int(value)
        if not low <= n <= high:
            raise argparse.ArgumentTypeError(f"{n} is not in {low}..{high}")
        return n

    return check


def bands(value: str) -> tuple[int, ...]:
    out = tuple(int(x) for x in value.split(","))
    if list(out) != sorted(set(out)) or not out or out[0] < 1 or out[-1] > 99:
        raise argparse.ArgumentTypeError("bands must rise from 1 to 99")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description="Germline small-variant calling on Spark")
    p.add_argument("-I", "--input", nargs="+", required=True)
    p.add_argument("-O", "--output", required=True)
    p.add_argument("-R", "--reference", required=True, help="FASTA; its index stands beside it as .fai")
    p.add_argument("-L", "--interval", help="BED")
    p.add_argument("-P", "--interval-padding", type=within(0, 10**6), default=0)
    p.add_argument("-Q", "--base-quality-score-threshold", type=within(6, 127), default=18, help="base qualities below count as the lowest")
    p.add_argument("-T", "--target-span", help="name:start-end")
    p.add_argument("-D", "--max-reads-depth", type=within(0, 10**9), default=50)
    p.add_argument("-G", "--gvcf-gq-bands", type=bands, default=BANDS)
    p.add_argument("--pcr-indel-model", type=str.lower, choices=["none", "hostile", "aggressive", "conservative"], default="conservative")
    p.add_argument("--emit-ref-confidence", choices=["NONE", "GVCF"], default="NONE")
    p.add_argument("--dbsnp")
    p.add_argument("--bqsr-recal-table")
    p.add_argument("--inspect-reads", action="store_true")
    p.add_argument("--sample", default="sample")
    p.add_argument("--nthreads", type=within(1, 128), help="cores of a local session; a cluster's are its own matter")
    p.add_argument("--nstreampool", type=within(1, 20), help="taken and ignored: Spark schedules reading")
    p.add_argument("--old-pairhmm-engine", action="store_true", help="taken and ignored: there is one engine")
    p.add_argument("--whole", action="store_true", help="one output file in place of a folder of parts")
    p.add_argument("--compression-level", type=within(0, 9), default=6)
    p.add_argument("--index", action=argparse.BooleanOptionalAction, default=True, help="a position index beside a whole .gz file")
    p.add_argument("--md5", action="store_true", help="a checksum beside a whole file")
    p.add_argument("--assemble-output", help="a folder for the assembled haplotypes and their graphs")
    return p


def merged(parts: list[DataFrame]) -> DataFrame:
    """Reads of several inputs as one table; ids tell the inputs apart."""
    numbered = [x.withColumn("read_id", F.col("read_id") * len(parts) + i) for i, x in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


def check_contigs(contigs: DataFrame, other: DataFrame, what: str) -> None:
    """Fails unless a dictionary agrees with the reference's in order, names and lengths."""
    wrong = dictionaries_agree(contigs, other, "tid", ["name", "length"]).orderBy("tid").limit(3).collect()
    if wrong:
        raise ValueError(f"the contigs of {what} are not those of the reference: {', '.join(str(r['tid']) for r in wrong)}")


def spans_of(args: argparse.Namespace, spark: SparkSession, contigs: DataFrame) -> DataFrame | None:
    """The intervals to call in, (tid, start, end), or None for everything."""
    if args.interval:
        return text.bed(spark, args.interval, args.interval_padding, contigs).join(contigs, "name").select("tid", "start", "end")
    if args.target_span:
        name, _, span = args.target_span.partition(":")
        a, _, b = span.partition("-")
        return contigs.filter(F.col("name") == name).select("tid", F.lit(int(a)).alias("start"), F.lit(int(b)).alias("end"))
    return None


#: Up to so many intervals are given to the file's index; of more, the reads are filtered once they are read.
MOST_REGIONS = 10_000


def load(spark: SparkSession, path: str, contigs: DataFrame, intervals: DataFrame | None) -> DataFrame:
    if not path.endswith(".bam"):
        check_contigs(contigs, text.sam_header(spark, path)[0], path)
        return text.sam(spark, path, contigs)
    system, inner = bam._open(path)
    known = bam.head_of(system, inner)
    if known is None:
        raise ValueError(f"{path} has no header")
    check_contigs(contigs, spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(known[1])], "tid int, name string, length long"), path)
    reader = spark.read.format("bam")
    if intervals is not None:
        rows = intervals.join(contigs, "tid").select("name", "start", "end").limit(MOST_REGIONS + 1).collect()
        if len(rows) <= MOST_REGIONS:
            reach = caller.INTERVAL_REACH
            reader = reader.option("regions", ";".join(f"{r['name']}:{max(1, r['start'] - reach)}-{r['end'] + reach}" for r in rows))
    return reader.load(path)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    contigs = text.fasta_index(spark, args.reference + ".fai")
    reference = text.fasta(spark, args.reference).join(contigs, "name").select("tid", F.col("start").cast("int").alias("start"), "bases")
    spark.dataSource.register(bam.BamSource)
    intervals = spans_of(args, spark, contigs)
    reads = merged([load(spark, p, contigs, intervals) for p in args.input])
    dbsnp = text.vcf(spark, args.dbsnp).join(contigs, "name").select("tid", "start", "id", "ref", "alts", "filter") if args.dbsnp else None
    recal = steps(text.recal_report(spark, args.bqsr_recal_table)) if args.bqsr_recal_table else None
    inspect = contigs if args.inspect_reads else None
    if args.assemble_output:
        caller.haplotypes(reads, reference, args.max_reads_depth).write.mode("overwrite").parquet(args.assemble_output)
    style = {"whole": args.whole, "level": args.compression_level, "index": args.index, "md5": args.md5}
    if args.emit_ref_confidence == "GVCF":
        gvcf.write(spark, reads, reference, contigs, args.output, args.sample, args.gvcf_gq_bands, intervals, style, dbsnp=dbsnp, depth=args.max_reads_depth, pcr_indel_model=args.pcr_indel_model, recal=recal, inspect=inspect, quality_floor=args.base_quality_score_threshold)
    else:
        calls = caller.call(reads, reference, intervals, dbsnp, "VCF", args.max_reads_depth, None, args.pcr_indel_model, recal=recal, inspect=inspect, quality_floor=args.base_quality_score_threshold)
        caller.write_vcf(calls, contigs, args.output, args.sample, style=style)


def main() -> None:
    args = parser().parse_args()
    session = SparkSession.builder.appName("helixframe")
    if args.nthreads:
        session = session.master(f"local[{args.nthreads}]")
    run(session.getOrCreate(), args)


if __name__ == "__main__":
    main()
