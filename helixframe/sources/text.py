"""Text sources: SAM, FASTA and its index, BED, VCF, recalibration reports.

Lines are read by Spark's text reader, so a large file is split; only headers and reports, which
are small, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, length) in the index's order."""
    rows = spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases int, line_width int")
    names = [(i, r["name"], r["length"]) for i, r in enumerate(rows.collect())]
    return spark.createDataFrame(names, "tid int, name string, length long")


def fasta(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """(name, start, bases): a row per line with its 1-based start; anything but ACGT becomes N.

    A contig's lines are numbered by a window over their lengths, so contigs are never joined into one string.
    """
    lines = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id()).filter(F.length(F.trim("value")) > 0)
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1))
    # the header above a line: headers are few, so the window over all lines only carries them forward by file order
    headers = [(r["__at"], r["h"]) for r in lines.withColumn("h", head).filter("h is not null").select("__at", "h").orderBy("__at").collect()]
    if not headers:
        return spark.createDataFrame([], "name string, start long, bases string")
    bounds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(h).alias("h")) for a, h in headers])
    named = lines.filter(~F.col("value").startswith(">")).withColumn("name", F.element_at(F.filter(bounds, lambda b: b["a"] < F.col("__at")), -1)["h"])
    before = Window.partitionBy("name").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.regexp_replace(F.upper(F.trim("value")), "[^ACGT]", "N")
    return named.select("name", (F.coalesce(F.sum(F.length(F.trim("value"))).over(before), F.lit(0)) + 1).cast("long").alias("start"), bases.alias("bases"))


def bed(spark: SparkSession, path: str, padding: int = 0, contigs: DataFrame | None = None, prefix: str = "c") -> DataFrame:
    """(name, start, end): lines that begin with ``prefix`` as 1-based closed intervals, padded and merged where they overlap."""
    from ..operators.intervals import coalesced

    parts = F.split("value", r"\s+")
    rows = spark.read.text(path).filter(F.col("value").startswith(prefix)).select(parts[0].alias("name"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))
    end = F.col("end") + padding
    if contigs is not None:
        rows = rows.join(contigs.select(F.col("name").alias("__name"), F.col("length").alias("__length")), F.col("name") == F.col("__name"))
        end = F.least(end, F.col("__length"))
    rows = rows.select("name", F.greatest(F.lit(0), F.col("start") - padding).alias("start"), end.alias("end"))
    return coalesced(rows, ["name"]).select("name", (F.col("start") + 1).alias("start"), "end")


def cigar_column(text: Column) -> Column:
    """'5S10M' as an array of (op, len)."""
    tokens = F.when(text == "*", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)))
    return F.transform(tokens, lambda t: F.struct(F.substring(t, F.length(t), F.lit(1)).alias("op"), F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("len")))


def cigar_ref_length(cigar: Column) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda acc, c: acc + F.when(c["op"].isin("M", "D", "N", "=", "X"), c["len"]).otherwise(0))


def cigar_read_length(cigar: Column) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda acc, c: acc + F.when(c["op"].isin("M", "I", "S", "=", "X"), c["len"]).otherwise(0))


def header_of(path: str, mark: str = "@", chars: int = 1 << 20) -> list[str] | None:
    """The lines that begin with ``mark`` at a file's beginning, read no further; None where only Spark can open the path."""
    from pyarrow import fs
    from pyarrow.lib import ArrowInvalid

    try:
        system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        if not system.get_file_info(inner).is_file:
            return None
    except (ArrowInvalid, OSError):
        return None
    out, rest = [], b""
    with system.open_input_stream(inner) as f:
        while data := f.read(chars):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                if not line.startswith(mark.encode()):
                    return out
                out.append(line.decode().rstrip("\r"))
    return [*out, rest.decode()] if rest.startswith(mark.encode()) else out


def sam_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contigs, read groups) from the header lines."""
    known = header_of(path)
    if known is None:  # a folder of parts, or a file system of Spark's own
        known = [r["value"] for r in spark.read.text(path).filter(F.col("value").rlike("^@(SQ|RG)\t")).collect()]
    heads = [h for h in known if h[:4] in ("@SQ\t", "@RG\t")]
    tags = [(h[1:3], dict(x.split(":", 1) for x in h.split("\t")[1:])) for h in heads]
    contigs = [(i, t["SN"], int(t["LN"])) for i, t in enumerate(t for kind, t in tags if kind == "SQ")]
    groups = [(i, t) for i, t in enumerate(t for kind, t in tags if kind == "RG")]
    return spark.createDataFrame(contigs, "tid int, name string, length long"), spark.createDataFrame(groups, "rg_idx int, attrs map<string,string>")


def sam(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """Reads in the schema of ``schemas.READS``."""
    known = contigs if contigs is not None else sam_header(spark, path)[0]
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.length("value") > 0))
    cut = rows.select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("int").alias("start"), f[4].cast("int").alias("mapq"),
        cigar_column(f[5]).alias("cigar"), F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("rnext"), f[7].cast("int").alias("mstart"), f[8].cast("int").alias("isize"),
        f[9].alias("seq"), f[10].alias("q"), F.nullif(F.regexp_extract("value", r"\tRG:Z:([^\t]+)", 1), F.lit("")).alias("rg"),
    )
    names = known.select(F.col("name").alias("__n"), F.col("tid").alias("__t"))
    mates = known.select(F.col("name").alias("__m"), F.col("tid").alias("__mt"))
    out = cut.join(names, F.col("rname") == F.col("__n"), "left").join(mates, F.col("rnext") == F.col("__m"), "left")
    quals = F.when(F.col("q") == "*", F.array_repeat(F.lit(0), F.length("seq"))).otherwise(F.transform(F.split("q", ""), lambda c: F.ascii(c) - 33))
    return out.select(
        F.monotonically_increasing_id().alias("read_id"), "qname", "flag", F.coalesce("__t", F.lit(-1)).alias("tid"), "start", (F.col("start") + cigar_ref_length(F.col("cigar")) - 1).cast("int").alias("end"),
        "mapq", "cigar", F.coalesce("__mt", F.lit(-1)).alias("mtid"), "mstart", "isize", "seq", quals.alias("qual"), "rg",
    )


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, id, ref, alts, qual, filter, info) of a VCF; plain or gzip."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    return rows.select(f[0].alias("name"), f[1].cast("int").alias("start"), F.nullif(f[2], F.lit(".")).alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), F.nullif(f[5], F.lit(".")).cast("double").alias("qual"), f[6].alias("filter"), F.get(f, 7).alias("info"))


def recal_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a recalibration report by name, all columns as strings.  Reports are small by nature."""
    lines = [r["value"] for r in spark.read.text(path).collect()]
    tables: dict[str, DataFrame] = {}
    i = 0
    while i < len(lines):
        parts = lines[i].split(":")
        if lines[i].startswith("#:GATKTable:") and len(parts) > 3 and parts[2].isdigit():
            n, name = int(parts[3]), lines[i + 1].split(":")[2]
            columns = lines[i + 2].split()
            rows = [line.split() for line in lines[i + 3 : i + 3 + n]]
            tables[name] = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
            i += 3 + n
        else:
            i += 1
    return tables
