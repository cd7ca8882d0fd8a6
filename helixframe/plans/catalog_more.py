"""Further queries with SQL: steps on reads, sites and genotypes, the pile-up, recalibration and special functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import phred, special
from ..operators import annotation as an
from ..operators import intervals as iv
from ..operators import pileup
from ..operators import reads as rd
from ..operators import relational as rel
from ..sources.text import cigar_column, cigar_read_length, cigar_ref_length
from .catalog import ALLELES, EVENTS, JLS, _alleles, events, query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(LINE)


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query(f"""SELECT {KEYS}, round(pow(10.0, -l_quantity / 10) / (pow(10.0, -l_quantity / 10) + pow(10.0, -l_discount) + pow(10.0, -3.0)), 9) AS p0, round(-l_quantity / 10 - l_discount + 3.0, 6) AS s0, round(-l_quantity / 10 - 0.5 * l_tax, 6) AS d0,
(CASE WHEN -l_quantity / 10 >= greatest(-l_discount, -3.0) THEN 0 ELSE 1 END)::INT AS top FROM lineitem""")
def likelihood_arrays(spark, sf_dir):
    """Normalised log likelihoods, element-wise sums and differences, the first greatest element."""
    gl = F.array(-F.col("l_quantity") / 10, -F.col("l_discount"), F.lit(-3.0))
    other = F.array(-F.col("l_discount") + 3.0, F.lit(0.0), F.lit(0.0))
    tax = F.array(0.5 * F.col("l_tax"), F.lit(0.0), F.lit(0.0))
    return _line(spark, sf_dir).select(*LINE, F.round(phred.normalised(gl)[0], 9).alias("p0"), F.round(phred.elementwise_sum(gl, other)[0], 6).alias("s0"), F.round(phred.elementwise_difference(gl, tax)[0], 6).alias("d0"), phred.argmax(gl).alias("top"))


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS mean, CASE WHEN avg(l_quantity) > 6 THEN least(100, floor(avg(l_quantity)))::INT ELSE 0 END AS extend FROM lineitem GROUP BY 1")
def clip_extension(spark, sf_dir):
    """Mean of high-quality clips and the extension of activity."""
    return an.clip_extension(_line(spark, sf_dir), ["l_partkey"], "l_quantity").withColumn("mean", F.round("mean", 6))


CIGAR_SQL = "((1 + l_linenumber) || substr('MIDSN', 1 + (l_partkey % 5)::INT, 1) || (1 + l_suppkey % 3) || substr('MIDXN', 1 + (l_suppkey % 5)::INT, 1) || (1 + l_partkey % 4) || substr('MDSIH', 1 + (l_orderkey % 5)::INT, 1))"


@query(f"""
WITH t AS (SELECT {KEYS}, {CIGAR_SQL} AS c FROM lineitem),
n AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(c, '[0-9]+[MDN=X]'), lambda x: regexp_extract(x, '[0-9]+')::INT)), 0)::INT AS ref_len, coalesce(list_sum(list_transform(regexp_extract_all(c, '[0-9]+[MIS=X]'), lambda x: regexp_extract(x, '[0-9]+')::INT)), 0)::INT AS read_len, regexp_replace(c, '[0-9]+[SH]', '', 'g') AS core FROM t)
SELECT {KEYS}, ref_len, read_len, core <> '' AND ref_len > 0 AND NOT regexp_matches(core, '^[0-9]+D') AND NOT regexp_matches(core, 'D$') AND NOT regexp_matches(c, 'N') AND NOT regexp_matches(c, '[ID][0-9]+[ID]') AS good FROM n""")
def cigar_predicates(spark, sf_dir):
    """Lengths on read and reference, and whether a CIGAR is well made."""
    pick = lambda letters, by: F.substring(F.lit(letters), (1 + F.col(by) % 5).cast("int"), F.lit(1))
    c = F.concat((1 + F.col("l_linenumber")).cast("string"), pick("MIDSN", "l_partkey"), (1 + F.col("l_suppkey") % 3).cast("string"), pick("MIDXN", "l_suppkey"), (1 + F.col("l_partkey") % 4).cast("string"), pick("MDSIH", "l_orderkey"))
    df = _line(spark, sf_dir).select(*LINE, cigar_column(c).alias("c"))
    return df.select(*LINE, cigar_ref_length(F.col("c")).alias("ref_len"), cigar_read_length(F.col("c")).alias("read_len"), rd.good_cigar(F.col("c")).alias("good"))


@query(f"""
WITH t AS (SELECT {KEYS}, (l_partkey % 256)::INT AS flag, l_suppkey::INT AS s, (l_orderkey % 100)::INT AS m, ((l_quantity - 25) * 5)::INT AS z FROM lineitem)
SELECT {KEYS}, CASE WHEN z <> 0 AND flag & 1 <> 0 AND flag & 12 = 0 AND (flag & 16 <> 0) <> (flag & 32 <> 0) AND abs(z) <= 100 THEN CASE WHEN flag & 16 <> 0 THEN m - 1 ELSE s + abs(z) END END AS boundary FROM t""")
def adaptor_boundaries(spark, sf_dir):
    """First position of adaptor sequence of well-defined fragments."""
    flag, isize = (F.col("l_partkey") % 256).cast("int"), ((F.col("l_quantity") - 25) * 5).cast("int")
    return _line(spark, sf_dir).select(*LINE, rd.adaptor_boundary(flag, F.col("l_suppkey").cast("int"), (F.col("l_orderkey") % 100).cast("int"), isize).alias("boundary"))


@query(f"SELECT {KEYS}, l_quantity >= 10 AND l_partkey % 60 >= 20 AND (l_linenumber % 2 = 0 OR l_suppkey % 3 = l_partkey % 3) AS passes FROM lineitem")
def passing_reads(spark, sf_dir):
    """Reads that count for likelihoods, against those that only count in depth."""
    ok = rd.passing(F.col("l_quantity"), F.col("l_partkey") % 60, F.col("l_suppkey") % 3, F.col("l_partkey") % 3, F.col("l_linenumber") % 2 == 1)
    return _line(spark, sf_dir).select(*LINE, ok.alias("passes"))


@query(f"SELECT event_id, user_id, coalesce(lag(event_type) OVER w, 'N') AS before, coalesce(lead(event_type) OVER w, 'N') AS after, row_number() OVER w AS place FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)")
def neighbour_context(spark, sf_dir):
    """The base before and after each, and its place in coordinate order."""
    ev = an.neighbours(events(spark, sf_dir), ["user_id"], ["sec", "event_id"], "event_type")
    return an.ordered_reads(ev, ["user_id"], ["sec", "event_id"]).select("event_id", "user_id", "before", "after", "place")


@query("SELECT doc_id, reverse(translate(regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS strand FROM documents WHERE text IS NOT NULL")
def reverse_complement(spark, sf_dir):
    """The other strand, anything but ACGT masked."""
    df = table(spark, sf_dir, "documents").filter("text is not null")
    return df.select("doc_id", an.reverse_complement(an.masked(F.col("text"))).alias("strand"))


@query(f"""SELECT {KEYS}, (CASE WHEN least(l_quantity, l_partkey % 60) < 18 THEN 6 ELSE least(l_quantity, l_partkey % 60) END)::INT AS quality,
least(45, greatest(10, round(40 - exp((1 + l_suppkey % 20) / (3 * pi())) + 1)))::INT AS gap FROM lineitem""")
def model_qualities(spark, sf_dir):
    """Qualities and gap penalties of the pair-HMM."""
    return _line(spark, sf_dir).select(*LINE, an.model_quality(F.col("l_quantity"), F.col("l_partkey") % 60).cast("int").alias("quality"), an.pcr_penalty(1 + F.col("l_suppkey") % 20).alias("gap"))


@query("""
WITH q AS (SELECT l_orderkey, array_agg((l_quantity / 2.5)::INT ORDER BY l_linenumber, l_partkey, l_suppkey, (l_quantity / 2.5)::INT) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_min(list_filter(range(0, len(q)), lambda i: q[i + 1] > 9))::INT AS "first", list_max(list_filter(range(0, len(q)), lambda i: q[i + 1] > 9))::INT AS "last" FROM q""")
def poor_ends(spark, sf_dir):
    """What is left of a read once ends of poor quality are cut."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_quantity") / 2.5).cast("int").alias("q"))))
    g = _line(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["q"]).alias("q"))
    return g.select("l_orderkey", an.good_span(F.col("q")).alias("s")).select("l_orderkey", "s.first", "s.last")


@query(f"""SELECT {KEYS} FROM lineitem WHERE l_quantity >= 30 AND NOT (l_returnflag = 'R' AND l_linestatus = 'O')""")
def emitted_calls(spark, sf_dir):
    """Calls over the threshold whose alternates are more than a spanning deletion."""
    alts = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.array(F.lit("*"))).otherwise(F.array(F.lit("*"), F.lit("A")))
    return an.emitted(_line(spark, sf_dir), F.col("l_quantity"), alts).select(*LINE)


@query(f"""
WITH r AS (SELECT *, max(lk) OVER (PARTITION BY l_partkey) AS top FROM {ALLELES}),
p AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN allele = 0 AND top - lk < 0.2 THEN 1 ELSE 0 END DESC, lk DESC, allele) AS pick FROM r),
g AS (SELECT l_partkey, max(allele) FILTER (pick = 1) AS best, abs(max(lk) FILTER (pick = 1) - max(lk) FILTER (pick > 1)) AS gap FROM p GROUP BY 1)
SELECT l_partkey % 97 AS site, count(*) FILTER (best = 0 AND coalesce(gap, 0) > 0.2) AS ad0, count(*) FILTER (best = 1 AND coalesce(gap, 0) > 0.2) AS ad1, count(*) FILTER (best = 2 AND coalesce(gap, 0) > 0.2) AS ad2 FROM g GROUP BY 1""")
def allele_depths(spark, sf_dir):
    """Informative reads of each allele."""
    best = rel.best_alleles(_alleles(spark, sf_dir), ["l_partkey"], "allele", "lk", F.col("allele") == 0)
    return an.allele_depths(best.withColumn("site", F.col("l_partkey") % 97), ["site"], 3)


@query("SELECT l_partkey, count(*) FILTER (l_returnflag <> 'R')::BIGINT AS dp_passing, count(*) AS dp FROM lineitem GROUP BY 1")
def depth_with_filtered(spark, sf_dir):
    """Depth of passing reads, and with those set aside."""
    df = _line(spark, sf_dir)
    return an.depth_with_filtered(df.filter("l_returnflag <> 'R'"), df.filter("l_returnflag = 'R'"), ["l_partkey"])


@query(f"SELECT l_partkey, allele % 3 AS a, max(lk) AS lk FROM {ALLELES} GROUP BY 1, 2")
def haplotype_alleles(spark, sf_dir):
    """Likelihoods of alleles by the haplotypes that carry them."""
    names = spark.range(0, 7).select(F.col("id").alias("allele"), (F.col("id") % 3).alias("a"))
    return an.marginalised_by_map(_alleles(spark, sf_dir), names, ["l_partkey"], "allele", "a", "lk")


@query("SELECT p_partkey, p_size FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def uncalled_sites(spark, sf_dir):
    """Sites that no call holds."""
    calls = _line(spark, sf_dir).filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return an.uncalled(table(spark, sf_dir, "part"), calls, ["p_partkey"]).select("p_partkey", "p_size")


@query(f"""
WITH e AS (SELECT event_id, user_id, sec AS s, sec + event_id % 900 AS e FROM {EVENTS}), p AS (SELECT DISTINCT user_id, sec AS locus FROM {EVENTS} WHERE event_type = 'purchase')
SELECT p.user_id, locus, count(*) AS n, min(event_id) AS first_id FROM p JOIN e ON e.user_id = p.user_id AND locus BETWEEN s AND e.e GROUP BY 1, 2""")
def events_over_locus(spark, sf_dir):
    """Events of haplotypes that overlap a position."""
    ev = events(spark, sf_dir)
    spans = ev.select("event_id", "user_id", F.col("sec").alias("s"), (F.col("sec") + F.col("event_id") % 900).alias("e"))
    loci = ev.filter("event_type = 'purchase'").select("user_id", F.col("sec").alias("locus")).distinct()
    return iv.overlap_join(loci, spans, ["user_id"], ("locus", "locus"), ("s", "e"), width=3600).groupBy("user_id", "locus").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"""
WITH t AS (SELECT {KEYS}, l_partkey % 50 AS a, l_partkey % 50 + l_quantity::BIGINT AS b, l_suppkey % 50 AS c, l_suppkey % 50 + l_linenumber * 3 AS d FROM lineitem)
SELECT {KEYS}, a <= d AND c <= b AS meets, a <= c AND b >= d AS holds, a - 5 <= d AND c <= b + 5 AS near, CASE WHEN a <= d AND c <= b THEN greatest(a, c) END AS from_, CASE WHEN a <= d AND c <= b THEN least(b, d) END AS to_, greatest(1, a - 7) AS grown, least(b + 7, 60) AS grown_end FROM t""")
def interval_algebra(spark, sf_dir):
    """Overlap, containment, distance, intersection and padding of intervals."""
    a, c = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    df = _line(spark, sf_dir).select(*LINE, a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b"), c.alias("c"), (c + F.col("l_linenumber") * 3).alias("d"), F.lit(60).cast("long").alias("size"))
    a, b, c, d = (F.col(x) for x in "abcd")
    part = iv.intersected(a, b, c, d)
    out = df.withColumns({"meets": iv.overlaps(a, b, c, d), "holds": iv.contains(a, b, c, d), "near": iv.within_distance(a, b, c, d, 5), "from_": part["start"], "to_": part["end"]})
    return iv.padded(out, 7, "size", "a", "b").select(*LINE, "meets", "holds", "near", "from_", "to_", F.col("a").alias("grown"), F.col("b").alias("grown_end"))


@query(f"""
WITH t AS (SELECT {KEYS}, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e, l_partkey + l_linenumber * 4 AS a, l_partkey + l_linenumber * 4 + 3 AS b FROM lineitem)
SELECT {KEYS}, 'left' AS side, s AS start, a - 1 AS "end" FROM t WHERE s <= a - 1 UNION ALL SELECT {KEYS}, 'right', b + 1, e FROM t WHERE b + 1 <= e""")
def flank_regions(spark, sf_dir):
    """What of a region lies left and right of its variation."""
    s, a = F.col("l_partkey"), F.col("l_partkey") + F.col("l_linenumber") * 4
    df = _line(spark, sf_dir).select(*LINE, s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e"), a.alias("a"), (a + 3).alias("b"))
    return iv.flanks(df, LINE, "s", "e", "a", "b")


HET_SQL = "(SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') AS hr, count(*) FILTER (l_returnflag = 'A') AS het, count(*) FILTER (l_returnflag = 'R') AS ha FROM lineitem GROUP BY 1)"


def _dosage(spark, sf_dir):
    flag = F.col("l_returnflag")
    return _line(spark, sf_dir).groupBy("l_suppkey").agg(F.count_if(flag == "N").alias("hr"), F.count_if(flag == "A").alias("het"), F.count_if(flag == "R").alias("ha"))


@query(f"""
WITH c AS (SELECT *, hr + het + ha AS n, 2 * least(hr, ha) + het AS rare FROM {HET_SQL}),
x AS (SELECT *, unnest(range(rare % 2, least(rare, 2 * n - rare) + 1, 2)) AS h FROM c),
w AS (SELECT *, exp(h * ln(2.0) - lgamma(h + 1.0) - lgamma((rare - h) / 2.0 + 1) - lgamma((2 * n - rare - h) / 2.0 + 1) - (het * ln(2.0) - lgamma(het + 1.0) - lgamma((rare - het) / 2.0 + 1) - lgamma((2 * n - rare - het) / 2.0 + 1))) AS w FROM x),
p AS (SELECT l_suppkey, hr, het, ha, (coalesce(sum(w) FILTER (h > het), 0) + 0.5) / sum(w) AS p FROM w GROUP BY ALL)
SELECT l_suppkey, hr, het, ha, round(CASE WHEN p < 10e-60 THEN 160.0 ELSE greatest(0.0, -10 * log10(p)) END, 4) AS excess_het FROM p""")
def excess_heterozygosity(spark, sf_dir):
    """Phred-scaled mid-p of so many heterozygotes."""
    return _dosage(spark, sf_dir).withColumn("excess_het", F.round(an.excess_het(F.col("hr"), F.col("het"), F.col("ha")), 4))


@query(f"""SELECT l_suppkey, round(CASE WHEN hr + het + ha >= 10 AND p > 0 AND p < 1 THEN 1 - het / (2 * p * (1 - p) * (hr + het + ha)) END, 8) AS f FROM (SELECT *, (2 * hr + het)::DOUBLE / (2 * (hr + het + ha)) AS p FROM {HET_SQL})""")
def inbreeding_coefficient(spark, sf_dir):
    """Heterozygotes seen against those expected."""
    return _dosage(spark, sf_dir).select("l_suppkey", F.round(an.inbreeding(F.col("hr"), F.col("het"), F.col("ha")), 8).alias("f"))


@query("""
WITH RECURSIVE s AS (SELECT l_partkey, array_agg([pow(10.0, -l_quantity / 20), pow(10.0, -abs(25 - l_quantity) / 20), pow(10.0, -(50 - l_quantity) / 20)]) AS g, 2.0 * count(*) AS n2 FROM lineitem GROUP BY 1),
em AS (SELECT l_partkey, g, n2, 0 AS it, 0.5::DOUBLE AS f, 0.0::DOUBLE AS c, 0.0::DOUBLE AS r, 0.0::DOUBLE AS none, false AS done FROM s
UNION ALL SELECT l_partkey, g, n2, it + 1, (0.01 + cc) / (10.01 + n2), cc, n2 - cc, zz, greatest(abs(cc - c), abs(n2 - cc - r)) <= 0.1
FROM (SELECT *, list_sum(list_transform(g, lambda x: (2 * f * (1 - f) * x[2] + 2 * f * f * x[3]) / ((1 - f) * (1 - f) * x[1] + 2 * f * (1 - f) * x[2] + f * f * x[3]))) AS cc, list_sum(list_transform(g, lambda x: log10((1 - f) * (1 - f) * x[1] / ((1 - f) * (1 - f) * x[1] + 2 * f * (1 - f) * x[2] + f * f * x[3])))) AS zz FROM em WHERE NOT done AND it < 50))
SELECT l_partkey, round(c, 6) AS expected, floor(c + 0.5)::INT AS mleac, round(least(1.0, floor(c + 0.5) / n2), 6) AS mleaf, round(none, 6) AS log10_none FROM em WHERE done OR it = 50""")
def allele_frequency(spark, sf_dir):
    """Expected alternate alleles, their most likely count and share, and the probability of none, by expectation-maximisation."""
    q = F.col("l_quantity")
    w = F.struct(F.pow(F.lit(10.0), -q / 20).alias("r"), F.pow(F.lit(10.0), -F.abs(25 - q) / 20).alias("h"), F.pow(F.lit(10.0), -(50 - q) / 20).alias("a"))
    g = _line(spark, sf_dir).groupBy("l_partkey").agg(F.collect_list(w).alias("g")).withColumn("x", an.allele_frequency(F.col("g")))
    count = F.floor(F.col("x.count") + 0.5)
    return g.select("l_partkey", F.round("x.count", 6).alias("expected"), count.cast("int").alias("mleac"), F.round(F.least(F.lit(1.0), count / (2.0 * F.size("g"))), 6).alias("mleaf"), F.round("x.log10_none", 6).alias("log10_none"))


@query(f"""
WITH p AS (SELECT {KEYS}, [(l_quantity * 3)::INT, (l_discount * 900)::INT, (l_tax * 700)::INT, (l_partkey % 90)::INT, (l_suppkey % 80)::INT, (l_orderkey % 70)::INT] AS pl, 1 + l_linenumber % 2 AS k FROM lineitem),
s AS (SELECT {KEYS}, [pl[1], pl[k * (k + 1) // 2 + 1], pl[k * (k + 1) // 2 + k + 1]] AS x FROM p)
SELECT {KEYS}, x[1] - list_min(x) AS p0, x[2] - list_min(x) AS p1, x[3] - list_min(x) AS p2 FROM s""")
def genotype_subsetting(spark, sf_dir):
    """PLs once one of two alternates is dropped."""
    cols = [F.round(F.col("l_quantity") * 3), F.round(F.col("l_discount") * 900), F.round(F.col("l_tax") * 700), F.col("l_partkey") % 90, F.col("l_suppkey") % 80, F.col("l_orderkey") % 70]
    pl = F.array(*[c.cast("int") for c in cols])
    kept = F.array(F.lit(0), (1 + F.col("l_linenumber") % 2).cast("int"))
    df = _line(spark, sf_dir).select(*LINE, pl.alias("pl"), kept.alias("kept")).select(*LINE, an.subset_pls(F.col("pl"), F.col("kept")).alias("x"))
    return df.select(*LINE, *[F.col("x")[i].alias(f"p{i}") for i in range(3)])


@query(f"""
WITH b AS (SELECT l_partkey, l_returnflag = 'R' AS var, log10(1 - pow(10.0, -l_quantity / 10)) AS ok, -0.1 * l_quantity - log10(3.0) AS err FROM lineitem WHERE l_quantity >= 7),
c AS (SELECT l_partkey, var, CASE WHEN var THEN err ELSE ok END AS r, CASE WHEN var THEN ok ELSE err END AS a FROM b),
l AS (SELECT l_partkey, count(*) FILTER (NOT var) AS ref, count(*) FILTER (var) AS other, sum(r) AS c0, sum({JLS.format(a='r', b='a')} - log10(2.0)) AS c1, sum(a) AS c2 FROM c GROUP BY 1),
s AS (SELECT *, least(ref, 40) AS n, [0, floor(-10 * (least(c1, c0) - c0) + 0.5)::INT, floor(-10 * (least(c2, c0) - c0) + 0.5)::INT] AS snp FROM l),
i AS (SELECT *, [n * log10(1 - pow(10.0, -4.5)), n * ({JLS.format(a='log10(1 - pow(10.0, -4.5))', b='-4.5::DOUBLE')} - log10(2.0)), n * -4.5] AS g FROM s),
j AS (SELECT *, [floor(-10 * (g[1] - list_max(g)) + 0.5)::INT, floor(-10 * (g[2] - list_max(g)) + 0.5)::INT, floor(-10 * (g[3] - list_max(g)) + 0.5)::INT] AS indel FROM i),
q AS (SELECT *, list_sort(snp)[2] - list_sort(snp)[1] AS gs, list_sort(indel)[2] - list_sort(indel)[1] AS gi FROM j)
SELECT l_partkey AS pos, (ref + other)::BIGINT AS dp, ref, other, least(99, CASE WHEN gs <= gi THEN gs ELSE gi END)::INT AS gq, (CASE WHEN gs <= gi THEN snp ELSE indel END)[1] AS p0, (CASE WHEN gs <= gi THEN snp ELSE indel END)[2] AS p1, (CASE WHEN gs <= gi THEN snp ELSE indel END)[3] AS p2 FROM q""")
def reference_confidence(spark, sf_dir):
    """Hom-ref PLs of each site: the worse of the substitution model and the indel model."""
    from . import gvcf

    cls = F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    found = _line(spark, sf_dir).select(F.lit(0).alias("tid"), F.lit(0).alias("bin"), F.col("l_partkey").alias("pos"), cls.alias("cls"), F.col("l_quantity").cast("int").alias("qual"), F.lit(None).cast("int").alias("hq_clips"))
    sites = gvcf.site_confidence(rd.locus_sums(found))
    return sites.select("pos", "dp", F.col("ad")[0].alias("ref"), F.col("ad")[1].alias("other"), "gq", *[F.col("pl")[i].alias(f"p{i}") for i in range(3)])


BASES = "regexp_replace(translate(text, 'etaoinsrhl', '{to}'), '[^ACGT]', 'N', 'g')"


def _bases(to: str):
    """Texts as ``BASES`` spells them: a byte a character, taken from a table."""
    table = np.full(256, ord("N"), np.uint8)
    table[[ord(c) for c in "ACGT" + "etaoinsrhl"]] = [ord(c) for c in "ACGT" + to]

    @F.arrow_udf("string")
    def spelled(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        found = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        later = np.flatnonzero(found & 0xC0 == 0x80)  # a character's bytes after its first
        ends = offsets - offsets[0] - np.searchsorted(later, offsets - offsets[0])
        out = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.delete(table[found], later))])
        return pc.if_else(pc.is_valid(texts), out, pa.scalar(None, pa.string())) if texts.null_count else out

    return spelled


def _pieces(df, step: int, size: int, least: int, *more: str):
    """(tid, at, piece, *more): pieces of a text ``b`` of ASCII from every ``step``-th offset that leaves ``least`` characters; cut from bytes, as Spark counts characters from a string's beginning."""
    whole = df.select("tid", *more, F.col("b").cast("binary").alias("b"))
    # no filter, which would work out the text once more below it
    offsets = F.when(F.length("b") >= least, F.sequence(F.lit(0), F.greatest(F.length("b") - least, F.lit(0)), F.lit(step)))
    each = whole.select("tid", *more, "b", F.explode(offsets).alias("at"))
    return each.select("tid", "at", F.substring("b", F.col("at") + 1, F.lit(size)).cast("string").alias("piece"), *more)


@query(f"""
WITH r AS (SELECT doc_id, unnest(string_split({BASES.format(to='ACGTACGTAC')}, '')) AS ch, unnest(range(1, length(text) + 1)) AS pos FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, unnest(string_split({BASES.format(to='ACGTACGTCA')}, '')) AS ch, unnest(range(1, length(text) + 1)) AS pos FROM documents WHERE length(text) > 0),
d AS (SELECT doc_id, unnest(range(0, length(text) - 53, 40)) AS o FROM documents),
x AS (SELECT doc_id, o, unnest(range(0, 43)) AS k FROM d),
e AS (SELECT *, 12 + o + k AS pos, CASE WHEN k < 20 THEN 5 + k WHEN k > 22 THEN 2 + k END AS i FROM x),
f AS (SELECT e.doc_id, k, e.pos, CASE WHEN i IS NULL OR k IN (0, 19, 23) OR b.ch <> r.ch THEN 0 ELSE 1 END AS cls, CASE WHEN i IS NULL THEN 30 ELSE 8 + (e.doc_id + 7 * i) % 35 END AS qual FROM e JOIN r ON r.doc_id = e.doc_id AND r.pos = e.pos LEFT JOIN b ON b.doc_id = e.doc_id AND b.pos = o + 7 + i),
g AS (SELECT *, CASE WHEN k = 0 AND qual > 10 THEN len(list_filter(range(0, 5), lambda j: 8 + (doc_id + 7 * j) % 35 > 28)) END AS hq FROM f)
SELECT doc_id AS tid, cls, qual::INT AS qual, count(*) AS n, sum(pos)::BIGINT AS places, sum(hq)::BIGINT AS hq FROM g GROUP BY 1, 2, 3""")
def pileup_histogram(spark, sf_dir):
    """Reads with a clip and a deletion, laid along each text, against a reference in chunks: counts by contig, class and quality."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") >= 54)
    whole = docs.select(F.col("doc_id").alias("tid"), _bases("ACGTACGTAC")("text").alias("b"))
    chunks = _pieces(whole, 30, 30, 1).select("tid", (F.col("at") + 1).alias("start"), F.col("piece").alias("bases"))
    cigar = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(n).alias("len")) for op, n in (("S", 5), ("M", 20), ("D", 3), ("M", 20))])
    quals = F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: (8 + (F.col("doc_id") + 7 * i) % 35).cast("int"))
    laid = _pieces(docs.select(F.col("doc_id").alias("tid"), _bases("ACGTACGTCA")("text").alias("b"), quals.alias("qual")), 40, 54, 54, "qual")
    reads = laid.select("tid", F.lit(0).alias("flag"), (F.col("at") + 12).alias("start"), F.substring("piece", 7, 45).alias("seq"), "qual", cigar.alias("cigar"))
    return pileup.histogram(reads, chunks, F.lit(None).cast("int"), width=256)


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 4 >= 2 AS rev, doc_id % 3 = 0 AS sec, {BASES.format(to='ACGTACGTAC')} AS s FROM documents WHERE length(text) > 0),
m AS (SELECT doc_id, rev, sec, length(s) AS n, unnest(string_split(CASE WHEN rev THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END, '')) AS ch, unnest(range(0, length(s))) AS j FROM d),
q AS (SELECT *, CASE WHEN rev THEN n - 1 - j ELSE j END AS i, strpos('ACGT', lag(ch) OVER (PARTITION BY doc_id ORDER BY j)) AS a, strpos('ACGT', ch) AS b FROM m),
v AS (SELECT *, (doc_id * 3 + i * 5) % 45 AS q, CASE WHEN j > 0 AND a > 0 AND b > 0 THEN 4 * (a - 1) + b - 1 END AS c, (j + 1) * CASE WHEN sec THEN -1 ELSE 1 END AS y FROM q),
n AS (SELECT doc_id, i, CASE WHEN q < 6 THEN q ELSE least(93, greatest(1, floor(q - 1.5 + q % 3 + coalesce((c - 8) / 4.0 * (q % 2), 0) + CASE WHEN abs(y) <= 20 THEN y / 10.0 ELSE 0 END + 0.5))) END AS x FROM v)
SELECT doc_id, sum(x)::BIGINT AS total, sum(x * (i + 1))::BIGINT AS mark FROM n GROUP BY 1""")
def recalibrated_quality(spark, sf_dir):
    """Qualities with the steps of read group, quality, context and cycle."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    rev, sec = F.col("doc_id") % 4 >= 2, F.col("doc_id") % 3 == 0
    flag = F.when(rev, 0x10).otherwise(0) + F.when(sec, 0x80).otherwise(0)
    quals = F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda i: ((F.col("doc_id") * 3 + i * 5) % 45).cast("int"))
    bases = F.regexp_replace(F.translate("text", "etaoinsrhl", "ACGTACGTAC"), "[^ACGT]", "N")
    reads = docs.select("doc_id", F.lit("g").alias("rg"), flag.alias("flag"), bases.alias("seq"), quals.alias("qual"))
    q = spark.range(0, 45).select(F.lit("g").alias("rg"), F.col("id").cast("int").alias("q"))
    code = lambda c: F.substring(F.lit("ACGT"), c + 1, F.lit(1))
    ctx = q.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(15))))
    cyc = q.withColumn("key", F.explode(F.sequence(F.lit(-20), F.lit(20)))).filter("key <> 0")
    tables = {
        "base": q.withColumn("value", F.col("q") - 1.5 + F.col("q") % 3),
        "context": ctx.select("rg", "q", F.concat(code(F.floor(F.col("c") / 4).cast("int")), code(F.col("c") % 4)).alias("key"), ((F.col("c") - 8) / 4.0 * (F.col("q") % 2)).alias("value")),
        "cycle": cyc.select("rg", "q", "key", (F.col("key") / 10.0).alias("value")),
    }
    new = rd.recalibrated(reads, tables)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return new.select("doc_id", total("qual").alias("total"), total(F.transform("qual", lambda x, i: x.cast("long") * (i + 1))).alias("mark"))


@query(f"""SELECT {KEYS}, round(-0.5772156649015329 + coalesce(list_sum(list_transform(range(1, l_quantity::INT), lambda k: 1.0 / k)), 0), 8) AS digamma,
round(2 / sqrt(pi()) * list_sum(list_transform(range(0, 30), lambda k: pow(-1.0, k) * pow(l_discount * 10, 2 * k + 1) / (exp(lgamma(k + 1.0)) * (2 * k + 1)))), 8) AS erf, round(l_discount * 10, 6) AS inverse,
(CASE WHEN l_extendedprice - 20000 > 0 THEN floor(l_extendedprice - 20000 + 0.5) ELSE ceil(l_extendedprice - 20000 - 0.5) END)::INT AS nearest FROM lineitem""")
def special_functions(spark, sf_dir):
    """Digamma, the error function and its inverse, rounding away from zero."""
    x = F.col("l_discount") * 10
    back = F.when(x == 0, 0.0).otherwise(special.erf_inverse(special.erf(x)))
    return _line(spark, sf_dir).select(*LINE, F.round(special.digamma(F.col("l_quantity")), 8).alias("digamma"), F.round(special.erf(x), 8).alias("erf"), F.round(back, 6).alias("inverse"), special.fast_round(F.col("l_extendedprice") - 20000).alias("nearest"))


@query(f"""
WITH t AS (SELECT {KEYS}, l_linenumber::DOUBLE AS x, l_quantity + 7 AS n, 0.05 + l_discount * 5 AS p, (l_suppkey % (l_linenumber + 1))::DOUBLE AS h, l_linenumber::DOUBLE AS k, l_quantity + 20 AS m FROM lineitem)
SELECT {KEYS}, round(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p) + (n - x) * ln(1 - p), 6) AS binomial,
round(lgamma(11.0) - lgamma(h + 1) - lgamma(11 - h) + lgamma(m - 9) - lgamma(k - h + 1) - lgamma(m - 10 - k + h + 1) - lgamma(m + 1) + lgamma(k + 1) + lgamma(m - k + 1), 6) AS hypergeometric FROM t""")
def log_probabilities(spark, sf_dir):
    """Binomial and hypergeometric log-probabilities by the saddle-point expansion."""
    x, p = F.col("l_linenumber"), 0.05 + F.col("l_discount") * 5
    both = special.hypergeometric_log_pmf(F.col("l_suppkey") % (x + 1), F.lit(10), x, F.col("l_quantity") + 20)
    return _line(spark, sf_dir).select(*LINE, F.round(special.binomial_log_pmf(x, F.col("l_quantity") + 7, p), 6).alias("binomial"), F.round(both, 6).alias("hypergeometric"))


@query("SELECT l_suppkey % 50 AS site, count(DISTINCT l_partkey) AS n_alleles, count(DISTINCT l_partkey % 13) AS n_events, max(length(l_returnflag || l_linestatus)) AS longest FROM lineitem GROUP BY 1")
def distinct_alleles(spark, sf_dir):
    """Distinct haplotypes and events of a site."""
    df = _line(spark, sf_dir).withColumn("site", F.col("l_suppkey") % 50)
    return df.groupBy("site").agg(F.countDistinct("l_partkey").alias("n_alleles"), F.countDistinct(F.col("l_partkey") % 13).alias("n_events"), F.max(F.length(F.concat("l_returnflag", "l_linestatus"))).alias("longest"))
