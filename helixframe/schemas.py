"""Schemas of the caller's tables.  Coordinates are 1-based and closed in all of them."""

CIGAR = "array<struct<op:string,len:int>>"
READS = f"read_id long, qname string, flag int, tid int, start int, end int, mapq int, cigar {CIGAR}, mtid int, mstart int, isize int, seq string, qual array<int>, rg string"
CONTIGS = "tid int, name string, length long"
REGIONS = "region_id long, tid int, start int, end int, active boolean"
HAPLOTYPES = f"region_id long, hap_id int, is_ref boolean, bases string, cigar {CIGAR}, score double, kmer int, ref_start int"
LIKELIHOODS = "region_id long, read_id long, hap_id int, log10_lk double"
CALLS = "region_id long, tid int, start int, stop int, alleles array<string>, qual double, ac array<int>, af array<double>, an int, dp int, fs double, sor double, mq double, qd double, mleac array<int>, mleaf array<double>, baseq_ranksum double, mq_ranksum double, readpos_ranksum double, excess_het double, gt array<int>, ad array<int>, gq int, pl array<int>, sb array<int>, pid string, pgt string, ps int"
