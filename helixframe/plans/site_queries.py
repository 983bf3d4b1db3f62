"""Site, consensus, genotype and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.functions import sam
from helixframe.operators import consensus as cs
from helixframe.operators import graph as gr
from helixframe.operators.intervals import overlap_join
from helixframe.plans.views import oracle, view

EVIDENCE = """it as (select pos, item, cast(sum(n) as bigint) as n, max(ord) as last from sites group by pos, item),
ev as (select pos, list({'item': item, 'n': n} order by n desc, last, item) as e, cast(sum(n) as bigint) as total from it group by pos),
"""
#: I_x(a, b) by the hypergeometric series, for pairs x, m with a = x and b = m - x at 0.5.
TAIL = """
pr as (select distinct x, m, case when 0.5 <= (x + 1) / (m + 2) then x else m - x end as a, case when 0.5 <= (x + 1) / (m + 2) then m - x else x end as b from {src}),
se as (select x, m, a, b, sum(exp(a * ln(0.5) + b * ln(0.5) - ln(a) + lgamma(a + b) - lgamma(a) - lgamma(b) + k * ln(0.5) + lgamma(a + b + k) - lgamma(a + b) - lgamma(a + 1 + k) + lgamma(a + 1))) as s from pr, range(0, 400) r(k) where b > 1e-9 and a > 1e-9 group by 1, 2, 3, 4),
tl as (select pr.x, pr.m, case when pr.x < 1e-15 then 1.0 when pr.m - pr.x < 1e-15 then 0.0 when 0.5 <= (pr.x + 1) / (pr.m + 2) then s else 1 - s end as miss from pr left join se on pr.x = se.x and pr.m = se.m),
"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.evidence(view(spark, sf_dir, "sites"), ["pos"])


@register("site_evidence", oracle(["sites"], EVIDENCE + """--- select pos, total, array_to_string(list_transform(e, lambda x: x.item || 'x' || x.n), ' ') as evidence from ev"""))
def site_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each site in order."""
    return observed(spark, sf_dir).withColumn("evidence", cs.represent(F.col("evidence")))


@register("majority_calls", oracle(["sites"], EVIDENCE + "tp as (select *, round(e[1].n + 0.2::double, 6) as x, round(total + 1.0::double, 6) as m from ev)," + TAIL.format(src="tp") + """--- select pos, case when 1 - miss >= 0.3 then e[1].item end as call, round(case when 1 - miss >= 0.3 then 1 - miss else 1 end, 6) as p from tp join tl on tp.x = tl.x and tp.m = tl.m"""))
def majority_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority call of each site with its probability."""
    return cs.majority_calls(observed(spark, sf_dir), 0.3).select("pos", "call", F.round("p", 6).alias("p"))


@register("pure_calls", oracle(["sites"], EVIDENCE + """--- select pos, case when e[1].n >= 20 and e[1].n >= 0.4 * total then e[1].item end as call from ev"""))
def pure_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by depth and purity."""
    return observed(spark, sf_dir).select("pos", cs.pure_call(F.col("evidence"), F.col("total"), 20, 0.4).alias("call"))


SAMPLED = """t as (select pos, sample % 4 as s, item, sum(n) as n, max(ord) as last from sites group by 1, 2, 3), k as (select *, row_number() over (partition by pos, s order by n desc, last, item) as r, sum(n) over (partition by pos, s) as total from t),
c as (select pos, s, case when n >= 0.3 * total then item else 'N' end as call from k where r = 1),
w as (select pos, [coalesce(max(call) filter (s = 0), 'N'), coalesce(max(call) filter (s = 1), 'N'), coalesce(max(call) filter (s = 2), 'N'), coalesce(max(call) filter (s = 3), 'N')] as calls from c group by pos),
u as (select *, list_distinct(list_filter(calls, lambda c: c <> 'N')) as clear from w),
"""


@register("nway_comparison", oracle(["sites"], SAMPLED + """--- select pos, array_to_string(calls, '') as partition, case when len(clear) <= 1 then '' when list_contains(clear, '-') then 'deletion' else 'substitution' end as change, len(clear) >= 2 as interesting, not list_contains(calls[1:4], 'N') and not list_has_any(calls[1:2], calls[3:4]) as split from u"""))
def nway_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of four groups of samples site by site."""
    sites = view(spark, sf_dir, "sites").withColumn("s", F.col("sample") % 4)
    found = cs.evidence(sites, ["pos", "s"])
    called = found.withColumn("call", F.coalesce(cs.pure_call(F.col("evidence"), F.col("total"), 0, 0.3), F.lit("N")))
    calls = F.col("calls")
    return cs.nway(called, ["pos"], "s", [0, 1, 2, 3]).select("pos", cs.partition_string(calls).alias("partition"), cs.change_type(calls, F.lit(False)).alias("change"), cs.interesting(calls).alias("interesting"), cs.splits(calls, [0, 1], [2, 3]).alias("split"))


@register("partition_counts", oracle(["sites"], SAMPLED + """--- select array_to_string(calls, '') as partition, cast(count(*) as bigint) as n from u where len(clear) >= 2 group by 1"""))
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many interesting sites have each partition."""
    return nway_comparison(spark, sf_dir).where("interesting").groupBy("partition").agg(F.count("*").alias("n"))


@register("implied_absence", oracle(["sites"], """d as (select pos, sum(case when item <> '-' then n else 0 end) as depth, sum(case when item = '-' then n else 0 end) // 4 as ins from sites group by pos),
l as (select *, lag(pos) over (order by pos) as p, lag(depth) over (order by pos) as b from d) --- select pos, cast(least(depth, case when pos = 0 then depth when p = pos - 1 then b else 0 end) - ins as bigint) as n from l where least(depth, case when pos = 0 then depth when p = pos - 1 then b else 0 end) - ins > 0"""))
def implied_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without insertion that depth implies; a quarter of the gaps stands for insertions (A4)."""
    by = view(spark, sf_dir, "sites").withColumn("is_insertion", F.col("item") == "-").groupBy("pos", "is_insertion").agg(F.sum("n").alias("n"))
    return cs.implied_absence(by.withColumn("n", F.when(F.col("is_insertion"), F.floor(F.col("n") / 4)).otherwise(F.col("n"))), [])


TEXT = "ACGTTGCA" * 8
#: Every alignment over a fixed text; from 8 bases on four shapes of CIGAR take turns by rid, below it is plain M.
ALIGNED = f"""g as (select rid, qname, seqid, strand, s0, e0 - s0 as size, case when e0 - s0 < 8 then 4 else rid % 4 end as kind, substr('{TEXT}', cast(1 + rid % 4 as int), cast(e0 - s0 + 3 as int)) as seq from aln)"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alignment over a fixed text: an insertion and a deletion, clipped ends, = and X, a skip, or plain M below 8 bases."""
    size = F.col("e0") - F.col("s0")
    less = lambda n: (size - n).cast("string")
    shapes = [F.concat(F.lit("3M2I1D"), less(4), F.lit("M")), F.concat(F.lit("2S"), less(0), F.lit("M3H")), F.concat(F.lit("3=1X"), less(4), F.lit("M")), F.concat(F.lit("4M2N"), less(6), F.lit("M"))]
    cigar = F.when(size < 8, F.concat(less(0), F.lit("M"))).otherwise(F.get(F.array(*shapes), (F.col("rid") % 4).cast("int")))
    return view(spark, sf_dir, "aln").withColumn("cigar", cigar).withColumn("seq", F.substring(F.lit(TEXT), (1 + F.col("rid") % 4).cast("int"), (size + 3).cast("int")))


@register("pile_up", oracle(["aln"], ALIGNED + """, x as (select *, unnest(range(0, size)) as i from g),
r as (select *, case kind when 0 then case when i < 3 then i when i > 3 then i + 1 end when 1 then i + 2 when 3 then case when i < 4 then i else i - 2 end else i end as r from x where kind <> 3 or i not in (4, 5)),
b as (select seqid, strand, s0 + i as pos, false as is_insertion, case when r is null then '-' else substr(seq, cast(r + 1 as int), 1) end as item from r union all select seqid, strand, s0 + 3, true, substr(seq, 4, 2) from g where kind = 0)
--- select seqid, strand, pos, is_insertion, item, cast(count(*) as bigint) as n from b group by all"""))
def pile_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed items of every alignment at each position and strand."""
    return cs.pile_up(aligned(spark, sf_dir), ["seqid", "strand"])


@register("aligned_blocks", oracle(["aln"], ALIGNED + """--- select rid, qname, s0, cast(size as int) as reference_length,
case kind when 0 then s0 || '-' || (s0 + 3) || ',' || (s0 + 4) || '-' || (s0 + size) when 2 then (s0 + 4) || '-' || (s0 + size) when 3 then s0 || '-' || (s0 + 4) || ',' || (s0 + 6) || '-' || (s0 + size) else s0 || '-' || (s0 + size) end as blocks from g"""))
def aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference length and aligned blocks of every alignment."""
    blocks = F.array_join(F.transform(sam.aligned_blocks(F.col("s0"), F.col("cigar")), lambda b: F.concat(b["start"].cast("string"), F.lit("-"), b["end"].cast("string"))), ",")
    return aligned(spark, sf_dir).select("rid", "qname", "s0", sam.reference_length(F.col("cigar")).alias("reference_length"), blocks.alias("blocks"))


@register("projected_positions", oracle(["aln"], ALIGNED + """, x as (select *, rid % (size + 1) as i from g)
--- select rid, cast(case when i = size then null when kind = 0 then case when i < 3 then i when i > 3 then i + 1 end when kind = 1 then i + 2 when kind = 3 then case when i < 4 then i when i > 5 then i - 2 end else i end as int) as at from x"""))
def projected_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place of the reference in each alignment as a place of its read; null where no base of the read stands there."""
    offset = F.col("rid") % (F.col("e0") - F.col("s0") + 1)
    return aligned(spark, sf_dir).select("rid", sam.read_position(F.col("cigar"), offset).cast("int").alias("at"))


@register("genotype_calls", oracle(["gt"], """tp as (select *, [ro, ao1, ao2] as c, round(greatest(ro, ao1, ao2) + 0.2::double, 6) as x, round(ro + ao1 + ao2 + 1.0::double, 6) as m from gt),""" + TAIL.format(src="tp") + """
q as (select chrom, pos, c, greatest(ro, ao1, ao2) as top, case when miss <= 0 then 100.0 else least(100, -10 * log10(miss)) end as gq from tp join tl on tp.x = tl.x and tp.m = tl.m)
--- select chrom, pos, round(gq, 3) as gq, case when gq < 5 then '.' else cast(list_position(c, top) - 1 as varchar) end as gt from q"""))
def genotype_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes by posterior majority."""
    counted = view(spark, sf_dir, "gt").withColumn("counts", F.array("ro", "ao1", "ao2"))
    return cs.genotypes(counted, min_gq=5.0).select("chrom", "pos", F.round("gq", 3).alias("gq"), "gt")


@register("ploidy_reduction", oracle(["gt"], """--- select chrom, pos, case when ro % 2 = ao1 % 2 and ao1 % 3 = ao2 then (ro % 2) || '/' || (ao1 % 3) else './.' end as gt from gt"""))
def ploidy_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tetraploid genotypes as diploid ones."""
    alleles = F.array(F.col("ro") % 2, F.col("ao1") % 2, F.col("ao1") % 3, F.col("ao2"))
    return view(spark, sf_dir, "gt").select("chrom", "pos", cs.reduce_ploidy(alleles, 2).alias("gt"))


CLUSTERS = """m as (select *, max(e0) over (partition by seqid order by s0, e0, fid rows between unbounded preceding and 1 preceding) as last from feat),
g as (select *, sum(case when last is null or s0 >= last then 1 else 0 end) over (partition by seqid order by s0, e0, fid) as grp from m), cl as (select fid as node, min(fid) over (partition by seqid, grp) as root, count(*) over (partition by seqid, grp) as n from g),
"""


def overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    feat = view(spark, sf_dir, "feat")
    queries = feat.select("seqid", F.col("fid").alias("b"), F.col("s0").alias("qs"), F.col("e0").alias("qe"))
    return feat.select(F.col("fid").alias("node")), overlap_join(feat, queries, ["seqid"]).where("fid < b").select(F.col("fid").alias("a"), "b")


@register("overlap_clusters", oracle(["feat"], CLUSTERS + "--- select node, root from cl"))
def overlap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of overlapping features (L1)."""
    return gr.clusters(*overlaps(spark, sf_dir))


@register("large_clusters", oracle(["feat"], CLUSTERS + "--- select node, root from cl where n >= 2"))
def large_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of two features or more (L3)."""
    return gr.of_size(gr.clusters(*overlaps(spark, sf_dir)), 2)


@register("reachable_features", oracle(["feat"], CLUSTERS + "sd as (select distinct root from cl join feat on node = fid where typ = (select min(typ) from feat)) --- select node from cl where root in (select root from sd)"))
def reachable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that those of the first type reach by overlaps."""
    feat = view(spark, sf_dir, "feat")
    first = feat.agg(F.min("typ").alias("typ"))
    seeds = feat.join(F.broadcast(first), "typ").select(F.col("fid").alias("node"))
    return gr.reachable(overlaps(spark, sf_dir)[1], seeds).select("node")
