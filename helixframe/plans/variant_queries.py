"""Queries of variant records made of orders, of patched sequences and of the best cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.operators import variants as op
from helixframe.plans.views import oracle, view

SAMPLES = ["reference", "a", "b"]
#: The third genotype is diploid in a quarter of the records; effects are of three kinds.
MADE = """v as (select cast(chrom as varchar) as chrom, pos, ['A', case when pos % 5 = 0 then 'CC' else 'C' end, 'G'] as variants, case when pos % 6 = 0 then null else ro % 3 end as ga, ao1 % 3 as gb, pos % 4 = 0 as two, ao2 as gc, ro, ao1, ao2, pos % 3 as k from gt),
w as (select *, case when ga is null then null else [ga] end as a, case when two then list_sort([gb, gc]) else [gb] end as b, case k when 0 then 'STOP Effect_Impact=HIGH Functional_Class=NONSENSE' when 1 then 'SYN Effect_Impact=LOW Functional_Class=SILENT' else '' end as effects from v),
n as (select * from w where (a is not null and a[1] <> 0) or list_distinct(b) <> [0] or (a is not null and list_distinct(b) <> a)),
"""


def records(spark: SparkSession, sf_dir: str, diploid: bool = True) -> DataFrame:
    """Variant records as the VCF reader gives them."""
    gt, text = view(spark, sf_dir, "gt"), lambda c: F.col(c).cast("string")
    a = F.when(F.col("pos") % 6 != 0, (F.col("ro") % 3).cast("string")).otherwise(".")
    b = (F.col("ao1") % 3).cast("string")
    b = F.when(F.col("pos") % 4 == 0, F.concat(text("ao2"), F.lit("/"), b)).otherwise(b) if diploid else b
    both = F.concat_ws(",", text("ao1"), text("ao2"))
    sample = lambda g: F.create_map(F.lit("GT"), g, F.lit("GQ"), (F.col("ro") + 1).cast("string"), F.lit("RO"), text("ro"), F.lit("AO"), both)
    effect = F.when(F.col("pos") % 3 == 0, F.create_map(F.lit("EFF"), F.lit("STOP(HIGH|NONSENSE)"))).when(F.col("pos") % 3 == 1, F.create_map(F.lit("EFF"), F.lit("SYN(LOW|SILENT)"))).otherwise(F.create_map(F.lit("DP"), F.lit("1")))
    alt = F.array(F.when(F.col("pos") % 5 == 0, "CC").otherwise("C"), F.lit("G"))
    return gt.select(text("chrom").alias("chrom"), "pos", F.lit("A").alias("ref"), alt.alias("alt"), effect.alias("info"), F.create_map(F.lit("a"), sample(a), F.lit("b"), sample(b)).alias("samples"))


_SHOWN = "array_to_string(list_transform(list_filter(list_sort([row(-ro, 1), row(-ao1, 2), row(-ao2, 3)]), lambda x: x[1] <> 0), lambda x: (-x[1]) || 'x' || variants[x[2]]), ' ')"


@register("nway_variants", oracle(["gt"], MADE + f"""x as (select *, {_SHOWN} as c from n where effects not like 'SYN%') --- select chrom, pos, 'A' as genotype_reference, cast(null as double) as quality_reference, '1xA' as count_reference, coalesce(variants[a[1] + 1], '?') as genotype_a, cast(ro + 1 as double) as quality_a, c as count_a,
array_to_string(list_transform(b, lambda i: variants[i + 1]), '/') as genotype_b, cast(ro + 1 as double) as quality_b, c as count_b, effects from x"""))
def nway_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at which samples differ, but those of silent effect, as a table."""
    return op.nway_table(op.nway_records(records(spark, sf_dir), SAMPLES, effect_filter="-SILENT"), SAMPLES)


@register("nway_snps", oracle(["gt"], MADE + """--- select chrom, pos from n where a is not null and len(list_filter(list_concat(a, b), lambda i: length(variants[i + 1]) > 1)) = 0"""))
def nway_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at which samples differ by single bases, the first sample being called."""
    return op.nway_records(records(spark, sf_dir), SAMPLES, required=["a"], only_snps=True).select("chrom", "pos")


@register("nway_characters", oracle(["gt"], MADE.replace("pos % 4 = 0 as two", "false as two") + """l as (select *, case when pos % 5 = 0 then ['0', '1', '2'] else variants end as names from n), s as (select chrom, pos // 65536 as block, pos, unnest(['reference', 'a', 'b']) as sample, unnest([names[1], coalesce(names[a[1] + 1], 'N'), names[b[1] + 1]]) as c from l)
--- select chrom, block, sample, string_agg(c, '' order by pos) as characters from s group by 1, 2, 3"""))
def nway_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of haploid alleles at records where samples differ."""
    return op.nway_nexus(op.nway_records(records(spark, sf_dir, diploid=False), SAMPLES), SAMPLES)


@register("patched_sequences", oracle(["seqs"], """j as (select doc_id, seq, unnest(range(0, (length(seq) + 15) // 20)) as j from seqs), p as (select doc_id, seq, j, 20 * j + 3 as z, 1 + j % 2 as n, max(j) over (partition by doc_id) = j as final, unnest(['s', 't']) as sample from j where 20 * j + 5 <= length(seq)),
v as (select *, case when sample = 's' then (j + doc_id) % 3 when j % 3 = 0 then 0 else 1 end as g from p),
x as (select doc_id, sample, j, case g when 0 then substr(seq, cast(z + 1 as int), cast(n as int)) when 1 then 'ACG' else 'N' end || substr(seq, cast(z + n + 1 as int), cast(case when final then length(seq) else 20 - n end as int)) as piece from v),
y as (select doc_id, sample, string_agg(piece, '' order by j) as rest from x group by 1, 2)
--- select d.doc_id as name, s.sample, case when rest is null then seq else substr(seq, 1, 3) || rest end as seq from seqs d cross join (select unnest(['s', 't']) as sample) s left join y on y.doc_id = d.doc_id and y.sample = s.sample"""))
def patched_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with two samples' variants every twenty bases put in."""
    seqs = view(spark, sf_dir, "seqs").select(F.col("doc_id").alias("name"), "seq", F.col("doc_id").alias("chrom"))
    sites = seqs.where("length(seq) >= 5").select("chrom", F.col("seq").cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 5) / 20).cast("int"))).alias("j"))
    gt = lambda c: F.create_map(F.lit("GT"), c)
    s, t = ((F.col("j") + F.col("chrom")) % 3).cast("string"), F.when(F.col("j") % 3 == 0, ".").otherwise("1")
    made = sites.select("chrom", (20 * F.col("j") + 4).alias("pos"), F.substring("b", 20 * F.col("j") + 4, 1 + F.col("j") % 2).cast("string").alias("ref"), F.array(F.lit("ACG"), F.lit("N")).alias("alt"), F.create_map(F.lit("s"), gt(s), F.lit("t"), gt(t)).alias("samples"))
    return op.patched(seqs.select("name", "seq"), made, ["s", "t"])


@register("best_cover", oracle(["aln"], """p as (select seqid, score, rid, unnest(range(s0, e0)) as pos from aln where e0 > s0), b as (select seqid, pos, rid from p qualify row_number() over (partition by seqid, pos order by score desc, rid) = 1)
--- select seqid, min(pos) as first, cast(count(*) as bigint) as n, rid from (select *, pos - row_number() over (partition by seqid, rid order by pos) as g from b) group by seqid, rid, g"""))
def best_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which alignment is the best at each base, in stretches; no leftovers."""
    return op.best_cover(view(spark, sf_dir, "aln"), ["seqid"], "rid").select("seqid", "first", "n", "rid")


@register("merged_alignments", oracle(["aln"], "--- select rid, seqid, s0, e0, sample from aln"))
def merged_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of all samples together in the order of their places (O1, O2)."""
    rows = view(spark, sf_dir, "aln").select("rid", "seqid", "s0", "e0", "sample")
    return op.by_place([rows.where("sample = 'A'"), rows.where("sample <> 'A' or sample is null")], ["seqid", "s0", "e0", "rid"])
