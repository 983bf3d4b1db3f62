"""Interval queries over the alignment and feature views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.operators import fragments as fr
from helixframe.operators import intervals as iv
from helixframe.plans.views import oracle, view

KEYS = ["seqid", "strand"]
DEPTH = """
st as (select {keys}, pos, sum(d) as d from (select {keys}, s0 as pos, 1 as d from {src} where e0 > s0 union all select {keys}, e0, -1 from {src} where e0 > s0) group by {keys}, pos having sum(d) <> 0),
dp as (select {keys}, pos as start, lead(pos) over w as "end", cast(sum(d) over w as bigint) as depth from st window w as (partition by {keys} order by pos)),
runs as (select * from dp where depth > 0 and "end" is not null),
"""


def depth_sql(keys: str, src: str = "aln") -> str:
    return DEPTH.format(keys=keys, src=src)


TOP = "top as (select * from (select *, max(score) over (partition by qname, sample) as best from aln) where score = best),"
HITS = "hits as (select distinct a.rid, a.qname, a.s0, a.e0, a.strand, a.score, a.sample, f.fid, a.strand * f.strand as rel from top a join feat f on a.seqid = f.seqid and ((f.s0 < f.e0 and f.s0 < a.e0 and f.e0 > a.s0) or (f.s0 = f.e0 and a.s0 <= f.s0 and f.s0 < a.e0))),"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.feature_hits(fr.top_hits(view(spark, sf_dir, "aln"), ["qname", "sample"]), view(spark, sf_dir, "feat"))


@register("feature_counts", oracle(["aln", "feat"], TOP + HITS + """
c as (select fid, sample, cast(count(*) as bigint) as n from hits group by fid, sample), t as (select sample, sum(n) as total from c group by sample)
--- select fid, c.sample, n, round(n * 1e6 / total, 6) as rpm from c join t on c.sample = t.sample"""))
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments per feature and sample over top hits, and reads per million."""
    return fr.per_million(fr.count_features(hits(spark, sf_dir), ["fid", "sample"]), "sample")


@register("feature_counts_by_strand", oracle(["aln", "feat"], TOP + HITS + """--- select fid, sample, case when rel < 0 then concat(cast(fid as varchar), 'r') else cast(fid as varchar) end as name, cast(count(*) as bigint) as n from hits group by 1, 2, 3"""))
def feature_counts_by_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of either strand under names with and without r."""
    named = hits(spark, sf_dir).withColumn("name", F.when(F.col("rel") < 0, F.concat(F.col("fid").cast("string"), F.lit("r"))).otherwise(F.col("fid").cast("string")))
    return fr.count_features(named, ["fid", "sample", "name"])


@register("strandedness", oracle(["aln", "feat"], TOP + HITS + """
s as (select sample, fid, sum(case when rel > 0 then 1 else 0 end) as f, sum(case when rel < 0 then 1 else 0 end) as r from hits group by sample, fid)
--- select sample, cast(count(*) as bigint) as n_features, round(avg(100.0 * (f - r) / (f + r)), 6) as strandedness from s where f + r >= 5 group by sample"""))
def strandedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strandedness of features with 5 hits or more."""
    return fr.strandedness(hits(spark, sf_dir), 5)


@register("co_occurrence", oracle(["aln", "feat"], TOP + HITS + """
p as (select a.fid, b.fid as other, a.rel, b.rel as other_rel, a.rid, a.s0, a.e0, a.score, a.sample, a.strand from hits a join hits b on a.rid = b.rid and a.qname = b.qname and a.s0 = b.s0 and a.e0 = b.e0 and a.score = b.score and a.sample = b.sample and a.strand = b.strand where a.fid <> b.fid)
--- select fid, other, rel, other_rel, cast(count(*) as bigint) as n from p group by 1, 2, 3, 4"""))
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of features that one alignment hits."""
    return fr.co_occurrence(hits(spark, sf_dir))


@register("monogamous_hits", oracle(["aln"], """c as (select *, max(score) over w as best, count(*) over w as n_all from aln window w as (partition by qname, sample)),
k as (select *, count(*) over (partition by qname, sample) as n_kept from c where score >= best - 2.0 * 25)
--- select rid, qname, seqid, s0, e0, strand, score, sample, n_kept = 1 as mono from k"""))
def monogamous_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits within two SNPs of the best, and whether the fragment has one alone."""
    return fr.infidelity(view(spark, sf_dir, "aln"), ["qname", "sample"], 2.0, 25.0)


@register("fragment_sizes", oracle(["aln"], """--- select sample, cast(count(*) as bigint) as n, round(avg(e0 - s0), 6) as mean, round(stddev_pop(e0 - s0), 6) as sd, cast(sum(case when e0 - s0 between 10 and 40 then 1 else 0 end) as bigint) as kept from aln group by sample"""))
def fragment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragment-size statistics and how many pass the size limits."""
    return fr.size_stats(view(spark, sf_dir, "aln"), "sample", 10, 40)


@register("depth_runs", oracle(["aln"], depth_sql("seqid, strand") + """--- select seqid, strand, start, "end", depth from runs"""))
def depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of coverage by sequence and strand, as runs."""
    return iv.depth_runs(view(spark, sf_dir, "aln"), KEYS)


@register("max_depth", oracle(["aln"], depth_sql("seqid, strand") + """--- select seqid, strand, greatest(1, max(depth)) as depth from runs group by 1, 2"""))
def max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest depth by sequence and strand, 1 at least."""
    return depth_runs(spark, sf_dir).groupBy(*KEYS).agg(F.greatest(F.lit(1).cast("bigint"), F.max("depth")).alias("depth"))


@register("overlapping_features", oracle(["aln", "feat"], """--- select a.rid, a.qname, a.s0 as qs, a.e0 as qe, f.fid from aln a join feat f on a.seqid = f.seqid and ((f.s0 < f.e0 and f.s0 < a.e0 and f.e0 > a.s0) or (f.s0 = f.e0 and a.s0 <= f.s0 and f.s0 < a.e0)) where a.strand * f.strand >= 0"""))
def overlapping_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features on the strand of each alignment that overlaps them."""
    queries = view(spark, sf_dir, "aln").select("rid", "qname", "seqid", F.col("s0").alias("qs"), F.col("e0").alias("qe"), F.col("strand").alias("q_strand"))
    return iv.overlap_join(view(spark, sf_dir, "feat"), queries, ["seqid"], same_strand=True).select("rid", "qname", "qs", "qe", "fid")


@register("features_at_sites", oracle(["sites", "feat"], """p as (select distinct pos from sites) --- select pos, seqid, cast(count(*) as bigint) as n from p join feat on s0 <= pos and pos < e0 group by pos, seqid"""))
def features_at_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of features active at each site of every sequence."""
    feat = view(spark, sf_dir, "feat")
    points = view(spark, sf_dir, "sites").select("pos").distinct().withColumn("seqid", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("seqid", "pos", F.col("pos").alias("qs"), (F.col("pos") + 1).alias("qe"))
    return iv.overlap_join(feat, points, ["seqid"]).where("s0 < e0").groupBy("pos", "seqid").agg(F.count("*").alias("n"))


@register("collapsed_features", oracle(["feat"], """m as (select *, max(e0) over (partition by typ, seqid, strand order by s0, e0, fid rows between unbounded preceding and 1 preceding) as last from feat),
g as (select *, sum(case when last is null or s0 >= last then 1 else 0 end) over (partition by typ, seqid, strand order by s0, e0, fid) as grp from m)
--- select typ, seqid, strand, min(s0) as start, max(e0) as "end", cast(count(*) as bigint) as n from g group by typ, seqid, strand, grp"""))
def collapsed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping features of a type and strand merged."""
    return iv.collapse(view(spark, sf_dir, "feat"), ["typ", "seqid", "strand"])


@register("related_features", oracle(["feat"], """
w as (select seqid, fid, strand as st, s0 as ps, e0 as pe, greatest(0, case when strand < 0 then s0 - 30 else s0 - 50 end) as s0, case when strand < 0 then e0 + 50 else e0 + 30 end as e0 from feat where typ <= 'Brand#3'),
r as (select w.seqid, w.fid, c.fid as q_fid, st, c.strand as cs, ps < c.e0 and c.s0 < pe as meets, c.s0 * st < ps * st as before from w join feat c on w.seqid = c.seqid and c.typ > 'Brand#3' and w.s0 < c.e0 and w.e0 > c.s0 and w.s0 < w.e0)
--- select seqid, fid, q_fid, case when st * cs = -1 then case when meets then 'opposite' when before then 'upstrand_opposite' else 'downstrand_opposite' end when meets then 'in' when before then 'upstrand' else 'downstrand' end as relation from r"""))
def related_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of features of later brands to those of earlier ones."""
    feat = view(spark, sf_dir, "feat")
    return iv.relate(feat.where("typ <= 'Brand#3'"), feat.where("typ > 'Brand#3'"), ["seqid"], 50, 30)


@register("modified_features", oracle(["feat"], """m as (select *, 5 as a, -3 + floor(0.5 + (e0 - s0) * 0.5) as b from feat)
--- select fid, seqid, cast(greatest(0, case when strand > 0 then s0 + a else s0 - b end) as bigint) as s0, cast(case when strand > 0 then e0 + b else e0 - a end as bigint) as e0, -strand as strand, 'moved' as typ from m"""))
def modified_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features moved along their strand, flipped and retyped."""
    return iv.modify(view(spark, sf_dir, "feat"), "5", "-3+50%", "flip", "moved").select("fid", "seqid", "s0", "e0", "strand", "typ")


ZIPPED = """
z as (select seqid, pos, sum(case when sample = 'A' then d else 0 end) as a, sum(case when sample = 'N' then d else 0 end) as n, sum(case when sample = 'R' then d else 0 end) as r
  from (select seqid, sample, s0 as pos, 1 as d from aln where e0 > s0 union all select seqid, sample, e0, -1 from aln where e0 > s0) group by seqid, pos),
t as (select seqid, pos as start, lead(pos) over w as "end", cast(sum(a) over w as bigint) as "d_A", cast(sum(n) over w as bigint) as "d_N", cast(sum(r) over w as bigint) as "d_R" from z where a <> 0 or n <> 0 or r <> 0 window w as (partition by seqid order by pos)),
tracks as (select * from t where "end" is not null),
"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.zip_tracks(view(spark, sf_dir, "aln"), ["seqid"], "sample", ["A", "N", "R"])


@register("zipped_tracks", oracle(["aln"], ZIPPED + """--- select seqid, start, "end", "d_A", "d_N", "d_R" from tracks"""))
def zipped_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of three samples side by side."""
    return tracks(spark, sf_dir)


def _core_sql(test: str, size: int) -> str:
    return ZIPPED + f"""l as (select *, lag("end") over (partition by seqid order by start) as last from tracks where {test}),
i as (select *, sum(case when last is null or start - last > 16 then 1 else 0 end) over (partition by seqid order by start) as g from l)
--- select seqid, min(start) as start, max("end") as "end" from i group by seqid, g having max("end") - min(start) >= {size}"""


@register("core_regions", oracle(["aln"], _core_sql('"d_A" >= 3 and "d_N" >= 3 and "d_R" >= 3', 40)))
def core_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that all samples cover."""
    return iv.core_regions(tracks(spark, sf_dir), ["seqid"], ["A", "N", "R"], 3, 16, 40)


@register("unique_regions", oracle(["aln"], _core_sql('"d_A" < 7 and "d_N" < 7 and "d_R" < 7', 60)))
def unique_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that no sample covers well."""
    return iv.core_regions(tracks(spark, sf_dir), ["seqid"], ["A", "N", "R"], 7, 16, 60, "unique")


@register("sample_normalizers", oracle(["aln"], depth_sql("sample, seqid") + """tt as (select sample, cast(sum(depth * ("end" - start)) as bigint) as total from runs group by sample), g as (select exp(avg(ln(total))) as m from tt where total > 0)
--- select sample, total, round(m / total, 9) as multiplier from tt, g"""))
def sample_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipliers that bring samples to the geometric mean of their total depth."""
    return iv.depth_totals(iv.depth_runs(view(spark, sf_dir, "aln"), ["sample", "seqid"]), "sample").withColumn("multiplier", F.round("multiplier", 9))


@register("crosstalk_depth", oracle(["aln"], """
c as (select seqid, strand, s0, e0, cast(1 as double) as w from aln where e0 > s0 union all select seqid, -strand, s0, e0, cast(-0.25 as double) from aln where e0 > s0),
st as (select seqid, strand, pos, sum(d) as d from (select seqid, strand, s0 as pos, w as d from c union all select seqid, strand, e0, -w from c) group by 1, 2, 3),
dp as (select seqid, strand, pos as start, lead(pos) over w as "end", sum(d) over w as depth from st window w as (partition by seqid, strand order by pos))
--- select seqid, strand, start, "end", cast(case when round(depth, 9) > 0 then round(depth, 9) else 0 end as double) as depth from dp where "end" is not null"""))
def crosstalk_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth less a quarter of the other strand's."""
    return iv.crosstalk_runs(view(spark, sf_dir, "aln"), ["seqid"], 0.25)


@register("transcripts", oracle(["aln"], depth_sql("seqid, strand") + """
l as (select *, lag("end") over (partition by seqid, strand order by start) as last from runs where depth >= 2),
i as (select *, sum(case when last is null or start > last then 1 else 0 end) over (partition by seqid, strand order by start) as g from l),
b as (select seqid, strand, g, start, "end", depth, unnest(range(start, "end")) as p from i),
m as (select seqid, strand, g, min(p) as start, max(p) + 1 as "end", list_sort(list(depth))[count(*) // 2 + 1] as median from b group by 1, 2, 3)
--- select seqid, strand, start, "end", median from m where median >= 4"""))
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a depth whose upper median is high."""
    return iv.transcripts(depth_runs(spark, sf_dir), KEYS, 2, 4)


@register("modes", oracle(["aln"], depth_sql("seqid, strand") + """g as (select * from runs where depth >= 5)
--- select seqid, strand, start, "end", depth from g a where not exists (select 1 from g b where a.seqid = b.seqid and a.strand = b.strand and b.start < a."end" + 20 and b."end" > a.start - 20 and (b.depth > a.depth or (b.depth = a.depth and b.start < a.start)))"""))
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima of depth."""
    return iv.modes(depth_runs(spark, sf_dir), KEYS, 5, 20)


@register("five_prime_ends", oracle(["aln"], """--- select seqid, strand, case when strand < 0 then e0 - 1 else s0 end as pos, cast(count(*) as bigint) as n from aln group by 1, 2, 3"""))
def five_prime_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of 5' ends at each base."""
    return iv.starts_track(view(spark, sf_dir, "aln"), KEYS)


@register("mapping_ambiguity", oracle(["aln"], """
k as (select *, count(*) over (partition by qname, sample) as n_of from aln),
z as (select seqid, pos, sum(d) as a, sum(case when n_of = 1 then d else 0 end) as u from (select seqid, n_of, s0 as pos, 1 as d from k where e0 > s0 union all select seqid, n_of, e0, -1 from k where e0 > s0) group by seqid, pos),
t as (select seqid, pos as start, lead(pos) over w as "end", sum(a) over w as a, sum(u) over w as u from z where a <> 0 or u <> 0 window w as (partition by seqid order by pos))
--- select seqid, start, "end", round(case when a > 0 then 1 - u / a else 0 end, 9) as ambiguity from t where "end" is not null"""))
def mapping_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the depth that comes from fragments with several alignments."""
    return fr.mapping_ambiguity(view(spark, sf_dir, "aln"), ["qname", "sample"], ["seqid"]).withColumn("ambiguity", F.round("ambiguity", 9))


@register("mate_pairs", oracle(["aln"], """
o as (select *, row_number() over (partition by qname, seqid, sample, strand order by s0, e0, score, rid) as k from aln)
--- select a.qname, a.seqid, a.sample, a.s0 as first_s0, b.s0 as second_s0, least(a.s0, b.s0) as s0, greatest(a.e0, b.e0) as e0 from o a join o b on a.qname = b.qname and a.seqid = b.seqid and a.sample = b.sample and a.k = b.k where a.strand = 1 and b.strand = -1"""))
def mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and reverse alignments of a fragment paired one to one in their order; mates_by_fields has the pairing by mate fields."""
    return fr.pair_mates(view(spark, sf_dir, "aln"), ["qname", "seqid", "sample"])


@register("uncovered_features", oracle(["aln", "feat"], """--- select fid, seqid from feat f where not exists (select 1 from aln a where a.strand = f.strand and a.e0 - a.s0 > 45 and a.seqid = f.seqid and f.s0 < f.e0 and f.s0 < a.e0 and f.e0 > a.s0)"""))
def uncovered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that no long alignment of their strand overlaps, by an anti-join."""
    feat = view(spark, sf_dir, "feat")
    queries = view(spark, sf_dir, "aln").where("e0 - s0 > 45").select("seqid", "strand", F.col("s0").alias("qs"), F.col("e0").alias("qe")).distinct()
    met = iv.overlap_join(feat, queries, ["seqid", "strand"]).where("s0 < e0").select("fid").distinct()
    return feat.join(met, "fid", "left_anti").select("fid", "seqid")
