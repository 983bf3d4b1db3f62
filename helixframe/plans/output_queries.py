"""Queries of the lines that the writers give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.operators import calling
from helixframe.operators import intervals as iv
from helixframe.plans.interval_queries import ZIPPED, tracks
from helixframe.plans.site_queries import TAIL
from helixframe.plans.variant_queries import records
from helixframe.plans.views import oracle, view
from helixframe.sinks import text


@register("fasta_records", oracle(["seqs"], r"""l as (select doc_id, seq, unnest(range(0, greatest(1, (length(seq) + 69) // 70))) as k from seqs) --- select doc_id, '>d' || doc_id || chr(10) || string_agg(substr(seq, cast(70 * k + 1 as int), 70), chr(10) order by k) as value from l group by doc_id"""))
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA records in lines of 70 (K1)."""
    return view(spark, sf_dir, "seqs").withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).select("doc_id", text.fasta_text().alias("value"))


@register("fastq_records", oracle(["seqs"], """--- select doc_id, '@d' || doc_id || chr(10) || seq || chr(10) || '+' || chr(10) || translate(seq, 'ACGT', 'I#5h') as value from seqs"""))
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ records (K2)."""
    reads = view(spark, sf_dir, "seqs").withColumns({"name": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "qual": F.translate("seq", "ACGT", "I#5h")})
    return reads.select("doc_id", text.fastq_text().alias("value"))


@register("gff_lines", oracle(["feat"], """--- select fid, concat_ws(chr(9), seqid, '.', typ, s0 + 1, e0, case when fid % 4 = 0 then '.' else (fid * 0.5::double)::varchar end, case when strand < 0 then '-' else '+' end, '.', 'ID=g' || fid || ';Note=a%2Cb%3B') as value from feat"""))
def gff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as GFF3 lines (K4)."""
    none = F.lit(None).cast("string")
    attr = F.create_map(F.lit("Note"), F.lit("a,b;"), F.lit("ID"), F.concat(F.lit("g"), F.col("fid").cast("string")))
    feat = view(spark, sf_dir, "feat").withColumns({"source": none, "phase": none, "score": F.when(F.col("fid") % 4 != 0, F.col("fid") * F.lit(0.5)), "attr": attr})
    return feat.select("fid", text.gff_text().alias("value"))


@register("plots_of_depth", oracle(["aln"], """n as (select seqid, strand, max(e0) as n from aln group by 1, 2), p as (select seqid, strand, unnest(range(0, n)) as pos from n), d as (select seqid, strand, unnest(range(s0, e0)) as pos from aln where e0 > s0)
--- select seqid, strand, pos, cast(count(k) as bigint) as value from p left join (select *, 1 as k from d) using (seqid, strand, pos) group by 1, 2, 3"""))
def plots_of_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth by strand at each base of every sequence (K7)."""
    aln, keys = view(spark, sf_dir, "aln"), ["seqid", "strand"]
    return text.plot_values_of(iv.depth_runs(aln, keys), aln.groupBy(*keys).agg(F.max("e0").alias("length")), keys)


@register("igv_lines", oracle(["aln"], ZIPPED + """--- select seqid, start, concat_ws(chr(9), seqid, start, "end", 'D', "d_A", "d_N", "d_R") as value from tracks"""))
def igv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of depth as track lines (K8)."""
    return tracks(spark, sf_dir).select("seqid", "start", text.igv_rows(None, ["d_A", "d_N", "d_R"]).alias("value"))


@register("plots_of_tracks", oracle(["aln"], ZIPPED + """b as (select seqid, unnest(range(start, "end")) as pos, "d_A", "d_N", "d_R" from tracks) --- select plot, seqid, pos, value from (select unnest(['d_A', 'd_N', 'd_R']) as plot, seqid, pos, unnest(["d_A", "d_N", "d_R"]) as value from b)"""))
def plots_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every base of each sample's track."""
    return text.plot_rows(tracks(spark, sf_dir), ["d_A", "d_N", "d_R"])


@register("vcf_lines", oracle(["gt"], """--- select pos, concat_ws(chr(9), chrom, pos, '.', 'A', case when pos % 5 = 0 then 'CC' else 'C' end || ',G', '.', '.', case pos % 3 when 0 then 'EFF=STOP(HIGH|NONSENSE)' when 1 then 'EFF=SYN(LOW|SILENT)' else 'DP=1' end) as value from gt"""))
def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant records as lines."""
    none = F.lit(None).cast("string")
    made = records(spark, sf_dir).withColumns({"id": none, "qual": none.cast("double"), "filter": none})
    return made.select("pos", text.vcf_line().alias("value"))


@register("depth_advice", oracle([], """k as (select unnest(['base', 'base', 'base', 'base', 'deletion', 'insertion']) as kind, unnest([0, 1, 2, 3, 0, 0]) as errors), tp as (select *, round(depth - errors + 0.2::double, 6) as x, round(depth + 1.0::double, 6) as m from k, (select unnest(range(1, 101)) as depth) where depth >= errors),""" + TAIL.format(src="tp") + """
--- select kind, errors, min(depth) as depth from tp join tl on tp.x = tl.x and tp.m = tl.m where 1 - miss >= 0.99 group by 1, 2"""))
def depth_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths that calls need (G8); the same for all tables."""
    return calling.depth_advice(spark)
