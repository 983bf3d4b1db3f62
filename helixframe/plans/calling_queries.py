"""Queries of the consensus caller and of the comparison's filters and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.operators import calling as cl
from helixframe.plans.site_queries import SAMPLED, TAIL, nway_comparison
from helixframe.plans.views import oracle, view

#: Users divisible by five stand for insertions, odd ones for the reverse strand; the reference repeats ACGT.
OBSERVED = """ob as (select pos, cast(sample % 2 as int) as strand, sample % 5 = 0 as ins, item, n, ord from sites),
dd as (select strand, pos, sum(case when not ins then n else 0 end) as depth, sum(case when ins then n else 0 end) as inserted from ob group by 1, 2),
pv as (select d.strand, d.pos, d.depth, d.inserted, case when d.pos = 0 then d.depth else coalesce(b.depth, 0) end as before from dd d left join dd b on b.strand = d.strand and b.pos = d.pos - 1),
wh as (select * from ob union all select pos, strand, true, '-', least(depth, before) - inserted, 4611686018427387904 from pv where least(depth, before) > inserted),
g as (select 2 as strand, pos, ins, item, n, ord from wh union all select * from (select strand, pos, ins, item, n, ord from wh)),
gi as (select strand, pos, ins, item, cast(sum(n) as bigint) as n, max(ord) as last from g group by 1, 2, 3, 4),
tops as (select strand, pos, ins, first(item order by n desc, last, item) as item, first(n order by n desc, last, item) as n, sum(n) as total from gi group by 1, 2, 3),
tp as (select *, round(n + case when ins then case when item = '-' then 0.8 else 0.2 end when item = '-' then 0.2 else 0.2 end::double, 6) as x, round(total + 1.0::double, 6) as m from tops),
""" + TAIL.format(src="tp") + """
pc as (select strand, pos, ins, item, 1 - miss as p from tp join tl on tp.x = tl.x and tp.m = tl.m),
cl as (select w.pos, w.ins, case when w.p >= 0.3 then w.p end as p, case when w.p >= 0.3 and a.p >= 0.1 and b.p >= 0.1 and a.item = w.item and b.item = w.item then w.item end as call from pc w left join pc a on a.strand = 0 and a.pos = w.pos and a.ins = w.ins left join pc b on b.strand = 1 and b.pos = w.pos and b.ins = w.ins where w.strand = 2),
rf as (select distinct pos, substr('ACGT', cast(pos % 4 + 1 as int), 1) as base from sites),
ch as (select cl.*, base, case when call is null then null when ins then case when call <> '-' then 'insertion-before' end when call = '-' then 'deletion' when call <> base then 'substitution' end as change from cl join rf on rf.pos = cl.pos),
"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sites").select("pos", (F.col("sample") % 2).cast("int").alias("strand"), (F.col("sample") % 5 == 0).alias("is_insertion"), "item", "n", F.col("ord").cast("bigint").alias("ord"))


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sites").select("pos").distinct().withColumn("base", F.substring(F.lit("ACGT"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.changes(cl.site_calls(_observed(spark, sf_dir), [], 0.3, 0.1), _reference(spark, sf_dir), [])


@register("site_calls", oracle(["sites"], OBSERVED + "--- select pos, ins as is_insertion, call, round(p, 6) as p, base, change from ch"))
def site_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and insertion calls on which both strands agree, and what they change."""
    return _changed(spark, sf_dir).select("pos", "is_insertion", "call", F.round("p", 6).alias("p"), "base", "change")


@register("expected_miscalls", oracle(["sites"], OBSERVED + """w as (select *, case when p is not null and (ins or call is not null) then 1 - p else 0 end as q from ch)
--- select cast(count(*) filter (change = 'substitution') as bigint) as substitutions, cast(count(*) filter (change = 'insertion-before') as bigint) as insertions, cast(count(*) filter (change = 'deletion') as bigint) as deletions, round(sum(q), 6) as expected_miscalls, round(sum(case when change is not null then q else 0 end), 6) as expected_miscalled_changes from w"""))
def expected_miscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of changes and of expected miscalls."""
    return cl.miscalls(_changed(spark, sf_dir), [])


@register("consensus_text", oracle(["sites"], OBSERVED + """j as (select rf.pos, rf.base, b.call as c, coalesce(i.call, '') as i from rf left join ch b on b.pos = rf.pos and not b.ins left join ch i on i.pos = rf.pos and i.ins and i.call <> '-')
--- select cast(floor(pos / 100) as bigint) as block, string_agg(i || case when c = '-' then '' else coalesce(c, 'N') end, '' order by pos) as consensus, string_agg(i || case when c = '-' then '' else coalesce(c, lower(base)) end, '' order by pos) as masked,
string_agg(repeat('-', length(i)) || base, '' order by pos) as aligned_reference, string_agg(i || coalesce(c, 'N'), '' order by pos) as aligned_result from j group by 1"""))
def consensus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus, masked and aligned texts in stretches of 100 bases."""
    return cl.consensus_text(_changed(spark, sf_dir), _reference(spark, sf_dir), [], 100)


NWAY = SAMPLED + "uu as (select pos, calls, pos % 3 = 0 as ins, len(list_distinct(calls)) as kinds, len(clear) as clears, list_contains(calls, 'N') as vague, list_contains(calls, '-') as gap from u),"


def _nway(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = nway_comparison(spark, sf_dir).select("pos", F.filter(F.split("partition", ""), lambda c: c != "").alias("calls"))
    return parts.withColumn("is_insertion", F.col("pos") % 3 == 0)


@register("nway_filters", oracle(["sites"], NWAY + """--- select pos, kinds = 2 as "binary", kinds between 2 and 10 as sane, not vague as unambiguous, not ins and not gap as no_indels, not ins or len(list_filter(calls, lambda c: c not in ('-', 'N'))) > 0 as not_boring from uu"""))
def nway_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filter of the comparison at every site."""
    c, i = F.col("calls"), F.col("is_insertion")
    return _nway(spark, sf_dir).select("pos", cl.binary(c).alias("binary"), cl.sane(c).alias("sane"), cl.unambiguous(c).alias("unambiguous"), cl.no_indels(c, i).alias("no_indels"), cl.not_boring(c, i).alias("not_boring"))


@register("nway_filtered", oracle(["sites"], NWAY + """--- select 'snps' as filter, pos from uu where not ins and not gap and clears >= 2 union all select 'bisect', pos from uu where not vague and kinds = 2 and clears >= 2
union all select 'full', pos from uu where not vague and (not ins or len(list_filter(calls, lambda c: c not in ('-', 'N'))) > 0) union all select 'split', pos from uu where clears >= 2 and calls[1] <> 'N' and calls[3] <> 'N' and calls[1] <> calls[3]"""))
def nway_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that four settings of the filter chain keep."""
    sites = _nway(spark, sf_dir)
    kept = {"snps": cl.nway_filtered(sites, indels=False), "bisect": cl.nway_filtered(sites, require_bisect=True), "full": cl.nway_filtered(sites, require_all=True, full=True), "split": cl.nway_filtered(sites, split=([0], [2]))}
    whole = [df.select(F.lit(name).alias("filter"), "pos") for name, df in kept.items()]
    return whole[0].unionByName(whole[1]).unionByName(whole[2]).unionByName(whole[3])


@register("calls_with_reference", oracle(["sites"], SAMPLED + """k3 as (select pos, pos % 3 = 0 as is_insertion, cast(s as int) as s, call from c)
--- select * from k3 union all select distinct pos, is_insertion, -1, case when is_insertion then '-' else substr('ACGT', cast(pos % 4 + 1 as int), 1) end from k3"""))
def calls_with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each sample and the reference's as one more."""
    from helixframe.operators import consensus as cs

    sites = view(spark, sf_dir, "sites").withColumn("s", (F.col("sample") % 4).cast("int"))
    found = cs.evidence(sites, ["pos", "s"])
    called = found.select("pos", (F.col("pos") % 3 == 0).alias("is_insertion"), "s", F.coalesce(cs.pure_call(F.col("evidence"), F.col("total"), 0, 0.3), F.lit("N")).alias("call"))
    return cl.with_reference(called, _reference(spark, sf_dir), ["pos"], "s", -1)


@register("nexus_characters", oracle(["sites"], SAMPLED + """x as (select pos, unnest(range(1, 5)) as k, calls from u where len(clear) >= 2) --- select 's' || (k - 1) as sample, cast(floor(pos / 100) as bigint) as block, string_agg(calls[k], '' order by pos) as characters from x group by 1, 2"""))
def nexus_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's characters at interesting sites, in stretches of 100 positions."""
    return cl.nexus_rows(nway_comparison(spark, sf_dir).where("interesting").select("pos", "partition"), ["s0", "s1", "s2", "s3"], 100)
