"""The consensus caller over stranded evidence, and filters and outputs of the comparison of samples at sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.seq import might_be_same_base
from helixframe.functions.stats import proportion_at_least
from helixframe.operators import consensus as cs

#: Order of evidence that no alignment gave.
LAST = 1 << 62


def with_absence(observed: DataFrame, keys: list[str]) -> DataFrame:
    """A4 over observed (keys, strand, pos, is_insertion, item, n, ord): adds the readings without insertion that each strand's depth implies."""
    implied = cs.implied_absence(observed, [*keys, "strand"])
    return observed.unionByName(implied.withColumns({"is_insertion": F.lit(True), "item": F.lit("-"), "ord": F.lit(LAST)}))


def insertion_prior(indel_prior: float, weight: float = 1.0):
    """Weight of an item before an insertion point: `-` is the rule there."""
    return lambda item: F.when(item == "-", weight - indel_prior * weight).otherwise(indel_prior * weight)


def site_calls(observed: DataFrame, keys: list[str], cutoff: float = 0.99, stranded_cutoff: float = 0.0, indel_prior: float = 0.2, weight: float = 1.0, majority: float = 0.5) -> DataFrame:
    """(keys, pos, is_insertion, call, p, evidence) from stranded observations; p is null where nothing reached the cutoff.

    Bases and insertions are called on the evidence of both strands; with a stranded cutoff a call stands only if each
    strand on its own makes the same one.
    """
    site = [*keys, "pos", "is_insertion"]

    def called(rows: DataFrame, at: list[str], least: float) -> DataFrame:
        found = cs.evidence(rows, at)
        parts = [
            cs.majority_calls(found.where(~F.col("is_insertion")), least, indel_prior, weight, majority),
            cs.majority_calls(found.where(F.col("is_insertion")), least, indel_prior, weight, majority, insertion_prior(indel_prior, weight)),
        ]
        return parts[0].unionByName(parts[1])

    whole = with_absence(observed, keys)
    both = called(whole, site, cutoff).withColumn("p", F.when(F.col("call").isNotNull(), F.col("p")))
    if stranded_cutoff:
        strands = called(whole, [*site, "strand"], stranded_cutoff).groupBy(*site).agg(F.count("call").alias("_n"), F.min("call").alias("_a"), F.max("call").alias("_b"))
        agree = (F.col("_n") == 2) & (F.col("_a") == F.col("call")) & (F.col("_b") == F.col("call"))
        both = both.join(strands, site, "left").withColumn("call", F.when(agree, F.col("call"))).drop("_n", "_a", "_b")
    return both.select(*site, "call", "p", "evidence")


def changes(calls: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with the reference's base (keys, pos, base) and what changes there, null for nothing."""
    with_base = calls.join(reference.select(*keys, "pos", "base"), [*keys, "pos"])
    change = (
        F.when(F.col("is_insertion"), F.when(F.col("call") != "-", "insertion-before"))
        .when(F.col("call") == "-", "deletion")
        .when(~might_be_same_base(F.col("base"), F.col("call")), "substitution")
    )
    return with_base.withColumn("change", change)


def miscalls(changed: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of each change, and the expected numbers of miscalls and of miscalled changes.

    A call that the strands' disagreement removed still counts among the insertions that may be miscalled, not among bases.
    """
    counted = F.col("p").isNotNull() & (F.col("is_insertion") | F.col("call").isNotNull())
    wrong = F.when(counted, 1 - F.col("p")).otherwise(0.0)
    kinds = [F.count_if(F.col("change") == k).alias(n) for k, n in (("substitution", "substitutions"), ("insertion-before", "insertions"), ("deletion", "deletions"))]
    aggs = [*kinds, F.round(F.sum(wrong), 6).alias("expected_miscalls"), F.round(F.sum(F.when(F.col("change").isNotNull(), wrong).otherwise(0.0)), 6).alias("expected_miscalled_changes")]
    return changed.groupBy(*keys).agg(*aggs) if keys else changed.agg(*aggs)


def consensus_text(changed: DataFrame, reference: DataFrame, keys: list[str], block: int = 1 << 16) -> DataFrame:
    """(keys, block, consensus, masked, aligned_reference, aligned_result) in stretches of `block` reference bases, which put together in their order give the whole sequence.

    Uncalled bases are N, in the masked text the reference's base in lower case; deletions are left out of the first
    two; insertions stand before their base.
    """
    base = changed.where("not is_insertion").select(*keys, "pos", F.col("call").alias("c"))
    inserted = changed.where("is_insertion and call <> '-'").select(*keys, "pos", F.col("call").alias("ins"))
    at = reference.join(base, [*keys, "pos"], "left").join(inserted, [*keys, "pos"], "left").withColumn("ins", F.coalesce("ins", F.lit("")))
    kept = F.when(F.col("c") == "-", "").otherwise(F.col("c"))
    texts = {
        "consensus": F.concat("ins", F.coalesce(kept, F.lit("N"))),
        "masked": F.concat("ins", F.coalesce(kept, F.lower("base"))),
        "aligned_reference": F.concat(F.repeat(F.lit("-"), F.length("ins")), "base"),
        "aligned_result": F.concat("ins", F.coalesce("c", F.lit("N"))),
    }
    rows = at.select(*keys, F.floor(F.col("pos") / block).alias("block"), F.struct("pos", *[t.alias(n) for n, t in texts.items()]).alias("_x"))
    whole = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("_x")).alias("_all"))
    return whole.select(*keys, "block", *[F.array_join(F.col("_all")[n], "").alias(n) for n in texts])


def binary(calls: Column) -> Column:
    """Exactly two different calls."""
    return F.size(F.array_distinct(calls)) == 2


def sane(calls: Column) -> Column:
    """From two to ten different calls, so that each can be a digit."""
    return F.size(F.array_distinct(calls)).between(2, 10)


def unambiguous(calls: Column) -> Column:
    """No ambiguous call."""
    return F.forall(calls, lambda c: ~c.isin(*cs.AMBIGUOUS))


def no_indels(calls: Column, is_insertion: Column) -> Column:
    """Neither an insertion site nor a deletion in any sample."""
    return ~is_insertion & ~F.array_contains(calls, "-")


def not_boring(calls: Column, is_insertion: Column) -> Column:
    """Not an insertion site at which no sample has an insertion."""
    return ~is_insertion | F.exists(calls, lambda c: ~c.isin("-", "N"))


def nway_filtered(sites: DataFrame, indels: bool = True, require_all: bool = False, require_bisect: bool = False, full: bool = False, split: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """The filters over (calls, is_insertion) in their order: indels, all called or interesting, bisecting, splitting."""
    calls, ins = F.col("calls"), F.col("is_insertion")
    tests = [] if indels else [no_indels(calls, ins)]
    tests += [unambiguous(calls)] if require_all or require_bisect else []
    tests += [binary(calls)] if require_bisect else []
    tests += [not_boring(calls, ins)] if full else [cs.interesting(calls)]
    tests += [cs.splits(calls, *split)] if split else []
    return sites.where(reduce(lambda a, b: a & b, tests))


def with_reference(called: DataFrame, reference: DataFrame, site: list[str], sample: str, name) -> DataFrame:
    """Calls (site, is_insertion, sample, call) and the reference's own as one more sample: its base, `-` at insertion sites."""
    at = called.select(*site, "is_insertion").distinct().join(reference, site)
    own = at.select(*site, "is_insertion", F.lit(name).alias(sample), F.when(F.col("is_insertion"), "-").otherwise(F.col("base")).alias("call"))
    return called.select(*own.columns).unionByName(own)


def _characters(partitions: Column, i: int) -> Column:
    return F.array_join(F.transform(partitions, lambda x: F.substring(x, i + 1, 1)), "")


def nexus_rows(partitions: DataFrame, samples: list, block: int = 1 << 16) -> DataFrame:
    """(sample, block, characters) from (pos, partition): each sample's characters in the order of sites, in stretches of `block` positions."""
    letters = partitions.select(F.floor(F.col("pos") / block).alias("block"), F.struct("pos", "partition").alias("x")).groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("all"))
    rows = letters.select("block", F.posexplode(F.array(*[_characters(F.col("all")["partition"], i) for i in range(len(samples))])).alias("i", "characters"))
    return rows.select(F.element_at(F.array(*[F.lit(s) for s in samples]), F.col("i") + 1).alias("sample"), "block", "characters")


def nexus_head(samples: list, characters: int) -> str:
    """What stands before the matrix."""
    names = "\n".join(str(s) for s in samples)
    return f'#NEXUS\nbegin taxa;\ndimensions ntax={len(samples)};\ntaxlabels\n{names}\n;\nend;\nbegin characters;\ndimensions nchar={characters};\nformat datatype=STANDARD symbols="ACGT-0123456789" missing=N;\nmatrix\n'


def depth_advice(spark: SparkSession, cutoff: float = 0.99, indel_prior: float = 0.2, weight: float = 1.0, majority: float = 0.5, most: int = 10_000) -> DataFrame:
    """(kind, errors, depth): the least depth at which a base with so many errors, a deletion or an insertion is called; no row if `most` is not enough."""
    base, indel = (weight - indel_prior * weight) / 4, indel_prior * weight
    cases = [*[("base", e, base) for e in range(4)], ("deletion", 0, indel), ("insertion", 0, indel)]
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(e).alias("errors"), F.lit(p).alias("prior")) for k, e, p in cases])).alias("c")
    tried = spark.range(1, most + 1).select(F.col("id").alias("depth"), kinds).where("depth >= c.errors").select("depth", "c.*")
    p = proportion_at_least(F.round(F.col("depth") - F.col("errors") + F.col("prior"), 6), F.round(F.col("depth") + F.lit(weight), 6), majority)
    return tried.where(p >= cutoff).groupBy("kind", "errors").agg(F.min("depth").alias("depth"))
