"""Fragments: choice of hits, pairing, feature counts, strandedness, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.intervals import overlap_join, runs_of, deltas


def top_hits(hits: DataFrame, keys: list[str], min_score: int | None = None, only_mono: bool = False) -> DataFrame:
    """P20: hits of the best score of their fragment (keys), at least min_score; only_mono: of fragments with one such hit."""
    best = hits.withColumn("_best", F.max("score").over(Window.partitionBy(*keys))).where("score = _best").drop("_best")
    if min_score is not None:
        best = best.where(F.col("score") >= min_score)
    if only_mono:
        best = best.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")
    return best


def random_hit(hits: DataFrame, keys: list[str], identity: list[str], seed: int = 0) -> DataFrame:
    """One hit of each fragment, by the least hash of its identity and a seed."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*identity, F.lit(seed)), *identity)
    return hits.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def infidelity(hits: DataFrame, keys: list[str], snps: float = 2.0, snp_cost: float = 25.0) -> DataFrame:
    """Hits within `snps` SNPs of their fragment's best; mono: the fragment keeps one alone."""
    all_of = Window.partitionBy(*keys)
    kept = hits.withColumn("_best", F.max("score").over(all_of)).where(F.col("score") >= F.col("_best") - snps * snp_cost).drop("_best")
    return kept.withColumn("mono", F.count("*").over(all_of) == 1)


def feature_hits(hits: DataFrame, features: DataFrame) -> DataFrame:
    """Hits with the features they overlap, each feature and relative strand once a hit; strandless features count as forward.

    Equal hits are made one before the join. Only features of several rows can then meet a hit twice, and only their
    pairs are compared; those of other features pass on as they are joined.
    """
    queries = hits.select("rid", "qname", "seqid", F.col("s0").alias("qs"), F.col("e0").alias("qe"), F.col("strand").alias("q_strand"), "score", "sample")
    each = Window.partitionBy("rid", "qname", "seqid", "qs", "qe", "q_strand", "score", "sample").orderBy("rid")
    queries = queries.withColumn("_k", F.row_number().over(each)).where("_k = 1").drop("_k")
    strand = F.when(F.coalesce("strand", F.lit(0)) == 0, 1).otherwise(F.col("strand"))
    of = features.select("fid", "seqid", "s0", "e0", strand.alias("strand")).withColumn("_n", F.count("*").over(Window.partitionBy("fid")))

    def pairs(some):
        found = overlap_join(some.drop("_n"), queries, ["seqid"])
        return found.select("rid", "qname", F.col("qs").alias("s0"), F.col("qe").alias("e0"), F.col("q_strand").alias("strand"), "score", "sample", "fid", (F.col("q_strand") * F.col("strand")).alias("rel"))

    return pairs(of.where("_n = 1")).unionByName(pairs(of.where("_n > 1")).distinct())


def count_features(found: DataFrame, keys: list[str]) -> DataFrame:
    """A5: hits by key."""
    return found.groupBy(*keys).agg(F.count("*").alias("n"))


def per_million(counts: DataFrame, sample: str) -> DataFrame:
    """Counts with reads per million of their sample."""
    totals = counts.groupBy(sample).agg(F.sum("n").alias("_total"))
    return counts.join(totals, sample).withColumn("rpm", F.round(F.col("n") * 1e6 / F.col("_total"), 6)).drop("_total")


def strandedness(found: DataFrame, least: int = 5) -> DataFrame:
    """Mean of 100 (f - r) / (f + r) over features with `least` hits."""
    by = found.groupBy("sample", "fid").agg(F.count_if(F.col("rel") > 0).alias("f"), F.count_if(F.col("rel") < 0).alias("r")).where(F.col("f") + F.col("r") >= least)
    return by.groupBy("sample").agg(F.count("*").alias("n_features"), F.round(F.avg(100.0 * (F.col("f") - F.col("r")) / (F.col("f") + F.col("r"))), 6).alias("strandedness"))


def co_occurrence(found: DataFrame) -> DataFrame:
    """How often a hit that has one feature has another, by their strands."""
    same = ["rid", "qname", "s0", "e0", "strand", "score", "sample"]
    other = found.select(*same, F.col("fid").alias("other"), F.col("rel").alias("other_rel"))
    return found.join(other, same).where("fid <> other").groupBy("fid", "other", "rel", "other_rel").agg(F.count("*").alias("n"))


def size_stats(hits: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """Number, mean and population sd of sizes, and how many are within limits."""
    size = F.col("e0") - F.col("s0")
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean"), F.round(F.stddev_pop(size), 6).alias("sd"), F.count_if(size.between(least, most)).alias("kept"))


def pair_mates(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th forward hit with the k-th reverse one of its fragment, so that each is used once."""
    order = Window.partitionBy(*keys, "strand").orderBy("s0", "e0", "score", "rid")
    ranked = hits.withColumn("_k", F.row_number().over(order))
    first = ranked.where("strand = 1").select(*keys, "_k", F.col("s0").alias("first_s0"), F.col("e0").alias("_e1"))
    second = ranked.where("strand = -1").select(*keys, "_k", F.col("s0").alias("second_s0"), F.col("e0").alias("_e2"))
    return first.join(second, [*keys, "_k"]).select(*keys, "first_s0", "second_s0", F.least("first_s0", "second_s0").alias("s0"), F.greatest("_e1", "_e2").alias("e0"))


def mapping_ambiguity(hits: DataFrame, fragment: list[str], keys: list[str]) -> DataFrame:
    """1 - depth of fragments with one hit / depth of all, 0 where there is none, as runs."""
    marked = hits.withColumn("_n", F.count("*").over(Window.partitionBy(*fragment)))
    steps = deltas(marked.withColumn("_one", (F.col("_n") == 1).cast("int")), [*keys, "_one"])
    wide = steps.groupBy(*keys, "pos").agg(F.sum("delta").alias("all"), F.coalesce(F.sum(F.when(F.col("_one") == 1, F.col("delta"))), F.lit(0)).alias("one")).where("all <> 0 or one <> 0")
    runs = runs_of(wide, keys, {"all": F.col("all"), "one": F.col("one")})
    return runs.select(*keys, "start", "end", F.when(F.col("all") > 0, 1 - F.col("one") / F.col("all")).otherwise(0.0).alias("ambiguity"))
