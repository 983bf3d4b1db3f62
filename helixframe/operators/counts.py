"""Count matrices in tidy form (feature, sample, n): filters, library sizes, normalisation, tests, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe import selection
from helixframe.functions.stats import glog2
from helixframe.operators.ordered import with_running


def filter_matrix(counts: DataFrame, min_total: int = 10, min_max: int = 0) -> DataFrame:
    """Features whose total and greatest count reach both limits."""
    kept = counts.groupBy("feature").agg(F.sum("n").alias("_t"), F.max("n").alias("_m")).where((F.col("_t") >= min_total) & (F.col("_m") >= min_max))
    return counts.join(kept.select("feature"), "feature", "left_semi")


def library_sizes(counts: DataFrame) -> DataFrame:
    """Size of each sample, 1 at least, and the multiplier to the mean size."""
    sizes = counts.groupBy("sample").agg(F.greatest(F.lit(1), F.sum("n")).cast("bigint").alias("size"))
    mean = sizes.agg(F.avg("size").alias("_mean"))
    return sizes.crossJoin(F.broadcast(mean)).select("sample", "size", F.round(F.col("_mean") / F.col("size"), 9).alias("multiplier"))


def moderated_log(counts: DataFrame, sizes: DataFrame, moderation: float = 5.0) -> DataFrame:
    """log2 reads per million, moderated by m counts of the mean library."""
    mean = sizes.agg(F.avg("size").alias("_mean"))
    joined = counts.join(F.broadcast(sizes.select("sample", "size")), "sample").crossJoin(F.broadcast(mean))
    rpm, m = F.col("n") * 1e6 / F.col("size"), moderation * 1e6 / F.col("_mean")
    return joined.select("feature", "sample", F.round(F.log2((rpm + F.sqrt(rpm * rpm + 4 * m * m)) / 2), 6).alias("value"))


def glog(counts: DataFrame, moderation: float = 5.0) -> DataFrame:
    """R2 on bare counts."""
    return counts.select("feature", "sample", F.round(glog2(F.col("n").cast("double"), moderation), 6).alias("value"))


def complete(counts: DataFrame) -> DataFrame:
    """The matrix with its zeros: every feature with every sample; samples are few, features are not gathered."""
    samples = counts.select("sample").distinct()
    grid = counts.select("feature").distinct().crossJoin(F.broadcast(samples))
    return grid.join(counts, ["feature", "sample"], "left").select("feature", "sample", F.coalesce("n", F.lit(0)).alias("n"))


def tmm(counts: DataFrame, reference: str, log_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """Trimmed mean of M values against one sample, scaled so that the factors' geometric mean is 1; 1 for samples without common features."""
    sizes = counts.groupBy("sample").agg(F.sum("n").alias("size"))
    sized = counts.where("n > 0").join(F.broadcast(sizes), "sample").withColumn("p", F.col("n") / F.col("size"))
    ref = sized.where(F.col("sample") == reference).select("feature", F.col("p").alias("rp"), F.col("n").alias("rn"), F.col("size").alias("rsize"))
    both = sized.where(F.col("sample") != reference).join(ref, "feature")
    m, a = F.log2(F.col("p") / F.col("rp")), (F.log2("p") + F.log2("rp")) / 2
    v = (F.col("size") - F.col("n")) / F.col("size") / F.col("n") + (F.col("rsize") - F.col("rn")) / F.col("rsize") / F.col("rn")
    both = both.select("feature", "sample", F.round(m, 12).alias("m"), F.round(a, 12).alias("a"), v.alias("v"))
    total = both.groupBy("sample").agg(F.count("*").alias("total"))

    def ranked(df, column):
        """Mean rank of ties, by counts of each value, summed up in blocks of the value."""
        ties = df.groupBy("sample", column).agg(F.count("*").alias("_n")).withColumn("_bucket", F.floor(F.col(column) * (1 << 16)))
        upto = with_running(ties, ["sample"], "_bucket", {"_upto": F.col("_n")}, order=[column], block=1 << 10)
        return df.join(upto.select("sample", column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"r_{column}")), ["sample", column])

    both = ranked(ranked(both, "m"), "a").join(F.broadcast(total), "sample")
    keep = lambda r, trim: (F.col(r) >= F.floor(F.col("total") * trim) + 1) & (F.col(r) <= F.col("total") - F.floor(F.col("total") * trim))
    found = both.where(keep("r_m", log_trim) & keep("r_a", sum_trim)).groupBy("sample").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("f"))
    logs = sizes.select("sample").join(found, "sample", "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return logs.crossJoin(F.broadcast(logs.agg(F.avg("f").alias("_mean")))).select("sample", F.round(F.pow(F.lit(2.0), F.col("f") - F.col("_mean")), 6).alias("factor"))


def rms_distances(values: DataFrame) -> DataFrame:
    """Root mean square difference of each pair of samples (a < b)."""
    b = values.select("feature", F.col("sample").alias("b"), F.col("value").alias("vb"))
    pairs = values.withColumnRenamed("sample", "a").join(b, "feature").where("a < b")
    return pairs.groupBy("a", "b").agg(F.round(F.sqrt(F.avg(F.pow(F.col("value") - F.col("vb"), F.lit(2)))), 6).alias("distance"))


def spread_filter(values: DataFrame, min_sd: float = 0.0, min_span: float = 0.0) -> DataFrame:
    """P25: features whose values differ, by their span and sample standard deviation at least."""
    by = values.groupBy("feature").agg(F.round(F.max("value") - F.min("value"), 6).alias("span"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    return by.where((F.col("span") > 0) & (F.col("span") >= min_span) & (F.coalesce("sd", F.lit(0.0)) >= min_sd))


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """False discovery rate: the least p * n / rank at or above each p. Works on counts of equal p, in blocks."""
    ties = tests.groupBy(p).agg(F.count("*").alias("_n"))
    ties = with_running(ties.withColumn("_bucket", F.floor(F.col(p) * (1 << 20))), [], "_bucket", {"_rank": F.col("_n")}, order=[p], block=1 << 10)
    total = tests.where(F.col(p).isNotNull()).agg(F.count("*").alias("_total"))
    raw = ties.crossJoin(F.broadcast(total)).withColumn("_q", F.col(p) * F.col("_total") / F.col("_rank")).withColumn("_back", -F.col("_bucket"))
    least = with_running(raw.withColumn("_down", -F.col(p)), [], "_back", maxima={"_m": -F.col("_q")}, order=["_down"], block=1 << 10)
    return tests.join(least.select(p, F.least(F.lit(1.0), -F.col("_m")).alias("fdr")), p)


def design(samples: DataFrame, terms: list[str], constant: bool = True) -> DataFrame:
    """The design matrix: one column for each term `selection=name` over tags, 1 where it selects."""
    columns: list[Column] = []
    for spec in terms:
        expression, name = selection.split_name(spec)
        columns.append(selection.selects(expression, F.col("tags")).cast("int").alias(name))
    return samples.select("sample", *([F.lit(1).alias("const")] if constant else []), *columns)


def merge_matrices(matrices: list[DataFrame]) -> DataFrame:
    """(feature, col, n, agrees) of several matrices; agrees tells whether all that have a value give the same."""
    whole = matrices[0]
    for other in matrices[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy("feature", "sample").agg(F.max("n").alias("n"), (F.min("n") == F.max("n")).alias("agrees"))


def compare_ranks(a: DataFrame, b: DataFrame, n: int = 50) -> DataFrame:
    """The top n features of two result tables (feature, p) rank by rank."""
    top = lambda df, name: df.orderBy("p", "feature").limit(n).withColumn("rank", F.row_number().over(Window.orderBy("p", "feature"))).select("rank", F.col("feature").alias(name))
    return top(a, "first").join(top(b, "second"), "rank", "full")
