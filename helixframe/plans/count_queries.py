"""Count-matrix queries over quantities by part and return status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import selection
from helixframe.catalog import register
from helixframe.functions.stats import fisher_2x2
from helixframe.operators import counts as ct
from helixframe.plans.views import oracle, view

SIZES = "sz as (select sample, cast(greatest(1, sum(n)) as bigint) as size from counts group by sample),"
LOGS = SIZES + """mn as (select avg(size) as mean from sz), lg as (select feature, c.sample, round(log2((n * 1e6 / size + sqrt((n * 1e6 / size) * (n * 1e6 / size) + 4 * (5e6 / mean) * (5e6 / mean))) / 2), 6) as value from counts c join sz on c.sample = sz.sample, mn),"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "counts")
    return ct.moderated_log(counts, ct.library_sizes(counts))


@register("filtered_counts", oracle(["counts"], """k as (select feature from counts group by feature having sum(n) >= 700 and max(n) >= 300) --- select * from counts where feature in (select feature from k)"""))
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of enough counts."""
    return ct.filter_matrix(view(spark, sf_dir, "counts"), 700, 300)


@register("library_sizes", oracle(["counts"], SIZES + """--- select sample, size, round((select avg(size) from sz) / size, 9) as multiplier from sz"""))
def library_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library sizes and multipliers."""
    return ct.library_sizes(view(spark, sf_dir, "counts"))


@register("log_expression", oracle(["counts"], LOGS + "--- select feature, sample, value from lg"))
def log_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderated log2 reads per million."""
    return logs(spark, sf_dir)


@register("glog_counts", oracle(["counts"], "--- select feature, sample, round(log2((n + sqrt(cast(n as double) * n + 100)) / 2), 6) as value from counts"))
def glog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderated log2 counts (R2)."""
    return ct.glog(view(spark, sf_dir, "counts"))


@register("sample_distances", oracle(["counts"], LOGS + "--- select a.sample as a, b.sample as b, round(sqrt(avg(power(a.value - b.value, 2))), 6) as distance from lg a join lg b on a.feature = b.feature and a.sample < b.sample group by 1, 2"))
def sample_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each pair of samples."""
    return ct.rms_distances(logs(spark, sf_dir))


@register("varying_features", oracle(["counts"], LOGS + "--- select feature, round(max(value) - min(value), 6) as span, round(stddev_samp(value), 6) as sd from lg group by feature having max(value) - min(value) > 0 and round(max(value) - min(value), 6) >= 1 and coalesce(round(stddev_samp(value), 6), 0) >= 0.5"))
def varying_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose expression varies (P25)."""
    return ct.spread_filter(logs(spark, sf_dir), 0.5, 1.0)


TMM = """sz as (select sample, sum(n) as size from counts group by sample), s as (select feature, c.sample, n, size, n / size as p from counts c join sz on c.sample = sz.sample where n > 0),
r as (select feature, p as rp, n as rn, size as rsize from s where sample = 'NO'),
b as (select s.sample, round(log2(p / rp), 12) as m, round((log2(p) + log2(rp)) / 2, 12) as a, (size - n) / size / n + (rsize - rn) / rsize / rn as v from s join r on s.feature = r.feature where s.sample <> 'NO'),
k as (select *, rank() over (partition by sample order by m) + (count(*) over (partition by sample, m) - 1) / 2 as rm, rank() over (partition by sample order by a) + (count(*) over (partition by sample, a) - 1) / 2 as ra, count(*) over (partition by sample) as t from b),
f as (select sample, sum(m / v) / sum(1 / v) as f from k where rm >= floor(t * 0.3) + 1 and rm <= t - floor(t * 0.3) and ra >= floor(t * 0.05) + 1 and ra <= t - floor(t * 0.05) group by sample),
l as (select sz.sample, coalesce(f, 0) as f from sz left join f on sz.sample = f.sample)
--- select sample, round(power(2, f - (select avg(f) from l)), 6) as factor from l"""


@register("tmm_factors", oracle(["counts"], TMM))
def tmm_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation factors by trimmed means of M values."""
    return ct.tmm(view(spark, sf_dir, "counts"), "NO")


@register("feature_tests", oracle(["counts"], """t as (select feature, cast(coalesce(sum(n) filter (sample in ('AF', 'RF')), 0) as bigint) as a, cast(coalesce(sum(n) filter (sample in ('NO', 'NF')), 0) as bigint) as b from counts group by feature),
g as (select cast(sum(a) as bigint) as c, cast(sum(b) as bigint) as d from t), q as (select distinct a, b, c, d from t, g), h as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as k from q),
l as (select a, b, k, sum(case when k > greatest(0, a - d) then ln((a + b - k + 1) * (a + c - k + 1) / (k * (d - a + k)::double)) else 0 end) over (partition by a, b order by k) as lp from h),
m as (select a, b, max(lp) as top, max(lp) filter (k = a) as seen from l group by 1, 2),
p as (select l.a, l.b, round(sum(exp(lp - top)) filter (lp <= seen + 1e-6) / sum(exp(lp - top)), 6) as p from l join m on l.a = m.a and l.b = m.b group by 1, 2)
--- select feature, t.a, t.b, c, d, p from t join p on t.a = p.a and t.b = p.b, g"""))
def feature_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 2x2 test of every feature's returned and other quantities against all features' (G14, 2x2 only)."""
    by = view(spark, sf_dir, "counts").groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("sample").isin(*s), F.col("n"))), F.lit(0)).alias(k) for k, s in (("a", ("AF", "RF")), ("b", ("NO", "NF")))])
    total = by.agg(F.sum("a").alias("c"), F.sum("b").alias("d"))
    tables = by.select("a", "b").distinct().crossJoin(F.broadcast(total))
    tested = tables.withColumn("p", F.round(fisher_2x2(*[F.col(c).cast("double") for c in "abcd"]), 6))
    return by.join(tested, ["a", "b"]).select("feature", "a", "b", "c", "d", "p")


@register("discovery_rates", oracle(["counts"], """p as (select feature, sample, (1 + n % 997) / 1000.0::double as p from counts), r as (select *, count(*) over (order by p) as k, count(*) over () as t from p), q as (select *, min(p * t / k) over (order by p desc) as q from r)
--- select feature, sample, round(least(1, q), 9) as fdr from q"""))
def discovery_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False discovery rates of stand-in p-values."""
    tests = view(spark, sf_dir, "counts").select("feature", "sample", ((1 + F.col("n") % 997) / 1000.0).alias("p"))
    return ct.benjamini_hochberg(tests).select("feature", "sample", F.round("fdr", 9).alias("fdr"))


@register("merged_matrices", oracle(["counts"], """d as (select * from counts union all select feature, sample, case when n > 500 then n + 1 else n end from counts) --- select feature, sample, max(n) as n, min(n) = max(n) as agrees from d group by 1, 2"""))
def merged_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two matrices merged, differing cells marked."""
    counts = view(spark, sf_dir, "counts")
    return ct.merge_matrices([counts, counts.withColumn("n", F.when(F.col("n") > 500, F.col("n") + 1).otherwise(F.col("n")))])


@register("ranked_comparison", oracle(["counts"], """a as (select feature, row_number() over (order by n desc, feature) as rank from counts where sample = 'AF' qualify rank <= 50), b as (select feature, row_number() over (order by n desc, feature) as rank from counts where sample = 'RF' qualify rank <= 50)
--- select cast(coalesce(a.rank, b.rank) as int) as rank, a.feature as first, b.feature as second from a full join b on a.rank = b.rank"""))
def ranked_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 50 features of two samples rank by rank."""
    by = lambda s: view(spark, sf_dir, "counts").where(F.col("sample") == s).select("feature", (-F.col("n")).alias("p"))
    return ct.compare_ranks(by("AF"), by("RF"))


@register("design_matrix", oracle([], """s as (select c_custkey as sample, [c_mktsegment, 'n' || c_nationkey] as tags from customer)
--- select sample, 1 as "const", cast(list_contains(tags, 'BUILDING') or list_contains(tags, 'MACHINERY') as int) as built, cast((list_contains(tags, 'n1') or list_contains(tags, 'n2')) and not list_contains(tags, 'BUILDING') as int) as near, cast(list_contains(tags, 'BUILDING') <> (not list_contains(tags, 'n3')) as int) as odd from s"""))
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design matrix of customers by tag selections."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("sample"), F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tags"))
    return ct.design(customers, ["BUILDING/MACHINERY=built", "n1/n2:-BUILDING=near", "BUILDING^-n3=odd"])


@register("selection_weights", oracle([], """--- select c_custkey as sample, cast(2.5 * cast(c_mktsegment = 'BUILDING' as int) + cast(c_nationkey <> 1 as int) as double) as weight from customer"""))
def selection_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of customers by tag selections."""
    tags = F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("sample"), selection.weight("{2.5}BUILDING,-n1", tags).alias("weight"))
