"""URL filter: fixed rules first, then a tree of path templates for each host.

Rules are prefixes of host and path; a rule fits its host and all subdomains, and the longest that fits decides. The
other urls are judged by their template:

1. Segments that look like numbers, hashes or dates become `*` at once, so that pages are counted by few shapes.
2. From the top of each host's tree down to the end of every path, the children of a node are generalised: those whose
   labelled share of bad pages differs from the node's by more than `z` standard errors stay apart, however few pages
   they have; of the rest, a child that is rare beside many siblings is variable and becomes `*`, the others are
   merged into one branch `?`. Where a node's paths go on alike, the segments are taken over as they are.
3. A template's purity is its labelled share of good pages, smoothed towards its host's and that towards the
   overall one by `weight` pseudo-pages each. Templates below `least` are blocked.

Labelled pages are those that a rule settles and those that the caller labels. Everything runs on counts by shape,
aggregated before they are shuffled; pages are joined with their shape's verdict in the end (the plan may broadcast
the shapes where their size allows it). A round of jobs takes each growing node to its next fork, so that their number
is that of forks along a path, not of segments; only shapes that still grow take part, checkpointed after each round.

Cases: a null url or one without "://" has an empty host and path and its own template; an empty path has none of
the segments; very long urls are whole paths, with no depth at which they are cut; a path that ends at a fork is a
template of its own; ties (pages exactly at `rare`, shares exactly at `z`) merge, and a purity equal to `least` allows;
repeated page ids give a row each; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import stash, table

NAME = "op3_url_filter"
ORACLE_SQL = None
#: (verdict, host, path prefix)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^([0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{16,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|[0-9]+[-_].*|.*[-_][0-9]+)(\.[A-Za-z0-9]{1,5})?$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. Of equal length, block goes first."""
    out = None
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def shape_of(path: Column) -> Column:
    """All segments, variable ones as `*`."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def templates(counted: DataFrame, rare: float, many: int, z: float) -> DataFrame:
    """counted: (host, shape, pages, labelled, bad) by shape. Adds `template`, an array like shape with branches generalised.

    A round takes every node that still grows to its next fork: what its shapes' rests have in common is the common
    prefix of the least and the greatest of them. Then the branches of the fork are named.
    """
    tree = counted.withColumns({"template": F.array().cast("array<string>"), "rest": F.col("shape")})
    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]
    done = None
    while True:
        least = tree.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        differs = F.filter(F.sequence(F.lit(0), F.least(F.size("lo"), F.size("hi"))), lambda i: ~F.get("lo", i).eqNullSafe(F.get("hi", i)) | F.get("lo", i).isNull())
        forks = least.select("host", "template", F.element_at(differs, 1).alias("common"))
        moved = tree.join(forks, ["host", "template"]).withColumns({"template": F.concat("template", F.slice("rest", 1, F.col("common"))), "rest": F.slice("rest", F.col("common") + 1, F.greatest(F.size("rest"), F.lit(1)))})
        moved = stash(moved.drop("common"))
        ended = moved.where(F.size("rest") == 0).drop("rest")
        done = ended if done is None else done.unionByName(ended)
        growing = moved.where(F.size("rest") > 0).withColumn("child", F.get("rest", F.lit(0)))
        if growing.isEmpty():
            return stash(done)
        branch = growing.groupBy("host", "template", "child").agg(*sums)
        node = branch.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("pages").alias("all_pages"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        share = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1)
        apart = F.abs(F.col("bad") - share * F.col("labelled")) > z * F.sqrt(F.greatest(F.col("labelled") * share * (1 - share), F.lit(0.25)))
        named = (
            F.when(F.col("child") == "*", "*")
            .when((F.col("children") > many) & (F.col("pages") < rare * F.col("all_pages")) & ~apart, "*")
            .when((F.col("children") > 1) & ~apart, "?")
            .otherwise(F.col("child"))
        )
        chosen = branch.join(node, ["host", "template"]).select("host", "template", "child", named.alias("named"))
        grown = growing.join(chosen, ["host", "template", "child"])
        tree = grown.withColumns({"template": F.concat("template", F.array("named")), "rest": F.slice("rest", 2, F.size("rest"))}).drop("child", "named")


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, rare: float = 0.01, many: int = 20, z: float = 3.0, weight: float = 5.0, least: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page. labelled: (label_id, bad), joined on pages.label_id."""
    url = F.col("url")
    parsed = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    parsed = parsed.withColumn("found", ruled(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    parsed = parsed.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"), "shape", *(["label_id"] if labelled is not None else []))
    known = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int"))
    if labelled is not None:
        marked = labelled.where("label_id is not null and bad is not null").groupBy("label_id").agg(F.max("bad").alias("bad"))
        # shapes are counted by label id first, so that a hot id is aggregated before the join
        by_id = parsed.withColumn("known", known).groupBy("host", "shape", "known", "label_id").agg(F.count("*").alias("pages"))
        evidence = by_id.join(marked, "label_id", "left").withColumn("known", F.coalesce("known", "bad"))
    else:
        evidence = parsed.withColumn("known", known).groupBy("host", "shape", "known").agg(F.count("*").alias("pages"))
    value = F.col("pages") * F.col("known")
    counted = evidence.groupBy("host", "shape").agg(F.sum("pages").alias("pages"), F.sum(F.when(F.col("known").isNotNull(), F.col("pages")).otherwise(0)).alias("labelled"), F.sum(F.coalesce(value, F.lit(0))).alias("bad"))
    tree = templates(counted, rare, many, z)
    by_template = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    by_host = by_template.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    overall = by_host.agg(((F.sum("host_bad") + 0.5) / (F.sum("host_labelled") + 1)).alias("prior"))
    host_share = (F.col("host_bad") + weight * F.col("prior")) / (F.col("host_labelled") + weight)
    purity = 1 - (F.col("bad") + weight * host_share) / (F.col("labelled") + weight)
    scored = by_template.join(by_host, "host").join(F.broadcast(overall)).select("host", "template", F.round(purity, 9).alias("purity"))
    named = tree.select("host", "shape", "template").join(scored, ["host", "template"])
    joined = parsed.join(named, ["host", "shape"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") < least, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: verdict on every page's url. A page is labelled by its document, whose id its path names: bad if toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.when(number != "", number.cast("bigint")).alias("label_id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("label_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter(pages, labels)
