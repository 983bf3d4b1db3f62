"""Alignments, annotations, variants and tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import ann
from helixframe.sources.lines import numbered


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SAM text without its headers; tags as an array."""
    fields = F.split("value", "\t")
    names = ["qname", "flag:int", "rname", "pos:int", "mapq:int", "cigar", "mrnm", "mpos:int", "isize:int", "seq", "qual"]
    columns = [F.get(fields, F.lit(k)).cast(n.partition(":")[2] or "string").alias(n.partition(":")[0]) for k, n in enumerate(names)]
    return spark.read.text(path).where("value not like '@%' and value <> ''").select(*columns, F.slice(fields, 12, 1 << 20).alias("tags"))


def sam_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header lines as (kind, fields); values are split at the first colon."""
    lines = spark.read.text(path).where(r"value rlike '^@[A-Z][A-Z]\t'")
    rest = F.filter(F.slice(F.split("value", "\t"), 2, 1 << 20), lambda x: x.contains(":"))
    pairs = F.transform(rest, lambda x: F.struct(F.substring_index(x, ":", 1), F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)))
    return lines.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(pairs).alias("fields"))


def reference_lengths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rname, length) of the @SQ lines."""
    return sam_headers(spark, path).where("kind = 'SQ'").select(F.col("fields")["SN"].alias("rname"), F.col("fields")["LN"].cast("bigint").alias("length"))


def annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """GFF2, GTF or GFF3 features with 0-based half-open bounds; . is no strand (null), ? an unknown one (0)."""
    fields = F.transform(F.split("value", "\t"), lambda x: F.trim(x))
    at = lambda k: F.get(fields, F.lit(k))
    rows = spark.read.text(path).where(F.size(F.split("value", "\t")) >= 8).where("value not like '#%'")
    strand = F.when(at(6) == "+", 1).when(at(6) == "-", -1).when(at(6) == "?", 0)
    value = lambda k, kind: F.when(at(k) != ".", at(k)).try_cast(kind)
    text = F.coalesce(at(8), F.lit(""))
    attr = F.when(text.rlike('^[A-Za-z0-9_]+ "'), ann.gtf_attributes(text)).otherwise(ann.attributes(text))
    return rows.select(at(0).alias("seqid"), at(1).alias("source"), at(2).alias("typ"), (at(3).cast("bigint") - 1).alias("s0"), at(4).cast("bigint").alias("e0"), value(5, "double").alias("score"), strand.cast("tinyint").alias("strand"), value(7, "int").alias("phase"), attr.alias("attr"))


def children(features: DataFrame) -> DataFrame:
    """(parent, child) ids of features by their Parent attribute; a missing parent gives no row."""
    ids = features.select(F.col("attr")["ID"].alias("parent")).where("parent is not null")
    links = features.select(ann.feature_id(F.col("attr"), F.col("typ"), F.col("seqid"), F.col("s0"), F.col("e0"), F.col("strand")).alias("child"), F.explode(F.split(F.col("attr")["Parent"], ",")).alias("parent"))
    return links.join(ids, "parent", "left_semi").select("parent", "child")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records (chrom, pos, id, ref, alt[], qual, filter, info, samples): samples by name, their fields by format key."""
    lines = spark.read.text(path)
    head = lines.where("value like '#CHROM%'").limit(1).collect()
    names = head[0].value.split("\t")[9:] if head else []
    f = F.split("value", "\t")
    info = F.map_from_entries(F.transform(F.filter(F.split(f[7], ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_extract(x, "(?s)^[^=]*=?(.*)$", 1))))
    keys = F.split(F.get(f, F.lit(8)), ":")
    one = lambda k: F.map_from_entries(F.transform(F.arrays_zip(keys.alias("k"), F.split(F.get(f, F.lit(9 + k)), ":").alias("v")), lambda x: F.struct(x["k"], x["v"])))
    samples = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), one(k))]) if names else F.lit(None).cast("map<string,map<string,string>>")
    return lines.where("value not like '#%' and value <> ''").select(f[0].alias("chrom"), f[1].cast("bigint").alias("pos"), f[2].alias("id"), f[3].alias("ref"), F.filter(F.split(f[4], ","), lambda x: x != ".").alias("alt"), f[5].try_cast("double").alias("qual"), f[6].alias("filter"), info.alias("info"), samples.alias("samples"))


def userplot(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, forward, reverse) from 0; a plain plot has one number a line and no reverse."""
    lines = numbered(spark, path)
    headed = lines.where("value like '#%'").select("file").distinct().withColumn("headed", F.lit(True))
    rows = lines.join(F.broadcast(headed), "file", "left").where("value not like '#%' and value <> ''")
    f = F.split(F.trim("value"), r"\s+")
    return rows.select("file", F.when(F.col("headed"), f[0].cast("bigint") - 1).otherwise(F.col("line")).alias("pos"), F.when(F.col("headed"), F.get(f, F.lit(1))).otherwise(f[0]).cast("bigint").alias("forward"), F.when(F.col("headed"), F.get(f, F.lit(2))).cast("bigint").alias("reverse"))


def grouped_table(spark: SparkSession, path: str, default_group: str = "All") -> DataFrame:
    """A grouped table in tidy form (name, grp, col, value). #Groups names each column's group; other # lines are remarks."""
    lines = spark.read.text(path)
    marks = [r.value for r in lines.where("value like '#Groups%'").limit(1).collect()]
    first = lines.where("value not like '#%' and trim(value) <> ''").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "name string, grp string, col string, value string")
    sep = "\t" if "\t" in first[0].value else ","
    table = spark.read.option("sep", sep).option("header", True).option("comment", "#").csv(path)
    columns = table.columns[1:]
    groups, last = [], default_group
    for k in range(len(columns)):
        named = marks[0].split(sep)[k + 1 :][:1] if marks else []
        last = named[0] if named and named[0] else last
        groups.append(last)
    entries = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for g, c in zip(groups, columns, strict=True)])
    return table.select(F.col(f"`{table.columns[0]}`").alias("name"), F.explode(entries).alias("x")).select("name", "x.*")


def evidence_table(spark: SparkSession, path: str) -> DataFrame:
    """The eight columns of an evidence table as long rows (pos, is_insertion, reference, evidence, call, consequences)."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path).toDF("pos", "ie", "se", "reference", "ic", "sc", "iq", "sq")
    sides = F.array(F.struct(F.lit(True).alias("is_insertion"), F.col("ie").alias("evidence"), F.col("ic").alias("call"), F.col("iq").alias("consequences")), F.struct(F.lit(False).alias("is_insertion"), F.col("se").alias("evidence"), F.col("sc").alias("call"), F.col("sq").alias("consequences")))
    return t.select(F.col("pos").cast("bigint").alias("pos"), "reference", F.explode(sides).alias("x")).select("pos", "x.is_insertion", "reference", "x.evidence", "x.call", "x.consequences")


def datums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(sample, value, field) of log lines such as `(> sample value field`."""
    rule = r"^\(>\s*(\S+)\s+(\S+)\s+(.*)$"
    lines = spark.read.text(path).where("value like '(>%'")
    return lines.select(F.regexp_extract("value", rule, 1).alias("sample"), F.regexp_replace(F.regexp_extract("value", rule, 2), ",", "").alias("value"), F.regexp_extract("value", rule, 3).alias("field"))
