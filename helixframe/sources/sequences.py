"""Sequence files as (file, ord, name, seq, qual)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.reads import filtered
from helixframe.sources.lines import numbered, sniff

SCHEMA = "file string, ord bigint, name string, seq string, qual string"


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records begin at `>`; the name is the whole header, an empty one is an error; white space in sequences is dropped."""
    text = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    name = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    rest = F.when(F.instr("value", "\n") > 0, F.substring(F.col("value"), F.instr("value", "\n") + 1, F.length("value"))).otherwise("")
    checked = F.when(F.trim(name) == "", F.raise_error(F.lit("sequence without a name")).cast("string")).otherwise(name)
    return text.select("file", "ord", checked.alias("name"), F.regexp_replace(rest, r"\s", "").alias("seq"), F.lit(None).cast("string").alias("qual"))


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Strict records of four lines, told by line number, since @ is also a quality."""
    lines = numbered(spark, path).withColumn("ord", F.floor(F.col("line") / 4))
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rows = lines.groupBy("file", "ord").agg(at(0).alias("head"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qual")).where("coalesce(head, '') <> '' or coalesce(seq, '') <> ''")
    good = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    head = F.when(F.coalesce(good, F.lit(False)), F.substring(F.col("head"), F.lit(2), F.length("head"))).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("head", F.lit("")))).cast("string"))
    return rows.select("file", "ord", head.alias("name"), "seq", "qual")


def csfasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Colour-space records of two lines; lines that begin with # are comments."""
    return fasta(spark, path).select("file", "ord", "name", F.regexp_replace("seq", "^#.*", "").alias("seq"), "qual").where("name not like '#%'")


def gff_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The sequences after ##FASTA in a GFF3 file."""
    lines = numbered(spark, path)
    mark = lines.where("value like '##FASTA%'").groupBy("file").agg(F.min("line").alias("mark"))
    after = lines.join(F.broadcast(mark), "file").where("line > mark")
    from helixframe.operators.ordered import with_running

    numbered_records = with_running(after, ["file"], "line", {"ord": F.col("value").startswith(">").cast("bigint")})
    parts = numbered_records.groupBy("file", "ord").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("x"))
    return parts.select("file", "ord", F.substring(F.col("x")[0]["value"], 2, 1 << 30).alias("name"), F.regexp_replace(F.array_join(F.transform(F.slice("x", 2, 1 << 30), lambda r: r["value"]), ""), r"\s", "").alias("seq"), F.lit(None).cast("string").alias("qual"))


def genbank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The ORIGIN of each record of a GenBank file, by its version, accession or locus name."""
    text = spark.read.option("lineSep", "\n//").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value").where("value like '%LOCUS%'")
    field = lambda key: F.nullif(F.regexp_extract("value", rf"(?m)^{key}\s+(\S+)", 1), F.lit(""))
    origin = F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    return text.select("file", "ord", F.coalesce(field("VERSION"), field("ACCESSION"), field("LOCUS")).alias("name"), F.upper(F.regexp_replace(origin, "[^A-Za-z]", "")).alias("seq"), F.lit(None).cast("string").alias("qual"))


READERS = {"fasta": fasta, "fastq": fastq, "genbank": genbank, "gff": gff_sequences}


def read_sequences(spark: SparkSession, spec: str, qualities: bool | str = False) -> DataFrame:
    """A file of any of these formats, with filters after ~~ (`reads.fq~~lengthatleast:50~~first:10`).

    qualities: False drops them, True keeps what there is, "required" fails for a format without any.
    """
    path, *filters = spec.split("~~")
    kind = sniff(spark, path)
    if kind == "empty":
        return spark.createDataFrame([], SCHEMA)
    if kind not in READERS or (qualities == "required" and kind != "fastq"):
        raise ValueError(f"{path}: {kind} has no sequences" + " with qualities" * (kind in READERS))
    found = filtered(READERS[kind](spark, path), filters)
    return found if qualities else found.withColumn("qual", F.lit(None).cast("string"))
