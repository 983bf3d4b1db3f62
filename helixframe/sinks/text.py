"""Writers of text formats: each row becomes one value of text, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import ann


def fasta_text(width: int | None = 70) -> Column:
    """K1: a FASTA record of name and seq, in lines of `width`."""
    seq = F.col("seq") if width is None else F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), "name", F.lit("\n"), seq)


def fastq_text() -> Column:
    """K2: a FASTQ record of name, seq and qual."""
    return F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")


def gff_text() -> Column:
    """K4: a GFF3 line of a feature."""
    strand = F.when(F.col("strand") > 0, "+").when(F.col("strand") < 0, "-").when(F.col("strand") == 0, "?").otherwise(".")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", dot("seqid"), dot("source"), dot("typ"), (F.col("s0") + 1).cast("string"), F.col("e0").cast("string"), dot("score"), strand, dot("phase"), ann.attribute_text(F.col("attr")))


def write(df: DataFrame, value: Column, path: str, compression: str | None = None, order: list[str] | None = None) -> None:
    """K1-K4: rows as text; `order` sorts the files by range first."""
    out = df if order is None else df.orderBy(*order)
    out.select(value.alias("value")).write.mode("overwrite").option("compression", compression or "none").text(path)


def write_gff(df: DataFrame, path: str) -> None:
    """K4: features by sequence and start."""
    write(df, gff_text(), path, order=["seqid", "s0"])


def plot_values(runs: DataFrame, length: int, value: str = "depth") -> DataFrame:
    """K7: (pos, value) of every base from runs (start, end, value), 0 where there is none."""
    spark = runs.sparkSession
    each = runs.select(F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), F.col(value).alias("value"))
    return spark.range(length).withColumnRenamed("id", "pos").join(each, "pos", "left").select("pos", F.coalesce("value", F.lit(0)).alias("value"))


def plot_values_of(runs: DataFrame, lengths: DataFrame, keys: list[str], value: str = "depth", block: int = 1 << 16) -> DataFrame:
    """K7: (keys, pos, value) of every base of all sequences of `lengths` (keys, length), 0 where no run is; bases are made in blocks."""
    blocks = lengths.where("length > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / block))))
    every = blocks.select(*keys, F.explode(F.sequence(F.col("_b") * block, F.least(F.col("length"), (F.col("_b") + 1) * block) - 1)).alias("pos"))
    each = runs.select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), F.col(value).alias("value"))
    return every.join(each, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("value", F.lit(0)).alias("value"))


def write_plot(runs: DataFrame, length: int, path: str, value: str = "depth") -> None:
    """K7: one number a line for each base."""
    write(plot_values(runs, length, value), F.col("value").cast("string"), path, order=["pos"])


def igv_rows(tracks: DataFrame, names: list[str]) -> Column:
    """K8: a track line for each run: chromosome, start, end, feature, values."""
    return F.concat_ws("\t", F.col("seqid").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("D"), *[F.col(n).cast("string") for n in names])


def plot_rows(tracks: DataFrame, names: list[str]) -> DataFrame:
    """(plot, seqid, pos, value) of each base and column of tracks (seqid, start, end, names), whose rows may be runs of any width."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("plot"), F.col(n).alias("value")) for n in names])).alias("x")
    return tracks.select("seqid", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), *names).select(each, "seqid", "pos").select("x.plot", "seqid", "pos", "x.value")


def write_plots(tracks: DataFrame, names: list[str], path: str) -> None:
    """A folder for each column and sequence with lines `pos value` from 1, in order."""
    rows = plot_rows(tracks, names).repartitionByRange("plot", "seqid", "pos").sortWithinPartitions("plot", "seqid", "pos")
    rows.select("plot", "seqid", F.concat_ws(" ", (F.col("pos") + 1).cast("string"), F.col("value").cast("string")).alias("value")).write.mode("overwrite").partitionBy("plot", "seqid").text(path)


def vcf_line() -> Column:
    """A VCF line without samples from chrom, pos, id, ref, alt, qual, filter, info."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda x: F.concat(x["key"], F.when(x["value"] == "", "").otherwise(F.concat(F.lit("="), x["value"])))), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot("id"), "ref", F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise("."), dot("qual"), dot("filter"), F.when(F.size("info") > 0, info).otherwise("."))


def grouped_csv(tidy: DataFrame, path: str, columns: list[tuple[str, str]], remarks: list[str] = ()) -> None:
    """K5: (name, col, value) as a wide CSV with remarks and #Groups lines on top. columns: (group, column) in order."""
    wide = tidy.groupBy("name").pivot("col", [c for _, c in columns]).agg(F.first("value")).orderBy("name")
    head = [*(f"#{r}" for r in remarks), ",".join(["#Groups", *[g for g, _ in columns]]), ",".join(["Name", *[c for _, c in columns]])]
    top = tidy.sparkSession.createDataFrame([(k, x) for k, x in enumerate(head)], "k bigint, value string")
    body = wide.select(F.monotonically_increasing_id() + len(head), F.concat_ws(",", "name", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for _, c in columns])).toDF("k", "value")
    top.unionByName(body).orderBy("k").select("value").coalesce(1).write.mode("overwrite").text(path)
