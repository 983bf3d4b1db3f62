"""Text with line numbers, also where a file is read in several splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) with lines counted from 0 in each file.

    Lines are counted by split; what comes before a split is a sum over a file's few splits.
    """
    text = spark.read.text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    parts = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return lines.join(F.broadcast(parts), ["file", "_at"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file by its first bytes: fasta, fastq, sam, bam, genbank, gff, vcf, sff, empty, text or unknown."""
    import bz2
    import zlib

    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("head")).limit(1).collect()
    head = bytes(row[0].head) if row else b""
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(head)
        if head[:4] == b"BAM\x01":
            return "bam"
    elif head[:3] == b"BZh":
        head = bz2.BZ2Decompressor().decompress(head)
    if not head.strip():
        return "empty"
    for start, kind in ((b"@HD\t", "sam"), (b"@SQ\t", "sam"), (b">", "fasta"), (b"LOCUS", "genbank"), (b"@", "fastq"), (b"##gff", "gff"), (b".sff", "sff"), (b"##fileformat=VCF", "vcf")):
        if head.startswith(start):
            return kind
    first = next((x for x in head.split(b"\n") if x and not x.startswith(b"#")), b"")
    return "gff" if first.count(b"\t") in (7, 8) else "sam" if first.count(b"\t") >= 10 else "text"
