"""Alignment functions as Column expressions: CIGAR lengths and blocks, flags, scores, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
FLAGS = {"paired": 1, "properly_paired": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}


def flag(flags: Column, name: str) -> Column:
    """whether a flag is set."""
    return flags.bitwiseAND(F.lit(FLAGS[name])) != 0


def with_flag(flags: Column, name: str, on: bool) -> Column:
    """flags with one set or cleared."""
    return flags.bitwiseOR(F.lit(FLAGS[name])) if on else flags.bitwiseAND(F.lit(0xFFF & ~FLAGS[name]))


def operations(cigar: Column) -> Column:
    """The CIGAR as an array of structs (n, op)."""
    found = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def reference_length(cigar: Column) -> Column:
    """bases of the reference that an alignment covers (operations M D N P = X)."""
    return F.aggregate(operations(cigar), F.lit(0), lambda acc, x: acc + F.when(x["op"].isin("M", "D", "N", "P", "=", "X"), x["n"]).otherwise(0))


def placed(cigar: Column) -> Column:
    """Operations with their offsets: structs (op, n, ref, read), offsets from the alignment's start and the read's."""
    zero = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<op:string,n:int,ref:int,read:int>>").alias("out"))

    def step(acc, x):
        on_ref = F.when(x["op"].isin("M", "D", "N", "P", "=", "X"), x["n"]).otherwise(0)
        on_read = F.when(x["op"].isin("M", "I", "S", "=", "X"), x["n"]).otherwise(0)
        one = F.struct(x["op"].alias("op"), x["n"].alias("n"), acc["ref"].alias("ref"), acc["read"].alias("read"))
        return F.struct((acc["ref"] + on_ref).alias("ref"), (acc["read"] + on_read).alias("read"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(operations(cigar), zero, step, lambda acc: acc["out"])


def aligned_blocks(start0: Column, cigar: Column) -> Column:
    """F8: structs (start, end) on the reference of the operations M."""
    blocks = F.filter(placed(cigar), lambda x: x["op"] == "M")
    return F.transform(blocks, lambda x: F.struct((start0 + x["ref"]).alias("start"), (start0 + x["ref"] + x["n"]).alias("end")))


def read_position(cigar: Column, offset: Column) -> Column:
    """Where in the read the reference's base `offset` after the alignment's start is; null in a deletion or skip and outside."""
    holds = F.filter(placed(cigar), lambda x: x["op"].isin("M", "=", "X") & (x["ref"] <= offset) & (offset < x["ref"] + x["n"]))
    return F.get(F.transform(holds, lambda x: x["read"] + offset - x["ref"]), F.lit(0))


def score(tags: Column, mapq: Column) -> Column:
    """the AS tag, else the mapping quality. tags: array of TAG:TYPE:VALUE."""
    found = F.filter(tags, lambda x: x.startswith("AS:i:"))
    return F.coalesce(F.substring(F.get(found, F.lit(0)), 6, 20).cast("int"), mapq)


def with_tag(tags: Column, tag: str, value: Column) -> Column:
    """tags with one set."""
    return F.concat(F.filter(tags, lambda x: ~x.startswith(tag + ":")), F.array(F.concat(F.lit(tag + ":i:"), value.cast("string"))))


def original_name(qname: Column, flags: Column) -> Column:
    """the read's name with /1 or /2 as its flags say."""
    return F.concat(qname, F.when(flag(flags, "first"), "/1").when(flag(flags, "second"), "/2").otherwise(""))
