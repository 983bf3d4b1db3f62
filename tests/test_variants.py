"""Variants put into sequences, their errors, and functions on the rows that went wrong once."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixframe.functions import ann
from helixframe.functions import seq as sq
from helixframe.operators import variants as op

SEQS, RECORDS = "name string, seq string", "chrom string, pos bigint, ref string, alt array<string>, samples map<string,map<string,string>>"


def record(pos, ref, alt, gt, chrom="c"):
    return (chrom, pos, ref, alt, {"s": {"GT": gt}})


def patched(spark, records):
    seqs = spark.createDataFrame([("c", "ACGTACGT"), ("d", "TT"), ("e", "")], SEQS)
    return {r.name: r.seq for r in op.patched(seqs, spark.createDataFrame(records, RECORDS), ["s"]).collect()}


def test_variants_are_put_in(spark):
    records = [record(7, "GT", ["", "N"], "1"), record(1, "A", ["CC"], "1"), record(3, "GT", ["G"], "0"), record(5, "A", ["T"], None), record(6, "C", ["T"], ".")]
    assert patched(spark, records) == {"c": "CCCGTAC", "d": "TT", "e": ""}
    assert patched(spark, []) == {"c": "ACGTACGT", "d": "TT", "e": ""}


@pytest.mark.parametrize(
    ("records", "message"),
    [
        ([record(1, "AC", ["A"], "1"), record(2, "C", ["A"], "1")], "overlap"),
        ([record(1, "C", ["A"], "1")], "REF"),
        ([record(1, "A", ["C"], "0/1")], "haploid"),
        ([record(1, "A", ["<DEL>"], "1")], "unsupported"),
        ([record(1, "A", ["C"], "1", "x")], "no sequence"),
    ],
)
def test_variants_that_cannot_be_put_in(spark, records, message):
    with pytest.raises(PySparkException, match=message):
        patched(spark, records)


def test_characters_of_haploid_records_only(spark):
    made = spark.createDataFrame([("c", 1, "A", ["C"], {"a": {"GT": "0/1"}}, {"DP": "1"})], RECORDS + ", info map<string,string>")
    kept = op.nway_records(made, ["reference", "a"])
    assert kept.count() == 1
    with pytest.raises(PySparkException, match="one allele"):
        op.nway_nexus(kept, ["reference", "a"]).collect()
    assert op.nway_records(made, ["reference", "a"], only_snps=True, effect_filter="HIGH").count() == 0


def test_attributes_keep_their_last_digits(spark):
    text = "ID=x0;Parent=y1;Note=z2;Alias=w3"
    found = spark.range(1).select(ann.attributes(F.lit(text)).alias("a")).first().a
    assert found == {"ID": "x0", "Parent": "y1", "Note": "z2", "Alias": "w3"}


def test_sequence_of_no_kmers(spark):
    rows = spark.createDataFrame([("ACG",), ("",), (None,)], "seq string").select(sq.kmers_to_sequence(sq.kmers(F.col("seq"), 4)).alias("x")).collect()
    assert [r.x for r in rows] == [None, None, None]
