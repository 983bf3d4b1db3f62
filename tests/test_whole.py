"""Queries and functions that do the whole job, on every row and at great counts."""

import math

from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.functions import stats
from helixframe.operators import reads
from helixframe.plans.views import view

SF = "/root/testdata/sf0.001"


def exact_p(a, b, c, d):
    ln = lambda n: math.lgamma(n + 1)
    of = {x: -ln(x) - ln(a + b - x) - ln(a + c - x) - ln(d - a + x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
    top = max(of.values())
    return math.fsum(math.exp(v - top) for v in of.values() if v <= of[a] + 1e-6) / math.fsum(math.exp(v - top) for v in of.values())


def test_every_feature_is_tested_on_its_own_counts(spark):
    found = catalog.queries()["feature_tests"](spark, SF).collect()
    by = {}
    for r in view(spark, SF, "counts").collect():
        cell = by.setdefault(r.feature, [0, 0])
        if r["sample"] in ("AF", "RF", "NO", "NF"):
            cell[r["sample"] in ("NO", "NF")] += r.n
    c, d = (sum(x) for x in zip(*by.values(), strict=True))
    assert sorted((r.feature, r.a, r.b, r.c, r.d) for r in found) == sorted((f, a, b, c, d) for f, (a, b) in by.items())
    for r in found:
        assert abs(r.p - exact_p(r.a, r.b, r.c, r.d)) < 2e-6


def test_every_alignment_is_piled_up(spark):
    alns = view(spark, SF, "aln")
    found = catalog.queries()["aligned_blocks"](spark, SF)
    assert found.count() == alns.count() > alns.where("e0 - s0 >= 8").count()
    piled = catalog.queries()["pile_up"](spark, SF).where("not is_insertion").agg(F.sum("n")).first()[0]
    skipped = 2 * alns.where("e0 - s0 >= 8 and rid % 4 = 3").count()
    assert piled == alns.agg(F.sum(F.col("e0") - F.col("s0"))).first()[0] - skipped


def at_least(x, n):
    """Chance of a fair coin for x heads or more of n, in whole numbers: I_0.5(x, n - x + 1)."""
    term = total = math.comb(n, x)
    for k in range(x, min(n, x + 20 * math.isqrt(n))):
        term = term * (n - k) // (k + 1)
        total += term
    bits = total.bit_length() - 60
    return math.ldexp(total >> max(bits, 0), max(bits, 0) - n)


def test_incomplete_beta_at_great_counts(spark):
    cases = [(n, x) for n in (100_000, 1_000_000) for x in (n // 2, n // 2 - math.isqrt(n), n // 2 + math.isqrt(n) // 2)]
    rows = [(float(x), float(n - x + 1), at_least(x, n)) for n, x in cases]
    rows += [(n / 2, n / 2, 0.5) for n in (3e4, 1e5, 1e6)]
    frame = spark.createDataFrame(rows, "a double, b double, want double")
    for r in frame.withColumn("p", stats.incomplete_beta(F.col("a"), F.col("b"), F.lit(0.5))).collect():
        assert abs(r.p - r.want) < 1e-6, r


def test_trimming_on_a_fixture_and_clipping_of_whole_reads(spark):
    given = spark.createDataFrame([(1, "ACGT" * 200, "I" * 800)], "doc_id bigint, seq string, qual string")
    trimmed = [reads.clip(given, trim_to=t, trim_start=5, trim_end=5).first().seq for t in (400, None)]
    assert trimmed == [("ACGT" * 200)[5:395], ("ACGT" * 200)[5:795]]
    plain = view(spark, SF, "seqs").withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    lengths = {r.doc_id: len(r.seq) for r in plain.collect()}
    found = {r.doc_id: len(r.seq) for r in reads.clip(plain, trim_start=5, trim_end=5).collect()}
    assert found == {i: max(n - 10, 0) for i, n in lengths.items()} and max(found.values()) > 390
