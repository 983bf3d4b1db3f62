"""Hand-checked values of functions and operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe import selection
from helixframe.functions import ann, sam, seq, stats
from helixframe.operators import consensus as cs
from helixframe.operators import graph, intervals, reads
from helixframe.operators.ordered import with_neighbour, with_running


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda column: frame.select(column.alias("x")).first().x


def test_sequences(one):
    assert [one(seq.reverse_complement(F.lit(s))) for s in ("AACGTN", "acgtRY", "")] == ["NACGTT", "RYacgt", ""]
    assert [(one(seq.canonical(F.lit(k))), one(seq.sign(F.lit(k)))) for k in ("TTT", "ACG", "ACGT")] == [("AAA", -1), ("ACG", 1), ("ACGT", 0)]
    assert one(seq.kmers(F.lit("ACNGTA"), 2)) == ["AC", "GT", "TA"] and one(seq.kmers(F.lit("A"), 2)) == []
    assert one(seq.canonical_kmers(F.lit("TTGNACG"), 2)) == ["AA", "CA", "AC", "CG"] and one(seq.canonical_kmers(F.lit("A"), 2)) == []
    assert one(seq.kmers_to_sequence(F.array(*map(F.lit, ("ACG", "CGT", "GTT"))))) == "ACGTT"
    assert one(seq.translate_codons(F.lit("ATGTAANNNA"))) == "M*X"
    assert [one(seq.might_be_same(F.lit(a), F.lit(b))) for a, b in (("RN", "AC"), ("R", "C"), ("A", "AA"))] == [True, False, False]
    assert [one(seq.might_be_same_amino(F.lit(a), F.lit(b))) for a, b in (("B", "D"), ("X", "K"), ("Z", "D"))] == [True, True, False]
    assert [one(seq.ambiguity_code(F.array(*map(F.lit, b)))) for b in ("A", "AG", "GA", "ACGT", "A-")] == ["A", "R", "R", "N", None]
    assert one(seq.ambiguity_bases(F.lit("B"))) == ["C", "G", "T"]
    assert [one(seq.slice_padded(F.lit("ACGTA"), F.lit(a), F.lit(b), F.lit(s))) for a, b, s in ((-2, 3, 1), (3, 7, -1), (1, 3, 1))] == ["NNACG", "NNTA", "CG"]
    assert tuple(one(seq.longest_run(F.array(*[F.lit(bool(x)) for x in (1, 1, 0, 1, 1, 1, 0, 1, 1, 1)])))) == (3, 3)


def test_alignments(one):
    cigar = F.lit("3S10M2I5M1D4M")
    assert one(sam.reference_length(cigar)) == 20
    assert [tuple(b) for b in one(sam.aligned_blocks(F.lit(100), cigar))] == [(100, 110), (110, 115), (116, 120)]
    assert one(sam.score(F.array(F.lit("NM:i:1"), F.lit("AS:i:-7")), F.lit(3))) == -7 and one(sam.score(F.array().cast("array<string>"), F.lit(3))) == 3
    assert one(sam.with_flag(F.lit(16), "paired", True)) == 17 and one(sam.flag(F.lit(16), "reverse"))
    assert one(sam.original_name(F.lit("r"), F.lit(128))) == "r/2"
    assert one(sam.with_tag(F.array(F.lit("AS:i:1"), F.lit("X:i:2")), "AS", F.lit(9))) == ["X:i:2", "AS:i:9"]


def test_features(one):
    meets = lambda *v: one(ann.overlaps(*map(F.lit, v)))
    assert [meets(3, 8, 5, 6), meets(5, 5, 5, 6), meets(3, 8, 5, 5), meets(5, 5, 5, 5), meets(3, 8, 8, 9), meets(5, 5, 8, 9)] == [True, True, True, False, False, False]
    assert tuple(one(x) for x in ann.shifted(F.lit(10), F.lit(20), F.lit(-1), F.lit(2), F.lit(5))) == (5, 18)
    assert intervals.shift_size("10-100%") == (10, -1.0)
    counts = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(5))
    assert one(ann.encode_counts(counts)) == "5xb 2xa" and one(ann.parse_counts(F.lit("5xb 2xa"))) == {"b": 5, "a": 2}
    assert one(ann.encode(F.lit("a;b%"))) == "a%3Bb%25"


def test_statistics(one):
    for a, b, x in ((1.5, 2.5, 0.3), (6.2, 0.8, 0.5), (0.8, 5.2, 0.5), (30.0, 11.0, 0.9)):
        steps = 200_000
        width = x / steps
        area = sum(((k + 0.5) * width) ** (a - 1) * (1 - (k + 0.5) * width) ** (b - 1) for k in range(steps)) * width
        want = area / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        assert abs(one(stats.incomplete_beta(F.lit(a), F.lit(b), F.lit(x))) - want) < 1e-4
    assert round(one(stats.proportion_at_least(F.lit(5.2), F.lit(6.0), 0.5)), 6) == 0.981518
    assert round(one(stats.proportion_at_least(F.lit(6.2), F.lit(7.0), 0.5)), 6) == 0.991025
    assert abs(one(stats.fisher_2x2(*map(F.lit, (5.0, 0.0, 0.0, 5.0)))) - 2 / 252) < 1e-9
    # counts in the hundred thousands: against the sum of the whole support
    for a, b, c, d in ((100_500, 100_000, 300_000, 300_000), (40, 90_000, 20, 100_000), (3, 0, 1_000_000, 500_000), (0, 0, 5, 7), (90_000, 10, 10, 90_000)):
        terms, at = [], 0.0
        for x in range(max(0, a - d), min(a + b, a + c) + 1):
            terms.append((at, x))
            at += math.log((a + b - x) * (a + c - x) / ((x + 1) * (d - a + x + 1))) if x < min(a + b, a + c) else 0
        top, seen = max(terms)[0], dict((x, t) for t, x in terms)[a]
        want = sum(math.exp(t - top) for t, _ in terms if t <= seen + 1e-6) / sum(math.exp(t - top) for t, _ in terms)
        assert abs(one(stats.fisher_2x2(*[F.lit(float(v)) for v in (a, b, c, d)])) - want) < 1e-8
    assert [round(one(stats.glog2(F.lit(x), 5.0)), 6) for x in (0.0, 10.0)] == [2.321928, 3.593481]


def test_selection(spark):
    rows = spark.createDataFrame([(["strain1", "time1"],), ([],), (["x"],), (["a"],)], "tags array<string>")
    chosen = lambda e: [r.x for r in rows.select(selection.selects(e, F.col("tags")).alias("x")).collect()]
    assert chosen("strain1^-time1") == [True, True, True, True]
    assert chosen("") == [False] * 4 and chosen("all") == [True] * 4
    assert chosen("a/b:c") == [False] * 4 and chosen("[a/x]:-time1") == [False, False, True, True]
    with pytest.raises(ValueError, match="missing"):
        selection.selects("[a", F.col("tags"))


def test_genotypes(spark):
    rows = spark.createDataFrame([(1, [10, 0]), (2, [8, 2]), (3, [None, 1])], "id int, counts array<bigint>")
    found = {r.id: (r.gt, round(r.gq, 3)) for r in cs.genotypes(rows).collect()}
    assert found == {1: ("0", 32.886), 2: (".", 13.844), 3: (".", 0.0)}
    alleles = lambda v: F.array(*map(F.lit, v))
    got = spark.range(1).select(cs.reduce_ploidy(alleles((1, 1, 2, 2)), 2).alias("a"), cs.reduce_ploidy(alleles((1, 2, 2, 2)), 2).alias("b")).first()
    assert tuple(got) == ("1/2", "./.")


def test_ambiguity_calls(spark):
    rows = spark.createDataFrame([(1, "A", 30, 1), (2, "A", 12, 1), (2, "G", 11, 2), (3, "A", 1, 1), (4, "-", 20, 1)], "pos int, item string, n bigint, ord bigint")
    found = cs.ambiguity_calls(cs.evidence(rows, ["pos"])).collect()
    assert {r.pos: r.call for r in found} == {1: "A", 2: "R", 3: None, 4: "-"}


def test_partition_and_change(one):
    calls = F.array(*map(F.lit, ("A", "A", "TT", "N")))
    assert one(cs.partition_string(calls)) == "AA0N" and one(cs.change_type(calls, F.lit(True))) == "insertion-before"


def test_running_values_and_neighbours_do_not_depend_on_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), p, rng.randrange(-5, 6)) for p in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k int, pos bigint, v bigint")
    want, state = {}, {}
    for k, p, v in sorted(rows):
        total, most, last = state.get(k, (0, None, None))
        state[k] = (total + v, v if most is None else max(most, v), v)
        want[(k, p)] = (*state[k][:2], last)
    for block in (1, 7, 64, 1 << 20):
        found = with_neighbour(with_running(df, ["k"], "pos", {"total": F.col("v")}, {"most": F.col("v")}, block=block), ["k"], "pos", {"last": F.col("v")}, False, block=block)
        assert {(r.k, r.pos): (r.total, r.most, r.last) for r in found.collect()} == want


def test_intervals(spark):
    items = spark.createDataFrame([(1, 0, 4, 0), (2, 2, 6, 0)], "fid int, s0 bigint, e0 bigint, seqid int")
    assert sorted((r.start, r.end, r.depth) for r in intervals.depth_runs(items, ["seqid"]).collect()) == [(0, 2, 1), (2, 4, 2), (4, 6, 1)]
    features = spark.createDataFrame([(1, 0, 5, 0), (2, 4, 9, 0), (3, 9, 12, 0)], "fid int, s0 bigint, e0 bigint, seqid int")
    merged = lambda overlap: sorted((r.start, r.end) for r in intervals.collapse(features, ["seqid"], overlap).collect())
    assert merged(0) == [(0, 9), (9, 12)] and merged(-1) == [(0, 12)]
    runs = spark.createDataFrame([(0, k, k + 1, d) for k, d in enumerate([0, 5, 9, 9, 0, 2]) if d], "seqid int, start bigint, end bigint, depth bigint")
    assert [(r.start, r.end, r.median) for r in intervals.transcripts(runs, ["seqid"], 1, 9).collect()] == [(1, 4, 9)]
    peaks = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 3, 5), (0, 3, 4, 1), (0, 4, 5, 5)], "seqid int, start bigint, end bigint, depth bigint")
    assert [(r.start, r.end) for r in intervals.modes(peaks, ["seqid"], 5, 2).collect()] == [(1, 3)]
    good = spark.createDataFrame([(0, 0, 2, 1), (0, 4, 5, 1), (0, 8, 9, 1)], "seqid int, start bigint, end bigint, d_a bigint")
    assert sorted((r.start, r.end) for r in intervals.core_regions(good, ["seqid"], ["a"], 1, 2, 1).collect()) == [(0, 5), (8, 9)]
    points = spark.createDataFrame([(0, k, v) for k, v in enumerate("aabbba")], "k int, pos bigint, v string")
    assert sorted((r.first, r.n, r.v) for r in intervals.run_length(points, ["k"], "pos", "v").collect()) == [(0, 2, "a"), (2, 3, "b"), (5, 1, "a")]
    tiles = intervals.shred(spark.createDataFrame([("s", "ACGTACGTAC"), ("e", "")], "name string, seq string"), 4, 2).collect()
    assert [r.name.split(":")[1] for r in sorted(tiles, key=lambda r: (r.start, r.end))] == ["1..2", "1..4", "3..6", "5..8", "7..10", "9..10"]


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(2)
    spans = lambda n: [(k, s, s + rng.choice([0, 1, 5, 30])) for k in range(n) for s in [rng.randrange(100)]]
    a, b = spans(60), spans(60)
    meets = lambda s, e, qs, qe: (s < e and s < qe and e > qs) or (s == e and qs <= s < qe)
    want = sorted((i, j) for i, s, e in a for j, qs, qe in b if meets(s, e, qs, qe))
    left, right = spark.createDataFrame([(0, *x) for x in a], "k int, i int, s0 bigint, e0 bigint"), spark.createDataFrame([(0, *x) for x in b], "k int, j int, qs bigint, qe bigint")
    for size in (1, 8, 4096):
        assert sorted((r.i, r.j) for r in intervals.overlap_join(left, right, ["k"], size).collect()) == want


def test_clip(spark):
    rows = spark.createDataFrame([("good", "ACGTACGTACGTAAAA", "I" * 16), ("bad", "ACGTACGTACGTAAAA", "#" * 16), ("same", "A" * 16, "I" * 16), ("adaptor", "GGGGGGGGGGACGTACGTAC", "I" * 20)], "name string, seq string, qual string")
    found = {r.name: (r.seq, r.reason) for r in reads.clip(rows, length=8, match=6, max_errors=1, adaptors=["TTTTGGGGGGGG"]).collect()}
    assert found["good"] == ("ACGTACGTACGTAAAA", None) and found["bad"][1] == "quality" and found["same"][1] == "homopolymer"
    assert found["adaptor"] == ("GACGTACGTAC", None)


def test_pairs_and_graph(spark):
    rows = spark.createDataFrame([("a/1", "AC"), ("a/2", "AA"), ("b/1", "G")], "name string, seq string")
    assert sorted(tuple(r) for r in reads.pair_reads(rows).collect()) == [("a", "AC", "TT"), ("b", "G", None)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7)], "a int, b int")
    assert {r.node: r.root for r in graph.connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert {r.node: r.distance for r in graph.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()} == {1: 0, 2: 1, 3: 2}
