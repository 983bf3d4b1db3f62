"""Operators without a SQL twin, or whose corners the tables do not reach."""

import random

from pyspark.sql import functions as F

from helixframe.functions import variants as vr
from helixframe.operators import calling as cl
from helixframe.operators import tracks as tk


def test_depth_limit_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(3), s, s + rng.randrange(1, 40)) for k in range(900) for s in [rng.randrange(400)]]
    found = {r.rid for r in tk.depth_limited(spark.createDataFrame(rows, "rid bigint, seqid int, s0 bigint, e0 bigint"), ["seqid"], 4).collect()}
    want, open_ends = set(), {}
    for rid, seqid, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        ends = open_ends[seqid] = [x for x in open_ends.get(seqid, []) if x > s]
        if len(ends) < 4:
            ends.append(e)
            want.add(rid)
    assert found == want and len(want) < 900


def test_effects_are_described_and_ordered(spark):
    text = "intron(MODIFIER|||||g1|||t1),stop(HIGH|NONSENSE|cga/tga|R1*||g%31),silent(LOW|SILENT|)"
    row = spark.range(1).select(vr.effects(F.lit(text)).alias("e"), F.size(vr.effects(F.lit(None).cast("string"))).alias("none")).first()
    assert [e.tags[0] for e in row.e] == ["stop", "silent", "intron"] and row.none == 0
    assert row.e[0].description == "stop Effect_Impact=HIGH Functional_Class=NONSENSE Codon_Change=cga/tga Amino_Acid_change=R1* Gene_Name=g1"
    assert row.e[0].tags == ["stop", "HIGH", "NONSENSE"] and row.e[2].tags == ["intron", "MODIFIER"]


def test_small_texts(spark):
    row = spark.range(1).select(
        vr.graphlet(F.array(*map(F.lit, [0, 1, 5, 10]))).alias("g"),
        vr.pretty_number(F.lit(1234567), 12).alias("n"),
        vr.equal_genotypes(F.array(F.lit(0)), F.array(F.lit(0), F.lit(0))).alias("same"),
        vr.equal_genotypes(F.array(F.lit(0), F.lit(1)), F.array(*map(F.lit, [0, 0, 1]))).alias("other"),
        vr.equal_genotypes(vr.genotype(F.lit(".")), F.array(F.lit(0))).alias("unknown"),
        vr.describe_counts(F.array(F.lit(1), F.lit(None).cast("int")), F.array(F.lit("A"), F.lit("C"))).alias("missing"),
    ).first()
    assert row.g == "_049" and row.n == "   1,234,567" and row.same and not row.other and not row.unknown and row.missing == ""


def test_trailing_mean_and_bias(spark):
    counts = [4, 0, 2]
    got = tk.trailing_mean(spark.createDataFrame([("a", "ACGTA", counts), ("b", "AC", [])], "name string, seq string, c array<int>"), F.col("c"), 3).collect()
    want = [sum(c) / len(c) for i in range(5) for c in [counts[max(0, i - 2) : min(3, i + 1)]]]
    assert {r.name: r.means for r in got} == {"a": want, "b": None}
    seq, depths = "ACGGTCA", [1, 2, 3, 4, 5, 6, 7]
    comp = str.maketrans("ACGT", "TGCA")
    sums = {}
    for i in range(7):
        kmer = "".join(seq[(i + j) % 7] for j in range(5))
        sums.setdefault(min(kmer, kmer[::-1].translate(comp)), []).append(depths[(i + 2) % 7])
    found = tk.kmer_bias(spark.createDataFrame([(seq, depths)], "seq string, depths array<int>"), 5).collect()
    assert {r.kmer: (r.n, r["mean"]) for r in found} == {k: (len(v), sum(v) / len(v)) for k, v in sums.items()}


def test_clip_summary_names_and_styles(spark):
    clips = spark.createDataFrame([("l", 10, 2, 8), ("l", 8, 0, 8), ("l", 5, 5, 5)], "lib string, length int, clip_start int, clip_end int")
    row = tk.clip_summary(clips, ["lib"]).first()
    assert (row.reads, row.kept, row.clipped_start, row.clipped_end) == (3, 2, 2, 1) and row.mean_after == round(14 / 3, 6)
    seqs = spark.createDataFrame([("a", "A"), ("b", "C")], "name string, seq string")
    assert tk.selected_names(seqs, ["b"]).count() == 1 and tk.selected_names(seqs, []).count() == 2
    feats = spark.createDataFrame([("g", "gene", 0, 9, 1, {"ID": "x"}), ("g", "gene", 1, 5, -1, {"n": "v"}), ("g", "CDS", 0, 3, 1, {})], "seqid string, typ string, s0 int, e0 int, strand int, attr map<string,string>")
    got = [r.attr for r in tk.styled(feats, "gene", "#f00").orderBy("s0").collect()]
    assert got[0] == {"ID": "x", "color": "#f00"} and got[1]["n"] == "v" and got[1]["ID"] and got[1]["color"] == "#f00"


def test_nexus_head_and_empty_inputs(spark):
    assert cl.nexus_head(["a", "b"], 5).startswith("#NEXUS\nbegin taxa;\ndimensions ntax=2;\ntaxlabels\na\nb\n;")
    assert tk.depth_limited(spark.createDataFrame([], "rid bigint, seqid int, s0 bigint, e0 bigint"), ["seqid"]).count() == 0
