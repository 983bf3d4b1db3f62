"""Operators that deal to blocks or batches: whole and right over the blocks' ends and on odd rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.functions import seq as sq
from helixframe.operators import consensus as cs
from helixframe.operators import fragments as fr
from helixframe.operators import graph
from helixframe.operators import intervals as iv
from helixframe.operators import reads as rd
from helixframe.operators import tracks as tk
from helixframe.operators import variants as vr

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [8, 1 << 14])
def test_best_cover_over_blocks_and_of_one_name_twice(spark, block):
    rng = random.Random(8)
    rows = [(rng.choice(["x", None]), s, s + rng.choice([0, 3, 7, 40]), rng.randrange(5), rng.randrange(60)) for _ in range(90) for s in [rng.randrange(-30, 300)]] + [("y", 0, 5, 1, 1), ("y", 9, 12, 1, 1)]
    best = {}
    for key, s, e, score, rid in rows:
        for p in range(s, e):
            best[key, p] = min(best.get((key, p), (9, 0)), (-score, rid))
    want = Counter()
    for key, p in sorted(best, key=str):
        if best.get((key, p - 1), (0, None))[1] != best[key, p][1]:
            n = next(j for j in range(1, 999) if best.get((key, p + j), (0, None))[1] != best[key, p][1])
            want[str(key), p, n, best[key, p][1]] += 1
    given = spark.createDataFrame(rows, "k string, s0 bigint, e0 bigint, score bigint, rid bigint")
    assert Counter((str(r.k), r["first"], r.n, r.rid) for r in vr.best_cover(given, ["k"], "rid", block).collect()) == want
    named = vr.best_cover(given.withColumn("rid", F.format_string("%03d", "rid")), ["k"], "rid", block)
    assert Counter((str(r.k), r["first"], r.n, int(r.rid)) for r in named.collect()) == want


@pytest.mark.parametrize("block", [4, 1 << 14])
@pytest.mark.parametrize("trim", [0, 2])
def test_pile_up_over_blocks_and_of_odd_rows(spark, block, trim):
    rng = random.Random(9)
    cigars = ["5M", "3S10M2I5M1D4M", "2I4M3N4M1I", "4=1X2P3M2H", "1M", "9D", "", None]
    rows = [(rng.choice([1, None]), s, rng.choice(cigars), rng.choice(["".join(rng.choices("ACGTN", k=rng.randrange(0, 30))), "ACGTéCGTACGTACGTAACCGGTTAC", None])) for _ in range(200) for s in [rng.randrange(0, 60)]]
    want = Counter()
    for key, s, cigar, text in rows:
        ops = re.findall("([0-9]+)([MIDNSHP=X])", cigar or "")
        length, ref, read = sum(int(n) for n, op in ops if op in "MDNP=X"), 0, 0
        for n, op in ((int(n), op) for n, op in ops):
            if op == "I" and trim < ref <= length - trim:
                want[key, s + ref, True, None if text is None else text[read : read + n]] += 1
            for j in range(n if op in "M=XD" else 0):
                if trim <= ref + j < length - trim:
                    want[key, s + ref + j, False, "-" if op == "D" else None if text is None else text[read + j : read + j + 1]] += 1
            ref, read = ref + n * (op in "MDNP=X"), read + n * (op in "MIS=X")
    found = cs.pile_up(spark.createDataFrame(rows, "k int, s0 bigint, cigar string, seq string"), ["k"], trim, block)
    assert {(r.k, r.pos, r.is_insertion, r.item): r.n for r in found.collect()} == want


def test_crosstalk_of_both_strands_over_blocks(spark):
    rows = [("a", 1, 0, 10), ("a", -1, 5, 20), ("a", 1, 5, 5), ("b", -1, 3, 9), ("c", 0, 2, 4)]
    want = {("a", 1, 0, 5): 1.0, ("a", 1, 5, 10): 0.75, ("a", 1, 10, 20): 0.0, ("a", -1, 0, 5): 0.0, ("a", -1, 5, 10): 0.75, ("a", -1, 10, 20): 1.0, ("b", 1, 3, 9): 0.0, ("b", -1, 3, 9): 1.0, ("c", 0, 2, 4): 0.75}
    given = spark.createDataFrame(rows, "k string, strand int, s0 bigint, e0 bigint")
    for block in (4, 1 << 16):
        assert {(r.k, r.strand, r.start, r.end): r.depth for r in iv.crosstalk_runs(given, ["k"], 0.25, block).collect()} == want


@pytest.mark.parametrize("name,most", [("depth_runs", 4), ("crosstalk_depth", 5)])
def test_runs_take_one_pass(spark, name, most):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= most


@pytest.mark.parametrize("whole", [True, False])
def test_good_runs_of_texts(spark, whole):
    rng = random.Random(10)
    text = lambda of, n: "".join(rng.choices(of, k=n))
    rows = [(i, text("ACGTN" if i % 3 or whole else "ACé", n), text("IIII#", n if i % 5 or whole else n + 3)) for i in range(60) for n in [rng.randrange(0, 40)]]
    rows += [(90, None, "III"), (91, "ACG", None)]
    found = spark.createDataFrame(rows, "i int, seq string, qual string").select("i", rd.good_run(F.col("seq"), F.col("qual"), F.lit(43), 3, 2).alias("r")).collect()
    by = {r.i: None if r.r is None else tuple(r.r) for r in found}
    for i, b, q in rows:
        if b is None or q is None:
            assert by[i] is None
            continue
        marks = [q[j] == "I" and j < len(b) and b[j] in "ACGT" and 3 <= j < len(q) - 2 for j in range(len(q))]
        runs = [(n, -j) for j in range(len(marks)) for n in [next((x for x in range(len(marks) - j) if not marks[j + x]), len(marks) - j)] if n]
        size, start = max(runs, default=(0, -3))
        assert by[i] == (-start, size), (i, b, q)


def test_trailing_means_of_null_and_empty_lists(spark):
    given = spark.createDataFrame([("a", [1.0, 2.0, None, 4.0]), ("b", []), ("c", None), ("d", [3.0])], "name string, c array<double>").coalesce(1)
    assert {r.name: r.means for r in tk.trailing_mean(given, F.col("c"), 2).collect()} == {"a": [1.0, 1.5, None, None, 4.0], "b": None, "c": None, "d": [3.0, 3.0]}


def test_kmers_are_cut_between_other_letters_without_a_search_in_each(spark):
    row = spark.range(1).select(sq.kmers(F.lit("ACNGTAéACG"), 3).alias("k"), sq.kmers(F.lit(None).cast("string"), 3).alias("n"), sq.kmers_to_sequence(F.array().cast("array<string>")).alias("e")).first()
    assert row.k == ["GTA", "ACG"] and row.n == [] and row.e is None
    plan = catalog.queries()["kmers_joined"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()


@pytest.mark.parametrize("name", ["clipped_reads", "clip_summaries", "trailing_means", "best_cover", "pile_up", "longest_good_runs"])
def test_no_structure_is_made_of_each_base(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan or "MapInArrow" in plan


def test_reach_looks_into_the_last_two_steps_alone(spark, monkeypatch):
    kept, stash = [], graph.stash
    monkeypatch.setattr(graph, "stash", lambda df: kept.append(stash(df)) or kept[-1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(3, 20), (20, 5), (4, 4)], "a bigint, b bigint")
    found = graph.reachable(edges, spark.createDataFrame([(4,), (99,)], "node bigint")).collect()
    assert {r.node: r.distance for r in found} == {4: 0, 99: 0, 3: 1, 5: 1, 2: 2, 6: 2, 20: 2, 1: 3, 7: 3, 0: 4, 8: 4, 9: 5}
    assert sum(df.count() for df in kept[1:]) == len(found)


def test_hits_meet_each_feature_once_and_pairs_are_not_all_compared(spark):
    hits = [(1, 1, 0, 5, 9, 1, 7, "A")] * 2 + [(1, 1, 1, 5, 9, 1, 7, "A"), (2, 1, 0, 8, 30, -1, 7, None), (2, 1, 0, 8, 30, -1, 7, None)]
    feats = [("f", 0, 0, 6, 1), ("g", 0, 0, 6, 1), ("g", 0, 7, 20, 1), ("g", 1, 0, 9, 1), ("h", 0, 8, 9, None), ("i", 0, 8, 25, -1), ("i", 0, 9, 10, -1), (None, 0, 0, 40, 0)]
    given = spark.createDataFrame(hits, "rid int, qname int, seqid int, s0 bigint, e0 bigint, strand int, score int, sample string"), spark.createDataFrame(feats, "fid string, seqid int, s0 bigint, e0 bigint, strand int")
    found = Counter((r.rid, r.s0, r.sample, r.fid, r.rel) for r in fr.feature_hits(*given).collect())
    want = {(i, s, x, f, st * (fs or 1)) for i, _, q, s, e, st, _, x in hits for f, fq, a, b, fs in feats if q == fq and a < e and s < b}
    assert set(found) == want and set(found.values()) == {1}
    plan = fr.feature_hits(*given)._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate") and "Union" in plan
