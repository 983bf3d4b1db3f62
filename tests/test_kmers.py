"""K-mers in batches: whole and right on long sequences, names that repeat and letters that are no bases."""

import random
from collections import Counter
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.operators import kmers as km
from helixframe.operators import reads as rd
from helixframe.operators import tracks as tk

SF = "/root/testdata/sf0.001"
TURN = str.maketrans("ACGT", "TGCA")


def canonical(kmer):
    return min(kmer, kmer[::-1].translate(TURN))


def kmers(seq, k):
    return [canonical(seq[i : i + k]) for i in range(len(seq) - k + 1) if set(seq[i : i + k]) <= set("ACGT")]


@pytest.fixture(scope="module")
def given():
    rng = random.Random(5)
    text = lambda n, of="ACGT": "".join(rng.choices(of, k=n))
    return [("a", text(300)), ("b", text(200, "ACGTN")), ("a", text(100)), ("c", "ACG"), ("d", None), ("e", ""), ("f", text(60) + "é" + text(60)), (None, text(30)), (None, text(30))]


def frame(spark, given):
    return spark.createDataFrame(given, "name string, seq string")


@pytest.mark.parametrize("piece", [97, km.PIECE])
@pytest.mark.parametrize("k", [3, 9, 13, 25])
def test_counts_postings_and_depth(spark, given, monkeypatch, k, piece):
    monkeypatch.setattr(km, "PIECE", piece)
    seqs = frame(spark, given).coalesce(1)
    by = {}
    for name, seq in given:
        by.setdefault(name, []).extend(kmers(seq or "", k))
    whole = Counter(x for v in by.values() for x in v)
    counts = rd.count_kmers(seqs, k)
    assert {r.kmer: r.n for r in counts.collect()} == whole
    assert sorted((str(r.name), r.kmer, r.n) for r in rd.postings(seqs, k).collect()) == sorted((str(n), x, c) for n, v in by.items() for x, c in Counter(v).items())
    bag = counts.where("n > 1")
    found = {r.name: (round(r.present, 4), round(r["mean"], 4), r.median, r.least, r.most) for r in rd.kmer_depth(seqs, bag, k).collect()}
    of = lambda v: [whole[x] if whole[x] > 1 else 0 for x in v]
    assert found == {n: (round(100 * mean(x > 0 for x in of(v)), 4), round(mean(of(v)), 4), median(of(v)), min(of(v)), max(of(v))) for n, v in by.items() if v}


@pytest.mark.parametrize("k", [1, 4, 12])
def test_longest_runs_of_good_kmers(spark, k):
    rng = random.Random(6)
    given = [(str(i), "".join(rng.choices("ACGTacgtN", weights=[9, 3, 9, 3, 1, 1, 1, 1, 1], k=rng.randrange(0, 90)))) for i in range(40)]
    seen = sorted({x for _, s in given for x in kmers(s.upper(), k)})
    good = set(seen[:: 2 if k > 1 else 1])
    want = {}
    for name, seq in given:
        marks = [canonical(seq[i : i + k].upper()) in good and set(seq[i : i + k].upper()) <= set("ACGT") for i in range(len(seq) - k + 1)]
        runs = [(n, -i) for i in range(len(marks)) for n in [next((j for j in range(len(marks) - i) if not marks[i + j]), len(marks) - i)] if n]
        size, start = max(runs, default=(0, 0))
        want[name] = seq[-start : -start + size + k - 1] if size else ""
    found = tk.clean_runs(spark.createDataFrame(given, "name string, seq string"), spark.createDataFrame([(x,) for x in sorted(good)], "kmer string"), k)
    assert {r.name: r.seq for r in found.collect()} == want


@pytest.mark.parametrize("k", [5, 12])
def test_bias_of_odd_letters_and_short_depths(spark, k):
    rng = random.Random(7)
    rows = [("".join(rng.choices(of, k=n)), [rng.choice([None, 1, 2, 3]) for _ in range(m)] if m else None) for of, n, m in (("ACGT", 70, 70), ("ACGTNaé", 60, 60), ("ACGT", 50, 20), ("ACGT", 40, 0), ("ACGT", 4, 4), ("ACGT", 90, 95))]
    letters = str.maketrans("ACGTNa", "TGCANt")
    cells = {}
    for seq, own in rows:
        for i in range(len(seq) if len(seq) >= k else 0):
            kmer, at = (seq + seq[: k - 1])[i : i + k], (i + k // 2) % len(seq)
            cells.setdefault(min(kmer, kmer[::-1].translate(letters)), []).append(own[at] if own and at < len(own) else None)
    found = {r.kmer: (r.n, r["mean"]) for r in tk.kmer_bias(spark.createDataFrame(rows, "seq string, depths array<int>").coalesce(1), k).collect()}
    known = {x: [d for d in v if d is not None] for x, v in cells.items()}
    assert found == {x: (len(v), mean(known[x]) if known[x] else None) for x, v in cells.items()}


def test_bias_of_one_long_sequence_is_linear(spark):
    seqs = spark.range(1).select(F.repeat(F.lit("ACGGTCATTG"), 200_000).alias("seq"))
    found = tk.kmer_bias(seqs.withColumn("depths", F.array_repeat(F.lit(2), 2_000_000)), 5).collect()
    assert sum(r.n for r in found) == 2_000_000 and {r["mean"] for r in found} == {2.0}


@pytest.mark.parametrize("name", ["clean_runs", "kmer_bias", "kmer_postings", "kmer_depth", "kmer_stats"])
def test_no_row_is_made_of_each_base(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "explode(" not in plan


def test_slices_of_short_texts_equal_their_sql(spark, tmp_path):
    import duckdb

    texts = [(i, "ACGTACGTACGT"[: i % 9], "en", "s", 9) for i in range(200)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = sorted((r.doc_id, r.slice) for r in catalog.queries()["padded_slices"](spark, str(tmp_path)).collect())
    assert found == sorted(con.sql(catalog.oracle_sql()["padded_slices"]).fetchall())
