"""Suffix arrays and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import substrings
from helixframe.llm.common import table
from helixframe.llm.suffixes import common_prefixes, suffix_array
from tests.llm.common import SF, documents, edge_texts, sf_folder, with_clash


def brute(given, length):
    """Counts of every string of `length` bytes over all rows; the covered bytes of each row."""
    texts = [(i, (t or "").encode()) for i, t in given]
    times = Counter()
    for _, data in texts:
        times.update(hash(data[k : k + length]) for k in range(len(data) - length + 1))
    out = []
    for i, data in texts:
        cover = np.zeros(len(data) + 1, dtype=np.int64)
        for k in range(len(data) - length + 1):
            if times[hash(data[k : k + length])] > 1:
                cover[k] += 1
                if k + length < len(cover):
                    cover[k + length] -= 1
        gone = np.cumsum(cover[: len(data)]) > 0 if len(data) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int(((~np.concatenate(([False], gone[:-1]))) & gone).sum()) if len(data) else 0
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark):
    given = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert rows(substrings.query(spark, SF)) == brute(given, 400)


def pieces(rng):
    """Texts that share passages, also within one text, at other offsets and of other lengths."""
    shared = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(300, 1500))) for _ in range(6)]
    out = []
    for k in range(70):
        parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 900)))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a : a + rng.randrange(100, len(s))], "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 60)))]
        out.append((k, "".join(parts)))
    return out


def test_random_texts_and_hot_anchors(spark):
    rng = random.Random(8)
    given = pieces(rng)
    assert rows(substrings.cut(documents(spark, given))) == brute(given, 400)
    hot = substrings.covered(documents(spark, given), hot=1).collect()
    plain = substrings.covered(documents(spark, given)).collect()
    key = lambda found: sorted((r.key, r.n, tuple(substrings.united([(s.s, s.e) for s in r.spans]))) for r in found)
    assert key(hot) == key(plain)


def test_chunks_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    given = pieces(rng)
    found = []
    for text in (t.encode() for _, t in given):
        whole = substrings.anchors([text], 400, 64)
        if whole:
            found.append(len(whole[0]))
    assert sum(found) > 100
    passage = "".join(rng.choice("abcdefghijkl ") for _ in range(3000))
    filler = lambda n: "".join(rng.choice("mnopqrst ") for _ in range(n))
    big = [(1, filler(substrings.CHUNK - 1000) + passage + filler(5000)), (2, passage[500:2500])]
    got = {r.doc_id: r.n_removed for r in substrings.cut(documents(spark, big)).collect()}
    assert got == {1: 2000, 2: 2000}


def test_rows_of_short_periods(spark):
    """A text of a short period gives two rows, not one a period, so that such texts fill no group."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(450)
    given = [(k, "of the " * (400 + k)) for k in range(20)] + [(30, "of the " * 400), (31, "and " * 99), (32, "and " * 101), (33, None)]
    given += [(40, passage + noise(500) + passage + noise(300) + passage), (41, noise(20) + passage), (42, noise(200) + "of the " * 90 + noise(700) + "of the " * 60 + noise(9)), (43, noise(3000))]
    assert rows(substrings.cut(documents(spark, given))) == brute(given, 400)
    hot = substrings.covered(documents(spark, given), hot=1).collect()
    plain = substrings.covered(documents(spark, given)).collect()
    key = lambda found: sorted((r.key, r.n, tuple(substrings.united([(s.s, s.e) for s in r.spans]))) for r in found)
    assert key(hot) == key(plain)
    found = substrings.anchor_table(documents(spark, given[:20]), 400, 64).groupBy("key").count().collect()
    assert len(found) == 20 and max(r["count"] for r in found) <= 4


def test_rows_of_frequent_kinds_stay_apart(spark, monkeypatch):
    """The rows of a frequent kind are not dealt to one task; every repeated row is found, none else."""
    given = [(1, 1, k) for k in range(3000)] + [(2, k, k) for k in range(500)] + [(3 + k % 900, 5, k) for k in range(2700)] + [(5000 + k, 5, k) for k in range(40)]
    rows = spark.createDataFrame(given, "anchor bigint, around bigint, key bigint").repartition(8, "key")
    kinds = rows.groupBy("anchor", "around").agg(F.count("*").alias("times"))
    times = Counter(g[:2] for g in given)
    for most in (1000, 10, 1):
        monkeypatch.setattr(substrings, "FREQUENT", most)
        found = substrings.repeated(rows, kinds).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r[:3] for r in found) == sorted(g for g in given if times[g[:2]] > 1)
        if most > 1:
            assert max(Counter(r["task"] for r in found if r["anchor"] == 1).values()) < 1000
    assert substrings.repeated(rows.limit(0), kinds.limit(0)).count() == 0


def test_kinds_of_one_anchor_stay_apart(spark, monkeypatch):
    """The many kinds of one anchor are not dealt to one task for their number."""
    given = [(1, k) for k in range(3000)] + [(2 + k, 0) for k in range(500)] + [(1000 + k // 3, k) for k in range(2700)]
    kinds = spark.createDataFrame(given, "anchor bigint, around bigint").repartition(8, "around")
    times = Counter(g[0] for g in given)
    for most in (1000, 10, 1):
        monkeypatch.setattr(substrings, "FREQUENT", most)
        found = substrings.of_several(kinds).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r["anchor"], r["around"], r["kinds"]) for r in found) == sorted((a, b, times[a]) for a, b in given if times[a] > 1)
        if most > 1:
            assert max(Counter(r["task"] for r in found if r["anchor"] == 1).values()) < 1000


def test_copies_of_frequent_texts_stay_apart(spark, monkeypatch):
    """Copies of one text and empty texts are not dealt to one task, and lose what they lose otherwise."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    text = noise(1500)
    given = [(k, text) for k in range(300)] + [(1000 + k, "") for k in range(300)] + [(2000, text[:900] + noise(400)), (2001, noise(30) + text[700:]), (2002, noise(900)), (2003, text[:399]), (2004, None)]
    given += [(3000 + k // 2, t) for k, t in enumerate(t for t in (noise(420), noise(500)) for _ in range(2))]
    docs = documents(spark, given).repartition(8)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for most in (1000, 2, 1):
        monkeypatch.setattr(substrings, "FREQUENT", most, raising=False)
        before = {k: spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            found = substrings.cut(docs).withColumn("task", F.spark_partition_id()).collect()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert sorted((tuple(r)[:5] for r in found), key=str) == brute(given, 400)
        if most > 2:
            for low in (0, 1000):
                assert max(Counter(r["task"] for r in found if low <= r["doc_id"] < low + 1000).values()) < 200


def test_edges(spark, tmp_path):
    given = [(i, t if t is None or len(t) < 30_000 else t[:30_000]) for i, t in edge_texts()]
    sf = sf_folder(spark, tmp_path, documents=with_clash(documents(spark, given)))
    assert rows(substrings.query(spark, sf)) == brute(given, 400)
    assert substrings.cut(documents(spark, given).limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(10)
    for alphabet in (b"ab", b"abcdef", bytes(range(256)), b"a"):
        for n in (0, 1, 2, 17, 300):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            order = suffix_array(data, n).tolist()
            assert order == sorted(range(n), key=lambda k: data[k:])
            if n > 1:
                got = common_prefixes(data, np.array(order[:-1]), np.array(order[1:]), 24)
                for a, b, m in zip(order, order[1:], got, strict=False):
                    x = 0
                    while x < 24 and a + x < n and b + x < n and data[a + x] == data[b + x]:
                        x += 1
                    assert m == x
