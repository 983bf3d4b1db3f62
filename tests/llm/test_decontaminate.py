"""Hits against DuckDB and plain Python; blocks of the benchmark against one."""

import hashlib
import random
import re

import duckdb

from helixframe.llm import decontaminate
from helixframe.llm.common import table
from tests.llm.common import SF, documents, edge_texts, sf_folder, with_clash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(given, items):
    out = []
    for i, text in given:
        found, hit, names = words(text), set(), set()
        for name, item in items:
            own = words(item)
            n = min(10, len(own))
            for a in range(len(own) - n + 1 if n else 0):
                for b in range(len(found) - n + 1):
                    if found[b : b + n] == own[a : a + n]:
                        hit.update(range(b, b + n))
                        names.add("" if name is None else str(name))
        out.append((i, len(found), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = sorted(con.sql(decontaminate.ORACLE_SQL).fetchall(), key=str)
    assert rows(decontaminate.query(spark, SF)) == want
    assert sum(r[5] for r in want) > 0


TEXTS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "x ONE-two'three four five six seven eight nine ten; y"), (3, "short item here"), (4, "a short, item HERE and here short item"), (5, None), (6, ""), (None, "short item here"), (7, "É one"), (7, "É one")]
ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, " ... "), (None, "item here"), (2, "item here"), (10, "two three four five six seven eight nine ten eleven twelve")]


def test_small(spark):
    docs, items = documents(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = brute(TEXTS, ITEMS)
    assert rows(decontaminate.decontaminate(docs, items)) == want
    assert rows(decontaminate.decontaminate(docs, items, block_bytes=20)) == want


def test_edges(spark, tmp_path):
    given = edge_texts()
    sf = sf_folder(spark, tmp_path, documents=with_clash(documents(spark, given)), benchmark=with_clash(spark.createDataFrame([(1, "word"), (2, "aaaa aaaa"), (3, "zero")], "item_id bigint, text string")))
    assert rows(decontaminate.query(spark, sf)) == brute(given, [(1, "word"), (2, "aaaa aaaa"), (3, "zero")])
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.contaminated for r in decontaminate.decontaminate(documents(spark, given), empty).collect()} == {False}
    assert decontaminate.decontaminate(documents(spark, given).limit(0), empty).count() == 0


def test_remove_spans(spark):
    item = "one two three four five six seven eight nine ten"
    docs = documents(spark, [(1, f"before the passage stand these eight words here, {item} and after it some more words follow"), (2, item), (3, "clean text"), (4, None)])
    got = {r.doc_id: r for r in decontaminate.remove_spans(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1].text == "before the passage stand these eight words here, and after it some more words follow" and got[1].n_chars == len(got[1].text)
    assert got[3].text == "clean text" and got[4].text is None


def test_remove_spans_block_by_block_gives_the_same(spark):
    items = [(k, " ".join(f"w{(3 * k + j) % 40}" for j in range(10 + k % 3))) for k in range(12)] + [(50, "p q"), (51, "r s")]
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice([rng.choice(items)[1], "clean words", "p r s q", "z"]) for _ in range(8))) for k in range(60)]
    docs = documents(spark, [*texts, (60, None), (61, ""), (0, texts[0][1]), (None, "p q and many clean words stand here")])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = decontaminate.remove_spans(docs, bench)
    assert rows(decontaminate.remove_spans(docs, bench, block_bytes=120)) == rows(whole)
    left = whole.collect()
    assert 5 < len(left) < 64 and not any(x[5] for x in brute([(r.doc_id, r.text) for r in left], items))
    assert decontaminate.remove_spans(docs.limit(0), bench, block_bytes=120).count() == 0
