"""Benchmark decontamination by a broadcast set of word n-grams.

Item and document texts are folded (A-Z to a-z) and cut into words; every run of `n` item words, or a whole item of
fewer, is a window. The windows go to the workers as a hash map from word-id tuples to items. A document's words are
mapped to item word ids at once; only stretches in which all words are known can hold a window, and each such place
is verified by the exact tuple.

The map grows with the benchmark only. Its size is checked first: beyond `block_bytes` of item text it is dealt into
blocks of that size. Blocks are fetched, shipped and scanned one after the other, each one's hits being written to the
shared folder before the next is fetched, so that neither the driver nor a worker ever holds more than one; the hits of
the blocks are then united per text.

Cases: an empty table of documents gives no rows; very long texts are scanned whole, a row at a time; of several items
with the same window all are named; a null or empty text has no words and no hit; a null item id counts as the empty string; items without words
have no window; repeated item ids are one item; repeated document rows give a row each; an empty benchmark gives
rows without hits. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import map_columns, map_rows, table, written

NAME = "op10_decontaminate"
WINDOW = 10
SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
FOLD = bytes(32 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


class Windows:
    """Windows of a block of items: word ids and, by length, the items of each id tuple."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            found = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words(text or b""))
            size = min(n, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                self.items.setdefault(size, {}).setdefault(found[i : i + size], set()).add(item)

    def scan(self, text: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, which of them are hit (None: none), and the items found."""
        found = words(text)
        items: set[str] = set()
        if not found or not self.items:
            return len(found), None, items
        get = self.ids.get
        known = np.array([get(w, 0) for w in found], dtype=np.int64)
        unknown = np.concatenate(([0], np.cumsum(known == 0)))
        hit = None
        for size, windows in self.items.items():
            if size > len(found):
                continue
            for i in np.flatnonzero(unknown[size:] == unknown[:-size]).tolist():
                got = windows.get(tuple(known[i : i + size].tolist()))
                if got:
                    items |= got
                    hit = np.zeros(len(found), dtype=bool) if hit is None else hit
                    hit[i : i + size] = True
        return len(found), hit, items


class Blocks:
    """The items, dealt by a hash of their text into blocks of about block_bytes at most, each fetched where it is used."""

    def __init__(self, benchmark: DataFrame, n: int, block_bytes: int):
        self.items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
        size = self.items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.n, self.count = n, max(1, -(-size // block_bytes))

    def windows(self, k: int) -> Windows:
        part = self.items if self.count == 1 else self.items.where(F.pmod(F.xxhash64("text"), F.lit(self.count)) == k)
        return Windows([(r.item_id, bytes(r.text)) for r in part.collect()], self.n)


def block_hits(docs: DataFrame, blocks: Blocks) -> DataFrame:
    """(key, bytes, hits, items) of every text with a hit: its hash and size, the hit words and the items of all blocks."""

    def scan(k: int) -> DataFrame:
        windows = blocks.windows(k)

        def run(keys, texts):
            out = {"key": [], "bytes": [], "hits": [], "items": []}
            for key, text in zip(keys, texts, strict=True):
                _, hit, items = windows.scan(text)
                if hit is not None:
                    for name, value in (("key", key), ("bytes", len(text)), ("hits", np.flatnonzero(hit).tolist()), ("items", sorted(items))):
                        out[name].append(value)
            return out

        texts = docs.where("text is not null").select(F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
        return written(map_columns(texts, run, "key bigint, bytes int, hits array<int>, items array<string>").dropDuplicates(["key", "bytes"]))

    found = reduce(DataFrame.unionByName, [scan(k) for k in range(blocks.count)])
    return found.groupBy("key", "bytes").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _row(out: dict, i, n: int, n_hit: int, items: set[str]) -> None:
    for k, v in (("doc_id", i), ("n_words", n), ("n_hit", n_hit), ("n_items", len(items)), ("items_sha256", hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()), ("contaminated", n_hit > 0)):
        out.setdefault(k, []).append(v)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document row: words, words hit, items found."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = Blocks(benchmark, n, block_bytes)
    if blocks.count == 1:
        windows = blocks.windows(0)

        def run(ids, texts):
            out = {k: [] for k in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
            for i, text in zip(ids, texts, strict=True):
                total, hit, items = windows.scan(text or b"")
                _row(out, i, total, 0 if hit is None else int(hit.sum()), items)
            return out

        return map_columns(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, SCHEMA)
    counted = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.col("text").cast("binary").alias("text"))
    counted = map_columns(counted, lambda i, key, size, texts: {"doc_id": i, "key": key, "bytes": size, "n_words": [len(words(t or b"")) for t in texts]}, "doc_id bigint, key bigint, bytes int, n_words bigint")
    none, nothing = F.array().cast("array<int>"), F.array().cast("array<string>")
    rows = counted.join(block_hits(docs, blocks), ["key", "bytes"], "left").withColumns({"hits": F.coalesce("hits", none), "items": F.array_sort(F.coalesce("items", nothing))})
    return rows.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def without(data: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words, from the first one's start of each stretch to the last one's end, nor the spaces before."""
    places = [m.span() for m in WORD.finditer(data.translate(LOWER))]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    pieces, at = [], 0
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        pieces.append(data[at : places[first][0]].rstrip(b" "))
        at = places[last - 1][1]
    return b"".join([*pieces, data[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most_share: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """docs without contaminated words: documents with more than most_share of their words hit go, from the others the hit
    stretches are cut (from the first hit word's start to the last one's end, with the white space before it), until no
    window is left: what a cut brings together is scanned again.

    Cases: null and empty texts stay as they are; n_chars, where docs has it, follows the text and a null one stays null;
    repeated rows are each cut; other columns are kept; an empty benchmark changes nothing; an empty table stays empty. A
    benchmark of several blocks takes a round of jobs over the texts with hits for each cut.
    """
    fields, blocks = docs.schema, Blocks(benchmark, n, block_bytes)

    def kept(columns, cut):
        out = dict(zip(fields.names, columns, strict=True))
        keep, texts = [], list(out["text"])
        for k, text in enumerate(texts):
            data = (text or "").encode()
            now = cut(k, data)
            if now is not None:
                keep.append(k)
                if len(now) < len(data):
                    texts[k] = now.decode()
        out["text"] = texts
        if "n_chars" in out:
            out["n_chars"] = [c if t is None else len(t) for c, t in zip(out["n_chars"], texts, strict=True)]
        return {name: [values[k] for k in keep] for name, values in out.items()}

    if blocks.count == 1:
        windows = blocks.windows(0)

        def clean(_, data: bytes) -> bytes | None:
            while (hit := windows.scan(data)[1]) is not None:
                if hit.mean() > most_share:
                    return None
                data = without(data, hit)
            return data

        return map_rows(docs, lambda *columns: kept(columns, clean), fields)

    def once(*columns):
        *columns, hits = columns

        def cut(k, data):
            if not hits[k]:
                return data
            hit = np.zeros(len(words(data)), dtype=bool)
            hit[hits[k]] = True
            return None if hit.mean() > most_share else without(data, hit)

        return kept(columns, cut)

    done, todo = [], docs
    while True:
        marked = todo.withColumns({"_key": F.xxhash64("text"), "_bytes": F.octet_length("text")})
        hits = block_hits(todo, blocks).select(F.col("key").alias("_key"), F.col("bytes").alias("_bytes"), F.col("hits").alias("_hits"))
        joined = written(marked.join(hits, ["_key", "_bytes"], "left").select(*fields.names, "_hits"))
        done.append(joined.where("_hits is null").drop("_hits"))
        todo = joined.where("_hits is not null")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = written(map_rows(todo, once, fields))


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: benchmark windows in every document."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(cast(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.rid, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
