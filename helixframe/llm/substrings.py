"""Exact removal of long substrings that occur more than once, by suffix arrays over shared-anchor groups.

A string of `length` bytes is judged by the place in it with the least hash of `GRAM` bytes, its anchor (leftmost
of ties): equal strings have equal anchors, so all copies of a string meet in the group of its anchor's hash. Within
a text an anchor owns a run of start positions, and start positions belong to one anchor each.

1. A narrow pass over the texts gives (anchor hash, hash of all bytes that the run's strings cover) for each anchor.
   Rows that agree in both are copies of each other: all their strings repeat. No text is moved for them. Rows of one
   text that agree are merged where they arise, so that a text of a short period gives a row and not one a period.
2. Where one anchor hash has several different surroundings, one row of each is a boundary case. Their bytes are
   fetched, dealt by anchor, and sorted as suffixes in two stages (see `suffixes`); neighbours in that order that
   share `length` bytes from their start positions are repeats.
3. An anchor with more than `hot` different surroundings is not gathered. Its strings are split into classes by the
   anchor's offset in them and dealt anew by the bytes that all strings of a class hold; equal rows are merged before
   the shuffle. Groups that are still hot are split again by narrower classes, the last of which is one string.
4. The covered bytes of each text are united and cut out.

Texts are known by a 64-bit hash and their length, so copies of a text share their result. Everything a task gathers
is bounded: `hot` surroundings of under 2 * length bytes, or one text.

Cases: a null or empty text has no bytes and keeps none; texts shorter than `length` are kept whole; overlapping
repeats in one text count; repeated ids give a row each (a repeated text is removed in
all its rows); very long texts are read in overlapping parts; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import map_batches, map_columns, slices, table, written
from helixframe.llm.suffixes import common_prefixes, suffix_array

NAME = "op9_substring_dedup"
LENGTH = 400
GRAM = 64
BATCH = 256 << 10
#: Offsets in a class, level by level, where an anchor is hot; each is a multiple of the next.
WIDTHS = (48, 8, 1)
CHUNK = 1 << 20
#: Most kinds of surroundings, and most texts, that are broadcast as frequent.
FREQUENT = 1000
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, factor in (("up", MULTIPLIER), ("down", INVERSE)):
            values = np.full(size, factor, dtype=np.uint64)
            values[0] = 1
            _powers[name] = np.cumprod(values, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of the `gram` bytes from each position on."""
    up, down = powers(len(text))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[text] * up, dtype=np.uint64)))
    h = (sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of its least one, leftmost of ties."""
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        take = value[step:] < value[:-step]
        value = np.where(take, value[step:], value[:-step])
        place = np.where(take, place[step:], place[:-step])
        size += step
    return place


def merged(rows: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Rows of `anchors`, each text's in order, with one row for all of a text that agree in anchor and surroundings.

    A further column counts what a row stands for. Strings of rows that agree repeat within their text: the runs that
    they cover follow as rows of count 0, united, whose anchor and surroundings say nothing.
    """
    codes, around, who, _, a, b = rows
    order = np.lexsort((around, codes, who))
    new = np.concatenate(([True], (np.diff(codes[order]) != 0) | (np.diff(around[order]) != 0) | (np.diff(who[order]) != 0)))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    one = order[starts]
    out = [*(x[one] for x in rows), sizes]
    again = np.sort(order[np.repeat(sizes > 1, sizes)])
    if not len(again):
        return out
    apart = (np.diff(who[again]) != 0) | (a[again[1:]] > b[again[:-1]] + length)
    first, last = again[np.concatenate(([True], apart))], again[np.concatenate((apart, [True]))]
    runs = [np.zeros_like(first), np.zeros_like(first), who[first], a[first], a[first], b[last], np.zeros_like(first)]
    return [np.concatenate(x) for x in zip(out, runs, strict=True)]


def anchors(texts: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """(anchor hash, surroundings hash, text number, place, first start, last start, count) over a few texts at once."""
    data, at, starts, owner, base = b"".join(texts), 0, [], [], []
    if len(data) < length:
        return []
    for k, text in enumerate(texts):
        if len(text) >= length:
            starts.append(np.arange(at, at + len(text) - length + 1, dtype=np.int64))
            owner.append((k, at))
        at += len(text)
    if not starts:
        return []
    h = gram_hashes(np.frombuffer(data, dtype=np.uint8), gram)
    valid = np.concatenate(starts)
    place = least_places(h, length - gram + 1)[valid]
    new = np.flatnonzero((np.diff(place) != 0) | (np.diff(valid) != 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(valid)])) - 1
    a, b, p = valid[first], valid[last], place[first].astype(np.int64)
    text_of = np.searchsorted([o[1] for o in owner], a, "right") - 1
    ids, begins = np.array([o[0] for o in owner]), np.array([o[1] for o in owner])
    codes = h[p].view(np.int64)
    a_list, b_list, p_list = a.tolist(), b.tolist(), p.tolist()
    around = [xxhash.xxh3_64_intdigest(data[x : y + length], z - x) for x, y, z in zip(a_list, b_list, p_list, strict=True)]
    base = begins[text_of]
    return merged([codes, np.array(around, dtype=np.uint64).view(np.int64), ids[text_of], p - base, a - base, b - base], length)


def key_of(data: bytes) -> int:
    """The same as Spark's xxhash64 of the text."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


ANCHOR = "anchor bigint, around bigint, key bigint, n int, p int, a int, b int, times int"


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per anchor and surroundings of every text, and the runs that several of one text cover (see `merged`)."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                few, size = [], 0
                for text in piece.column(0).to_pylist():
                    for at in range(0, max(1, len(text) - length + 1), CHUNK):
                        part = text if len(text) <= CHUNK else text[at : at + CHUNK + length - 1]
                        few.append((part, at, text))
                        size += len(part)
                        if size >= CHUNK:
                            yield from rows(few)
                            few, size = [], 0
                if few:
                    yield from rows(few)

    def rows(few):
        found = anchors([part for part, _, _ in few], length, gram)
        if found:
            codes, around, which, p, a, b, times = found
            keys = np.array([key_of(text) for _, _, text in few], dtype=np.int64)[which]
            sizes = np.array([len(text) for _, _, text in few], dtype=np.int32)[which]
            shift = np.array([at for _, at, _ in few], dtype=np.int64)[which]
            columns = [codes, around, keys, sizes, *((x + shift).astype(np.int32) for x in (p, a, b)), times.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "around", "key", "n", "p", "a", "b", "times"])

    return map_batches(docs.where(F.octet_length("text") >= length).select(F.col("text").cast("binary").alias("text")), run, ANCHOR)


def frequent_texts(docs: DataFrame, length: int) -> DataFrame:
    """(key, n) of the texts of `length` bytes or more that make up more than a FREQUENT-th part of all rows."""
    limit = max(1, docs.count() // FREQUENT)
    texts = docs.where(F.octet_length("text") >= length).groupBy(F.xxhash64("text").alias("key"), F.octet_length("text").alias("n"))
    return written(texts.agg(F.count("*").alias("copies")).where(F.col("copies") > limit).select("key", "n"))


def contexts(docs: DataFrame, cases: DataFrame, length: int, frequent: DataFrame) -> DataFrame:
    """Bytes of the boundary cases: (anchor, kinds, key, n, p, a, data); a text's copies give them once or more.

    Copies of a frequent text are merged before the shuffle."""
    wanted = cases.groupBy("key", "n").agg(F.collect_list(F.struct("anchor", "kinds", "p", "a", "b")).alias("cases"))
    texts = docs.where(F.octet_length("text") >= length).select(F.xxhash64("text").alias("key"), F.octet_length("text").alias("n"), F.col("text").cast("binary").alias("text"))
    once = texts.join(F.broadcast(frequent), ["key", "n"], "left_semi").groupBy("key", "n").agg(F.first("text").alias("text"))
    texts = texts.join(F.broadcast(frequent), ["key", "n"], "left_anti").unionByName(once)

    def run(batches):
        last = None
        for batch in batches:
            for piece in slices(batch):
                out = {k: [] for k in ("anchor", "kinds", "key", "n", "p", "a", "data")}
                for key, n, text, found in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if (key, n) == last:
                        continue
                    last = (key, n)
                    for case in found:
                        for name, value in zip(out, (case["anchor"], case["kinds"], key, n, case["p"], case["a"], text[case["a"] : case["b"] + length]), strict=True):
                            out[name].append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return map_batches(texts.join(wanted, ["key", "n"]).select("key", "n", "text", "cases"), run, "anchor bigint, kinds bigint, key bigint, n int, p int, a int, data binary")


def repeats(cases: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int, int]]:
    """(key, n, start, end) of the byte runs covered by strings that repeat among the cases (key, n, first start, bytes)."""
    data = b"".join(c[3] for c in cases)
    sizes = np.array([len(c[3]) for c in cases])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(cases)), sizes)
    offset = np.arange(len(data)) - begins[owner]
    order = suffix_array(data, length)
    order = order[offset[order] <= sizes[owner[order]] - length]
    # a place comes once: starts belong to one anchor each, and one row stands for all copies
    same = common_prefixes(data, order[:-1], order[1:], length) >= length
    hit = np.zeros(len(data), dtype=bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    places = np.flatnonzero(hit)
    if not len(places):
        return []
    new = np.flatnonzero((np.diff(places) != 1) | (np.diff(owner[places]) != 0)) + 1
    first, last = places[np.concatenate(([0], new))], places[np.concatenate((new, [len(places)])) - 1]
    who = owner[first].tolist()
    return [(cases[k][0], cases[k][1], cases[k][2] + x, cases[k][2] + y + length) for k, x, y in zip(who, offset[first].tolist(), offset[last].tolist(), strict=True)]


SPAN = "key bigint, n int, s int, e int"


def sorted_repeats(found: DataFrame, length: int) -> DataFrame:
    """Repeats among the surroundings of each anchor; several anchors share one suffix array of about BATCH bytes."""

    def run(batches):
        few, size, last = [], 0, None
        for batch in batches:
            for anchor, key, n, a, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and size >= BATCH:
                    yield from rows(few)
                    few, size = [], 0
                last = anchor
                few.append((key, n, a, data))
                size += len(data)
        yield from rows(few)

    def rows(few):
        if few and (spans := repeats(few, length)):
            columns = [pa.array(c, type=t) for c, t in zip(zip(*spans, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "s", "e"])

    return map_batches(found.select("anchor", "key", "n", "a", "data").repartition("anchor").sortWithinPartitions("anchor"), run, SPAN)


def classed(cases: DataFrame, length: int, width: int) -> DataFrame:
    """Splits cases (anchor, key, n, p, a, data) by the anchor's offset in their strings, `width` offsets a class.

    The strings of a class all hold certain bytes around the anchor, which with class and anchor make its group:
    equal strings stay together, and strings that differ there part. With a width of 1 a class is one string.
    """

    def run(anchor, key, n, p, a, data):
        out = {k: [] for k in ("anchor", "around", "key", "n", "p", "a", "data")}
        for group, text_key, size, at, first, text in zip(anchor, key, n, p, a, data, strict=True):
            last = first + len(text) - length
            for j in range((at - last) // width, (at - first) // width + 1):
                low, high = max(first, at - (j + 1) * width + 1), min(last, at - j * width)
                shared = text[at - j * width - first : at - (j + 1) * width + 1 + length - first]
                own = text[low - first : high - first + length]
                codes = (xxhash.xxh3_64_intdigest(shared, (group ^ j * MULTIPLIER) % (1 << 64)), xxhash.xxh3_64_intdigest(own, at - low))
                for name, value in zip(out, (*(h - (1 << 64) if h >> 63 else h for h in codes), text_key, size, at, low, own), strict=True):
                    out[name].append(value)
        return out

    return map_columns(cases.select("anchor", "key", "n", "p", "a", "data"), run, "anchor bigint, around bigint, key bigint, n int, p int, a int, data binary")


def of_several(kinds: DataFrame) -> DataFrame:
    """Adds to the kinds of anchors that have several of them their number, `kinds`.

    At most FREQUENT anchors have more than a FREQUENT-th part of all kinds; their numbers are broadcast.
    """
    limit = max(1, kinds.count() // FREQUENT)
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    frequent = F.broadcast(several.where(F.col("kinds") > limit))
    others = several.where(F.col("kinds").between(2, limit))
    return kinds.join(frequent, "anchor").unionByName(kinds.join(frequent, "anchor", "left_anti").join(others, "anchor"))


def refined_repeats(cases: DataFrame, length: int, hot: int, widths: tuple[int, ...]) -> DataFrame | None:
    """Repeats among cases of hot anchors, by ever narrower classes; None if there are no cases.

    Each level moves a few rows for each case that is still in a hot group, merges equal ones before the shuffle and
    sorts the groups that are no longer hot.
    """
    if not widths or cases.isEmpty():
        return None
    rows = written(classed(cases, length, widths[0]))
    kinds = written(rows.groupBy("anchor", "around").agg(F.count("*").alias("times"), F.min(F.struct("key", "n", "p", "a", "data")).alias("one")))
    copies = rows.select("anchor", "around", "key", "n", F.col("a").alias("s"), (F.col("a") + F.octet_length("data")).alias("e"))
    spans = copies.join(kinds.where("times > 1").select("anchor", "around"), ["anchor", "around"]).select("key", "n", "s", "e")
    if widths[0] > 1:
        left = written(of_several(kinds).select("anchor", "kinds", "one.*"))
        spans = spans.unionByName(sorted_repeats(left.where(F.col("kinds") <= hot), length))
        more = refined_repeats(left.where(F.col("kinds") > hot), length, hot, widths[1:])
        spans = spans if more is None else spans.unionByName(more)
    return spans


def repeated(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows whose (anchor, around) stands for several in `kinds` (anchor, around, times).

    At most FREQUENT kinds have more than their FREQUENT-th part of all rows; these are broadcast, so that the rows of
    a frequent kind stay where they are.
    """
    on = ["anchor", "around"]
    total = kinds.agg(F.sum("times")).first()[0] or 0
    limit = max(1, total // FREQUENT)
    frequent = F.broadcast(kinds.where(F.col("times") > limit).select(on))
    others = kinds.where(F.col("times").between(2, limit)).select(on)
    return rows.join(frequent, on, "left_semi").unionByName(rows.join(frequent, on, "left_anti").join(others, on, "left_semi"))


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 512, frequent: DataFrame | None = None) -> DataFrame:
    """(key, n, spans) of every text with repeated strings; `frequent` are its frequent texts, where they are known."""
    frequent = frequent_texts(docs, length) if frequent is None else frequent
    all_anchors = written(anchor_table(docs, length, gram))
    kinds = written(all_anchors.where("times > 0").groupBy("anchor", "around").agg(F.sum("times").alias("times"), F.min(F.struct("key", "n", "p", "a", "b")).alias("one")))
    copies = repeated(all_anchors.where("times = 1"), kinds).unionByName(all_anchors.where("times = 0"))
    copies = copies.select("key", "n", F.col("a").alias("s"), (F.col("b") + length).alias("e"))
    cases = of_several(kinds).select("anchor", "kinds", "one.*")
    found = written(contexts(docs, cases, length, frequent))
    spans = copies.unionByName(sorted_repeats(found.where(F.col("kinds") <= hot), length))
    more = refined_repeats(found.where(F.col("kinds") > hot), length, hot, WIDTHS)
    spans = spans if more is None else spans.unionByName(more)
    return spans.distinct().groupBy("key", "n").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union; spans that touch join."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document row: doc_id, its bytes, those kept, and the number removed."""
    frequent = frequent_texts(docs, length)
    spans = covered(docs, length, frequent=frequent)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumns({"key": F.xxhash64("text"), "n": F.octet_length("text")}).withColumn("text", F.col("text").cast("binary"))
    # every string of a text with copies repeats; such texts and short ones need no spans and are dealt by their ids
    texts = texts.join(F.broadcast(frequent.withColumn("copied", F.lit(True))), ["key", "n"], "left")
    alone = F.col("copied") | (F.col("n") < length)
    whole = F.when(F.col("copied"), F.array(F.struct(F.lit(0).alias("s"), F.col("n").alias("e")))).alias("whole")
    texts = texts.select("doc_id", "text", whole, F.when(alone, F.xxhash64("doc_id")).otherwise(F.col("key")).alias("key"), F.when(alone, -1).otherwise(F.col("n")).alias("n"))
    found = texts.join(spans, ["key", "n"], "left").select("doc_id", "text", F.coalesce("whole", "spans").alias("spans"))

    def run(ids, data, found):
        out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, spans in zip(data, found, strict=True):
            runs = united([(x["s"], x["e"]) for x in spans or ()])
            digest, at = hashlib.sha256(), 0
            for s, e in runs:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            for name, value in (("n_bytes", len(text)), ("n_removed", sum(e - s for s, e in runs)), ("n_spans", len(runs)), ("kept_sha256", digest.hexdigest())):
                out[name].append(value)
        return out

    return map_columns(found, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: repeated strings of 400 bytes cut from every document."""
    return cut(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
