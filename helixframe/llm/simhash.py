"""Near-duplicate classes by SimHash, found through a segment-popcount embedding.

Fingerprints: 64 bits by majority over the XXH64 of every word shingle.

Search: a fingerprint is cut into 32 segments of two bits; its embedding is the vector of their bit counts. The
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. The embedding is kept in
unary code, two bits a segment, so that the Manhattan distance is the popcount of a difference.

Grid: the segments form `groups` groups. Fingerprints within `distance` bits have embeddings within that Manhattan
distance, so at least groups - distance of their groups agree entirely. A grid cell is a choice of that many groups
with their count vectors; every distinct fingerprint is put in one cell for each choice, and the join looks in each
cell alone: first the lower bound by Manhattan distance, then the exact bits. No link is lost, and a cell gives a
spanning forest of its links rather than all pairs, so groups of many close fingerprints stay linear in output.

More groups make cells finer (8 groups: 70 cells for each fingerprint of 24 bits' entropy; 10 groups: 210 of 29 bits).

A cell of more than `hot` rows is not compared where it was gathered: its rows pass on as they come, are dealt into
blocks by hash, and each pair of blocks is a task's unit of its own, so that a unit holds about `hot` rows at most and no
link is lost. What a unit gives is a star for each of its linked sets.

Near copies (`one_of_each`): 256 bits a text in four words, linked within 48 bits, which a Jaccard similarity of 0.8 has
in 95 of 100 pairs (a pair of similarity J differs in a share acos(2J / (1 + J)) / pi of its bits, 39 of 256 at 0.8). An
exact grid for so many bits would need binomially many cells a row; instead a cell is a choice of `k` one-bit segments
and their counts, of `tables` random choices. k grows with the logarithm of the number n of fingerprints, so that a cell
holds about 128 rows, and the number of tables is what a pair of similarity 0.8 needs to share a cell with probability
1 - `missed`: about n ** 0.24 of them (14 at 5e4, 20 at 2e5, 152 at 1e9, 295 at 1e10). The bound by Manhattan distance is
the count of the first word's differences, and the exact 256 bits decide.

Copies: only distinct fingerprints enter the search; documents join their class by fingerprint, after aggregation.

Cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other (one_of_each
keeps them all); fewer words than a shingle are one shingle; very long texts are hashed in slices; a bit set in exactly
half the shingles is 0; a row with a null id is in its class but never names it (a class of null ids only has a null
component_id); repeated rows give a row each; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import map_columns, stash, table
from helixframe.operators.graph import connected

NAME = "op5_simhash_dedup"
ORACLE_SQL = None
EVEN = 0x5555555555555555


def shingles(data: bytes, shingle: int) -> tuple[Iterator[bytes], int]:
    """The folded shingles of a text in UTF-8 and their number."""
    words = data.lower().split()
    if not words:
        return iter(()), 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    size = min(shingle, len(words))
    joined = b" ".join(words)
    cuts = map(slice, starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    return map(joined.__getitem__, cuts), len(words) - size + 1


def majority(hashes: np.ndarray) -> bytes:
    """The bits that more than half of the rows of bytes set."""
    counts = np.zeros(8 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8."""
    found, n = shingles(data, shingle)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), "<u8", n)
    return int.from_bytes(majority(hashes.view(np.uint8).reshape(-1, 8)), "little")


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit words."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WORDS = 4


def wide_fingerprint(data: bytes, shingle: int) -> tuple[int, ...]:
    """Four 64-bit words: two from one XXH3 of 128 bits for each shingle, two from a mix of its halves."""
    found, _ = shingles(data, shingle)
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), "<u8").reshape(-1, 2)
    bits = majority(np.concatenate((halves, mixed(halves)), axis=1).view(np.uint8))
    return tuple(int.from_bytes(bits[at : at + 8], "little") for at in range(0, 8 * WORDS, 8))


def signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp), with the fingerprint as a signed long."""

    def run(ids, texts):
        return {"doc_id": ids, "fp": [signed(fingerprint(t or b"", shingle)) for t in texts]}

    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id bigint, fp bigint")


WIDE = [f"fp{k}" for k in range(WORDS)]


def wide_fingerprints(docs: DataFrame, shingle: int, key: str) -> DataFrame:
    """(doc_id, key, fp0 .. fp3); key names a column of longs."""

    def run(ids, texts, keys):
        found = [wide_fingerprint(t or b"", shingle) for t in texts]
        return {"doc_id": ids, key: keys} | {name: [signed(f[k]) for f in found] for k, name in enumerate(WIDE)}

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), key]
    return map_columns(docs.select(columns), run, f"doc_id bigint, {key} bigint, " + ", ".join(f"{w} bigint" for w in WIDE))


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments in unary code: 00, 01, 11 for 0, 1, 2."""
    even = np.uint64(EVEN)
    low, high = fp & even, (fp >> np.uint64(1)) & even
    return (low | high) | ((low & high) << np.uint64(1))


def group_masks(groups: int) -> list[int]:
    """64-bit masks of the groups, each of about 32 / groups segments."""
    edges = [round(k * 32 / groups) * 2 for k in range(groups + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def cells_of(rows: DataFrame, key, choices: int) -> DataFrame:
    """rows in one cell for each choice; key(words, choice) gives the cells of arrays of unsigned words."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            whole = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            for at in range(0, len(whole[0]), 2048):
                part = [x[at : at + 2048] for x in whole]
                cell = np.concatenate([key(part, k).view(np.int64) for k in range(choices)])
                which = np.repeat(np.arange(choices, dtype=np.int16), len(part[0]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (which, cell, *(np.tile(y.view(np.int64), choices) for y in part))], names=["choice", "cell", *names])

    return rows.mapInArrow(run, "choice smallint, cell bigint, " + ", ".join(f"{n} bigint" for n in names))


def compared(grid: DataFrame, unit: list[str], close, hot: int | None) -> DataFrame:
    """Stars of the linked rows within each unit of grid (unit columns, then node, then words): (a, b) and nulls. With
    `hot`, the rows of larger units are not compared but returned, with null a and b."""
    names = grid.columns
    first = len(unit)

    def star(columns, bounds):
        a, b = stars(columns[first].view(np.uint64), [x.view(np.uint64) for x in columns[first:]], bounds, close)
        if len(a):
            empty = {n: pa.nulls(len(a), grid_types[n]) for n in names}
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *empty.values()], names=["a", "b", *names])

    def passed(columns):
        if len(columns[0]):
            none = pa.nulls(len(columns[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, columns)], names=["a", "b", *names])

    def run(batches):
        held, large = None, False  # rows of the last unit, and whether earlier ones of it have been passed on
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in now[:first]])) + 1
            if large:  # the rows up to the first new unit belong to what is passed on
                end = int(new[0]) if len(new) else len(now[0])
                yield from passed([x[:end] for x in now])
                now, new, large = [x[end:] for x in now], new[1:] - end, not len(new)
                if large:
                    held = None
                    continue
            cut = int(new[-1]) if len(new) else 0
            bounds = np.concatenate(([0], new))
            if hot is not None:
                for k in np.flatnonzero(np.diff(bounds) > hot).tolist():
                    yield from passed([x[bounds[k] : bounds[k + 1]] for x in now])
            if cut:
                yield from star([x[:cut] for x in now], bounds if hot is None else small_bounds(bounds, hot))
            held = [x[cut:].copy() for x in now]
            if hot is not None and len(held[0]) > hot:
                yield from passed(held)
                held, large = None, True
        if held is not None:
            yield from star(held, np.array([0, len(held[0])]))

    grid_types = {f.name: pa.int16() if f.dataType.simpleString() == "smallint" else pa.int32() if f.dataType.simpleString() == "int" else pa.int64() for f in grid.schema}
    out = "a bigint, b bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grid.schema)
    return grid.repartition(*unit).sortWithinPartitions(*unit, names[first]).mapInArrow(run, out)


def small_bounds(bounds: np.ndarray, hot: int) -> np.ndarray:
    """bounds with the ranges above hot cut into single rows, which have no pairs."""
    return np.concatenate([np.arange(a, b) if b - a > hot else np.array([a]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] + [bounds[-1:]])


def searched(grid: DataFrame, close, hot: int = 20_000) -> DataFrame:
    """(a, b): stars of all rows of grid (choice, cell, node, words) that are close within a cell."""
    found = stash(compared(grid, ["choice", "cell"], close, hot))
    pairs = found.where("a is not null").select("a", "b")
    rest = found.where("a is null").drop("a", "b")
    if not rest.isEmpty():
        node = grid.columns[2]
        sizes = rest.groupBy("choice", "cell").agg(F.ceil(F.count("*") * 2 / hot).cast("int").alias("blocks"))
        dealt = rest.join(sizes, ["choice", "cell"]).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = dealt.select("choice", "cell", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), *grid.columns[2:])
        pairs = pairs.unionByName(compared(units, ["choice", "cell", "u", "v"], close, None).select("a", "b"))
    return pairs.distinct()


def close_within(distance: int, words: int):
    """close(a, b): indexes of the pairs of rows (node, words) within so many bits; a first bound by the Manhattan
    distance of the first word's segment counts, then by its bits, then all words."""

    def close(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        def bits(k, near):
            return np.bitwise_count((a[k][near] if a[k].ndim else a[k]) ^ b[k][near]).astype(np.int32)

        near = np.flatnonzero(np.bitwise_count(a[0] ^ b[0]) <= distance)  # [0]: embedding
        total = bits(1, near)
        for k in range(2, words + 1):
            stay = total <= distance
            near, total = near[stay], total[stay]
            total = total + bits(k, near)
        return near[total <= distance]

    return close


def stars(node: np.ndarray, columns: list[np.ndarray], bounds: np.ndarray, close, small: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(centre, row) for the linked rows within each range of bounds: all pairs are compared where a range has up to
    `small` rows; of larger ones each linked set is grown from a row. columns: the node, then the fingerprint's words."""
    words = columns[1:] or columns
    codes = [embed(words[0]), *words]
    n, sizes = int(bounds[-1]), np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left, right = [], []
    i = np.flatnonzero((sizes <= small)[owner]) if len(sizes) else np.zeros(0, dtype=np.int64)
    for lag in range(1, min(small, int(sizes.max(initial=0)) + 1)):
        i = i[i + lag < n]
        i = i[owner[i + lag] == owner[i]]
        if not len(i):
            break
        hit = i[close([x[i] for x in codes], [x[i + lag] for x in codes])]
        left.append(hit)
        right.append(hit + lag)
    for k in np.flatnonzero(sizes > small).tolist():
        at = np.arange(bounds[k], bounds[k + 1])
        rest = [x[bounds[k] : bounds[k + 1]] for x in codes]
        while len(at) > 1:
            todo = [(at[0], [x[0] for x in rest])]
            at, rest = at[1:], [x[1:] for x in rest]
            while todo and len(at):
                one, code = todo.pop()
                hit = close(code, rest)
                if len(hit):
                    left.append(np.full(len(hit), one))
                    right.append(at[hit])
                    todo += [(at[j], [x[j] for x in rest]) for j in hit.tolist()]
                    stay = np.ones(len(at), dtype=bool)
                    stay[hit] = False
                    at, rest = at[stay], [x[stay] for x in rest]
    if not left or not sum(map(len, left)):
        return node[:0], node[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    member = np.flatnonzero(label != np.arange(n))
    return node[label[member]], node[member]


def links(fps: DataFrame, distance: int = 4, groups: int = 8, hot: int = 20_000) -> DataFrame:
    """(a, b): a spanning set of the links of distinct fingerprints (fp) within `distance` bits; none is lost."""
    masks = group_masks(groups)
    choices = [np.uint64(sum(masks[i] for i in chosen)) for chosen in combinations(range(groups), groups - distance)]
    odd = np.uint64(0x9E3779B97F4A7C15)

    def key(words, k):
        # an odd multiple of the masked counts is one-to-one
        return (embed(words[0]) & choices[k]) * odd

    return searched(cells_of(fps.select("fp"), key, len(choices)), close_within(distance, 1), hot)


def tables_for(n: int, similarity: float, missed: float, held: int = 128) -> tuple[int, int]:
    """(segments in a choice, choices) for n fingerprints: about `held` rows a cell, and a pair of that similarity shares
    no cell with a probability of `missed`."""
    k = max(6, ceil(log2(max(2, n) / held)))
    differ = acos(2 * similarity / (1 + similarity)) / pi
    return k, ceil(log(missed) / log(1 - (1 - differ) ** k))


def near_links(nodes: DataFrame, distance: int, similarity: float, missed: float, hot: int = 20_000) -> DataFrame:
    """(a, b): stars of the nodes (node, fp0 .. fp3) within `distance` of 256 bits that share a random cell."""
    k, choices = tables_for(nodes.count(), similarity, missed)
    dice = np.random.default_rng(64)
    masks = np.zeros((choices, WORDS), dtype=np.uint64)
    for row in masks:
        for bit in dice.choice(64 * WORDS, k, replace=False).tolist():
            row[bit // 64] |= np.uint64(1 << bit % 64)
    odds = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)

    def key(columns, c):
        # a sum of odd multiples: chance meetings of unlike counts only add comparisons
        return np.add.reduce([(columns[1 + w] & masks[c, w]) * odds[w] for w in range(WORDS)])

    return searched(cells_of(nodes.select("node", *WIDE), key, choices), close_within(distance, WORDS), hot)


def classes(docs: DataFrame, shingle: int = 4, distance: int = 4, groups: int = 8) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links reach."""
    if not 0 <= distance < groups <= 32:
        raise ValueError("0 <= distance < groups <= 32")
    marked = stash(fingerprints(docs, shingle))
    nodes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(nodes, distance, groups)).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.select("doc_id", "fp").join(named, "fp")


def one_of_each(docs: DataFrame, shingle: int = 5, distance: int = 48, similarity: float = 0.8, missed: float = 0.03) -> DataFrame:
    """docs, with all columns, of which a row with its class's least doc_id stays, found by its id and text (of equal ones, one).

    Rows without an id and rows without a word (null, empty or white space) all stay. Two texts are linked if their wide
    fingerprints differ in at most `distance` of 256 bits and meet in a cell (see the head of this module).
    """
    worded = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    texts = docs.where(worded).withColumn("_text", F.xxhash64("text"))
    marked = wide_fingerprints(texts, shingle, "_text")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_text"))).alias("first")
    nodes = stash(marked.groupBy(*WIDE).agg(first).withColumn("node", F.monotonically_increasing_id()))
    roots = connected(near_links(nodes, distance, similarity, missed))
    least = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    stay = least.where("first is not null").select("first.doc_id", "first._text")
    named = texts.join(stay, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
    return named.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull() | ~worded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: class of every document."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
