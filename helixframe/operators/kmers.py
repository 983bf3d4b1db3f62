"""Windows of bases in whole Arrow batches: a k-mer of up to 24 bases is a number of two bits a base, in the order of its text.

Texts are read as the bytes of a batch, a piece at a time, so that no array is longer than a piece and no row is made of
each base. Tables of all k-mers are held up to DENSE bases (32 MB of counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bases of a number, most of a table of all k-mers, and bytes of a piece.
WIDEST, DENSE, PIECE = 24, 11, 1 << 20
#: Numbers of bases by byte, 4 for others; in either case or in capitals alone.
EITHER = np.full(256, 4, np.uint8)
EITHER[list(b"ACGT")] = range(4)
CAPITALS = EITHER.copy()
EITHER[list(b"acgt")] = range(4)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows in them; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, bounds, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]


def pieces(bounds: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes together; a longer row is alone."""
    at = 0
    while at < len(bounds) - 1:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, upto
        at = upto


def windows(data: np.ndarray, bounds: np.ndarray, k: int, bases: np.ndarray = CAPITALS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in the data, canonical number) of every window of k bases ACGT within a row, a piece of the bytes at a time."""
    for low in range(int(bounds[0]), int(bounds[-1]) - k + 1, PIECE):
        codes = bases[data[low : min(low + PIECE + k - 1, int(bounds[-1]))]]
        n = len(codes) - k + 1
        kind = np.uint32 if k <= 16 else np.uint64
        forward, backward = np.zeros(n, kind), np.zeros(n, kind)
        for j in range(k):
            forward = (forward << kind(2)) | codes[j : j + n]
            backward = (backward << kind(2)) | (3 - (codes[k - 1 - j : k - 1 - j + n] & 3))
        first = int(np.searchsorted(bounds, low, "right")) - 1
        last = int(np.searchsorted(bounds, low + n, "left"))
        row = np.repeat(np.arange(first, last), np.diff(np.clip(bounds[first : last + 1], low, low + n)))
        at = np.arange(low, low + n)
        whole = at + k <= bounds[row + 1]
        wrong = codes > 3
        if wrong.any():
            upto = np.concatenate([[0], np.cumsum(wrong)])
            whole &= upto[k:] == upto[:n]
        found = np.minimum(forward, backward)
        yield (row, at, found) if whole.all() else (row[whole], at[whole], found[whole])


def texts(numbers: np.ndarray, k: int) -> pa.Array:
    """The k-mers of numbers as strings."""
    letters = np.empty((len(numbers), k), np.uint8)
    rest = numbers.astype(np.uint64)
    for j in range(k - 1, -1, -1):
        letters[:, j] = np.frombuffer(b"ACGT", np.uint8)[(rest & np.uint64(3)).astype(np.intp)]
        rest >>= np.uint64(2)
    bounds = (np.arange(len(numbers) + 1) * k).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(numbers), pa.py_buffer(bounds.tobytes()), pa.py_buffer(letters.tobytes())).cast(pa.string())


def numbers_of(kmers: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, number) of those texts that are k bases ACGT."""
    data, bounds = text_bytes(kmers)
    index = np.flatnonzero(np.diff(bounds) == k)
    letters = CAPITALS[data[bounds[index][:, None] + np.arange(k)]] if len(index) else np.zeros((0, k), np.uint8)
    upper = (letters <= 3).all(axis=1)
    number = np.zeros(len(index), np.int64)
    for j in range(k):
        number = number * 4 + letters[:, j]
    return index[upper], number[upper]


def table_of(counts: DataFrame, k: int) -> np.ndarray:
    """A table of all k-mers' counts (kmer, n), 0 where there is none; made at the driver, of 4 ** k numbers whatever the input."""
    found = counts.select("kmer", F.col("n").cast("bigint").alias("n")).toArrow().combine_chunks()
    table = np.zeros(4**k, np.int64)
    if found.num_rows:
        index, number = numbers_of(found["kmer"].combine_chunks(), k)
        table[number] = found["n"].combine_chunks().to_numpy(zero_copy_only=False)[index]
    return table


def groups_of(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group by the keys, and one row of each group."""
    whole = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        codes = batch.column(key).dictionary_encode(null_encoding="encode")
        whole = whole * max(len(codes.dictionary), 1) + codes.indices.to_numpy(zero_copy_only=False)
        whole = np.unique(whole, return_inverse=True)[1]
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    return group, first


def tally(seqs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(keys, kmer, n) of sequences `seq`, summed up by task or piece; a key and k-mer may come more than once.

    A sequence that is alone in its key and of at most PIECE bytes has each k-mer once.
    """
    fields = [seqs.schema[c] for c in keys]
    schema = T.StructType([*fields, T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())])

    def out(batch, numbers, n, rows):
        made = [batch.column(c).take(pa.array(rows)) for c in keys] if keys else []
        return pa.RecordBatch.from_arrays([*made, texts(numbers, k), pa.array(n, pa.int64())], names=[*keys, "kmer", "n"])

    def run(batches):
        held = np.zeros(4**k, np.int64) if not keys and k <= DENSE else None
        for batch in batches:
            data, bounds = text_bytes(batch.column("seq"))
            if held is not None:
                for _, _, found in windows(data, bounds, k):
                    held += np.bincount(found, minlength=len(held))
                continue
            group, first = groups_of(batch, keys)
            if len(first) << 2 * k <= 1 << 22:
                sums = np.zeros(len(first) << 2 * k, np.int64)
                for row, _, found in windows(data, bounds, k):
                    sums += np.bincount((group[row] << 2 * k) + found, minlength=len(sums))
                there = np.flatnonzero(sums)
                yield out(batch, there & 4**k - 1, sums[there], first[there >> 2 * k])
                continue
            for low, high in pieces(bounds):
                for row, _, found in windows(data, bounds[low : high + 1], k):
                    both, n = np.unique((group[row + low] << 2 * k) + found.astype(np.int64), return_counts=True)
                    yield out(batch, both & 4**k - 1, n, first[both >> 2 * k])
        if held is not None:
            there = np.flatnonzero(held)
            yield out(None, there, held[there], None)

    return seqs.select(*keys, "seq").mapInArrow(run, schema)


def marked(seqs: DataFrame) -> DataFrame:
    """Sequences (name, seq) with `_many`: whether other rows have the name, or the sequence is longer than a piece, so that results are put together by name."""
    names = seqs.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("name").alias("_name"), F.lit(True).alias("_many"))
    return seqs.join(names, F.col("name").eqNullSafe(F.col("_name")), "left").select("name", "seq", (F.col("_many").isNotNull() | F.coalesce(F.octet_length("seq") > PIECE, F.lit(False))).alias("_many"))


def depths(seqs: DataFrame, table: np.ndarray, k: int) -> DataFrame:
    """Sums of the table's counts over each sequence's k-mers (name, total, hits, sum, median, least, most); of those marked `_many` a row for
    each different count instead, with the count and its times in (n, times) and no median."""
    held, top = seqs.sparkSession.sparkContext.broadcast(table), int(table.max()) + 1
    names = ["total", "hits", "sum", "median", "least", "most", "n", "times"]
    schema = T.StructType([seqs.schema["name"], *[T.StructField(c, T.DoubleType() if c == "median" else T.LongType()) for c in names]])

    def out(batch, rows, columns):
        made = [pa.nulls(len(rows), pa.float64() if c == "median" else pa.int64()) if x is None else pa.array(x, pa.float64() if c == "median" else pa.int64()) for c, x in zip(names, columns, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(rows)), *made], names=["name", *names])

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column("seq"))
            many = batch.column("_many").to_numpy(zero_copy_only=False).astype(bool)
            for low, high in pieces(bounds):
                for row, _, found in windows(data, bounds[low : high + 1], k):
                    row = row + low
                    both = np.sort(row * top + held.value[found])
                    whole = both[~many[row]]  # in the order of rows
                    if len(whole):
                        r, n = whole // top, whole % top
                        at = np.flatnonzero(np.diff(r, prepend=-1))
                        size = np.diff(at, append=len(r))
                        median = (n[at + (size - 1) // 2] + n[at + size // 2]) / 2
                        yield out(batch, r[at], [size, np.add.reduceat(n > 0, at, dtype=np.int64), np.add.reduceat(n, at), median, n[at], n[at + size - 1], None, None])
                    part, times = np.unique(both[many[row]], return_counts=True)
                    if len(part):
                        r, n = part // top, part % top
                        yield out(batch, r, [times, times * (n > 0), times * n, None, n, n, n, times])

    return seqs.mapInArrow(run, schema)


def longest_runs(good: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the first longest run of true in each row of an array cut at bounds (from 0), 0 where there is none."""
    edge = np.zeros(len(good) + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(good & ~(np.concatenate([[False], good[:-1]]) & ~edge[:-1])) if len(good) else np.zeros(0, np.int64)
    ends = np.flatnonzero(good & ~(np.concatenate([good[1:], [False]]) & ~edge[1:])) + 1 if len(good) else begins
    size, row = ends - begins, np.searchsorted(bounds, begins, "right") - 1
    order = np.lexsort((begins, -size, row))
    row, begins, size = row[order], begins[order], size[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    start, length = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    start[row[first]], length[row[first]] = begins[first] - bounds[row[first]], size[first]
    return start, length
