"""Best-fit-decreasing packing of token sequences.

1. Each text is tokenised in a narrow stage; documents longer than the capacity are cut into full pieces with the
   shorter one first. A worker numbers its pieces of each length as it goes, so a piece is known by
   (length, task, rank). This table (numbers only) is checkpointed, so tokenising happens once.
2. Best-fit decreasing depends on lengths alone. Pieces are counted by length and task; the driver gets the counts by
   length (at most `capacity` numbers, however large the corpus), and packs equal pieces many at a time: open bins
   are held as runs of equal remaining capacity, and a segment tree over remaining capacities gives the tightest
   one that fits in logarithmic time. The result is a plan of runs: pieces r..r+k of a length go to bins b..b+k at
   one offset. It grows with the number of distinct lengths, not with the corpus.
3. A piece's rank among all of its length is its rank in its task plus the counts of earlier tasks; the plan, joined
   by length and rank range, gives its sequence and offset.

Cases: a null or empty text is one piece that holds the end id alone; repeated ids are packed like others; an empty
table gives no rows; very long texts are encoded whole; of equally tight bins the first is taken, and equal lengths go by
task and rank. Only the named columns are read. A capacity below 1 is an error.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import map_columns, stash, table

NAME = "op7_packing"
ORACLE_SQL = None
CAPACITY = 2048
END_ID = 0
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
#: Characters outside this set, and the special token's text, go to the slower library, whose tables define the ids.
RARE = re.compile(r"[^\x09-\x0d\x20-\x7e\xa1-ɏ‐-‧]|<\|endoftext\|>")


class Encoder:
    """Token ids of a text. The same vocabulary is held by two libraries; the faster one serves texts of common characters."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers
        import tiktoken

        self.path, self.slow = public_tokenizers.path(f"{name}.json"), None
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if RARE.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One per worker process, kept between tasks."""
    return Encoder(name)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    def run(ids, texts):
        state = run.__dict__
        if "encoder" not in state:
            from pyspark import TaskContext

            context = TaskContext.get()
            state.update(encoder=encoder(tokenizer), task=context.partitionId() if context else 0, ranks={})
        ranks, task, out = state["ranks"], state["task"], {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")}
        for i, text in zip(ids, texts, strict=True):
            tokens = np.array([*(state["encoder"].ids(text) if text else ()), END_ID], dtype="<u4")
            for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                rank = ranks[length] = ranks.get(length, -1) + 1
                for name, value in zip(out, (i, k, start, length, zlib.crc32(tokens[start : start + length].tobytes()), task, rank), strict=True):
                    out[name].append(value)
        return out

    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA)


class Tightest:
    """A segment tree over remaining capacities: which are present, and the least one at or above a bound."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)

    def set(self, value: int, present: bool) -> None:
        k = value + self.size
        self.tree[k] = present
        while k > 1:
            k >>= 1
            self.tree[k] = self.tree[2 * k] | self.tree[2 * k + 1]

    def find(self, least: int) -> int | None:
        k = least + self.size
        if self.tree[k]:
            return least
        while k > 1:
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts by length: rows (length, first rank, number, first bin, offset)."""
    tree, open_bins, rows, bins = Tightest(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room is None:
                # new bins, each filled with this length before the next is opened
                each = capacity // length
                full, more = divmod(left, each)
                for k in range(each):
                    n = full + (k < more)
                    if n:
                        # the k-th place of the bins, the last of which is short
                        rows.append((length, rank, n, bins, k * length))
                        rank += n
                if full:
                    _open(tree, open_bins, capacity - each * length, bins, full)
                if more:
                    _open(tree, open_bins, capacity - more * length, bins + full, 1)
                bins += full + bool(more)
                left = 0
                break
            runs = open_bins[room]
            first, n = runs.pop()
            take = min(n, left)
            if take < n:
                runs.append((first + take, n - take))
            if not runs:
                del open_bins[room]
                tree.set(room, False)
            rows.append((length, rank, take, first, capacity - room))
            rank += take
            left -= take
            _open(tree, open_bins, room - length, first, take)
    return rows


def _open(tree: Tightest, open_bins: dict, room: int, first: int, n: int) -> None:
    if room:
        if room not in open_bins:
            open_bins[room] = []
            tree.set(room, True)
        open_bins[room].append((first, n))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    cuts = stash(pieces(docs, capacity, tokenizer))
    by_task = cuts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list[list[int]]] = {}
    for length, rank, n, first, offset in plan(counts, capacity):
        by_length.setdefault(length, []).append([rank, rank + n, first, offset])
    ranked = cuts.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    return place(ranked, by_length)


def place(ranked: DataFrame, by_length: dict[int, list[list[int]]]) -> DataFrame:
    """Looks each (length, rank) up in the plan by binary search."""
    arrays = {k: tuple(np.array(v, dtype=np.int64).T) for k, v in by_length.items()}

    def run(doc_id, piece, start, length, crc, rank):
        sequence, offset = [], []
        for size, r in zip(length, rank, strict=True):
            low, _, first, at = arrays[size]
            k = int(np.searchsorted(low, r, "right")) - 1
            sequence.append(int(first[k] + r - low[k]))
            offset.append(int(at[k]))
        return {"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "sequence_id": sequence, "offset": offset}

    return map_columns(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
