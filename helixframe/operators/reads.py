"""Reads and k-mers: name filters, clipping, k-mer counts and sets, statistics of sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import seq as sq
from helixframe.operators import kmers as km
from helixframe.operators.ordered import with_running

#: Record filters by name, each from its argument; all keep the record's columns (file, ord, name, seq, qual).
FILTERS = {
    "name": lambda df, _: df.withColumn("name", F.split(F.ltrim("name"), r"\s+")[0]),
    "bar": lambda df, n: df.withColumn("name", F.trim(F.element_at(F.split("name", r"\|"), int(n)))),
    "rename": lambda df, x: df.withColumn("name", F.lit(x)),
    "select": lambda df, names: df.where(F.col("name").isin(names.split(","))),
    "lengthatleast": lambda df, n: df.where(F.length("seq") >= int(n)),
    "pfilter": lambda df, sql: df.where(F.expr(sql)),
    "qclip": lambda df, q: quality_clip(df, int(q)),
    "first": lambda df, n: df.orderBy("file", "ord").limit(int(n)),
}


def filtered(df: DataFrame, specs: list[str]) -> DataFrame:
    """Applies filters such as `lengthatleast:50` in turn."""
    for spec in specs:
        name, _, argument = spec.partition(":")
        df = FILTERS[name](df, argument)
    return df


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def quality_clip(df: DataFrame, quality: int, offset: int = 64) -> DataFrame:
    """The earliest longest stretch of the quality at least."""
    run = good_run(F.col("qual"), F.col("qual"), F.lit(offset + quality), clip_ambiguous=False)
    marked = df.withColumn("_run", run)
    part = lambda c: F.substring(c, F.col("_run.start") + 1, F.col("_run.length"))
    return marked.withColumns({"seq": part("seq"), "qual": part("qual")}).drop("_run")


def quality_offset(df: DataFrame, reads: int = 100_001) -> int:
    """33 or 64 by the least quality character among a bounded number of reads."""
    least = df.where("qual is not null").select("qual").limit(reads).agg(F.min(F.array_min(F.transform(characters(F.col("qual")), lambda c: F.ascii(c))))).first()[0]
    return 33 if least is None or least < 59 else 64


def is_colorspace(seq: Column) -> Column:
    """Whether the first telling character after the first position is a colour."""
    return F.regexp_extract(F.upper(F.substring(seq, 2, 1 << 30)), "[0123.ACGTN]", 0).rlike("[0123.]")


def repeated_names(df: DataFrame) -> DataFrame:
    """Names that occur more than once in a file; empty if names are unique."""
    return df.groupBy("file", "name").agg(F.count("*").alias("n")).where("n > 1")


def good_run(seq: Column, qual: Column, least: Column, trim_start: int = 0, trim_end: int = 0, clip_ambiguous: bool = True) -> Column:
    """Struct (start, length) of the first longest stretch of good quality over ACGT between the trimmed ends."""

    def plain(q, b, least, bounds):
        """The same of rows of bytes, of equal bounds."""
        good = q >= np.repeat(least, np.diff(bounds))
        if clip_ambiguous:
            good &= km.CAPITALS[b] <= 3
        for low, step, n in ((bounds[:-1], 1, trim_start), (bounds[1:] - 1, -1, trim_end)):
            for j in range(min(n, int(np.diff(bounds).max(initial=0)))):
                at = low + step * j
                good[at[(at >= bounds[:-1]) & (at < bounds[1:])]] = False
        start, size = km.longest_runs(good, bounds)
        return np.where(size > 0, start, trim_start), size

    def one(q, b, least):
        marks = [ord(x) >= least and (not clip_ambiguous or (i < len(b) and b[i] in "ACGT")) and trim_start <= i < len(q) - trim_end for i, x in enumerate(q)]
        return km.longest_runs(np.array(marks, bool), np.array([0, len(marks)]))

    def run(seqs: pa.Array, quals: pa.Array, least: pa.Array) -> pa.Array:
        starts, sizes = np.full(len(quals), trim_start), np.zeros(len(quals), np.int64)
        (b, seq_bounds), (q, bounds) = km.text_bytes(seqs), km.text_bytes(quals)
        least = least.to_numpy(zero_copy_only=False)
        none = (seqs.is_null().to_numpy(zero_copy_only=False) & clip_ambiguous) | quals.is_null().to_numpy(zero_copy_only=False)
        for low, high in km.pieces(bounds):
            theirs, own = seq_bounds[low : high + 1], bounds[low : high + 1]
            left, right = b[theirs[0] : theirs[-1]], q[own[0] : own[-1]]
            if np.array_equal(theirs - theirs[0], own - own[0]) and right.max(initial=0) < 128 and left.max(initial=0) < 128:
                starts[low:high], sizes[low:high] = plain(right, left, least[low:high], own - own[0])
                continue
            for i in range(low, high):
                if not none[i]:
                    start, size = one(quals[i].as_py(), seqs[i].as_py() or "", least[i])
                    starts[i], sizes[i] = start[0] if size[0] else trim_start, size[0]
        mask = pa.array(none)
        return pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], names=["start", "length"], mask=mask)

    return F.arrow_udf(run, "start int, length int")(seq, qual, least)


def adaptor_length(seq: Column, adaptors: list[str], max_errors: int = 1, least: int = 10) -> Column:
    """Length of the longest start of seq that is the end of an adaptor with at most max_errors mismatches (N fits all); 0 if under `least`."""
    ends = {a[-n:] for a in (x.upper().replace("U", "T") for x in adaptors) for n in range(least, len(a) + 1)}
    hits = []
    for end in sorted(ends, key=lambda e: (-len(e), e)):
        same = F.zip_with(characters(F.substring(seq, 1, len(end))), F.array(*[F.lit(c) for c in end]), lambda x, y: F.when(F.coalesce((x == y) | (x == "N") | (y == "N"), F.lit(False)), 0).otherwise(1))
        hits.append(F.when(F.aggregate(same, F.lit(0), lambda acc, x: acc + x) <= max_errors, len(end)))
    return F.coalesce(*hits, F.lit(0)) if hits else F.lit(0)


def clip(df: DataFrame, quality: int = 10, offset: int = 33, length: int = 24, match: int = 10, max_errors: int = 1, adaptors: list[str] | None = None, homopolymers: bool = False, revcom: bool = False, trim_to: int | None = None, trim_start: int = 0, trim_end: int = 0, clip_ambiguous: bool = True) -> DataFrame:
    """Reads (name, seq, qual) clipped by quality and adaptors; `reason` says why a read is rejected, null for those kept."""
    out = df.withColumn("seq", F.upper("seq"))
    if trim_to:
        out = out.withColumns({"seq": F.substring("seq", 1, trim_to), "qual": F.substring("qual", 1, trim_to)})

    def take(frame, start, n):
        return frame.withColumns({c: F.substring(c, start + 1, n) for c in ("seq", "qual")})

    out = out.withColumn("_run", good_run(F.col("seq"), F.col("qual"), F.lit(offset + quality), trim_start, trim_end, clip_ambiguous))
    out = take(out, F.col("_run.start"), F.col("_run.length")).drop("_run")
    short = F.length("seq") < length
    out = out.withColumn("reason", F.when(short, "quality"))
    for end in ("start", "end") if adaptors else ():
        side = F.col("seq") if end == "start" else sq.reverse_complement(F.col("seq"))
        out = out.withColumn("_n", F.when(F.col("reason").isNull(), adaptor_length(side, adaptors, max_errors, match)).otherwise(0))
        out = take(out, F.col("_n") if end == "start" else F.lit(0), F.length("seq") - F.col("_n")).drop("_n")
        out = out.withColumn("reason", F.coalesce("reason", F.when(short, "adaptor")))
    if not homopolymers:
        out = out.withColumn("reason", F.coalesce("reason", F.when(F.length(F.replace("seq", F.substring("seq", 1, 1), F.lit(""))) == 0, "homopolymer")))
    if revcom:
        out = out.withColumns({"seq": sq.reverse_complement(F.col("seq")), "qual": F.reverse("qual")})
    return out


def pair_reads(df: DataFrame) -> DataFrame:
    """Reads named x/1 with those named x/2, the latter complemented; orphans are kept: (base, seq1, seq2)."""
    base = F.regexp_replace("name", "/[12]$", "")
    first = df.where("name like '%/1'").select(base.alias("base"), F.col("seq").alias("seq1"))
    second = df.where("name like '%/2'").select(base.alias("base"), sq.reverse_complement(F.col("seq")).alias("seq2"))
    return first.join(second, "base", "full")


def count_kmers(seqs: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Canonical k-mers of upper-cased sequences with their counts, summed before the shuffle."""
    keys = keys or []
    if k <= km.WIDEST:
        each = km.tally(seqs.select(*keys, F.upper("seq").alias("seq")), k, keys)
    else:
        each = seqs.select(*keys, F.explode(sq.canonical_kmers(F.upper("seq"), k)).alias("kmer")).withColumn("n", F.lit(1).cast("bigint"))
    return each.groupBy(*keys, "kmer").agg(F.sum("n").alias("n"))


def postings(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, read, n) of every k-mer and read: rows rather than one list a k-mer, which would have no bound.

    A read whose name is its own is counted where it is; only the counts of other reads are shuffled.
    """
    if k > km.WIDEST:
        return count_kmers(seqs, k, ["name"])
    whole = km.marked(seqs.select("name", F.upper("seq").alias("seq")))
    more = km.tally(whole.where("_many"), k, ["name"]).groupBy("name", "kmer").agg(F.sum("n").alias("n"))
    return km.tally(whole.where("not _many"), k, ["name"]).unionByName(more)


def multiplicities(counts: DataFrame) -> DataFrame:
    """Histogram (n, kmers) of a count table."""
    return counts.groupBy("n").agg(F.count("*").alias("kmers"))


def kmer_stats(counts: DataFrame) -> DataFrame:
    """Number of different k-mers and of all, mean, weighted median and greatest multiplicity."""
    hist = multiplicities(counts)
    total = hist.agg(F.sum("kmers").alias("distinct"), F.sum(F.col("n") * F.col("kmers")).alias("total"), F.max("n").alias("most"))
    upto = with_running(hist.withColumn("_all", F.lit(0)), ["_all"], "n", {"upto": F.col("n") * F.col("kmers")})
    median = upto.crossJoin(F.broadcast(total)).where(2 * F.col("upto") > F.col("total")).agg(F.min("n").alias("median"))
    return total.crossJoin(median).select("distinct", "total", F.round(F.col("total") / F.col("distinct"), 6).alias("mean"), "median", "most")


def merged_counts(bags: list[DataFrame], cutoff: int) -> DataFrame:
    """K-mers whose counts over all bags reach the cutoff."""
    whole = bags[0]
    for bag in bags[1:]:
        whole = whole.unionByName(bag)
    return whole.groupBy("kmer").agg(F.sum("n").alias("n")).where(F.col("n") >= cutoff)


def shadow_counts(counts: DataFrame, k: int) -> DataFrame:
    """The greatest count among each k-mer's one-base neighbours, 0 if none is there."""
    near = counts.select("kmer", F.explode(sq.snp_neighbours(F.col("kmer"), k)).alias("other"))
    found = near.join(counts.select(F.col("kmer").alias("other"), F.col("n").alias("m")), "other").groupBy("kmer").agg(F.max("m").alias("shadow"))
    return counts.join(found, "kmer", "left").select("kmer", "n", F.coalesce("shadow", F.lit(0)).alias("shadow"))


def link_list(counts: DataFrame) -> DataFrame:
    """Links (kmer, other, sign, step) from each k-mer to the neighbours that are there."""
    sides = [F.struct(x.alias("raw"), F.lit(step).alias("step")) for f, step in ((sq.successors, 1), (sq.predecessors, -1)) for x in (F.get(f(F.col("kmer")), F.lit(i)) for i in range(4))]
    raw = counts.select("kmer", F.explode(F.array(*sides)).alias("_x")).select("kmer", "_x.*")
    near = raw.select("kmer", sq.canonical(F.col("raw")).alias("other"), sq.sign(F.col("raw")).alias("sign"), "step")
    return near.join(counts.select(F.col("kmer").alias("other")), "other").select("kmer", "other", "sign", "step")


def kmer_depth(seqs: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """By sequence, the share of k-mers that are in the bag and mean, median, least and most of their counts.

    Up to 11 bases the bag is a table that every task holds, and a sequence gives one row.
    """
    if k <= km.DENSE:
        each = km.depths(km.marked(seqs.select("name", F.upper("seq").alias("seq"))), km.table_of(counts, k), k)
        share = F.sum("hits") / F.sum("total")
        median = F.coalesce(F.first("median", True), F.percentile("n", F.lit(0.5), F.coalesce("times", F.lit(0))))
        return each.groupBy("name").agg(F.round(100 * share, 6).alias("present"), F.round(F.sum("sum") / F.sum("total"), 6).alias("mean"), median.alias("median"), F.min("least").alias("least"), F.max("most").alias("most"))
    each = seqs.select("name", F.explode(sq.canonical_kmers(F.upper("seq"), k)).alias("kmer"))
    found = each.join(counts, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.groupBy("name").agg(F.round(100 * F.avg((F.col("n") > 0).cast("int")), 6).alias("present"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


def sequence_stats(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """Number, bases and mean length of sequences."""
    n = F.length("seq").cast("bigint")
    return seqs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(n).alias("bases"), F.round(F.avg(n), 6).alias("mean"))


def sample_records(df: DataFrame, n: int, identity: list[str], seed: int = 0) -> DataFrame:
    """A reproducible uniform sample of n records."""
    return df.orderBy(F.xxhash64(*identity, F.lit(seed)), *identity).limit(n)
