"""Normalisation and smoothing of depth tracks, and small operators over reads, annotations and logs."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import ann
from helixframe.functions import seq as sq
from helixframe.operators import kmers as km
from helixframe.operators.intervals import deltas, runs_of
from helixframe.operators.ordered import with_running


def clear_depth_totals(hits: DataFrame, fragment: list[str], sample: str, samples: list, keys: list[str]) -> DataFrame:
    """Each sample's total depth over the sites at which, in every sample and on both strands, all depth comes from
    fragments with a single hit, and the multiplier that brings it to the geometric mean (totals below 1 count as 1).

    keys: the columns of a sequence; hits also have a strand. Sites are runs of the joint depth of all samples.
    """
    one = F.count("*").over(Window.partitionBy(*fragment)) == 1
    steps = deltas(hits.withColumn("_one", one), [*keys, sample, "strand", "_one"])
    names = {f"{s}{st}": (s, st) for s in samples for st in (1, -1)}
    is_of = lambda n: (F.col(sample) == names[n][0]) & (F.col("strand") == names[n][1])
    sums = [F.coalesce(F.sum(F.when(is_of(n), F.col("delta"))), F.lit(0)).alias(f"a_{n}") for n in names]
    sums += [F.coalesce(F.sum(F.when(is_of(n) & ~F.col("_one"), F.col("delta"))), F.lit(0)).alias(f"m_{n}") for n in names]
    wide = steps.groupBy(*keys, "pos").agg(*sums)
    runs = runs_of(wide, keys, {c: F.col(c) for c in wide.columns if c not in (*keys, "pos")})
    clear = runs.where(" and ".join(f"`m_{n}` = 0" for n in names))
    size = F.col("end") - F.col("start")
    totals = clear.agg(*[F.coalesce(F.sum(size * (F.col(f"a_{s}1") + F.col(f"a_{s}-1"))), F.lit(0)).alias(f"t_{s}") for s in samples])
    rows = totals.select(F.explode(F.array(*[F.struct(F.lit(s).alias(sample), F.col(f"t_{s}").alias("total")) for s in samples])).alias("x")).select("x.*")
    mean = rows.agg(F.exp(F.avg(F.ln(F.greatest(F.lit(1), "total")))).alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).select(sample, "total", (F.col("mean") / F.col("total")).alias("multiplier"))


def log_mean_divisors(tracks: DataFrame, names: list[str], min_depth: int = 5) -> DataFrame:
    """(sample, divisor) over the sites of depth runs (start, end, d_<name>) at which every sample has min_depth: its mean log depth against all samples'."""
    good = tracks
    for n in names:
        good = good.where(F.col(f"d_{n}") >= min_depth)
    size = F.col("end") - F.col("start")
    sums = good.agg(F.sum(size).alias("_bases"), *[F.sum(size * F.ln(f"d_{n}")).alias(n) for n in names])
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("sample"), F.exp((F.col(n) - mean) / F.col("_bases")).alias("divisor")) for n in names])).alias("x")).select("x.*")


def trimmed_mean(values: DataFrame, value: str, times: Column, trim: float) -> DataFrame:
    """(kept, mean) of the floor(n * (1 - trim)) least values, `times` being how often a row's value stands."""
    by = values.groupBy(value).agg(F.sum(times).alias("_times"))
    total = by.agg(F.floor(F.sum("_times") * F.lit(1 - trim)).alias("kept"))
    ranked = with_running(by.withColumn("_all", F.lit(0)), ["_all"], value, {"upto": F.col("_times")}, inclusive=False)
    taken = F.least(F.col("_times"), F.greatest(F.lit(0), F.col("kept") - F.col("upto")))
    return ranked.crossJoin(F.broadcast(total)).groupBy("kept").agg((F.sum(taken * F.col(value)) / F.first("kept")).alias("mean"))


def smoothed(values: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    """Circular triangular mean of (keys, pos, value) by sequence of `n` positions from 0: weights radius - |offset|, over radius squared.

    Each row gives its weighted value to the positions within the radius; these are summed before they are shuffled,
    so no sequence is one task. Rows have the sequence's length in `n`.
    """
    offsets = F.explode(F.sequence(F.lit(1 - radius), F.lit(radius - 1))).alias("_d")
    spread = values.select(*keys, "pos", "n", F.col(value).alias("_v"), offsets)
    return spread.groupBy(*keys, F.pmod(F.col("pos") + F.col("_d"), F.col("n")).alias("pos")).agg((F.sum((radius - F.abs("_d")) * F.col("_v")) / float(radius * radius)).alias("smooth"))


def by_weight(rows: DataFrame, weights: DataFrame, sample: str) -> DataFrame:
    """Rows of the samples that the weights have, with their multiplier."""
    return rows.join(weights, sample)


def tagged(samples: DataFrame, tags: DataFrame, sample: str) -> DataFrame:
    """Samples with their tags; those without have their own name and `all`."""
    return samples.join(tags, sample, "left").withColumn("tags", F.coalesce("tags", F.array(F.col(sample).cast("string"), F.lit("all"))))


def categories(genes: DataFrame, members: DataFrame, gene: str) -> DataFrame:
    """(category, genes, chosen) from genes with a mark `chosen` and (gene, category) pairs."""
    return members.distinct().join(genes, gene).groupBy("category").agg(F.count("*").alias("genes"), F.count_if("chosen").alias("chosen"))


def untrumped(rows: DataFrame, site: list[str], kind: str, trumps: dict[str, list[str]]) -> DataFrame:
    """Rows but those at a site that has one of a more specific kind: trumps[kind] lists what goes before it."""
    pairs = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, vs in trumps.items() for v in vs]
    beaten = rows.select(*site, F.col(kind).alias("_v")).distinct().withColumn("_p", F.explode(F.filter(F.array(*pairs), lambda p: p["v"] == F.col("_v")))).select(*site, F.col("_p.k").alias(kind)).distinct()
    return rows.join(beaten, [*site, kind], "left_anti")


def truly_unmapped(unmapped: DataFrame, mapped: DataFrame, name: str) -> DataFrame:
    """One row of each unmapped read whose name, without /1 or /2, no mapped read has."""
    base = lambda: F.regexp_replace(name, "/[12]$", "")
    return unmapped.withColumn("base", base()).join(mapped.select(base().alias("base")).distinct(), "base", "left_anti").dropDuplicates([name])


def joined_attribute(rows: DataFrame, keys: list[str], order: Column, value: str, joiner: str = "; ") -> DataFrame:
    """The distinct non-empty values of each group in the order they first come, joined.

    Values are made distinct before they are gathered, so that a group holds its different values only.
    """
    first = rows.where(F.col(value) != "").groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]), joiner).alias(value))


def log_table(datums: DataFrame, fields: list[str]) -> DataFrame:
    """One row a sample and one column a field from (sample, field, value)."""
    return datums.groupBy("sample").pivot("field", fields).agg(F.first("value"))


def clip_summary(clipped: DataFrame, keys: list[str]) -> DataFrame:
    """Reads, kept ones and mean lengths before and after clipping, from (length, clip_start, clip_end)."""
    after = F.col("clip_end") - F.col("clip_start")
    return clipped.groupBy(*keys).agg(F.count("*").alias("reads"), F.count_if(after > 0).alias("kept"), F.round(F.avg("length"), 6).alias("mean_before"), F.round(F.avg(after), 6).alias("mean_after"), F.count_if(F.col("clip_start") > 0).alias("clipped_start"), F.count_if(F.col("clip_end") < F.col("length")).alias("clipped_end"))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The state of a key-value log (key, op, value, order): the last entry of each key, none if that deletes it."""
    return log.groupBy(key).agg(F.max_by(F.struct("op", "value"), order).alias("x")).where("x.op <> 'delete'").select(key, "x.value")


def reduced(log: DataFrame, key: str, value: str) -> DataFrame:
    """The counting reducers: sum, and greatest, of a key's entries."""
    return log.groupBy(key).agg(F.sum(value).alias("sum"), F.max(value).alias("most"))


def clean_runs(seqs: DataFrame, good: DataFrame, k: int) -> DataFrame:
    """Each sequence cut to its longest run of positions whose k-mer is in `good`, the first of equal ones; empty if there is none.

    Up to 11 bases `good` is a table that every task holds, and each sequence is cut where it is.
    """
    if k <= km.DENSE:
        held = seqs.sparkSession.sparkContext.broadcast(km.table_of(good.select("kmer", F.lit(1).alias("n")), k) > 0)

        def run(batches):
            for batch in batches:
                data, bounds = km.text_bytes(batch.column("seq"))
                mask = np.zeros(bounds[-1] - bounds[0], bool)
                for _, at, found in km.windows(data, bounds, k, km.EITHER):
                    mask[at - bounds[0]] = held.value[found]
                start, size = km.longest_runs(mask, bounds - bounds[0])
                low = bounds[:-1] + start
                cut = [data[a:b].tobytes().decode() if b > a else "" for a, b in zip(low, low + np.where(size > 0, size + k - 1, 0), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(cut, pa.string())], names=["name", "seq"])

        return seqs.select("name", "seq").mapInArrow(run, seqs.select("name", "seq").schema)
    # slices of bytes; either strand is made once a sequence
    whole, n = F.upper("seq"), F.octet_length("seq")
    both = F.struct(whole.cast("binary").alias("f"), sq.reverse_complement(whole).cast("binary").alias("r"))
    windows = bound(both, lambda x: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.least(F.substring(x["f"], i, F.lit(k)), F.substring(x["r"], n - k + 2 - i, F.lit(k))).cast("string")))
    each = seqs.where(n >= k).select("name", F.posexplode(windows).alias("i", "kmer")).join(good.select("kmer"), "kmer", "left_semi")
    place = Window.partitionBy("name").orderBy("i")
    runs = each.withColumn("_g", F.col("i") - F.row_number().over(place)).groupBy("name", "_g").agg(F.min("i").alias("start"), F.count("*").alias("size"))
    best = runs.groupBy("name").agg(F.max_by(F.struct("start", "size"), F.struct("size", -F.col("start"))).alias("x"))
    return seqs.join(best, "name", "left").select("name", F.when(F.col("x").isNotNull(), F.substring("seq", (F.col("x.start") + 1).cast("int"), (F.col("x.size") + k - 1).cast("int"))).otherwise("").alias("seq"))


def trailing_mean(seqs: DataFrame, counts: Column, k: int) -> DataFrame:
    """For each sequence (name, seq) the mean of the counts of the up to k k-mers that cover each base; counts is an array by k-mer position."""

    def run(batches):
        for batch in batches:
            lists = batch.column("counts")
            bounds, there = lists.offsets.to_numpy().astype(np.int64), lists.is_valid().to_numpy(zero_copy_only=False)
            low = bounds[0]
            inner = lists.values.slice(low, bounds[-1] - low).cast(pa.float64())
            known = inner.is_valid().to_numpy(zero_copy_only=False)
            values, bounds = inner.fill_null(0.0).to_numpy(zero_copy_only=False), bounds - low
            size = np.where(there, np.diff(bounds), 0)
            wide = np.where(size > 0, size + k - 1, 0)
            ends = np.concatenate([[0], np.cumsum(wide)])
            sums, times, whole = np.zeros(ends[-1]), np.zeros(ends[-1], np.int64), np.ones(ends[-1], bool)
            # the values of each row, from the oldest that covers a base to the newest
            kept = np.repeat(size > 0, np.diff(bounds))
            at = np.arange(len(values)) - np.repeat(bounds[:-1] - ends[:-1], np.diff(bounds))
            at, values, known = at[kept], values[kept], known[kept]
            for j in range(k - 1, -1, -1):
                sums[at + j] += values
                times[at + j] += 1
                whole[at + j] &= known
            means = pa.array(sums / np.maximum(times, 1), mask=~whole)
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), means, mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([batch.column("name"), out], names=["name", "means"])

    named = seqs.select("name", counts.alias("counts"))
    return named.mapInArrow(run, T.StructType([named.schema["name"], T.StructField("means", T.ArrayType(T.DoubleType()))]))


def bound(value: Column, body) -> Column:
    """body(value) with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kmer_bias(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n, mean) of depth over the centres of circular k-mers, either strand's pooled; seqs: (seq, depths).

    Sequences of A, C, G and T are read a piece at a time, others a window at a time; sums are made before the shuffle.
    """
    turn = str.maketrans(sq.COMPLEMENT_FROM, sq.COMPLEMENT_TO)
    names = ["kmer", "n", "sum", "known"]

    def plain(data, bounds, low, starts, ends, values, known):
        """(number, value, whether there is one) of every window of rows of bases alone, from row `low` on."""
        size = np.diff(bounds)
        wide = np.concatenate([[0], np.cumsum(size + k - 1)])
        row = np.repeat(np.arange(len(size)), size + k - 1)
        place = np.arange(wide[-1]) - wide[row]
        for r, at, found in km.windows(data[bounds[row] + place % size[row]], wide, k):
            at = starts[low + r] + (at - wide[r] + k // 2) % size[r]
            there = at < ends[low + r]
            there[there] = known[at[there]]
            found = found.astype(np.int64)
            yield found, np.where(there, values[np.where(there, at, 0)], 0.0) if len(values) else np.zeros(len(found)), there

    def windows_of(text, own):
        """The same of a row of any characters, as (text, value or None)."""
        wrapped = text + text[: k - 1]
        for i in range(len(text)):
            kmer, at = wrapped[i : i + k], (i + k // 2) % len(text)
            yield min(kmer, kmer[::-1].translate(turn)), own[at] if own is not None and at < len(own) else None

    def out(numbers, columns):
        return pa.RecordBatch.from_arrays([km.texts(numbers, k), *columns], names=names)

    def run(batches):
        held = [np.zeros(4**k, t) for t in (np.int64, np.float64, np.int64)] if k <= km.DENSE else None
        odd = {}
        for batch in batches:
            data, bounds = km.text_bytes(batch.column("seq"))
            lists = batch.column("depths")
            inner = lists.values.cast(pa.float64())
            known = inner.is_valid().to_numpy(zero_copy_only=False)
            values = inner.fill_null(0.0).to_numpy(zero_copy_only=False)
            places = lists.offsets.to_numpy().astype(np.int64)
            starts, ends = places[:-1], np.where(lists.is_valid().to_numpy(zero_copy_only=False), places[1:], places[:-1])
            strange = np.concatenate([[0], np.cumsum(km.CAPITALS[data[bounds[0] : bounds[-1]]] > 3)])
            other = np.diff(strange[bounds - bounds[0]]) > 0 if k <= km.WIDEST else np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(other):
                for kmer, value in windows_of(batch.column("seq")[i].as_py(), lists[i].as_py()):
                    cell = odd.setdefault(kmer, [0, 0.0, 0])
                    cell[0] += 1
                    if value is not None:
                        cell[1] += float(value)
                        cell[2] += 1
                if len(odd) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), *map(pa.array, zip(*odd.values(), strict=True))], names=names)
                    odd = {}
            rows = np.flatnonzero(~other)
            if not len(rows):
                continue
            if len(rows) < batch.num_rows:
                data, bounds = km.text_bytes(batch.column("seq").take(pa.array(rows)))
                starts, ends = starts[rows], ends[rows]
            for low, high in km.pieces(bounds):
                for found, value, there in plain(data, bounds[low : high + 1], low, starts, ends, values, known):
                    if held is not None:
                        for whole, part in zip(held, (np.bincount(found, minlength=4**k), np.bincount(found, value, 4**k), np.bincount(found[there], minlength=4**k)), strict=True):
                            whole += part
                        continue
                    kinds, at = np.unique(found, return_inverse=True)
                    yield out(kinds, [pa.array(np.bincount(at)), pa.array(np.bincount(at, value)), pa.array(np.bincount(at, there).astype(np.int64))])
        if held is not None:
            there = np.flatnonzero(held[0])
            yield out(there, [pa.array(x[there]) for x in held])
        if odd:
            yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), *map(pa.array, zip(*odd.values(), strict=True))], names=names)

    pooled = seqs.where(F.length("seq") >= k).select("seq", "depths").mapInArrow(run, "kmer string, n bigint, sum double, known bigint")
    return pooled.groupBy("kmer").agg(F.sum("n").alias("n"), (F.sum("sum") / F.nullif(F.sum("known"), F.lit(0))).alias("mean"))


def numbered_names(features: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The second and later features of a name, in order, get /2, /3 ..."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return features.withColumn("_k", k).withColumn(name, F.when(F.col("_k") > 1, F.concat(name, F.lit("/"), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_k")


def selected_names(seqs: DataFrame, only: list[str]) -> DataFrame:
    """The sequences of these names, all if there are none."""
    return seqs.where(F.col("name").isin(*only)) if only else seqs


def styled(features: DataFrame, typ: str | Column, color: str | None = None) -> DataFrame:
    """Features with attributes `attr` and type `typ`: a colour and an ID where they have none."""
    extra = {"ID": ann.feature_id(F.col("attr"), F.col("typ"), F.col("seqid").cast("string"), F.col("s0"), F.col("e0"), F.col("strand"))} | ({"color": F.lit(color)} if color else {})
    out = features.where(F.col("typ") == typ)
    for key, value in extra.items():
        out = out.withColumn("attr", F.when(F.map_contains_key("attr", key), F.col("attr")).otherwise(F.map_concat("attr", F.create_map(F.lit(key), value))))
    return out


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, missing columns null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def distinct_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each span once."""
    return spans.select(*keys, "start", "end").distinct()


def depth_limited(alns: DataFrame, keys: list[str], depth: int = 100) -> DataFrame:
    """Alignments in the order of their start (then end and rid), each admitted if fewer than `depth` admitted ones still cover its start.

    The decision depends on all that came before, so a sequence is one stream; it passes through its task sorted (and
    spilled) by Spark and read a batch at a time. Only the ends of at most `depth` admitted alignments are held.
    """
    names = [*keys, "s0", "e0"]

    def run(batches):
        last, ends = None, []
        for batch in batches:
            keep = []
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                *key, start, end = row
                if key != last:
                    last, ends = key, []
                while ends and ends[0] <= start:
                    heapq.heappop(ends)
                keep.append(len(ends) < depth)
                if keep[-1]:
                    heapq.heappush(ends, end)
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return alns.repartition(*keys).sortWithinPartitions(*keys, "s0", "e0", "rid").mapInArrow(run, alns.schema)


def pair_by_mate(hits: DataFrame, fragment: list[str]) -> DataFrame:
    """Hits (rid, seqid, s0, e0, mate_seqid, mate_s0) whose mate fields name each other, each used once in the order of rid, then end: (fragment, first, second, s0, e0).

    The two places are brought into one order, so that both partners have the same key; the k-th of one side meets the
    k-th of the other. Where both places are the same, the odd and even ones meet.
    """
    own, mate = F.struct("seqid", "s0"), F.struct(F.col("mate_seqid").alias("seqid"), F.col("mate_s0").alias("s0"))
    side = F.when(own < mate, 0).when(own > mate, 1)
    at = hits.withColumns({"_lo": F.least(own, mate), "_hi": F.greatest(own, mate), "_side": side})
    k = F.row_number().over(Window.partitionBy(*fragment, "_lo", "_hi", "_side").orderBy("rid", "e0")) - 1
    ranked = at.withColumn("_k", k)
    ranked = ranked.withColumns({"_side": F.coalesce("_side", F.col("_k") % 2), "_k": F.when(F.col("_side").isNull(), F.floor(F.col("_k") / 2)).otherwise(F.col("_k"))})
    sides = [ranked.where(F.col("_side") == s).select(*fragment, "_lo", "_hi", "_k", F.col("rid").alias(n), F.col("s0").alias(f"_s{s}"), F.col("e0").alias(f"_e{s}")) for s, n in ((0, "first"), (1, "second"))]
    return sides[0].join(sides[1], [*fragment, "_lo", "_hi", "_k"]).select(*fragment, "first", "second", F.least("_s0", "_s1").alias("s0"), F.greatest("_e0", "_e1").alias("e0"))
