"""Pile-up evidence, consensus calls, comparison of samples at sites, genotypes."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import sam
from helixframe.functions.seq import ambiguity_code
from helixframe.functions.stats import incomplete_beta
from helixframe.operators import kmers as km
from helixframe.operators.ordered import with_neighbour

#: Calls that stand for no single base.
AMBIGUOUS = ["N", "R", "Y", "S", "W", "K", "M", "B", "D", "H", "V"]


def pile_up(alns: DataFrame, keys: list[str], trim: int = 0, block: int = 1 << 14) -> DataFrame:
    """A2: counts of observed items (keys, pos, is_insertion, item, n) from alignments (s0, cigar, seq).

    M, = and X give bases, D gives `-`, I the inserted string before a position; S and H are passed over. `trim` leaves
    out items so near either end of an alignment. Alignments are dealt to blocks of the coordinate and counted there, the
    alignments of one CIGAR together, so that no row is made of each base.
    """
    span = sam.reference_length(F.col("cigar"))
    own = alns.select(*keys, "s0", "cigar", "seq", F.explode(F.sequence(F.floor(F.col("s0") / block), F.floor((F.col("s0") + span) / block))).alias("_block"))
    schema = T.StructType([*(alns.schema[c] for c in keys), alns.select(F.col("s0") + F.lit(0)).schema[0], T.StructField("is_insertion", T.BooleanType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])
    names = [*keys, "pos", "is_insertion", "item", "n"]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema, strict=True)])
    known = {}

    def placed(cigar):
        """Operations (op, n, ref, read) and the length on the reference."""
        if cigar not in known:
            if len(known) > 100_000:
                known.clear()
            ref, read, ops = 0, 0, []
            for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
                ops.append((op, int(n), ref, read))
                ref += int(n) * (op in "MDNP=X")
                read += int(n) * (op in "MIS=X")
            known[cigar] = ops, ref
        return known[cigar]

    def out(types, key, base, codes, n, rest):
        """The items of one block: codes are the place in the block and a byte, 0 for no item; rest has others."""
        places, letters = codes >> 8, codes & 255
        table = pa.array(["", *map(chr, range(1, 128))])
        items = pa.concat_arrays([table.take(pa.array(letters)), pa.array([k[2] for k in rest], pa.string())])
        where = np.concatenate([places + base, np.array([k[0] for k in rest], np.int64)])
        inserted = pa.array([False] * len(codes) + [k[1] for k in rest], pa.bool_())
        held = [pa.array([v] * len(where), t) for v, t in zip(key, types, strict=True)]
        return pa.RecordBatch.from_arrays([*held, pa.array(where, place_type), inserted, items, pa.array(np.concatenate([n, np.array(list(rest.values()), np.int64)]), pa.int64())], names=names)

    place_type = {"bigint": pa.int64(), "int": pa.int32()}[schema["pos"].dataType.simpleString()]

    def counted(batch, group):
        """(group, code) of the bases of a batch, each piece of them, and the other items as a Counter of (group, pos, is_insertion, item)."""
        data, bounds = km.text_bytes(batch.column("seq"))
        start, low = batch.column("s0").to_numpy().astype(np.int64), batch.column("_block").to_numpy() * block
        size = np.diff(bounds)
        wide = np.concatenate([[0], np.cumsum((data[bounds[0] : bounds[-1]] > 127) | (data[bounds[0] : bounds[-1]] == 0))])
        odd = (np.diff(wide[bounds - bounds[0]]) > 0) | batch.column("seq").is_null().to_numpy(zero_copy_only=False)
        coded = batch.column("cigar").dictionary_encode()
        kind = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(len(coded.dictionary) + 1))
        rest, found = Counter(), []
        for c, cigar in enumerate(coded.dictionary.to_pylist()):
            ops, length = placed(cigar)
            rows = order[cuts[c] : cuts[c + 1]]
            plain = rows[~odd[rows]]
            for op, n, ref, read in ops:
                if op == "I" and trim < ref <= length - trim:
                    for i in rows.tolist():
                        if 0 <= start[i] + ref - low[i] < block:
                            text = batch.column("seq")[i].as_py()
                            rest[group[i], int(start[i] + ref), True, None if text is None else text[read : read + n]] += 1
                if op not in "M=XD":
                    continue
                # the part of the operation within the trimmed ends, some rows and bases at a time
                a, b = max(ref, trim) - ref, min(ref + n, length - trim) - ref
                for x in range(a, b, 1 << 12):
                    step = np.arange(x, min(b, x + (1 << 12)))
                    for y in range(0, len(plain), max(1, (1 << 20) // len(step))):
                        some = plain[y : y + max(1, (1 << 20) // len(step))]
                        at = (start[some] + ref - low[some])[:, None] + step
                        within = (at >= 0) & (at < block)
                        if op == "D":
                            letter = np.full(at.shape, ord("-"))
                        else:
                            there = (read + step)[None, :] < size[some][:, None]
                            place = bounds[some][:, None] + read + step
                            letter = np.where(there, data[np.where(there, place, 0)], 0) if len(data) else np.zeros(at.shape, np.int64)
                        code = (group[some][:, None] * block + at) * 256 + letter
                        found.append(np.unique(code[within], return_counts=True))
                for i in rows[odd[rows]].tolist():
                    text = batch.column("seq")[i].as_py()
                    for j in range(a, b):
                        if 0 <= start[i] + ref + j - low[i] < block:
                            item = "-" if op == "D" else None if text is None else text[read + j : read + j + 1]
                            if item is None or len(item) and not 0 < ord(item) < 128:
                                rest[group[i], int(start[i] + ref + j), False, item] += 1
                            else:
                                code = (group[i] * block + start[i] + ref + j - low[i]) * 256 + (ord(item) if item else 0)
                                found.append((np.array([code]), np.array([1])))
        return found, rest

    def merged(found):
        """(codes, counts) with each code once."""
        codes, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first], np.add.reduceat(n, first) if len(first) else n

    def run(batches):
        last, found, rest, types = None, [], Counter(), []
        for batch in batches:
            group, first = km.groups_of(batch, [*keys, "_block"])
            group = group.astype(np.int64)
            # groups in the order they come
            place = np.argsort(np.argsort(first))
            group, first = place[group], np.sort(first)
            types = [batch.column(c).type for c in keys]
            parts, others = counted(batch, group)
            codes, n = merged(parts)
            cuts = np.searchsorted(codes, np.arange(len(first) + 1) * (block * 256))
            own = [Counter() for _ in first]
            for (g, *item), times in others.items():
                own[g][tuple(item)] += times
            for g, at in enumerate(first.tolist()):
                key = tuple(batch.column(c)[at].as_py() for c in (*keys, "_block"))
                if key != last:
                    if last is not None:
                        yield out(types, last[:-1], last[-1] * block, *merged(found), rest)
                    last, found, rest = key, [], Counter()
                found.append((codes[cuts[g] : cuts[g + 1]] - g * block * 256, n[cuts[g] : cuts[g + 1]]))
                if len(found) > 1:
                    found = [merged(found)]
                rest.update(own[g])
        if last is not None:
            yield out(types, last[:-1], last[-1] * block, *merged(found), rest)

    return own.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block").mapInArrow(run, schema)


def evidence(observed: DataFrame, keys: list[str]) -> DataFrame:
    """A3: (keys, evidence, total): items by falling count, of equal ones that which got there first, as structs (item, n)."""
    items = observed.groupBy(*keys, "item").agg(F.sum("n").alias("n"), F.max("ord").alias("last"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "last", "item")))
    return items.groupBy(*keys).agg(F.transform(ordered, lambda x: F.struct(x["item"].alias("item"), (-x["m"]).alias("n"))).alias("evidence"), F.sum("n").alias("total"))


def represent(found: Column) -> Column:
    """evidence as text such as `Ax3 -x1`."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["item"], F.lit("x"), x["n"].cast("string"))), " ")


def implied_absence(observed: DataFrame, keys: list[str]) -> DataFrame:
    """A4: (keys, pos, n) of readings without insertion that depth implies: the lesser depth of a site and the one before, less its insertions."""
    depth = observed.groupBy(*keys, "pos").agg(F.sum(F.when(~F.col("is_insertion"), F.col("n")).otherwise(0)).alias("depth"), F.sum(F.when(F.col("is_insertion"), F.col("n")).otherwise(0)).alias("inserted"))
    near = with_neighbour(depth, keys, "pos", {"_p": F.col("pos"), "_d": F.col("depth")}, False)
    before = F.when(F.col("pos") == 0, F.col("depth")).when(F.col("_p") == F.col("pos") - 1, F.col("_d")).otherwise(0)
    return near.withColumn("n", F.least("depth", before) - F.col("inserted")).where("n > 0").select(*keys, "pos", "n")


def _tail(pairs: DataFrame, q: float) -> DataFrame:
    """Adds miss, the chance that a proportion is below q, for each (x, m): computed once for each distinct pair."""
    distinct = pairs.select("x", "m").distinct()
    return pairs.join(distinct.withColumn("miss", incomplete_beta(F.col("x").cast("double"), F.col("m") - F.col("x"), F.lit(q))), ["x", "m"])


def majority_calls(found: DataFrame, cutoff: float = 0.99, indel_prior: float = 0.2, weight: float = 1.0, majority: float = 0.5, prior_of=None) -> DataFrame:
    """Adds call (null below the cutoff) and p, the posterior probability that the first item has the majority.

    prior_of: gives an item's prior weight where it is not that of a base or gap.
    """
    top = F.element_at("evidence", 1)
    prior = prior_of(top["item"]) if prior_of else F.when(top["item"] == "-", indel_prior * weight).otherwise((weight - indel_prior * weight) / 4)
    pairs = found.withColumn("x", F.round(top["n"] + prior, 6)).withColumn("m", F.round(F.col("total") + weight, 6))
    p = 1 - F.col("miss")
    return _tail(pairs, majority).withColumn("call", F.when(p >= cutoff, top["item"])).withColumn("p", F.when(p >= cutoff, p).otherwise(1.0)).drop("x", "m", "miss")


def ambiguity_calls(found: DataFrame, cutoff: float = 0.99, indel_prior: float = 0.2, weight: float = 1.0, majority: float = 0.5) -> DataFrame:
    """Adds call, the code of the first items that together reach the cutoff, ties with the last included; null if none do."""
    prior = lambda item: F.when(item == "-", indel_prior * weight).otherwise((weight - indel_prior * weight) / 4)
    steps = found.withColumn("_row", F.struct(*found.columns)).select("_row", "total", F.posexplode("evidence").alias("_k", "_x"))
    upto = F.aggregate(F.slice(F.col("_row.evidence"), F.lit(1), F.col("_k") + 1), F.lit(0.0), lambda acc, x: acc + x["n"] + prior(x["item"]))
    tested = _tail(steps.withColumn("x", F.round(F.least(upto, F.col("total") + weight), 6)).withColumn("m", F.round(F.col("total") + weight, 6)), majority)
    reached = tested.where(1 - F.col("miss") >= cutoff).groupBy("_row").agg(F.min_by(F.col("_x.n"), F.col("_k")).alias("least"))
    code = ambiguity_code(F.transform(F.filter("_row.evidence", lambda x: x["n"] >= F.col("least")), lambda x: x["item"]))
    only_gap = (F.size("_row.evidence") > 0) & (F.size(F.filter("_row.evidence", lambda x: x["n"] >= F.col("least"))) == 1)
    call = F.when(only_gap, F.col("_row.evidence")[0]["item"]).otherwise(code)
    out = reached.select("_row.*", call.alias("call"))
    keys = [c for c in found.columns if c not in ("evidence", "total")]
    return found.join(out.select(*keys, "call"), keys, "left")


def pure_call(found: Column, total: Column, min_depth: int, min_purity: float) -> Column:
    """The first item if it has the depth and share."""
    top = F.element_at(found, 1)
    return F.when((top["n"] >= min_depth) & (top["n"] >= min_purity * total), top["item"])


def partition_string(calls: Column) -> Column:
    """Calls as one character each: bases and gaps as they are, N for ambiguous ones, others 0, 1, ... in the order they come."""
    other = F.array_distinct(F.filter(calls, lambda c: ~c.isin("A", "C", "G", "T", "-", *AMBIGUOUS)))
    return F.array_join(F.transform(calls, lambda c: F.when(c.isin("A", "C", "G", "T", "-"), c).when(c.isin(*AMBIGUOUS), "N").otherwise(F.chr(F.lit(47) + F.array_position(other, c)))), "")


def clear_calls(calls: Column) -> Column:
    """The distinct unambiguous calls."""
    return F.array_distinct(F.filter(calls, lambda c: ~c.isin(*AMBIGUOUS)))


def change_type(calls: Column, is_insertion: Column) -> Column:
    """What differs at a site; empty if nothing does."""
    clear = clear_calls(calls)
    return F.when(F.size(clear) <= 1, "").when(is_insertion, "insertion-before").when(F.array_contains(clear, "-"), "deletion").otherwise("substitution")


def interesting(calls: Column) -> Column:
    """Two different unambiguous calls at least."""
    return F.size(clear_calls(calls)) >= 2


def splits(calls: Column, a: list[int], b: list[int]) -> Column:
    """No ambiguity in either group of samples (by index) and no call in both."""
    of = lambda group: F.array(*[F.get(calls, F.lit(i)) for i in group])
    return F.forall(F.concat(of(a), of(b)), lambda c: ~c.isin(*AMBIGUOUS)) & ~F.arrays_overlap(of(a), of(b))


def nway(called: DataFrame, site: list[str], sample: str, samples: list) -> DataFrame:
    """One row a site with the calls of all samples in order, N where a sample has none."""
    at = [F.coalesce(F.max(F.when(F.col(sample) == s, F.col("call"))), F.lit("N")) for s in samples]
    return called.groupBy(*site).agg(F.array(*at).alias("calls"))


def genotypes(counted: DataFrame, prior: float = 0.2, total_prior: float = 1.0, majority: float = 0.5, min_gq: float = 20.0, most: float = 100.0) -> DataFrame:
    """Adds gt (allele of the greatest count, the first of ties; `.` below min_gq or with missing counts) and gq from `counts`, an array."""
    whole = F.forall("counts", lambda c: c.isNotNull())
    top = F.array_max("counts")
    x = F.round(F.when(whole, top) + prior, 6)
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    pairs = counted.withColumn("x", x).withColumn("m", F.round(total + F.greatest(F.lit(total_prior), prior * F.size("counts")), 6))
    scored = _tail(pairs.where("x is not null"), majority).withColumn("gq", F.least(F.lit(most), -10 * F.log10("miss")))
    scored = scored.withColumn("gq", F.when(F.col("miss") <= 0, most).otherwise(F.col("gq")))
    failed = pairs.where("x is null").select("*", F.lit(None).cast("double").alias("miss"), F.lit(0.0).alias("gq"))
    both = scored.unionByName(failed.select(*scored.columns))
    allele = F.when(F.col("x").isNull() | (F.col("gq") < min_gq), ".").otherwise((F.array_position("counts", top) - 1).cast("string"))
    return both.withColumn("gt", allele).drop("x", "m", "miss")


def reduce_ploidy(alleles: Column, ploidy: int) -> Column:
    """Blocks of equal alleles as one each, `.` for all if a block differs; an error if the number does not divide."""
    stride = F.floor(F.size(alleles) / ploidy).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(ploidy - 1)), lambda i: F.slice(alleles, i * stride + 1, stride))
    same = F.forall(blocks, lambda b: F.size(F.array_distinct(b)) == 1)
    text = F.array_join(F.transform(blocks, lambda b: b[0].cast("string")), "/")
    return F.when(F.size(alleles) % ploidy != 0, F.raise_error(F.lit(f"cannot reduce to ploidy {ploidy}")).cast("string")).when(same, text).otherwise("/".join("." * ploidy))
