"""Comparison of samples over variant records, sequences with their variants put in, the best of several alignments at each base."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe import selection
from helixframe.functions import variants as vr
from helixframe.operators import kmers as km

REFERENCE = "reference"


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.try_cast("bigint"))


def nway_records(records: DataFrame, samples: list[str], required: list[str] = (), only_snps: bool = False, effect_filter: str = "all") -> DataFrame:
    """Records (chrom, pos, ref, alt, info, samples) at which two samples differ, with arrays in the samples' order.

    Adds variants, genotypes, counts and qualities; the sample `reference` has the reference's allele once, and no
    quality. Kept are records all of whose `required` samples are called, with one-base variants only where asked, and
    with an effect that the filter selects; a record without effects counts as one without tags. It moves no rows.
    """
    field = lambda s, k: F.col("samples")[s][k]
    gts = [F.array(F.lit(0)) if s == REFERENCE else vr.genotype(field(s, "GT")) for s in samples]
    counts = [F.array(F.lit(1).cast("bigint")) if s == REFERENCE else F.concat(_numbers(field(s, "RO")), _numbers(field(s, "AO"))) for s in samples]
    gqs = [F.lit(None).cast("double") if s == REFERENCE else field(s, "GQ").try_cast("double") for s in samples]
    out = records.withColumns({"variants": F.concat(F.array("ref"), "alt"), "genotypes": F.array(*gts), "counts": F.array(*counts), "qualities": F.array(*gqs), "effects": vr.effects(F.col("info")["EFF"])})
    known = F.filter("genotypes", lambda g: g.isNotNull())
    # equality of mixtures is transitive, so that one different from the first is enough
    out = out.where(F.exists(known, lambda g: ~vr.equal_genotypes(g, F.get(known, F.lit(0)))))
    for s in required:
        out = out.where(F.get("genotypes", F.lit(samples.index(s))).isNotNull())
    if only_snps:
        out = out.where(F.forall(F.flatten(known), lambda i: F.length(F.get("variants", i)) == 1))
    tags = F.when(F.size("effects") > 0, F.transform("effects", lambda e: e["tags"])).otherwise(F.array(F.array().cast("array<string>")))
    return out.where(F.exists(tags, lambda t: selection.selects(effect_filter, t)))


def nway_table(kept: DataFrame, samples: list[str], effect_show: str = "all") -> DataFrame:
    """G16 (the table; VCF is not written): a row a record with each sample's genotype, quality and counts as texts, and the effects to be shown."""
    at = lambda column, i: F.get(column, F.lit(i))
    columns = []
    for i, s in enumerate(samples):
        columns += [vr.describe_genotype(at("genotypes", i), F.col("variants")).alias(f"genotype_{s}"), at("qualities", i).alias(f"quality_{s}"), F.coalesce(vr.describe_counts(at("counts", i), F.col("variants")), F.lit("")).alias(f"count_{s}")]
    shown = F.transform(F.filter("effects", lambda e: selection.selects(effect_show, e["tags"])), lambda e: e["description"])
    return kept.select("chrom", "pos", *columns, F.array_join(shown, " /// ").alias("effects"))


def nway_nexus(kept: DataFrame, samples: list[str], block: int = 1 << 16) -> DataFrame:
    """(chrom, block, sample, characters): each sample's haploid alleles in the order of positions, in stretches of `block` positions.

    A base stands for itself where all variants of a record are bases; else alleles are digits. Unknown ones are N.
    Genotypes of more alleles and records of more than ten variants are errors.
    """
    bases = F.forall("variants", lambda v: v.isin("A", "C", "G", "T"))

    def letter(gt: Column) -> Column:
        wrong = (F.size(gt) != 1) | (F.size("variants") > 10)
        allele = F.get(gt, F.lit(0))
        return F.when(gt.isNull(), "N").when(wrong, F.raise_error(F.lit("nexus output takes one allele a sample and ten variants a record at most")).cast("string")).when(bases, F.get("variants", allele)).otherwise(allele.cast("string"))

    rows = kept.select("chrom", F.floor(F.col("pos") / block).alias("block"), F.struct("pos", "variants", F.transform("genotypes", letter).alias("letters")).alias("x"))
    whole = rows.groupBy("chrom", "block").agg(F.array_sort(F.collect_list("x")).alias("all"))
    text_of = lambda i: F.array_join(F.transform("all", lambda x: F.get(x["letters"], F.lit(i))), "")
    texts = [text_of(i) for i in range(len(samples))]
    return whole.select("chrom", "block", F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), t.alias("characters")) for s, t in zip(samples, texts, strict=True)])).alias("y")).select("chrom", "block", "y.*")


def patched(seqs: DataFrame, records: DataFrame, samples: list[str]) -> DataFrame:
    """(name, sample, seq): each sequence with each sample's haploid variants put in, the reference's text where none is called.

    Errors: genotypes that are no single number, variants of other letters than ACGTN or that overlap, a REF that the
    sequence does not have, a record of a sequence that is not there. What is gathered is one sequence's variants.
    """
    calls = records.select(F.col("chrom").alias("name"), "pos", "ref", "alt", F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col("samples")[s]["GT"].alias("gt")) for s in samples])).alias("c"))
    calls = calls.where(F.col("c.gt").isNotNull() & (F.col("c.gt") != "."))
    number = F.when(F.col("c.gt").rlike("^[0-9]+$"), F.col("c.gt").cast("int")).otherwise(F.raise_error(F.concat(F.lit("genotype is not haploid: "), F.col("c.gt"))).cast("int"))
    text = F.when(number == 0, F.col("ref")).otherwise(F.get("alt", number - 1))
    text = F.when(text.rlike("^[ACGTN]*$") | (number == 0), text).otherwise(F.raise_error(F.lit("unsupported kind of variant")).cast("string"))
    entries = calls.groupBy("name", "c.sample").agg(F.array_sort(F.collect_list(F.struct((F.col("pos") - 1).cast("int").alias("at"), (F.col("pos") - 1 + F.length("ref")).cast("int").alias("end"), "ref", text.alias("text")))).alias("v"))
    each = seqs.select("name", F.col("seq").cast("binary").alias("b"), F.explode(F.array(*[F.lit(s) for s in samples])).alias("sample"))
    both = each.join(entries, ["name", "sample"], "full").withColumn("v", F.coalesce("v", F.array().cast("array<struct<at:int,end:int,ref:string,text:string>>")))
    part = lambda a, n: F.substring("b", a + 1, n).cast("string")

    def piece(x, i):
        last = F.when(i > 0, F.get("v", i - 1)["end"]).otherwise(0)
        fails = lambda m: F.raise_error(F.concat(F.lit(m + " at "), x["at"].cast("string"))).cast("string")
        return F.when(x["at"] < last, fails("variants overlap")).when(F.upper(part(x["at"], x["end"] - x["at"])) != x["ref"], fails("REF is not the sequence's")).otherwise(F.concat(part(last, x["at"] - last), x["text"]))

    tail = F.coalesce(F.get("v", F.size("v") - 1)["end"], F.lit(0))
    whole = F.concat(F.array_join(F.transform("v", piece), ""), part(tail, F.octet_length("b")))
    missing = F.raise_error(F.concat(F.lit("no sequence "), F.col("name").cast("string"))).cast("string")
    return both.select("name", "sample", F.when(F.col("b").isNull() & (F.size("v") > 0), missing).otherwise(whole).alias("seq"))


def best_cover(alns: DataFrame, keys: list[str], identity: str, block: int = 1 << 14) -> DataFrame:
    """(keys, first, n, identity): stretches of bases whose best alignment (s0, e0, score) is the same one, the least identity of ties; what it leaves over of an alignment is not given.

    Alignments are dealt to blocks of the coordinate and painted there from the worst to the best as Spark sorts them, so
    that no row is made of each base; stretches of one identity that meet, at the end of a block or else, are joined.
    """
    own = alns.where("e0 > s0").select(*keys, "score", identity, "s0", "e0")
    dealt = own.withColumn("_block", F.explode(F.sequence(F.floor(F.col("s0") / block), F.floor((F.col("e0") - 1) / block))))
    ordered = dealt.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", F.asc_nulls_first("score"), F.desc(identity))
    types = [alns.schema[c] for c in (*keys, identity)]
    schema = T.StructType([*types[:-1], T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), types[-1]])

    def run(batches):
        last, owner, names = None, np.full(block, -1, np.int32), []
        key_types = {}

        def stretches():
            cuts = np.flatnonzero(np.diff(owner, prepend=-2))
            ends = np.append(cuts[1:], block)
            there = owner[cuts] >= 0
            cuts, ends, base = cuts[there], ends[there], last[-1] * block
            held = [pa.array([v] * len(cuts), key_types[c]) for c, v in zip(keys, last[:-1], strict=True)]
            return pa.RecordBatch.from_arrays([*held, pa.array(cuts + base), pa.array(ends + base), pa.concat_arrays(names).take(pa.array(owner[cuts]))], names=schema.names)

        for batch in batches:
            group, _ = km.groups_of(batch, [*keys, "_block"])
            base = batch.column("_block").to_numpy() * block
            low = np.maximum(batch.column("s0").to_numpy() - base, 0).tolist()
            high = np.minimum(batch.column("e0").to_numpy() - base, block).tolist()
            key_types = {c: batch.column(c).type for c in keys}
            starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            for start, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = tuple(batch.column(c)[start].as_py() for c in (*keys, "_block"))
                if key != last:
                    if last is not None:
                        yield stretches()
                    last, names = key, []
                    owner[:] = -1
                number = sum(map(len, names))
                names.append(batch.column(identity).slice(start, stop - start))
                for i, (a, b) in enumerate(zip(low[start:stop], high[start:stop], strict=True), number):
                    owner[a:b] = i
        if last is not None:
            yield stretches()

    one = Window.partitionBy(*keys, identity).orderBy("first")
    found = ordered.mapInArrow(run, schema).withColumn("_opens", F.when(F.lag("end").over(one) == F.col("first"), 0).otherwise(1))
    whole = found.withColumn("_run", F.sum("_opens").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.groupBy(*keys, identity, "_run").agg(F.min("first").alias("first"), F.sum(F.col("end") - F.col("first")).alias("n")).select(*keys, "first", "n", identity)


def by_place(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """O1, O2: the alignments of all parts together, in the order of the keys: dealt by ranges, each sorted (and spilled) on its own."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy(*keys)
