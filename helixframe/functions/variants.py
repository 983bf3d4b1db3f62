"""Genotypes, effects and small texts as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Effect impacts from the gravest on, and the fields of an effect.
IMPACTS = ["HIGH", "MODERATE", "LOW", "MODIFIER"]
FIELDS = ["Effect_Impact", "Functional_Class", "Codon_Change", "Amino_Acid_change", "Amino_Acid_length", "Gene_Name", "Gene_BioType", "Coding", "Transcript", "Exon", "ERRORS", "WARNINGS"]


def genotype(text: Column) -> Column:
    """Alleles of a text such as 0/1, sorted; null if it is missing or has a `.`."""
    return F.when(text.isNotNull() & ~text.contains("."), F.array_sort(F.transform(F.split(text, "/"), lambda x: x.cast("int"))))


def equal_genotypes(a: Column, b: Column) -> Column:
    """Whether sorted genotypes are the same mixture, also of different ploidy; an unknown one equals none.

    Two mixtures are the same if each allele has the same share in both, so both are repeated to the product of sizes.
    """
    long = lambda x, y: F.array_sort(F.flatten(F.array_repeat(x, F.size(y))))
    return F.coalesce(long(a, b) == long(b, a), F.lit(False))


def describe_genotype(gt: Column, variants: Column) -> Column:
    """The alleles' texts joined by /, `?` for none."""
    return F.coalesce(F.array_join(F.transform(gt, lambda i: F.get(variants, i)), "/"), F.lit("?"))


def describe_counts(counts: Column, variants: Column) -> Column:
    """G18: "NxVariant ..." by falling count, then index, without zeros; empty if a count is missing."""
    pairs = F.transform(counts, lambda n, i: F.struct((-n).alias("m"), i.alias("i")))
    shown = F.filter(F.array_sort(pairs), lambda p: p["m"] != 0)
    text = F.array_join(F.transform(shown, lambda p: F.concat((-p["m"]).cast("string"), F.lit("x"), F.get(variants, p["i"]))), " ")
    return F.when(F.forall(counts, lambda n: n.isNotNull()), text).otherwise("")


def effects(text: Column) -> Column:
    """Effects `Name(IMPACT|class|...)`, comma-separated, as structs (priority, order, description, tags), gravest first."""
    items = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")

    def one(x, i):
        head, parts = F.substring_index(x, "(", 1), F.split(F.regexp_extract(x, r"\((.*)\)$", 1), r"\|")
        parts = F.transform(parts, lambda p: F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
        named = F.transform(parts, lambda p, k: F.when(p != "", F.concat(F.lit(" "), F.get(F.array(*map(F.lit, FIELDS)), k), F.lit("="), p)).otherwise(""))
        priority = F.array_position(F.array(*map(F.lit, IMPACTS)), F.get(parts, F.lit(0)))
        tags = F.filter(F.array(head, F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), lambda t: t.isNotNull() & (t != ""))
        return F.struct(priority.alias("priority"), i.alias("order"), F.concat(head, F.array_join(named, "")).alias("description"), tags.alias("tags"))

    return F.array_sort(F.transform(items, one))


def friendly_name(text: Column) -> Column:
    """the characters '"<>&|/\\_ . as underscores."""
    return F.translate(text, "'\"<>&|/\\_ .", "_" * 11)


def pad_slice(text: Column, start: Column, end: Column, pad: str = "N") -> Column:
    """text[start:end] as if the text went on as `pad` at both ends."""
    n = F.length(text)
    left = F.greatest(F.lit(0), F.least(end, F.lit(0)) - start)
    right = F.greatest(F.lit(0), end - F.greatest(start, n))
    a, b = F.greatest(F.lit(0), start), F.least(n, end)
    return F.concat(F.repeat(F.lit(pad), left), F.substring(text, a + 1, F.greatest(F.lit(0), b - a)), F.repeat(F.lit(pad), right))


def graphlet(values: Column) -> Column:
    """one character a value, `_` for 0 and then 0 to 9 by tenths of the greatest, rounded up."""
    peak = F.greatest(F.lit(1), F.array_max(values))
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit("_0123456789"), F.least(F.lit(10), F.floor((v * 10 + peak - 1) / peak).cast("int")) + 1, F.lit(1))), "")


def pretty_number(n: Column, width: int = 0) -> Column:
    """A whole number with thousands separated, padded on the left."""
    text = F.format_number(n, 0)
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))
