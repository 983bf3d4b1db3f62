"""Sequence functions as Column expressions: complement, ambiguity codes, k-mers, translation, slicing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes with the bases they stand for, and their complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT_FROM = "ABCDGHKMRSTVWYabcdghkmrstvwy"
COMPLEMENT_TO = "TVGHCDMKYSABWRtvghcdmkysabwr"
# The standard genetic code, codons in the order TCAG by first, second and third base.
CODE_BASES = "TCAG"
CODE_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(seq: Column) -> Column:
    """reverse complement with IUPAC codes, keeping case."""
    return F.translate(F.reverse(seq), COMPLEMENT_FROM, COMPLEMENT_TO)


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])


def base_bits(base: Column) -> Column:
    """The bases a code may be, as bits ACGT = 1, 2, 4, 8; null for other characters."""
    return F.element_at(_map({k: sum(1 << "ACGT".index(b) for b in v) for k, v in IUPAC.items()}), base)


def might_be_same_base(a: Column, b: Column) -> Column:
    """whether two codes may stand for one base; other characters must be equal."""
    return F.coalesce(base_bits(a).bitwiseAND(base_bits(b)) > 0, a == b)


def might_be_same(a: Column, b: Column) -> Column:
    """the same for sequences of equal length."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return (F.length(a) == F.length(b)) & F.forall(F.zip_with(chars(a), chars(b), lambda x, y: F.coalesce(might_be_same_base(x, y), F.lit(False))), lambda x: x)


def might_be_same_amino(a: Column, b: Column) -> Column:
    """amino acids, of which X may be any, B is D or N and Z is E or Q."""
    wide = lambda x, y: ((x == "B") & y.isin("D", "N")) | ((x == "Z") & y.isin("E", "Q"))
    return (a == b) | (a == "X") | (b == "X") | wide(a, b) | wide(b, a)


def ambiguity_code(bases: Column) -> Column:
    """the code of an array of bases; null if one of them is no base or there is none."""
    bits = F.aggregate(F.array_distinct(bases), F.lit(0), lambda acc, b: acc + F.element_at(_map({"A": 1, "C": 2, "G": 4, "T": 8}), b))
    return F.element_at(_map({sum(1 << "ACGT".index(b) for b in v): k for k, v in IUPAC.items()}), bits)


def ambiguity_bases(code: Column) -> Column:
    """the sorted bases of a code."""
    return F.filter(F.split(F.element_at(_map(IUPAC), code), ""), lambda b: b != "")


def canonical(kmer: Column) -> Column:
    """the lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def sign(kmer: Column) -> Column:
    """1 for canonical, -1 for not, 0 for a palindrome."""
    other = reverse_complement(kmer)
    return F.when(kmer < other, 1).when(kmer > other, -1).otherwise(0)


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence over ACGT alone (A15): windows that hold another character are left out."""

    def of(piece: Column) -> Column:
        # slices of bytes, since a substring of text is counted from its start
        slices = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - k + 1), lambda i: F.substring(b, i, F.lit(k)).cast("string"))
        return F.element_at(F.transform(F.array(piece.cast("binary")), slices), 1)

    pieces = F.filter(F.split(seq, "[^ACGT]+"), lambda p: F.octet_length(p) >= k)
    return F.coalesce(F.flatten(F.transform(pieces, of)), F.array().cast("array<string>"))


def canonical_kmers(seq: Column, k: int) -> Column:
    """The canonical form of each k-mer of `kmers`, the complement being made once for each stretch of ACGT."""

    def of(piece: Column) -> Column:
        n = F.octet_length(piece)
        both = F.struct(piece.cast("binary").alias("f"), reverse_complement(piece).cast("binary").alias("r"))
        each = lambda b: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.least(F.substring(b["f"], i, F.lit(k)), F.substring(b["r"], n - k + 2 - i, F.lit(k))).cast("string"))
        return F.element_at(F.transform(F.array(both), each), 1)

    return F.flatten(F.transform(F.filter(F.split(seq, "[^ACGT]+"), lambda p: F.octet_length(p) >= k), of))


def kmers_to_sequence(items: Column) -> Column:
    """the sequence of k-mers that overlap by all but one base; null for none."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x, i: F.when(i == 0, x).otherwise(F.right(x, F.lit(1)))), ""))


def successors(kmer: Column) -> Column:
    """The four k-mers that follow."""
    return F.array(*[F.concat(F.substring(kmer, F.lit(2), F.length(kmer)), F.lit(b)) for b in "ACGT"])


def predecessors(kmer: Column) -> Column:
    """The four k-mers that precede."""
    return F.array(*[F.concat(F.lit(b), F.substring(kmer, F.lit(1), F.length(kmer) - 1)) for b in "ACGT"])


def snp_neighbours(kmer: Column, k: int) -> Column:
    """The canonical forms of the 3k k-mers that differ in one base."""
    each = [F.concat(F.substring(kmer, 1, i), F.lit(b), F.substring(kmer, i + 2, k)) for i in range(k) for b in "ACGT"]
    return F.array_distinct(F.transform(F.filter(F.array(*each), lambda x: x != kmer), canonical))


def translate_codons(seq: Column, code: str = CODE_AMINO) -> Column:
    """amino acids of whole codons; codons with other characters give X."""
    table = {x + y + z: code[16 * i + 4 * j + k] for i, x in enumerate(CODE_BASES) for j, y in enumerate(CODE_BASES) for k, z in enumerate(CODE_BASES)}
    n = F.floor(F.octet_length(seq) / 3).cast("int")
    codons = lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.element_at(_map(table), F.substring(b, i * 3 + 1, F.lit(3)).cast("string")), F.lit("X")))
    one = F.element_at(F.transform(F.array(seq.cast("binary")), codons), 1)
    return F.when(n > 0, F.array_join(one, "")).otherwise(F.lit(""))


def slice_clamped(seq: Column, start: Column, end: Column) -> Column:
    """F16: the part [start, end) within the sequence; reverse complement if start is beyond end."""
    part = lambda a, b: F.substring(seq, F.greatest(a, F.lit(0)) + 1, F.greatest(F.least(b, F.length(seq)) - F.greatest(a, F.lit(0)), F.lit(0)))
    return F.when(start <= end, part(start, end)).otherwise(reverse_complement(part(end, start)))


def slice_padded(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """the part [start, end), padded with N beyond the ends, read on its strand."""
    left = F.repeat(F.lit("N"), F.greatest(F.lit(0), F.least(end, F.lit(0)) - start).cast("int"))
    right = F.repeat(F.lit("N"), F.greatest(F.lit(0), end - F.greatest(start, F.length(seq))).cast("int"))
    whole = F.concat(left, slice_clamped(seq, start, F.greatest(start, end)), right)
    return F.when(strand < 0, reverse_complement(whole)).otherwise(whole)


def longest_run(good: Column) -> Column:
    """Struct (start, length) of the first longest run of true in an array of booleans."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("start"), F.lit(0).alias("length"))

    def step(acc, x):
        run = F.when(x, acc["run"] + 1).otherwise(0)
        better = run > acc["length"]
        return F.struct((acc["at"] + 1).alias("at"), run.alias("run"), F.when(better, acc["at"] + 1 - run).otherwise(acc["start"]).alias("start"), F.greatest(run, acc["length"]).alias("length"))

    return F.aggregate(good, zero, step, lambda acc: F.struct(acc["start"].alias("start"), acc["length"].alias("length")))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
