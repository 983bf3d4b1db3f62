"""Feature functions as Column expressions: geometry on strands, ids, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(s: Column, e: Column, qs: Column, qe: Column) -> Column:
    """Whether [s, e) meets [qs, qe); a zero-width item is met by queries that hold its place."""
    return ((s < e) & (s < qe) & (e > qs)) | ((s == e) & (qs <= s) & (s < qe))


def five_prime(s: Column, e: Column, strand: Column) -> Column:
    """the start as read on the strand."""
    return F.when(strand < 0, e).otherwise(s)


def three_prime(s: Column, e: Column, strand: Column) -> Column:
    return F.when(strand < 0, s).otherwise(e)


def shifted(s: Column, e: Column, strand: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds with the start moved by `start` and the end by `end` along the strand; unstranded ones stay, the start is at least 0."""
    low = F.when(strand > 0, s + start).when(strand < 0, s - end).otherwise(s)
    high = F.when(strand > 0, e + end).when(strand < 0, e - start).otherwise(e)
    return F.greatest(low, F.lit(0)), high


def feature_id(attr: Column, typ: Column, seqid: Column, s: Column, e: Column, strand: Column) -> Column:
    """the feature's id, else one made from its place."""
    made = F.concat(typ, F.lit(":"), seqid.cast("string"), F.when(strand < 0, "-").when(strand > 0, "+").otherwise("."), s.cast("string"), F.lit(".."), e.cast("string"))
    return F.coalesce(*[F.element_at(attr, k) for k in ("ID", "id", "locus_tag")], made)


def decode(text: Column) -> Column:
    """Percent-decoding that leaves + alone."""
    return F.url_decode(F.regexp_replace(text, r"\+", "%2B"))


def attributes(text: Column) -> Column:
    """GFF3 attributes as a map; values are split at the first =, values of repeated keys joined by commas."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "."))
    pairs = F.transform(parts, lambda x: F.struct(decode(F.trim(F.substring_index(x, "=", 1))).alias("k"), decode(F.when(F.instr(x, "=") > 0, F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).otherwise("")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), ","))))


def encode(text: Column) -> Column:
    """percent-encoding of the characters that GFF3 reserves."""
    for ch, code in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A")):
        text = F.replace(text, F.lit(ch), F.lit(code))
    return text


def attribute_text(attr: Column) -> Column:
    """the map as GFF3 text, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attr)), lambda x: F.concat(encode(x["key"]), F.lit("="), encode(x["value"]))), ";")


def gtf_attributes(text: Column) -> Column:
    """GTF attributes, key "value"; pairs, as a map (the first of repeated keys counts)."""
    found = F.regexp_extract_all(text, F.lit('([A-Za-z0-9_]+ "[^"]*")'), F.lit(1))
    pairs = F.transform(found, lambda x: F.struct(F.substring_index(x, " ", 1).alias("k"), F.regexp_extract(x, '"([^"]*)"', 1).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter(pairs, lambda p: p["k"] == k), F.lit(0))["v"])))


def encode_counts(counts: Column) -> Column:
    """A map as "NxName ..." by falling count, then name."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda x: F.struct((-x["value"]).alias("n"), x["key"].alias("name"))))
    return F.array_join(F.transform(entries, lambda x: F.concat((-x["n"]).cast("string"), F.lit("x"), x["name"])), " ")


def parse_counts(text: Column) -> Column:
    """the map of such a text."""
    parts = F.filter(F.split(text, " "), lambda x: x != "")
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^[0-9]+x(.*)$", 1), F.regexp_extract(x, "^([0-9]+)x", 1).cast("bigint"))))
