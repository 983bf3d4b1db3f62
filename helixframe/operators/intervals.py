"""Interval algebra on half-open intervals [s0, e0): overlap joins, depth as runs, tracks, islands, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import ann
from helixframe.operators.ordered import BLOCK, with_neighbour, with_running


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], bin_size: int = 4096, same_strand: bool = False) -> DataFrame:
    """Pairs of a row of `a` (s0, e0, ...) and a query of `b` (qs, qe, ...) that overlap as ann.overlaps says.

    Both sides are dealt into bins by an equi-join, which AQE can split where a bin is hot; a pair is kept in the
    first bin that both have. Column names of the two sides differ but for `on`.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / bin_size), F.floor((F.greatest(e, s + 1) - 1) / bin_size)))
    left, right = a.withColumn("_bin", bins(F.col("s0"), F.col("e0"))), b.withColumn("_bin", bins(F.col("qs"), F.col("qe")))
    first = F.floor(F.greatest("s0", "qs") / bin_size)
    pairs = left.join(right, [*on, "_bin"]).where(ann.overlaps(F.col("s0"), F.col("e0"), F.col("qs"), F.col("qe")) & (F.col("_bin") == first))
    if same_strand:
        pairs = pairs.where("strand * q_strand >= 0")
    return pairs.drop("_bin")


def deltas(items: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """The changes of depth by position: +weight at starts, -weight at ends, summed before they are shuffled."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    steps = F.explode(F.array(F.struct(F.col("s0").alias("pos"), w.alias("delta")), F.struct(F.col("e0").alias("pos"), (-w).alias("delta"))))
    return items.where("e0 > s0").select(*keys, steps.alias("_step")).select(*keys, "_step.*").groupBy(*keys, "pos").agg(F.sum("delta").alias("delta"))


def depth_runs(items: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """A1: depth of coverage as runs (keys, start, end, depth) of depth over 0, adjacent runs of one depth merged."""
    return runs_of(deltas(items, keys).where("delta <> 0"), keys, {"depth": F.col("delta")}, block).where("depth > 0")


def runs_of(changes: DataFrame, keys: list[str], values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Runs (keys, start, end, values) between changes (keys, pos, ...), the values being running sums."""
    summed = with_running(changes, keys, "pos", values, block=block, ahead="end")
    return summed.where("end is not null").select(*keys, F.col("pos").alias("start"), "end", *values)


def zip_tracks(items: DataFrame, keys: list[str], track: str, names: list[str], block: int = BLOCK) -> DataFrame:
    """The depth of each named track side by side, as runs (keys, start, end, d_<name>...) up to the last end of any.

    Runs are cut wherever a track changes.
    """
    steps = deltas(items, [*keys, track])
    wide = steps.groupBy(*keys, "pos").agg(*[F.coalesce(F.sum(F.when(F.col(track) == n, F.col("delta"))), F.lit(0)).alias(f"d_{n}") for n in names])
    changed = wide.where(" or ".join(f"d_{n} <> 0" for n in names))
    return runs_of(changed, keys, {f"d_{n}": F.col(f"d_{n}") for n in names}, block)


def crosstalk_runs(items: DataFrame, keys: list[str], crosstalk: float, block: int = BLOCK) -> DataFrame:
    """Depth of each strand less a share of the other's, at least 0, as runs (keys, strand, start, end, depth).

    Both strands are summed up side by side; the share is taken of whole depths.
    """
    sided = [*keys, "_side"]
    steps = deltas(items.withColumn("_side", F.abs("strand")).withColumn("_back", F.col("strand") < 0), [*sided, "_back"])
    of = lambda back: F.coalesce(F.sum(F.when(F.col("_back") == back, F.col("delta"))), F.lit(0))
    both = runs_of(steps.groupBy(*sided, "pos").agg(of(False).alias("_f"), of(True).alias("_r")), sided, {"_f": F.col("_f"), "_r": F.col("_r")}, block)
    less = lambda strand, own, other: F.struct(strand.alias("strand"), (own - crosstalk * other).alias("depth"))
    f, r, side = F.col("_f"), F.col("_r"), F.col("_side")
    runs = both.withColumn("_x", F.explode(F.when(side == 0, F.array(less(side, f, f))).otherwise(F.array(less(side, f, r), less(-side, r, f)))))
    depth = F.round("_x.depth", 9)
    return runs.select(*keys, F.col("_x.strand").alias("strand"), "start", "end", F.when(depth > 0, depth).otherwise(0.0).alias("depth"))


def collapse(features: DataFrame, keys: list[str], overlap: int = 0, block: int = BLOCK) -> DataFrame:
    """Features merged while the next starts before the greatest end so far less `overlap`: (keys, start, end, n)."""
    ordered = with_running(features, keys, "s0", maxima={"_end": F.col("e0")}, order=["e0", "fid"], block=block, inclusive=False)
    opens = F.when(F.col("_end").isNull() | (F.col("s0") >= F.col("_end") - overlap), 1).otherwise(0)
    grouped = with_running(ordered, keys, "s0", {"_group": opens.cast("bigint")}, order=["e0", "fid"], block=block)
    return grouped.groupBy(*keys, "_group").agg(F.min("s0").alias("start"), F.max("e0").alias("end"), F.count("*").alias("n")).drop("_group")


def islands(runs: DataFrame, keys: list[str], gap: int = 0, block: int = BLOCK) -> DataFrame:
    """Runs (keys, start, end) numbered by island: a new one begins where the gap to the last end is over `gap`. Adds `island`."""
    near = with_neighbour(runs, keys, "start", {"_last": F.col("end")}, False, block=block)
    opens = F.when(F.col("_last").isNull() | (F.col("start") - F.col("_last") > gap), 1).otherwise(0).cast("bigint")
    return with_running(near, keys, "start", {"island": opens}, block=block).drop("_last")


def run_length(points: DataFrame, keys: list[str], pos: str, value: str, block: int = BLOCK) -> DataFrame:
    """Maximal runs of equal values in the order of unique positions: (keys, first, n, value)."""
    near = with_neighbour(points, keys, pos, {"_last": F.struct(F.lit(True).alias("there"), F.col(value).alias("v"))}, False, block=block)
    opens = F.when(F.col("_last").isNull() | ~F.col("_last.v").eqNullSafe(F.col(value)), 1).otherwise(0).cast("bigint")
    runs = with_running(near, keys, pos, {"_run": opens}, block=block)
    return runs.groupBy(*keys, "_run", value).agg(F.min(pos).alias("first"), F.count("*").alias("n")).drop("_run")


def transcripts(runs: DataFrame, keys: list[str], min_depth: int = 1, median_depth: int = 100) -> DataFrame:
    """Maximal stretches of min_depth whose upper median depth over bases is median_depth at least: (keys, start, end, median)."""
    good = islands(runs.where(F.col("depth") >= min_depth), keys)
    whole = good.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by_depth = good.groupBy(*keys, "island", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    ranked = with_running(by_depth, [*keys, "island"], "depth", {"_upto": F.col("bases")})
    middle = F.floor((F.col("end") - F.col("start")) / 2)
    found = ranked.join(whole, [*keys, "island"]).where(F.col("_upto") > middle).groupBy(*keys, "island", "start", "end").agg(F.min("depth").alias("median"))
    return found.where(F.col("median") >= median_depth).drop("island")


def modes(runs: DataFrame, keys: list[str], min_depth: int = 5, radius: int = 20, bin_size: int | None = None) -> DataFrame:
    """Runs of min_depth with no greater depth within `radius` and no equal one before them there: (keys, start, end, depth)."""
    good = runs.where(F.col("depth") >= min_depth)
    near = good.select(*keys, (F.col("start") - radius).alias("s0"), (F.col("end") + radius).alias("e0"), "start", "end", "depth")
    others = good.select(*keys, F.col("start").alias("qs"), F.col("end").alias("qe"), F.col("depth").alias("q_depth"))
    beaten = overlap_join(near, others, keys, bin_size or max(32, 2 * radius)).where("q_depth > depth or (q_depth = depth and qs < start)").select(*keys, "start").distinct()
    return good.join(beaten, [*keys, "start"], "left_anti").select(*keys, "start", "end", "depth")


def core_regions(tracks: DataFrame, keys: list[str], names: list[str], mincov: int = 1, maxdiff: int = 16, minsize: int = 200, what: str = "core") -> DataFrame:
    """Stretches where all tracks have mincov (core) or none has (unique), holes up to maxdiff closed, of minsize at least."""
    tests = [F.col(f"d_{n}") >= mincov if what == "core" else F.col(f"d_{n}") < mincov for n in names]
    good = tracks
    for test in tests:
        good = good.where(test)
    found = islands(good.select(*keys, "start", "end"), keys, maxdiff).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.where(F.col("end") - F.col("start") >= minsize).drop("island")


def span_ends(items: DataFrame, what: str = "fragment", lap: int = 0) -> DataFrame:
    """Items as whole fragments or their 5' or 3' base by strand, ends moved on by lap."""
    s, e, strand = F.col("s0"), F.col("e0"), F.col("strand")
    if what != "fragment":
        place = ann.five_prime(s, e - 1, strand) if what == "5prime" else ann.three_prime(s, e - 1, strand)
        s, e = place, place + 1
    return items.withColumn("_s", s).withColumn("_e", e + lap).drop("s0", "e0").withColumnsRenamed({"_s": "s0", "_e": "e0"})


def shift_size(text: str) -> tuple[int, float]:
    """(absolute, share of the length) of a shift such as 10-50%."""
    import re

    absolute, share = 0, 0.0
    for value, percent in re.findall(r"([+-]?[0-9.]+)(%?)", text):
        if percent:
            share += float(value) / 100
        else:
            absolute += int(value)
    return absolute, share


def modify(features: DataFrame, shift_start: str = "0", shift_end: str = "0", change_strand: str = "no", typ: str | None = None) -> DataFrame:
    """Features moved along their strand, restranded, retyped."""
    size = F.col("e0") - F.col("s0")
    moves = [F.lit(a) + F.floor(0.5 + size * p) for a, p in map(shift_size, (shift_start, shift_end))]
    s, e = ann.shifted(F.col("s0"), F.col("e0"), F.col("strand"), *moves)
    strand = {"no": F.col("strand"), "flip": -F.col("strand"), "clear": F.lit(0), "forward": F.lit(1), "reverse": F.lit(-1)}[change_strand]
    out = features.select("*", s.alias("_s"), e.alias("_e"), strand.alias("_strand")).drop("s0", "e0", "strand").withColumnsRenamed({"_s": "s0", "_e": "e0", "_strand": "strand"})
    return out if typ is None else out.withColumn("typ", F.lit(typ))


def relate(parents: DataFrame, children: DataFrame, on: list[str], upstrand: int = 0, downstrand: int = 0, bin_size: int = 4096) -> DataFrame:
    """(on, fid, q_fid, relation) for children near a parent, many to many.

    The parent is widened along its strand to find its children; the relation is told from its own bounds. Missing
    strands count as unstranded.
    """
    strand = F.coalesce("strand", F.lit(0))
    wide = parents.select(*on, "fid", strand.alias("p_strand"), F.col("s0").alias("ps"), F.col("e0").alias("pe"), F.greatest(F.lit(0), F.when(strand < 0, F.col("s0") - downstrand).otherwise(F.col("s0") - upstrand)).alias("s0"), F.when(strand < 0, F.col("e0") + upstrand).otherwise(F.col("e0") + downstrand).alias("e0"))
    queries = children.select(*on, F.col("fid").alias("q_fid"), F.coalesce("strand", F.lit(0)).alias("q_strand"), F.col("s0").alias("qs"), F.col("e0").alias("qe"))
    pairs = overlap_join(wide, queries, on, bin_size)
    meets = (F.col("ps") < F.col("qe")) & (F.col("qs") < F.col("pe"))
    against = F.col("p_strand") * F.col("q_strand") == -1
    lead = F.when(F.col("p_strand") != 0, F.col("p_strand")).otherwise(F.col("q_strand"))
    before = F.col("qs") * F.when(against, F.col("p_strand")).otherwise(lead) < F.col("ps") * F.when(against, F.col("p_strand")).otherwise(lead)
    relation = F.when(against & meets, "opposite").when(against, F.when(before, "upstrand_opposite").otherwise("downstrand_opposite")).when(meets, "in").when(lead == 0, "near").when(before, "upstrand").otherwise("downstrand")
    return pairs.select(*on, "fid", "q_fid", relation.alias("relation"))


def starts_track(items: DataFrame, keys: list[str], end: str = "5prime") -> DataFrame:
    """How many items start (5prime) or end (3prime) at each base, along their strand."""
    place = span_ends(items, end)
    return place.groupBy(*keys, F.col("s0").alias("pos")).agg(F.count("*").alias("n"))


def depth_totals(runs: DataFrame, sample: str) -> DataFrame:
    """Total depth of each sample and the multiplier that makes totals equal their geometric mean (1 for none)."""
    totals = runs.groupBy(sample).agg(F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("total"))
    mean = totals.where("total > 0").agg(F.exp(F.avg(F.ln("total"))).alias("mean"))
    return totals.crossJoin(F.broadcast(mean)).select(sample, "total", F.when(F.col("total") > 0, F.col("mean") / F.col("total")).otherwise(1.0).alias("multiplier"))


def shred(seqs: DataFrame, size: int = 200, stride: int = 50) -> DataFrame:
    """Tiles of every sequence (name, seq): (name, start, end, seq), the tiles at the ends cut short."""
    n = F.length("seq").cast("bigint")
    starts = F.when(n > 0, F.sequence(F.lit(stride - size).cast("bigint"), n - 1, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    tiles = seqs.select("name", "seq", F.explode(F.filter(starts, lambda i: F.lit(True))).alias("i"))
    start, end = F.greatest(F.col("i"), F.lit(0)), F.greatest(F.lit(0), F.least(F.length("seq"), F.col("i") + size))
    return tiles.select(F.concat("name", F.lit(":"), (start + 1).cast("string"), F.lit(".."), end.cast("string")).alias("name"), start.alias("start"), end.alias("end"), F.substring("seq", (start + 1).cast("int"), (end - start).cast("int")).alias("seq"))
