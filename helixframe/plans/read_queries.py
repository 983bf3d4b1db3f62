"""Sequence, read and k-mer queries over the document and conversation views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.functions import seq as sq
from helixframe.operators import reads as rd
from helixframe.plans.views import oracle, view

COMP = "translate(reverse({0}), 'ACGT', 'TGCA')"


def kmer_sql(k: int, keys: str = "") -> str:
    own = keys + ", " if keys else ""
    return f"""e as (select {own}substr(seq, cast(i as int), {k}) as w from (select {own}seq, unnest(range(1, length(seq) - {k} + 2)) as i from seqs where length(seq) >= {k})),
km as (select {own}least(w, {COMP.format('w')}) as kmer, cast(count(*) as bigint) as n from e group by all),
"""


def bag(spark: SparkSession, sf_dir: str, k: int, keys: list[str] | None = None) -> DataFrame:
    return rd.count_kmers(view(spark, sf_dir, "seqs"), k, keys)


@register("kmer_counts", oracle(["seqs"], kmer_sql(9) + "--- select kmer, n from km"))
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical 9-mers of all sequences."""
    return bag(spark, sf_dir, 9)


@register("kmer_histogram", oracle(["seqs"], kmer_sql(9) + "--- select n, cast(count(*) as bigint) as kmers from km group by n"))
def kmer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many 9-mers occur how often."""
    return rd.multiplicities(bag(spark, sf_dir, 9))


@register("kmer_stats", oracle(["seqs"], kmer_sql(9) + """c as (select n, sum(n) over (order by n) as upto, sum(n) over () as t from km)
--- select cast(count(*) as bigint) as "distinct", cast(sum(n) as bigint) as total, round(sum(n) / count(*), 6) as mean, (select min(n) from c where 2 * upto > t) as median, max(n) as most from km"""))
def kmer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiplicity of 9-mers: mean, weighted median, greatest."""
    return rd.kmer_stats(bag(spark, sf_dir, 9))


@register("kmer_sets", oracle(["seqs"], kmer_sql(7, "lang") + """a as (select kmer from km where lang = 'en' and n >= 10), b as (select kmer from km where lang = 'de' and n >= 10)
--- select 'both' as part, kmer from (select kmer from a intersect select kmer from b) union all select 'first', kmer from (select kmer from a except select kmer from b) union all select 'second', kmer from (select kmer from b except select kmer from a) union all select 'any', kmer from (select kmer from a union select kmer from b)"""))
def kmer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and differences of two languages' 7-mers at a cutoff."""
    whole = bag(spark, sf_dir, 7, ["lang"]).where("n >= 10")
    a, b = (whole.where(F.col("lang") == x).select("kmer") for x in ("en", "de"))
    parts = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a), "any": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("part"), "kmer")
        out = df if out is None else out.unionByName(df)
    return out


@register("kmer_threshold", oracle(["seqs"], kmer_sql(7, "lang") + "--- select kmer, cast(sum(n) as bigint) as n from km group by kmer having sum(n) >= 300"))
def kmer_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7-mers whose counts over all languages' bags reach a cutoff."""
    whole = bag(spark, sf_dir, 7, ["lang"])
    return rd.merged_counts([whole.where(F.col("lang") == x).drop("lang") for x in ("en", "de", "fr", "es")], 300)


def _variants(k: int) -> str:
    return " union all ".join(f"select kmer, substr(kmer, 1, {i}) || b || substr(kmer, {i + 2}) as o from km, bases" for i in range(k))


@register("kmer_shadows", oracle(["seqs"], kmer_sql(6) + f"""bases as (select unnest(['A', 'C', 'G', 'T']) as b), v as ({_variants(6)}), w as (select kmer, least(o, {COMP.format('o')}) as o from v where o <> kmer),
s as (select w.kmer, max(km.n) as shadow from w join km on w.o = km.kmer group by w.kmer) --- select km.kmer, n, coalesce(shadow, 0) as shadow from km left join s on km.kmer = s.kmer"""))
def kmer_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest count among the one-base neighbours of each 6-mer."""
    return rd.shadow_counts(bag(spark, sf_dir, 6), 6)


@register("kmer_links", oracle(["seqs"], kmer_sql(6) + f"""bases as (select unnest(['A', 'C', 'G', 'T']) as b), x as (select kmer, substr(kmer, 2) || b as o, 1 as step from km, bases union all select kmer, b || substr(kmer, 1, 5), -1 from km, bases),
y as (select kmer, least(o, {COMP.format('o')}) as other, case when o < {COMP.format('o')} then 1 when o > {COMP.format('o')} then -1 else 0 end as sign, step from x) --- select y.kmer, other, sign, step from y join km on y.other = km.kmer"""))
def kmer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the 6-mer graph with sign and direction."""
    return rd.link_list(bag(spark, sf_dir, 6))


@register("kmer_postings", oracle(["seqs"], kmer_sql(9, "doc_id").replace("km as", "kd as") + """--- select doc_id as name, kmer, n from kd"""))
def kmer_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sequences hold each 9-mer, how often."""
    return rd.postings(view(spark, sf_dir, "seqs").withColumnRenamed("doc_id", "name"), 9)


@register("kmer_depth", oracle(["seqs"], kmer_sql(9) + """d as (select doc_id, least(w, translate(reverse(w), 'ACGT', 'TGCA')) as kmer from (select doc_id, substr(seq, cast(i as int), 9) as w from (select doc_id, seq, unnest(range(1, length(seq) - 7)) as i from seqs where length(seq) >= 9)))
--- select doc_id as name, 100.0::double as present, round(avg(n), 6) as mean, median(n) as median, min(n) as least, max(n) as most from d join km on d.kmer = km.kmer group by doc_id"""))
def kmer_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each sequence's 9-mers over the whole bag."""
    seqs = view(spark, sf_dir, "seqs").withColumnRenamed("doc_id", "name")
    return rd.kmer_depth(seqs, rd.count_kmers(seqs, 9), 9)


@register("reverse_complements", oracle(["seqs"], """--- select doc_id, translate(reverse(seq), 'ACGT', 'TGCA') as rc from seqs"""))
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complement of every sequence (F1)."""
    return view(spark, sf_dir, "seqs").select("doc_id", sq.reverse_complement(F.col("seq")).alias("rc"))


_CODE = "case " + " ".join(f"when c = '{x + y + z}' then '{sq.CODE_AMINO[16 * i + 4 * j + k]}'" for i, x in enumerate("TCAG") for j, y in enumerate("TCAG") for k, z in enumerate("TCAG")) + " else 'X' end"


@register("translations", oracle(["seqs"], f"""--- select doc_id, coalesce(array_to_string(list_transform(list_transform(range(0, length(seq) // 3), lambda i: substr(seq, cast(i * 3 + 1 as int), 3)), lambda c: {_CODE}), ''), '') as protein from seqs"""))
def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence translated by the standard code."""
    return view(spark, sf_dir, "seqs").select("doc_id", sq.translate_codons(F.col("seq")).alias("protein"))


@register("sequence_stats", oracle(["seqs"], """--- select lang, cast(count(*) as bigint) as n, cast(sum(length(seq)) as bigint) as bases, round(avg(length(seq)), 6) as mean from seqs group by lang"""))
def sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, bases and mean length of sequences by language."""
    return rd.sequence_stats(view(spark, sf_dir, "seqs"), ["lang"])


@register("shredded", oracle(["seqs"], """t as (select doc_id, seq, unnest(range(-150, length(seq), 50)) as i from seqs where length(seq) > 0)
--- select doc_id || ':' || (greatest(i, 0) + 1) || '..' || greatest(0, least(length(seq), i + 200)) as name, cast(greatest(i, 0) as bigint) as start, cast(greatest(0, least(length(seq), i + 200)) as bigint) as "end", substr(seq, cast(greatest(i, 0) + 1 as int), cast(greatest(0, least(length(seq), i + 200)) - greatest(i, 0) as int)) as seq from t"""))
def shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 200 bases every 50."""
    from helixframe.operators.intervals import shred

    return shred(view(spark, sf_dir, "seqs").select(F.col("doc_id").cast("string").alias("name"), "seq")).withColumn("end", F.col("end").cast("bigint"))


RUNS = """c as (select conv_id, turn, role, p, ascii(substr(qual, cast(p as int), 1)) >= 100 as good from (select conv_id, turn, role, qual, unnest(range(1, length(qual) + 1)) as p from reads)),
g as (select *, p - row_number() over (partition by conv_id, turn, role, good order by p) as grp from c),
r as (select conv_id, turn, role, min(p) - 1 as start, count(*) as length from g where good group by conv_id, turn, role, grp),
b as (select *, row_number() over (partition by conv_id, turn, role order by length desc, start) as k from r),
"""


@register("longest_good_runs", oracle(["reads"], RUNS + """--- select q.conv_id, q.turn, q.role, cast(coalesce(b.start, 0) as int) as start, cast(coalesce(b.length, 0) as int) as length from reads q left join b on q.conv_id = b.conv_id and q.turn = b.turn and q.role = b.role and b.k = 1"""))
def longest_good_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First longest run of good quality characters of each read."""
    run = rd.good_run(F.col("qual"), F.col("qual"), F.lit(100), clip_ambiguous=False)
    return view(spark, sf_dir, "reads").select("conv_id", "turn", "role", run.alias("r")).select("conv_id", "turn", "role", "r.start", "r.length")


@register("quality_offset", oracle(["reads"], """m as (select min(ascii(c)) as least from (select unnest(regexp_extract_all(qual, '.')) as c from reads)) --- select cast(case when least is null or least < 59 then 33 else 64 end as int) as "offset" from m"""))
def quality_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality offset by the least character."""
    found = view(spark, sf_dir, "reads").agg(F.min(F.array_min(F.transform(rd.characters(F.col("qual")), lambda c: F.ascii(c)))).alias("least"))
    return found.select(F.when(F.col("least").isNull() | (F.col("least") < 59), 33).otherwise(64).alias("offset"))


@register("repeated_names", oracle(["reads"], """--- select role as file, cast(conv_id as varchar) as name, cast(count(*) as bigint) as n from reads group by 1, 2 having count(*) > 1"""))
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that repeat within a file."""
    return rd.repeated_names(view(spark, sf_dir, "reads").select(F.col("role").alias("file"), F.col("conv_id").cast("string").alias("name")))


#: Quality is low at the third base of each GGGG; ends of the adaptor GATTACA are cut from either end.
CLIPPED = """q as (select doc_id, seq, translate(replace(seq, 'GGGG', 'GG#G'), 'ACGT', 'IIII') as qual from seqs),
w as (select doc_id, seq, string_split(substr(qual, 6, greatest(cast(length(qual) - 10 as int), 0)), '#') as parts from q),
u as (select doc_id, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as i from w),
o as (select doc_id, length(part) as n, coalesce(sum(length(part) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s from u),
z as (select * from o qualify row_number() over (partition by doc_id order by n desc, s) = 1),
k as (select w.doc_id, length(seq) as length, s + 5 as s, n, substr(seq, cast(6 + s as int), cast(n as int)) as part from w join z on w.doc_id = z.doc_id),
"""


def _ends(text: str) -> str:
    """SQL for the length of the longest start of text that is an end of the adaptor with one mismatch at most."""
    return "case when length(part) < 24 then 0 " + " ".join(f"when hamming(substr({text}, 1, {n}), '{'GATTACA'[-n:]}') <= 1 then {n}" for n in range(7, 3, -1)) + " else 0 end"


@register("clipped_reads", oracle(["seqs"], CLIPPED + f"""a as (select doc_id, n, part, substr(part, {_ends('part')} + 1) as cut from k),
b as (select doc_id, n, case when length(cut) < 24 then cut else substr(cut, 1, length(cut) - ({_ends(COMP.format('cut'))})) end as s, length(cut) < 24 as short from a)
--- select doc_id, s as seq, case when n < 24 then 'quality' when short or length(s) < 24 then 'adaptor' when length(replace(s, substr(s, 1, 1), '')) = 0 then 'homopolymer' end as reason from b"""))
def clipped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sequences of varied quality, 5 off either end, clipped to their best stretch and of adaptors; short or uniform ones marked."""
    qual = F.translate(F.replace("seq", F.lit("GGGG"), F.lit("GG#G")), "ACGT", "IIII")
    seqs = view(spark, sf_dir, "seqs").withColumn("qual", qual)
    return rd.clip(seqs, adaptors=["GATTACA"], match=4, trim_start=5, trim_end=5).select("doc_id", "seq", "reason")


@register("clip_summaries", oracle(["seqs"], CLIPPED + """l as (select lang, k.* from k join seqs on seqs.doc_id = k.doc_id)
--- select lang, cast(count(*) as bigint) as reads, cast(count(*) filter (n > 0) as bigint) as kept, round(avg(length), 6) as mean_before, round(avg(n), 6) as mean_after, cast(count(*) filter (s > 0) as bigint) as clipped_start, cast(count(*) filter (s + n < length) as bigint) as clipped_end from l group by lang"""))
def clip_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and lengths by language before and after clipping by quality."""
    from helixframe.operators.tracks import clip_summary

    qual = F.translate(F.replace("seq", F.lit("GGGG"), F.lit("GG#G")), "ACGT", "IIII")
    run = rd.good_run(F.col("seq"), qual, F.lit(43), 5, 5)
    reads = view(spark, sf_dir, "seqs").select("lang", F.length("seq").alias("length"), run.alias("r"))
    return clip_summary(reads.select("lang", "length", F.col("r.start").alias("clip_start"), (F.col("r.start") + F.col("r.length")).alias("clip_end")), ["lang"])
