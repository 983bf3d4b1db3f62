"""Queries of the Column functions, record filters and small joins over the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe import selection
from helixframe.catalog import register
from helixframe.functions import ann, sam, stats, variants
from helixframe.functions import seq as sq
from helixframe.operators import consensus as cs
from helixframe.operators import intervals as iv
from helixframe.operators import reads as rd
from helixframe.operators import tracks as tk
from helixframe.plans.read_queries import COMP
from helixframe.plans.site_queries import EVIDENCE, TAIL, observed
from helixframe.plans.views import oracle, view
from helixframe.sources.tables import children

CODES = "".join(sq.IUPAC)
AMINO = "ACDEFGHIKLMNPQRSTVWYXBZ"
_BASES = "case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in sq.IUPAC.items()) + " end"
_CODE = "case {0} " + " ".join(f"when '{v}' then '{k}'" for k, v in sq.IUPAC.items()) + " end"


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("ambiguity_codes", oracle([], f"""p as (select o_orderkey as id, substr('{CODES}', cast(1 + o_orderkey % 15 as int), 1) as a, substr('{CODES}', cast(1 + o_custkey % 15 as int), 1) as b from orders),
x as (select *, {_BASES.format('a')} as ba, {_BASES.format('b')} as bb from p)
--- select id, a, b, len(list_intersect(string_split(ba, ''), string_split(bb, ''))) > 0 as same, ba as bases, a as code, {_CODE.format("array_to_string(list_sort(list_distinct(string_split(ba || bb, ''))), '')")} as either from x"""))
def ambiguity_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of codes: whether they may be one base, their bases, and the code of both."""
    code = lambda c: F.substring(F.lit(CODES), (1 + F.col(c) % 15).cast("int"), F.lit(1))
    pairs = rows_of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), code("o_orderkey").alias("a"), code("o_custkey").alias("b"))
    bases = lambda c: sq.ambiguity_bases(F.col(c))
    return pairs.select("id", "a", "b", sq.might_be_same_base(F.col("a"), F.col("b")).alias("same"), F.array_join(bases("a"), "").alias("bases"), sq.ambiguity_code(bases("a")).alias("code"), sq.ambiguity_code(F.concat(bases("a"), bases("b"))).alias("either"))


@register("amino_pairs", oracle([], f"""p as (select o_orderkey as id, substr('{AMINO}', cast(1 + o_orderkey % 23 as int), 1) as a, substr('{AMINO}', cast(1 + o_custkey % 23 as int), 1) as b from orders)
--- select id, a, b, a = b or 'X' in (a, b) or least(a, b) || greatest(a, b) in ('BD', 'BN', 'EZ', 'QZ') as same from p"""))
def amino_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of amino acids that may be the same."""
    letter = lambda c: F.substring(F.lit(AMINO), (1 + F.col(c) % 23).cast("int"), F.lit(1))
    pairs = rows_of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), letter("o_orderkey").alias("a"), letter("o_custkey").alias("b"))
    return pairs.withColumn("same", sq.might_be_same_amino(F.col("a"), F.col("b")))


@register("kmer_signs", oracle(["seqs"], f"""e as (select distinct substr(seq, cast(i as int), 6) as w from (select seq, unnest(range(1, length(seq) - 4)) as i from seqs where length(seq) >= 6)), c as (select w, {COMP.format('w')} as r from e)
--- select w as kmer, least(w, r) as canonical, case when w < r then 1 when w > r then -1 else 0 end as sign from c"""))
def kmer_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 6-mer that occurs, its canonical form and its sign."""
    each = view(spark, sf_dir, "seqs").select(F.explode(sq.kmers(F.col("seq"), 6)).alias("kmer")).distinct()
    return each.select("kmer", sq.canonical(F.col("kmer")).alias("canonical"), sq.sign(F.col("kmer")).alias("sign"))


@register("kmers_joined", oracle(["seqs"], "--- select doc_id, case when length(seq) >= 9 then seq end as seq from seqs"))
def kmers_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences put together from their 9-mers again."""
    return view(spark, sf_dir, "seqs").select("doc_id", sq.kmers_to_sequence(sq.kmers(F.col("seq"), 9)).alias("seq"))


@register("alignment_flags", oracle([], """h as (select l_orderkey as q, l_linenumber as k, l_partkey as p, cast(l_orderkey % 4096 as int) as f from lineitem)
--- select q, k, (f & 16) <> 0 as reverse, f | 1 as paired, f - (f & 1024) as not_duplicate, case when p % 2 = 0 then p else k end as score, case when p % 2 = 0 then 'AS:i:' || p || ',' else '' end || 'NM:i:7' as tags, q || case when f & 64 <> 0 then '/1' when f & 128 <> 0 then '/2' else '' end as name from h"""))
def alignment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags read, set and cleared, scores and tags, original names."""
    f, part = (F.col("l_orderkey") % 4096).cast("int"), F.col("l_partkey").cast("string")
    tags = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("NM:i:1"), F.concat(F.lit("AS:i:"), part))).otherwise(F.array(F.lit("NM:i:1")))
    return rows_of(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("q"),
        F.col("l_linenumber").alias("k"),
        sam.flag(f, "reverse").alias("reverse"),
        sam.with_flag(f, "paired", True).alias("paired"),
        sam.with_flag(f, "duplicate", False).alias("not_duplicate"),
        sam.score(tags, F.col("l_linenumber")).cast("bigint").alias("score"),
        F.array_join(sam.with_tag(tags, "NM", F.lit(7)), ",").alias("tags"),
        sam.original_name(F.col("l_orderkey").cast("string"), f).alias("name"),
    )


@register("feature_geometry", oracle(["feat"], """--- select fid, case when strand < 0 then e0 else s0 end as five_prime, case when strand < 0 then s0 else e0 end as three_prime, greatest(0, case when strand < 0 then s0 - 20 else s0 - 50 end) as shifted_start, case when strand < 0 then e0 + 50 else e0 + 20 end as shifted_end,
s0 < 700 and e0 > 300 as meets, case when fid % 3 = 0 then 'g' || fid else typ || ':' || seqid || case when strand < 0 then '-' else '+' end || s0 || '..' || e0 end as id from feat"""))
def feature_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends on the strand, moved bounds, overlap with a span, ids given or made."""
    s, e, strand = F.col("s0"), F.col("e0"), F.col("strand")
    low, high = ann.shifted(s, e, strand, F.lit(-50), F.lit(20))
    attr = F.when(F.col("fid") % 3 == 0, F.create_map(F.lit("ID"), F.concat(F.lit("g"), F.col("fid").cast("string")))).otherwise(F.create_map(F.lit("Note"), F.lit("x")))
    return view(spark, sf_dir, "feat").select("fid", ann.five_prime(s, e, strand).alias("five_prime"), ann.three_prime(s, e, strand).alias("three_prime"), low.alias("shifted_start"), high.alias("shifted_end"), ann.overlaps(s, e, F.lit(300), F.lit(700)).alias("meets"), ann.feature_id(attr, F.col("typ"), F.col("seqid"), s, e, strand).alias("id"))


@register("sequence_slices", oracle(["seqs"], f"""p as (select doc_id, seq, cast(length(seq) as int) as n, cast(doc_id % 90 - 45 as int) as a, case when doc_id % 2 = 0 then -1 else 1 end as strand from seqs), q as (select *, a + n as b, repeat('N', 45) || seq || repeat('N', 45) as wide from p)
--- select doc_id, case when strand < 0 then {COMP.format('substr(wide, a + 46, n)')} else substr(wide, a + 46, n) end as padded, {COMP.format('substr(seq, greatest(a, 0) + 1, least(b, n) - greatest(a, 0))')} as turned from q"""))
def sequence_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices as long as the sequence, padded with N on a strand, or clamped and turned round."""
    a, n = (F.col("doc_id") % 90 - 45).cast("int"), F.length("seq")
    strand = F.when(F.col("doc_id") % 2 == 0, -1).otherwise(1)
    return view(spark, sf_dir, "seqs").where("seq is not null").select("doc_id", sq.slice_padded(F.col("seq"), a, a + n, strand).alias("padded"), sq.slice_clamped(F.col("seq"), a + n, a).alias("turned"))


@register("attribute_texts", oracle([], """--- select p_partkey as fid, 'ID=g' || p_partkey || ';Note=a b+c%2C' || p_size || ';Parent=' || p_brand || '%2Cx' as gff, p_brand as gene from part"""))
def attribute_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of either kind read, and written sorted by key."""
    part, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    gff = F.concat(F.lit(" Note=a%20b+c%2C"), size, F.lit("; ID=g"), part, F.lit(";.;Parent="), F.col("p_brand"), F.lit(";Parent=x"))
    gtf = F.concat(F.lit('gene_id "'), F.col("p_brand"), F.lit('"; note "a; b"; gene_id "later";'))
    return rows_of(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), ann.attribute_text(ann.attributes(gff)).alias("gff"), ann.gtf_attributes(gtf)["gene_id"].alias("gene"))


@register("count_texts", oracle([], """c as (select user_id, event_type, count(*) as n from events group by 1, 2) --- select user_id, string_agg(n || 'x' || event_type, ' ' order by n desc, event_type) as counts, cast(sum(n) as bigint) as total from c group by 1"""))
def count_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events by user as texts, and read again."""
    by = rows_of(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    texts = by.groupBy("user_id").agg(ann.encode_counts(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))).alias("counts"))
    return texts.withColumn("total", F.aggregate(F.map_values(ann.parse_counts(F.col("counts"))), F.lit(0).cast("bigint"), lambda a, x: a + x))


@register("log_factorials", oracle([], "--- select o_orderkey as n, round(lgamma(o_orderkey + 1.0::double), 5) as value from orders"))
def log_factorials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of factorials."""
    return rows_of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.round(stats.log_factorial(F.col("o_orderkey")), 5).alias("value"))


@register("value_runs", oracle(["sites"], """v as (select sample, pos, max(item) as v from sites group by 1, 2), g as (select *, row_number() over (partition by sample order by pos) - row_number() over (partition by sample, v order by pos) as g from v)
--- select sample, min(pos) as first, cast(count(*) as bigint) as n, v from g group by sample, v, g"""))
def value_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal items along each sample's sites."""
    points = view(spark, sf_dir, "sites").groupBy("sample", "pos").agg(F.max("item").alias("v"))
    return iv.run_length(points, ["sample"], "pos", "v").select("sample", "first", "n", "v")


@register("ordered_samples", oracle([], """--- select c_custkey as sample, row_number() over (partition by c_nationkey order by case when c_mktsegment = 'BUILDING' then 0 else 1 end, case when c_mktsegment in ('MACHINERY', 'FURNITURE') then 0 else 1 end, c_custkey) as rank from customer"""))
def ordered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation by a sort expression."""
    expression, name = selection.split_name("BUILDING,MACHINERY/FURNITURE=rank")
    order = Window.partitionBy("c_nationkey").orderBy(*selection.order(expression, F.array("c_mktsegment"), F.col("c_custkey")))
    return rows_of(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.row_number().over(order).cast("bigint").alias(name))


@register("ambiguity_calls", oracle(["sites"], EVIDENCE + """st as (select pos, e, total, unnest(range(1, len(e) + 1)) as k from ev),
up as (select *, list_sum(list_transform(e[1:k], lambda x: x.n + 0.2::double)) as u from st), tp as (select *, round(least(u, total + 1), 6)::double as x, round(total + 1.0::double, 6) as m from up),""" + TAIL.format(src="tp") + f"""
rk as (select pos, min(k) as k from tp join tl on tp.x = tl.x and tp.m = tl.m where 1 - miss >= 0.9 group by pos),
ch as (select ev.pos, list_transform(list_filter(e, lambda x: x.n >= e[rk.k].n), lambda x: x.item) as items from ev join rk on ev.pos = rk.pos)
--- select ev.pos, case when len(items) = 1 then items[1] else {_CODE.format("array_to_string(list_sort(items), '')")} end as call from ev left join ch on ev.pos = ch.pos"""))
def ambiguity_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguity code of the items that have the majority of a site together."""
    return cs.ambiguity_calls(observed(spark, sf_dir), 0.9).select("pos", "call")


NAMED = "concat('  d|', doc_id, ' | ', lang, ' more')"


@register("named_records", oracle(["seqs"], f"""r as (select lang, doc_id, seq from seqs where length(seq) >= 1500 and lang in ('en', 'fr'))
--- select 'bar' as filters, doc_id, cast(doc_id as varchar) as name from r where lang = 'en' union all select 'name', doc_id, 'd|' || doc_id from r union all select 'rename', doc_id, 'same' from r where length(seq) % 2 = 0
union all select 'first', doc_id, lang from (select *, row_number() over (order by doc_id) as k from r) where k <= 20"""))
def named_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record filters on names and lengths, and the first twenty records left."""
    seqs = view(spark, sf_dir, "seqs").withColumns({"name": F.col("lang"), "file": F.lit("f"), "ord": F.col("doc_id")})
    kept = rd.filtered(seqs, ["lengthatleast:1500", "select:en,fr"])
    long = kept.withColumn("name", F.expr(NAMED))
    parts = {"bar": rd.filtered(long.where("lang = 'en'"), ["bar:2"]), "name": rd.filtered(long, ["name"]), "rename": rd.filtered(long, ["pfilter:length(seq) % 2 = 0", "rename:same"]), "first": rd.filtered(kept, ["first:20"])}
    return tk.concatenated([df.select(F.lit(n).alias("filters"), "doc_id", "name") for n, df in parts.items()])


@register("styled_features", oracle(["feat"], """t as (select min(typ) as typ from feat) --- select fid, 'ID=' || case when fid % 2 = 0 then 'g' || fid else typ || '%3A' end as id, case when fid % 2 = 0 then 'blue' else 'red' end as color from feat where typ = (select typ from t)""".replace("typ || '%3A'", "typ || ':' || seqid || case when strand < 0 then '-' else '+' end || s0 || '..' || e0")))
def styled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of one type with a colour and an ID where they have none."""
    own = F.create_map(F.lit("ID"), F.concat(F.lit("g"), F.col("fid").cast("string")), F.lit("color"), F.lit("blue"))
    feat = view(spark, sf_dir, "feat").withColumn("attr", F.when(F.col("fid") % 2 == 0, own).otherwise(F.create_map(F.lit("Note"), F.lit("x"))))
    first = feat.agg(F.min("typ").alias("typ"))
    return tk.styled(feat.join(F.broadcast(first), "typ"), F.col("typ"), "red").select("fid", F.concat(F.lit("ID="), F.col("attr")["ID"]).alias("id"), F.col("attr")["color"].alias("color"))


@register("feature_children", oracle(["feat"], """k as (select unnest([fid // 2, fid // 3]) as p, fid from feat) --- select 'g' || p as parent, 'g' || fid as child from k where p in (select fid from feat) """))
def feature_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and children by attributes; missing parents give none."""
    name = lambda c: F.concat(F.lit("g"), F.floor(c).cast("string"))
    attr = F.create_map(F.lit("ID"), name(F.col("fid")), F.lit("Parent"), F.concat_ws(",", name(F.col("fid") / 2), name(F.col("fid") / 3)))
    return children(view(spark, sf_dir, "feat").withColumn("attr", attr))


@register("paired_reads", oracle(["seqs"], f"""r as (select 'd' || (doc_id // 2) as base, doc_id % 2 as k, seq from seqs where doc_id % 7 <> 0)
--- select coalesce(a.base, b.base) as base, a.seq as seq1, {COMP.format('b.seq')} as seq2 from (select * from r where k = 0) a full join (select * from r where k = 1) b on a.base = b.base"""))
def paired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with their mates by name, the latter complemented; every seventh is missing, so that there are orphans."""
    name = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("/"), (1 + F.col("doc_id") % 2).cast("string"))
    return rd.pair_reads(view(spark, sf_dir, "seqs").where("doc_id % 7 <> 0").select(name.alias("name"), "seq"))


@register("trailing_means", oracle(["seqs"], """c as (select doc_id, i, ascii(substr(seq, cast(i + 1 as int), 1)) as c from (select doc_id, seq, unnest(range(0, length(seq))) as i from seqs)), n as (select doc_id, count(*) as n from c group by 1),
x as (select doc_id, i + d as at, avg(c) as m from c, (select unnest(range(0, 4)) as d) group by 1, 2) --- select doc_id, cast(count(*) as bigint) as n, round(sum(m), 4) as total, round(max(m), 6) as most from x group by 1"""))
def trailing_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the values of the up to four windows that cover each base, summed up by sequence."""
    counts = F.transform(rd.characters(F.col("seq")), lambda c: F.ascii(c))
    found = tk.trailing_mean(view(spark, sf_dir, "seqs").where("seq <> ''").withColumnRenamed("doc_id", "name"), counts, 4)
    return found.select(F.col("name").alias("doc_id"), F.size("means").cast("bigint").alias("n"), F.round(F.aggregate("means", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("means"), 6).alias("most"))


@register("kmer_bias", oracle(["seqs"], """p as (select seq || substr(seq, 1, 4) as w, seq, length(seq) as n, unnest(range(0, length(seq))) as i from seqs where length(seq) >= 5),
k as (select substr(w, cast(i + 1 as int), 5) as k, ascii(substr(seq, cast(1 + (i + 2) % n as int), 1)) % 7 as d from p) --- select least(k, translate(reverse(k), 'ACGT', 'TGCA')) as kmer, cast(count(*) as bigint) as n, round(avg(d), 6) as mean from k group by 1"""))
def kmer_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value at the centre of each 5-mer of circular sequences."""
    seqs = view(spark, sf_dir, "seqs").select("seq", F.transform(rd.characters(F.col("seq")), lambda c: F.ascii(c) % 7).alias("depths"))
    return tk.kmer_bias(seqs, 5).select("kmer", "n", F.round("mean", 6).alias("mean"))


@register("effect_texts", oracle([], """--- select o_orderkey as id, case when o_orderkey % 3 = 0 then 'STOP Effect_Impact=HIGH Functional_Class=NONSENSE Gene_Name=a,b /// UTR Effect_Impact=MODIFIER' when o_orderkey % 3 = 1 then 'SYN Effect_Impact=LOW Amino_Acid_change=K' || o_custkey else '' end as effects from orders"""))
def effect_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of changes as texts, the gravest first."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "UTR(MODIFIER|||),STOP(HIGH|NONSENSE||||a%2Cb)").when(k == 1, F.concat(F.lit("SYN(LOW|||K"), F.col("o_custkey").cast("string"), F.lit(")")))
    found = F.array_join(F.transform(variants.effects(text), lambda x: x["description"]), " /// ")
    return rows_of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), found.alias("effects"))


@register("pretty_numbers", oracle([], """--- select o_orderkey as id, lpad(format('{:,}', o_orderkey * 1000), 16, ' ') as text from orders"""))
def pretty_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with their thousands apart, to the right of a column."""
    return rows_of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), variants.pretty_number(F.col("o_orderkey") * 1000, 16).alias("text"))
