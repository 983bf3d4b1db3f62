"""Genomic views over the star-schema tables, in SQL that both engines read; the queries' oracles start from the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (tables, Spark SQL, DuckDB SQL or None if it is the same)
VIEWS = {
    "aln": (
        ["lineitem"],
        """select l_orderkey * 10 + l_linenumber as rid, l_orderkey as qname, cast(l_suppkey % 5 as int) as seqid, cast(l_partkey * 7 + l_orderkey % 7 as bigint) as s0,
cast(l_partkey * 7 + l_orderkey % 7 + l_quantity as bigint) as e0, case when l_linestatus = 'F' then -1 else 1 end as strand, cast(floor(l_extendedprice) as bigint) as score, l_returnflag as sample from lineitem""",
        None,
    ),
    "feat": (
        ["part"],
        """select p_partkey as fid, cast(p_partkey % 5 as int) as seqid, cast(p_partkey * 7 as bigint) as s0, cast(p_partkey * 7 + p_size * 4 as bigint) as e0,
case when p_partkey % 3 = 0 then -1 else 1 end as strand, p_brand as typ from part""",
        None,
    ),
    "seqs": (
        ["documents"],
        """select doc_id, lang, translate(upper(regexp_replace(text, '[^A-Za-z]', '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents""",
        """select doc_id, lang, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents""",
    ),
    "reads": (
        ["conversations"],
        """select conv_id, turn, role, regexp_replace(text, '[^!-~]', '') as qual from conversations""",
        """select conv_id, turn, role, regexp_replace(text, '[^!-~]', '', 'g') as qual from conversations""",
    ),
    "counts": (
        ["lineitem"],
        """select l_partkey as feature, concat(l_returnflag, l_linestatus) as sample, cast(sum(l_quantity) as bigint) as n from lineitem group by l_partkey, concat(l_returnflag, l_linestatus)""",
        """select l_partkey as feature, l_returnflag || l_linestatus as sample, cast(sum(l_quantity) as bigint) as n from lineitem group by l_partkey, l_returnflag || l_linestatus""",
    ),
    "sites": (
        ["events"],
        """select user_id as sample, cast(day(ts) * 24 + hour(ts) as bigint) as pos, case event_type when 'click' then 'A' when 'error' then '-' when 'purchase' then 'C' when 'signup' then 'G' else 'T' end as item, cast(1 + floor(abs(value)) as bigint) as n, event_id as ord from events""",
        None,
    ),
    "gt": (
        ["orders"],
        """select o_orderkey as pos, cast(o_custkey % 7 as int) as chrom, cast(floor(o_totalprice) as bigint) % 13 as ro, cast(floor(o_totalprice / 13) as bigint) % 11 as ao1, cast(floor(o_totalprice / 143) as bigint) % 3 as ao2 from orders""",
        None,
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame."""
    tables, sql, _ = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = f" {sql} ".replace(f" from {t} ", f" from {{{t}}} ")
    return spark.sql(sql, **frames)


def oracle(names: list[str], sql: str) -> str:
    """DuckDB SQL with the named views in front; sql may begin with further `name as (...)` parts and `---` before its select."""
    more, _, final = sql.rpartition("---")
    parts = [f"{n} as ({VIEWS[n][2] or VIEWS[n][1]})" for n in names]
    if more.strip():
        parts.append(more.strip().rstrip(","))
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + final.strip()
