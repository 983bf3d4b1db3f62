"""Inputs that every operator's tests share."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def rows(texts):
    """documents rows of texts, or of (id, text)."""
    pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    return [(i, t, "en", "src", None if t is None else len(t)) for i, t in pairs]


def documents(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS)


def edge_texts() -> list:
    """Null, empty, blank, very long, repeated and odd texts; a null id; ids that repeat."""
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, long), (6, long), (6, long), (7, long + " tail"), (8, "aaaa " * 5000), (9, "x" * 100_000),
        (10, "\x00\x01 zero \x7f"), (11, "é ü ß 漢字 😀 " * 40), (None, "no id at all, nor any other"), (None, None), (12, "\n\n\n"), (12, "line\nline\nline\n\nline"), (13, "0" * 20_000), (14, "@" * 5000), (15, "+1" * 5000), (16, "<" * 5000),
    ]


#: Extra columns named like the operators' own inner ones.
CLASH = ["key", "n", "anchor", "around", "choice", "cell", "fp", "a", "b", "kinds", "score", "held_out", "rank", "task", "length", "host", "path", "verdict", "shape", "child", "spans", "m", "w", "rejected_by", "sha", "copies", "toxic", "component_id", "root"]


def with_clash(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


def sf_folder(spark, tmp_path, **frames) -> str:
    """A folder like /root/testdata/sf*, with the given tables."""
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
