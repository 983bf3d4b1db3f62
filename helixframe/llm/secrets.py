"""Secret scan: all rules as one minimal deterministic automaton, one pass over the bytes of every whole text.

The three base rules (assign, access, hex) and the added ones (vendor key formats, private key headers) are compiled
together (see `automaton`); where the pass reaches an accepting state, the rule's own reverse and forward automata
give the leftmost start and the longest end. Spans are in code points with the end exclusive.

Cases: a null or empty text has no spans. Repeated ids give one row for each row; an empty table
gives none; very long texts are scanned whole in one pass; spans of one start are listed by kind. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.automaton import Scanner
from helixframe.llm.common import map_columns, map_rows, table

NAME = "op2_secret_scan"
ORACLE_SQL = None

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, regex, ignore case, least length in bytes); assign is checked by its value instead.
RULES = [
    ("assign", ASSIGN, True, 0),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 39),
    ("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", False, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 30),
    ("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", False, 0),
]
BASE = 3
VALUE = re.compile(ASSIGN.encode(), re.IGNORECASE)
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scanner() -> Scanner:
    return Scanner([rule[:3] for rule in RULES])


def find(scan: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the kept spans in code points, by start and then kind."""
    kept = []
    for start, kind, end in scan.scan(data):
        if kind == 0:
            value = VALUE.match(data, start, end)
            if len(value[2]) < 6:
                continue
        elif end - start < RULES[kind][3]:
            continue
        kept.append((start, kind, end))
    kept.sort()
    return to_code_points(data, kept)


def to_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points, by one walk over the text."""
    at = code = 0
    points = {}
    for offset in sorted({x for start, _, end in spans for x in (start, end)}):
        code += len(data[at:offset].decode("utf-8", "replace"))
        at = offset
        points[offset] = code
    return [(points[start], kind, points[end]) for start, kind, end in spans]


def digest(names: list[str], spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{names[k]}:{start}:{end}" for start, k, end in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of secrets in each text."""
    scan = scanner()

    def run(ids, texts):
        out = {"doc_id": ids, "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for text in texts:
            spans = find(scan, text or b"")
            base = [s for s in spans if s[1] < BASE]
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(digest(scan.names, base).encode()).hexdigest())
            out["spans"].append(digest(scan.names, spans))
        return out

    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, SCHEMA)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every found span of `text` replaced by the mask (spans that touch or overlap share one) and n_chars set to match.

    Cases: null and empty texts stay as they are; repeated rows are each masked; other columns are kept as they are; an
    empty table stays empty.
    """
    scan = scanner()
    fields = docs.schema

    def run(*columns):
        out = dict(zip(fields.names, columns, strict=True))
        texts = list(out["text"])
        for i, text in enumerate(texts):
            pieces, at = [], 0
            for start, _, end in find(scan, text.encode()) if text else ():
                if start >= at and end > at:
                    pieces += [text[at:start], mask] if start > at or not pieces else []
                    at = end
                elif end > at:
                    at = end
            if pieces:
                texts[i] = "".join(pieces) + text[at:]
        out["text"] = texts
        if "n_chars" in out:
            out["n_chars"] = [n if text is None else len(text) for n, text in zip(out["n_chars"], texts, strict=True)]
        return out

    return map_rows(docs, run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: secrets of every document."""
    return secret_scan(table(spark, sf_dir, "documents"))
