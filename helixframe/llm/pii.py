"""Personal data by anchor expansion.

One Aho-Corasick pass over each whole text finds anchors: at-signs, "://", digits, "+digit" and account cues. A local
parser expands each anchor by character-class runs and validates what it finds: emails (address syntax), IPv4 numbers,
payment cards (Luhn), phone numbers, and beyond those four base kinds IBANs (mod 97), urls with credentials and
numbers named by a cue (account, ssn, passport).

Each kind's spans are those of a leftmost scan that does not overlap; a match that fails its check is dropped and its
characters are used up. Parsers walk each run once, so very long runs cost linear time. Spans are in code points.

Cases: a null or empty text has no spans; repeated ids give a row each; an empty table gives none; very long
texts are searched whole; spans of one start are listed by kind. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import map_columns, table

NAME = "op6_personal_data"
ORACLE_SQL = None

KINDS = ["email", "ip", "card", "phone", "iban", "url", "account"]
BASE = 4
CUES = ("account", "acct", "ssn", "passport", "konto", "compte", "cuenta")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RUN = re.compile(r"[\x20().0-9-]*")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
URL = re.compile(r"://[^\s:@/]+:[^\s:@/]+@[A-Za-z0-9.-]+")
NUMBER = re.compile(r"(?:\x20?(?:no|nr|number|id))?\.?\x20*[:#=]?\x20*([0-9][0-9-]{4,20}[0-9])(?![0-9])")
DIGITS = frozenset("0123456789")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
        found.add_word("+" + digit, ("plus", 2))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for word in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(word, ("cue", len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(ch, 36)) for ch in text[4:] + text[:4])) % 97 == 1


def find(machine: ahocorasick.Automaton, text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start and then kind."""
    spans: list[tuple[int, int, int]] = []
    mail_free = ip_free = card_free = phone_free = other_free = 0
    for last, (what, size) in machine.iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= ip_free:
                run = DOTTED.match(text, at)
                ip_free = run.end()
                if "." in run[0]:
                    _ips(run, spans)
            if at >= card_free and (m := CARD.match(text, at)):
                card_free = m.end()
                if m.end() - m.start() >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, 2, m.end()))
            if at >= other_free and at >= 2 and text[at - 1].isupper() and text[at - 2].isupper() and (m := IBAN.match(text, at - 2)):
                if at - 3 < 0 or not text[at - 3].isalnum():
                    if iban_ok(m[0]):
                        spans.append((at - 2, 4, m.end()))
                        other_free = m.end()
        elif what == "plus":
            if at >= phone_free:
                end = PHONE_RUN.match(text, at + 2).end()
                while end > at + 3 and text[end - 1] not in DIGITS:
                    end -= 1
                if end > at + 3:
                    phone_free = end
                    if 10 <= sum(ch in DIGITS for ch in text[at:end]) <= 15:
                        spans.append((at, 3, end))
        elif what == "at":
            start = at
            while start > mail_free and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                spans.append((start, 0, m.end()))
                mail_free = m.end()
        elif what == "scheme":
            if m := URL.match(text, at):
                start = at
                while start > 0 and text[start - 1].isalnum() and text[start - 1].isascii():
                    start -= 1
                spans.append((start, 5, m.end()))
        elif m := NUMBER.match(text, last + 1):
            spans.append((m.start(1), 6, m.end(1)))
    spans = sorted(set(spans))
    return spans


def _ips(run: re.Match, spans: list) -> None:
    """Groups of four parts, in order, of one run of dotted numbers."""
    at, parts = run.start(), run[0].split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
            spans.append((at, 1, end))
        at = end + 1


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data in each text."""

    def run(ids, texts):
        machine = run.__dict__.get("machine")
        if machine is None:
            machine = run.machine = anchors()
        out = {"doc_id": ids, "n_email": [], "n_ip": [], "n_card": [], "n_phone": [], "base_sha256": [], "spans": []}
        for text in texts:
            spans = find(machine, text or "")
            base = [s for s in spans if s[1] < BASE]
            for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                out[name].append(sum(s[1] == k for s in base))
            named = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (base, spans)]
            out["base_sha256"].append(hashlib.sha256(named[0].encode()).hexdigest())
            out["spans"].append(named[1])
        return out

    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: personal data of every document."""
    return personal_data(table(spark, sf_dir, "documents"))
