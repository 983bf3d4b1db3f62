"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a linear model over its distinct words and
their prefixes; the document's probability is the noisy-or of its sentences, 1 - prod(1 - p). Only document labels
are used in training; the trained sentence probabilities then locate the offending sentences.

Training reads a bounded sample of labelled rows (`max_docs`, half of each label as far as there are as many, and
`max_bytes` of whole texts, by the order of a hash of the id) without the held-out fold. Scoring reads every whole text in one narrow stage; what it
ships to the workers is a dictionary of at most `max_features` weights.

Cases: a null or empty text has no sentence and scores 0. Ids that repeat are scored once per row. A label that is
null is ignored; of several labels of one id the highest counts. With no toxic or no clean label every score is 0.
An empty table gives no rows; very long texts are scored whole, sentence by sentence; features of equal gain are
chosen by name, sampled rows of equal hash by id.
Columns other than those named are never read, so clashing names do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import map_columns, map_rows, table

NAME = "op1_toxicity"
ORACLE_SQL = None

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
PREFIXES = (4, 5, 6, 7)
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, n_sentences int, offending array<struct<start:int,end:int,p:double>>"


def word_features(token: str) -> list[str]:
    """The words of a token and their proper prefixes, which catch inflected forms."""
    return [f for word in WORD.findall(token) for f in (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-cased tokens) of each sentence."""
    return [(m.start(), m.end(), set(m.group().lower().split())) for m in SENTENCE.finditer(text)]


class Model:
    """Weights by feature and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        """A mapping from word to weight that fills itself."""
        weights = self.weights

        class Words(dict):
            def __missing__(self, word):
                value = sum(weights.get(f, 0.0) for f in word_features(word))
                if len(self) < 500_000:
                    self[word] = value
                return value

        return Words()


class Bags:
    """Sentences as arrays of word numbers; each distinct word's features are numbered once, and no text is kept."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.features: dict[str, int] = {}
        self.of_word: list[np.ndarray] = []
        self.tokens, self.sizes, self.sentences = [], [], []

    def number(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = len(self.of_word)
            self.of_word.append(np.array([self.features.setdefault(f, len(self.features)) for f in word_features(word)], dtype=np.int32))
        return found

    def add(self, text: str) -> None:
        found = [np.array([self.number(w) for w in sorted(words)], dtype=np.int32) for _, _, words in sentences(text)]
        self.tokens.append(np.concatenate(found) if found else np.zeros(0, np.int32))
        self.sizes.append(np.array([len(x) for x in found], dtype=np.int32))

    def counts(self, y: np.ndarray) -> np.ndarray:
        """Documents of either label that hold each feature."""
        out = np.zeros((2, len(self.features)))
        for tokens, label in zip(self.tokens, y.astype(int).tolist(), strict=True):
            held = [self.of_word[w] for w in np.unique(tokens).tolist()]
            if held:
                out[label, np.unique(np.concatenate(held))] += 1
        return out

    def matrix(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, column) of every chosen feature's occurrence, and the document of each sentence. chosen: column by feature, else -1."""
        of_word = [c[c >= 0] for c in (chosen[f] for f in self.of_word)]
        size = np.array([len(c) for c in of_word], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(size)))
        flat = np.concatenate([*of_word, np.zeros(0, np.int64)]).astype(np.int32)
        tokens, sizes = np.concatenate([*self.tokens, np.zeros(0, np.int32)]), np.concatenate([*self.sizes, np.zeros(0, np.int32)])
        sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        kept = size[tokens] > 0
        tokens, sentence = tokens[kept], sentence[kept]
        n = size[tokens]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), [len(x) for x in self.sizes])
        return np.repeat(sentence, n), flat[np.repeat(starts[tokens], n) + within], owner


def train(labelled: Iterable[tuple[str, int]], max_features: int = 4000, min_docs: int = 4, steps: int = 150, l2: float = 2e-3, rate: float = 0.1) -> Model:
    """Fits the noisy-or model by Adam on the mean log-likelihood with an L2 penalty."""
    bags, marks = Bags(), []
    for text, label in labelled:
        bags.add(text or "")
        marks.append(label)
    y = np.array(marks, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model({}, -40.0)
    n1, n0 = y.sum(), len(y) - y.sum()
    names, (c0, c1) = list(bags.features), bags.counts(y)
    p1, p0 = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
    gain = np.where(c0 + c1 >= min_docs, np.abs(p1 - p0) * np.abs(np.log(p1 / p0)), 0)
    able = np.flatnonzero(gain > 0)
    best = sorted(able.tolist(), key=lambda i: (-gain[i], names[i]))[:max_features]
    chosen = {names[i]: k for k, i in enumerate(best)}
    column = np.full(len(names), -1, dtype=np.int64)
    column[best] = np.arange(len(best))
    docs, (rows, cols, owner) = y, bags.matrix(column)
    del bags, names
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, bias = np.zeros(len(chosen)), -4.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = np.clip(bias + np.bincount(rows, w[cols], len(owner)), -40, 40)
        q = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(owner, np.log1p(-np.minimum(q, 1 - 1e-12)), len(docs)))
        up = share * (y * none / np.maximum(1 - none, 1e-9) - (1 - y))
        slope = up[owner] * q
        g = -np.append(np.bincount(cols, slope[rows], len(w)), slope.sum())
        g[:-1] += l2 * w / max(1, len(w)) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    return Model({f: float(w[k]) for f, k in chosen.items() if abs(w[k]) > 0.02}, float(bias))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_bytes: int = 24 << 20) -> Iterator[tuple[str, int]]:
    """A bounded, reproducible sample of labelled rows outside the held-out fold, half of each label at most.

    Rows come in the order of a hash of their id, as far as their whole texts fit in max_bytes together; they are
    fetched a partition at a time.
    """
    label = (
        labels.where("doc_id is not null and toxic is not null")
        .where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    picked = [label.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", "text").where("text is not null")
    sizes = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    taken, left, room = [], max_docs, max_bytes
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        if r.n <= left and r["size"] <= room:
            taken.append((r.doc_id, r.toxic))
            left, room = left - r.n, room - r["size"]
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id bigint, toxic int")
    for r in rows.join(F.broadcast(chosen), "doc_id").toLocalIterator():
        yield r.text, r.toxic


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: score, decision and offending sentences (those of probability 0.5 or more)."""
    weights, bias = model.weights, model.bias

    def run(ids, texts):
        words = run.__dict__.get("words")
        if words is None:
            words = run.words = Model(weights, bias).scorer()
        out = {"doc_id": ids, "held_out": [], "score": [], "predicted": [], "n_sentences": [], "offending": []}
        exp = np.exp
        for i, text in zip(ids, texts, strict=True):
            found = [(m.start(), m.end(), m.group().lower()) for m in SENTENCE.finditer(text or "")]
            z = np.array([sum(map(words.__getitem__, set(s.split()))) for _, _, s in found], dtype=float) + bias
            z = np.clip(z, -40, 40)
            p = 1 / (1 + exp(-z))
            total = float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0
            out["held_out"].append(zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
            out["score"].append(total)
            out["predicted"].append(int(total >= 0.5))
            out["n_sentences"].append(len(found))
            out["offending"].append([{"start": found[k][0], "end": found[k][1], "p": float(p[k])} for k in np.flatnonzero(p >= 0.5)])
        return out

    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below the threshold.

    Cases: null and empty texts score 0 and stay; a score equal to the threshold goes; repeated rows are judged alike; an
    empty table stays empty.
    """
    fields, weights, bias = docs.schema, model.weights, model.bias

    def run(*columns):
        words = run.__dict__.get("words")
        if words is None:
            words = run.words = Model(weights, bias).scorer()
        named = dict(zip(fields.names, columns, strict=True))
        keep = []
        for k, text in enumerate(named["text"]):
            z = np.array([sum(map(words.__getitem__, set(m.group().lower().split()))) for m in SENTENCE.finditer(text or "")], dtype=float) + bias
            if not len(z) or -np.expm1(-np.logaddexp(0, np.clip(z, -40, 40)).sum()) < threshold:
                keep.append(k)
        return {name: [values[k] for k in keep] for name, values in named.items()}

    return map_rows(docs, run, fields)


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 6000) -> DataFrame:
    """Trains on a bounded sample of labelled rows and scores every document."""
    return score(docs, train(sample(docs, labels, max_docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
