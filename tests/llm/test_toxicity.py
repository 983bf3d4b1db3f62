"""Held-out accuracy, the naive noisy-or, and the cases of the docstring."""

import math
import zlib

import numpy as np

from helixframe.llm import toxicity
from helixframe.llm.common import table
from tests.llm.common import documents, edge_texts, sf_folder, with_clash


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    n1 = label.sum()
    return (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.query(spark, sf).select("doc_id", "held_out", "score", "predicted").join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()
    assert auc(found.score.to_numpy(), found.toxic.to_numpy()) > 0.97
    assert (found.predicted == found.toxic).mean() > 0.95


def test_score_is_the_noisy_or_of_sentences(spark):
    model = toxicity.Model({"bad": 3.0, "awfu*": 2.0, "fine": -1.0}, -2.0)
    texts = ["Bad day. Fine day!", "awfully bad", "fine", "", "nothing. at all\nhere"]
    got = {r.doc_id: r for r in toxicity.score(documents(spark, texts), model).collect()}

    def p(*weights):
        return 1 / (1 + math.exp(-(sum(weights) - 2.0)))

    expected = [1 - (1 - p(3)) * (1 - p(-1)), p(2, 3), p(-1), 0.0, 1 - (1 - p()) ** 3]
    assert all(abs(got[k].score - x) < 1e-12 for k, x in enumerate(expected))
    assert [(s.start, s.end) for s in got[0].offending] == [(0, 8)]


def test_held_out_labels_and_other_columns_have_no_say(spark, tmp_path):
    texts = [("horrible vile text number %d" if k % 3 == 0 else "a calm plain text number %d") % k for k in range(300)]
    docs = documents(spark, texts)
    labels = [(k, 1, int(k % 3 == 0)) for k in range(300)]
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    schema = "doc_id bigint, quality int, toxic int"
    one = toxicity.toxicity(docs, spark.createDataFrame(labels, schema))
    two = toxicity.toxicity(with_clash(docs.replace("src", "other", ["source"])), spark.createDataFrame(flipped, schema))
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(one) == key(two)
    assert all((s >= 0.5) == (k % 3 == 0) for k, s in key(one))


def test_edges(spark, tmp_path):
    docs = with_clash(documents(spark, edge_texts()))
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (5, 0, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    sf = sf_folder(spark, tmp_path, documents=docs, labels=labels)
    found = toxicity.query(spark, sf).collect()
    assert len(found) == len(edge_texts())
    assert all(r.score == 0.0 for r in found if r.doc_id in (1, 2))
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_keep_clean_keeps_rows_below_the_threshold(spark):
    model = toxicity.Model({"bad": 9.0}, -4.0)
    docs = documents(spark, [(1, "bad"), (2, "good"), (2, "good"), (3, None), (None, "bad")])
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, model).collect()) == [2, 2, 3]
    assert toxicity.keep_clean(docs, model).schema == docs.schema
