"""Each stage against its brute-force version on its own input; the whole run on a small folder."""

import importlib

import numpy as np

import corpus_pipeline
from helixframe.llm import decontaminate, secrets, simhash, toxicity
from helixframe.llm.common import table
from tests.llm import test_packing
from tests.llm.common import SF, documents, edge_texts, sf_folder, with_clash
from tests.llm.test_decontaminate import words
from tests.llm.test_secrets import base_spans


def one_of_each(marked):
    """Least id of each class of (id, wide fingerprint), by all pairs."""
    codes = list({f for _, f in marked})
    words, parent = np.array(codes, dtype=np.uint64), list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(words[k] ^ words[k + 1 :]).sum(1) <= 48).tolist():
            parent[root(k)] = root(k + 1 + j)
    at, least = {f: k for k, f in enumerate(codes)}, {}
    for i, f in marked:
        least[root(at[f])] = min(i, least.get(root(at[f]), i))
    return set(least.values())


def test_stages_on_documents(spark):
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items if (w := words(t)) for i in range(max(1, len(w) - 9))}

    def contaminated(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontaminate", "secrets", "packing"]

    given = docs.collect()
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.schema == docs.schema
    labelled = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in clean.collect()}
    toxic = [i for i, t in labelled.items() if t]
    assert np.mean([i not in kept for i in toxic]) > 0.9 and np.mean([i in kept for i, t in labelled.items() if not t]) > 0.97
    model = toxicity.train(toxicity.sample(docs, table(spark, SF, "labels")))
    assert kept == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}

    once = stages["near_dedup"](spark, docs, SF)
    assert once.schema == docs.schema
    stay = {r.doc_id for r in once.collect()}
    want = one_of_each([(r.doc_id, simhash.wide_fingerprint(r.text.encode(), 5)) for r in given])
    # cells are sampled: what all pairs keep stays, and nearly all that they drop goes
    assert want <= stay and len(stay - want) <= 0.03 * (len(given) - len(want))

    free = stages["decontaminate"](spark, docs, SF)
    assert free.schema == docs.schema
    after = {r.doc_id: r.text for r in free.collect()}
    assert not any(contaminated(t) for t in after.values())
    for r in given:
        if not contaminated(r.text):
            assert after[r.doc_id] == r.text

    masked = stages["secrets"](spark, docs, SF)
    assert masked.schema == docs.schema
    for r, was in zip(sorted(masked.collect()), sorted(given), strict=True):
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == was.text) == (not secrets.find(secrets.scanner(), was.text.encode()))

    test_packing.holds(stages["packing"](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in given])


def test_run_on_edges(spark, tmp_path):
    docs = documents(spark, edge_texts())
    sf = sf_folder(spark, tmp_path, documents=with_clash(docs), labels=spark.createDataFrame([(4, 1, 1), (8, 1, 0)], "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame([(1, "some words that nobody wrote")], "item_id bigint, text string"))
    found = corpus_pipeline.run(spark, sf).collect()
    assert found and {r.doc_id for r in found} <= {i for i, _ in edge_texts()}


def test_operators_import_without_swallowing_errors():
    for module in (decontaminate, secrets, simhash, toxicity):
        assert "except ImportError" not in open(importlib.import_module(module.__name__).__file__).read()
