"""Fingerprints by their definition; classes against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

from helixframe.llm import simhash
from helixframe.llm.common import table
from helixframe.operators.graph import connected as components
from tests.llm.common import SF, documents, edge_texts, sf_folder, with_clash


def naive(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, distance):
    """Least id reachable, by all pairs. fps: (id, fingerprint)."""
    codes = sorted({f for _, f in fps})
    parent = dict(zip(codes, codes, strict=True))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, a in enumerate(codes):
        for b in codes[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in fps), key=str)


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert rows(simhash.query(spark, SF)) == brute([(i, naive(t)) for i, t in docs], 4)


def test_edges(spark, tmp_path):
    given = edge_texts() + [(30, "ONE two THREE"), (31, "one two three"), (32, "É a b c d"), (33, "é a b c d")]
    sf = sf_folder(spark, tmp_path, documents=with_clash(documents(spark, given)))
    assert rows(simhash.query(spark, sf)) == brute([(i, naive(t)) for i, t in given], 4)
    assert simhash.classes(documents(spark, given).limit(0)).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    codes = set(centres)
    for c in centres:
        for _ in range(30):
            codes.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 8))))
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    for distance, groups in ((4, 8), (6, 9), (8, 10)):
        found = components(simhash.links(spark.createDataFrame(signed, "fp bigint"), distance, groups)).collect()
        classes = {}
        for r in found:
            classes.setdefault(r.root, set()).add(r.node % (1 << 64))
        want = {}
        for i, code, least in brute([(k, c) for k, c in enumerate(sorted(codes))], distance):
            want.setdefault(least, set()).add(int(code, 16))
        assert sorted(map(sorted, classes.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 2000, dtype=np.uint64), rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)) for k in range(32)]).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(0)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_the_number_of_tables_grows_slowly():
    found = [simhash.tables_for(n, 0.8, 0.03) for n in (1, 10**5, 10**7, 10**9, 10**10)]
    assert found == sorted(found) and found[0][1] < 12 and found[3][1] < 200 and found[4][1] < 300
    # rows in a cell stay about the same
    assert all(64 <= n / 2**k <= 256 for n, (k, _) in zip((10**5, 10**7, 10**9), found[1:4], strict=True))


def test_hot_cells_are_split_and_lose_nothing(spark):
    rng = random.Random(9)
    codes = {0}
    for _ in range(6):  # many fingerprints of few bits share cells
        codes |= {c ^ (1 << b) for c in rng.sample(sorted(codes), min(len(codes), 40)) for b in rng.sample(range(64), 20)}
    codes |= {c ^ ((1 << 40) - 1) for c in rng.sample(sorted(codes), 100)}
    fps = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp bigint").repartition(8)
    whole = {(r.node, r.root) for r in components(simhash.links(fps, 2, 4)).collect()}
    for hot in (10, 64, 500):
        assert {(r.node, r.root) for r in components(simhash.links(fps, 2, 4, hot)).collect()} == whole
    want = {i: least for i, _, least in brute([(c, c) for c in codes], 2)}
    sizes = sorted(Counter(want.values()).values())
    assert sorted(Counter(r for _, r in whole).values()) == [n for n in sizes if n > 1]


def jaccard(a, b):
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def test_near_copies_of_similarity_080_are_caught_and_others_left(spark):
    rng = random.Random(11)
    pairs = []
    for k in range(600):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(120, 500))]
        near = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.choice((0.005, 0.015, 0.021, 0.08))))):
            near[at] = f"x{rng.randrange(10**6)}"
        pairs.append((" ".join(words), " ".join(near)))
    docs = documents(spark, [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)])
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    alike = [k for k, p in enumerate(pairs) if 0.8 <= jaccard(*p)]
    apart = [k for k, p in enumerate(pairs) if jaccard(*p) < 0.55]
    assert len(alike) > 200 and len(apart) > 100
    assert np.mean([2 * k + 1 not in kept for k in alike]) >= 0.9
    assert np.mean([2 * k + 1 in kept for k in apart]) >= 0.97
    assert all(2 * k in kept for k in range(len(pairs)))


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5, 5), (7000, 6999), (6999, 7000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in range(301)}, **{k: 1000 for k in range(1000, 1400)}, 6999: 6999, 7000: 6999}


def test_one_of_each_keeps_the_least_id_and_rows_without_id(spark):
    text = " ".join(f"w{k}" for k in range(300))
    near = text.replace("w150 ", "x ")
    other = " ".join(f"v{k}" for k in range(300))
    docs = documents(spark, [(4, near), (3, text), (3, text), (9, other), (None, text), (None, None)])
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None", "None"]


def test_one_of_each_keeps_rows_without_text_and_every_text_of_a_repeated_id(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(60)) for w in ("a", "b", "c"))
    given = [(1, None), (2, ""), (3, " \n"), (4, None), (5, one), (6, one), (6, two), (6, three), (7, two), (7, two)]
    kept = simhash.one_of_each(documents(spark, given)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, None), (2, ""), (3, " \n"), (4, None), (5, one), (6, two), (6, three)], key=repr)
