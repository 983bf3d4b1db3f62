"""Token ids from the tokenizer library, gapless sequences, and the number of bins against a plain best fit."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import packing
from helixframe.llm.common import table
from tests.llm.common import SF, documents, edge_texts, sf_folder, with_clash


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*(found.encode(text, add_special_tokens=False).ids if text else ()), 0]


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def holds(found, given, capacity=packing.CAPACITY):
    """Every document's ids are there once, whole; every sequence is gapless from 0 and within the capacity."""
    ids = tokenizer()
    want = Counter()
    for i, text in given:
        tokens = np.array(ids(text), dtype="<u4")
        first = len(tokens) % capacity or min(len(tokens), capacity)
        for k, (a, b) in enumerate(zip([0, *range(first, len(tokens), capacity)], [first, *range(first + capacity, len(tokens) + 1, capacity)], strict=True)):
            want[(i, k, a, b - a, zlib.crc32(tokens[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == best_fit([r.length for r in found], capacity)


def test_documents(spark):
    holds(packing.query(spark, SF).collect(), [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])


def test_edges(spark, tmp_path):
    given = edge_texts() + [(30, "<|endoftext|> in a text"), (31, "tab​　 naïve ﬁ ퟿")]
    sf = sf_folder(spark, tmp_path, documents=with_clash(documents(spark, given)))
    holds(packing.query(spark, sf).collect(), given)
    assert packing.pack(documents(spark, given).limit(0)).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(documents(spark, given), capacity=0)


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(4)
    for capacity in (1, 2, 7, 64, 100):
        for _ in range(60):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 80))]
            rows = packing.plan(dict(Counter(lengths)), capacity)
            bins = {}
            for length, _, n, first, offset in rows:
                for k in range(n):
                    bins.setdefault(first + k, []).append((offset, length))
            for places in bins.values():
                assert sorted(places)[0][0] == 0 and sum(n for _, n in places) <= capacity
                assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:], strict=False))
            assert Counter(n for p in bins.values() for _, n in p) == Counter(lengths)
            assert len(bins) == best_fit(lengths, capacity)


def test_both_tokenizer_libraries_agree():
    own, ids = packing.Encoder(), tokenizer()
    rng = random.Random(6)
    chars = "abc XYZ 123 .,;:!?'\"\n\t éüßñ±÷ ə‘’ 漢字😀  ́ ###"
    for _ in range(400):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(60)))
        assert [*own.ids(text), 0] == ids(text) or not text


def test_both_libraries_agree_on_every_character_of_the_fast_set():
    coder = packing.Encoder()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(coder.path)
    fast = [c for c in map(chr, range(0x2100)) if not packing.RARE.search(c)]
    assert len(fast) > 500
    kinds = ["a", "Z", "é", "7", " ", "\n", "\r\n", "\t", "'", "'s", "'LL", ".", "-", "_", " ", "’", "²", "ǅ"]
    kinds = [k for k in kinds if not packing.RARE.search(k)]
    texts = [c for c in fast] + [c * 40 for c in fast] + [a + c + b for c in fast for a, b in zip(kinds, kinds[3:] + kinds[:3], strict=True)]
    texts += [f"{c}{c} {c}x {c}1  {c}\n{c}" for c in fast] + [a + b + c for a in kinds for b in kinds for c in kinds]
    texts += [k * 20_000 for k in kinds] + ["".join(fast[at::7]) * 30 for at in range(7)]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for text, want in zip(part, slow.encode_batch(part, add_special_tokens=False), strict=True):
            assert coder.ids(text) == want.ids, text[:60]
