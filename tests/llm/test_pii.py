"""Base kinds against the regex engine."""

import hashlib
import random
import re

from helixframe.llm import pii
from helixframe.llm.common import table
from tests.llm.common import SF, documents, edge_texts, sf_folder, with_clash

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {"email": lambda: True, "ip": lambda: all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def expect(text):
    spans = sorted((m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text or "") if passes(kind, m))
    names = list(RULES)
    named = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
    return [sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(",".join(named).encode()).hexdigest(), named


def agrees(found, given):
    assert len(found) == len(given)
    of = {}
    for i, t in given:
        of.setdefault(i, []).append(expect(t))
    for r in found:
        assert any([r.n_email, r.n_ip, r.n_card, r.n_phone] == c and r.base_sha256 == sha and set(named) <= set(r.spans.split(",")) for c, sha, named in of[r.doc_id]), (r, of[r.doc_id])


def test_documents(spark):
    agrees(pii.query(spark, SF).collect(), [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])


def test_random_texts(spark):
    rng = random.Random(2)
    parts = ["a", "b1", ".", "@", "-", "+", " ", "(", ")", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 (30) 1234-5678", "x@y.zz", "192.168.0.1", "é", "\n", "0", "007", "%", "_", "٣", "user.name+tag@mail.example.org", "1.2.3.4.5"]
    given = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(1500)]
    agrees(pii.personal_data(documents(spark, given)).collect(), given)


def test_edges(spark, tmp_path):
    given = edge_texts() + [(30, "1." * 5000), (31, "9" * 6000 + ".1.1.1"), (32, "a" * 20000 + "@"), (33, "a@" * 5000 + "b.c")]
    sf = sf_folder(spark, tmp_path, documents=with_clash(documents(spark, given)))
    agrees(pii.query(spark, sf).collect(), given)
    assert pii.personal_data(documents(spark, given).limit(0)).count() == 0


def test_added_kinds():
    machine = pii.anchors()
    text = "IBAN DE89 3704 0044 0532 0130 00 ok; https://bob:pw@host.example/x; account no: 12345678"
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(machine, text) if k >= pii.BASE] == [("iban", "DE89 3704 0044 0532 0130 00"), ("url", "https://bob:pw@host.example"), ("account", "12345678")]
