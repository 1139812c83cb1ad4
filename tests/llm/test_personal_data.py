import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from leafmark.llm.personal_data import added_spans, base_spans, find_personal_data, find_spans, stretches, train_field

KINDS = ["email", "ip", "card", "phone"]


def brute(text):
    text, found = text or "", []
    found += [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(map(int, str(2 * d))) for d in digits[1::2])) % 10 == 0:
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


TEXTS = [
    None, "", "plain words", "@", "a@b.c@d.e.f", "a@b@c.d", "x@-.-", "1.2.3.4.5.6.7.8", "1.2.3.999 001.02.3.255", "..a@b..c@d.e",
    "+1 (555) 123-4567.", "+12", "4111 1111-1111 1111 and 4111111111111112", "4" * 60, "+1+1 23456789 0", "é@b.c a@é.b 🎉 me@ex.org", "9" * 5000 + "." + "1",
    "a" * 100_000 + "@", "@" * 3000, "x@y.z " * 500,
]


def test_base_spans_against_plain_search():
    draw = random.Random(1)
    texts = [t for t in TEXTS if t is not None and len(t) < 50_000] + ["".join(draw.choice("a1@.+- (2,)\n") for _ in range(70)) for _ in range(4000)]
    for text in texts:
        assert sorted(base_spans(text)) == brute(text), text


def test_query_columns(docs):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[10]), (5, TEXTS[10]), (5, TEXTS[10])]
    got = find_personal_data(docs(rows, spans=F.lit("theirs"))).collect()
    assert len(got) == len(rows)
    texts = dict(enumerate(TEXTS))
    for r in got:
        if r.doc_id is None or r.doc_id == 5 or r.doc_id == 17:
            continue
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, joined(base).split(","))) <= set(r.spans.split(","))
    assert find_personal_data(docs(["a@b.c"]).filter("false")).count() == 0


def test_adjacent_items_of_one_kind():
    """Tokens that are all tagged alike give every item among them, beside base spans too."""
    for kind, text, want in [
        (3, "+1 555 123 4567, 555-987-6543", ["555-987-6543"]),
        (3, "+1 555 123 4567 555-987-6543", ["+1 555 123 4567", "555-987-6543"]),
        (2, "4111111111111112 4111111111111113", ["4111111111111112", "4111111111111113"]),
        (2, "4111 1111 1111 1112 4111-1111-1111-1113", ["4111 1111 1111 1112", "4111-1111-1111-1113"]),
        (3, "5551234 5559876", ["5551234", "5559876"]),
        (3, "44 2071234567", ["44 2071234567"]),
        (3, "(555) 123 4567", ["(555) 123 4567"]),
        (0, "me@example you@there", ["me@example", "you@there"]),
        (2, "12 4111111111111112", ["12 4111111111111112"]),
        (2, "12345", []),
    ]:
        base = base_spans(text)
        sequences = stretches(text)
        tags = np.full(sum(map(len, sequences)), kind + 1)
        got = added_spans(text, sequences, tags, base)
        assert [(k, text[a:b]) for k, a, b in got] == [(kind, w) for w in want], text


def test_field_adds_by_shape_and_leaves_the_rest():
    draw = random.Random(2)

    def word():
        return "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))

    def card(good):
        digits = [draw.randint(0, 9) for _ in range(15)]
        total = sum(digits[1::2]) + sum(sum(map(int, str(2 * d))) for d in digits[::2])
        return "".join(map(str, [*digits, (-total + (not good)) % 10]))

    def text(k):
        mail = f"{word()}.{draw.randint(1, 99)}@{word()}{draw.randint(1, 9)}.example.com"
        phone = f"+1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}"
        return " ".join([word(), mail, word(), "version", f"{draw.randint(1, 9)}.0.", word(), phone, word(), card(True), word()])

    field = train_field([text(k) for k in range(150)])
    held_out = [text(k) for k in range(100)]
    clean = [" ".join([word(), f"{draw.randint(1, 9)}.0", word(), "chapter", str(draw.randint(1, 99)), word()]) for _ in range(200)]
    assert all(not added for _, added in find_spans(held_out, field))          # all is found by the base already
    assert sum(bool(added) for _, added in find_spans(clean, field)) == 0
    # A mistyped digit fails the base's check; shape and neighbours give the number away.
    near = [f"{word()} {word()} {card(False)} {word()} {word()}" for _ in range(50)]
    found = [(base, added) for base, added in find_spans(near, field)]
    assert not any(base for base, _ in found)
    assert sum([k for k, _, _ in added] == [2] for _, added in found) >= 45


def test_training_sample_is_bounded_and_whole(docs):
    """Repeated rows and more texts than the sample: every row is still reported."""
    rows = [(k % 5, f"call +1 555 010 {k:04d} or mail a{k}@x.org") for k in range(60)] + [(None, None)]
    got = find_personal_data(docs(rows), train_texts=10).collect()
    assert len(got) == len(rows) and sum(r.n_email for r in got) == 60
