"""Cross-tokenizer alignment against a plain loop over byte offsets and dictionaries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmark.llm.alignment import align_one, alignment_report, byte_level_table, group_labels, load, piece_bytes

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [" " * 300_000 + "long blank run", 
    None, "", "Hello world", "Hello world", "the cat sat on the mat, the end.", "  spaces\tand\nlines\n\n",
    "é à 中文 🎉 emoji", "<|endoftext|> is plain text here", "x" * 3000, "abc" + "Zq9" * 400, "don't won't can't",
    "word " * 2000, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 ﬁ",
]


def brute(texts):
    """Per text: token lists, groups cut where both sides end, occurrence pairs, then counts."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    table = byte_level_table()
    rows = []
    for t in texts:
        if not t:
            rows.append(None)
            continue
        ai = a.encode(" " + t, add_special_tokens=False).ids
        bi = b.encode(t)
        ab = [bytes(table[c] for c in a.id_to_token(i)) for i in ai]
        bb = [piece_bytes(b.id_to_piece(i)) for i in bi]
        want = (" " + t).encode()
        if b"".join(ab) != want or b"".join(bb) != want:
            rows.append(None)
            continue
        ends_a, ends_b, pos = [], [], 0
        for x in ab:
            pos += len(x)
            ends_a.append(pos)
        pos = 0
        for x in bb:
            pos += len(x)
            ends_b.append(pos)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, x, y = [], 0, 0
        for hi in cuts:
            ga, gb = [], []
            while x < len(ai) and ends_a[x] <= hi:
                ga.append(ai[x])
                x += 1
            while y < len(bi) and ends_b[y] <= hi:
                gb.append(bi[y])
                y += 1
            groups.append((ga, gb))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        rows.append((len(ai), len(bi), groups, links))
    count = Counter(p for r in rows if r for p in r[3])
    top = defaultdict(int)
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        s = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()),
                    sum(m for p, m in links.items() if count[p] == top[p[0]]),
                    sum(m * count[p] for p, m in links.items()), hashlib.sha256(s.encode()).hexdigest()))
    return out


def test_against_brute_force(docs):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[4]), (3, TEXTS[2])]
    got = alignment_report(docs(rows, rk=F.lit(1), groups=F.lit("x")), A, B).collect()
    want = sorted(zip([i for i, _ in rows], brute([t for _, t in rows])), key=str)
    assert sorted([(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in got],
                  key=str) == want


def test_pointer_jumping_on_lengths():
    la, lb, n = group_labels(__import__("numpy").array([2, 3, 1, 4]), __import__("numpy").array([1, 4, 1, 2, 2]))
    # ends A: 2 5 6 10; ends B: 1 5 6 8 10 -> cuts 5, 6, 10
    assert (la.tolist(), lb.tolist(), n) == ([0, 0, 1, 2], [0, 0, 1, 2, 2], 3)


def test_empty_table(spark, docs):
    empty = docs([]).limit(0)
    assert alignment_report(empty, A, B).count() == 0


def test_pair_keys_are_formed_as_32_bit_numbers():
    """Sorting them is most of a document's work; wide keys with an inverse cost several times as much."""
    model = load(A, B)
    small, large = align_one("the cat sat on the mat, the end.", model), align_one("abc" + "Zq9" * 400, model)
    assert small[5].dtype == np.int32 and (np.diff(small[5]) > 0).all()
    assert all(int(r[6].sum()) == r[3] for r in (small, large))
