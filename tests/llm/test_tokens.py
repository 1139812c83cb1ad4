import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from leafmark.llm import bpe_trie, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  \n\n x", "a<|endoftext|>b <|endoftext|>", "it's I'll don't 'tis 123 ½²", "é" * 300, "x" * 4000, " " * 700 + "a",
    "\x1c\x1d a\x85b\xa0c", "日本語 テキスト 🎉🎉", "=" * 900, "a\r\n\tb", "▁x ▁", " lead", "trail ", "<s> </s> <0x41> \n\t",
    "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x250))),
]


def random_texts(n):
    draw = random.Random(4)
    letters = "aaeehtinorsl  .,'\n-1é"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(1, 300))) for _ in range(n)]


def test_bpe_is_exact(docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = TEXTS + random_texts(150)
    got = {r.doc_id: r for r in bpe_trie.encode_and_decode(docs(texts), VOCABULARY).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_gives_ids_and_decoded_text(docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = bpe_trie.encode_documents(docs(TEXTS), VOCABULARY).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.ids == tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == tokenizer.decode(r.ids, skip_special_tokens=False)


def test_bpe_store_begins_anew(monkeypatch):
    trie = bpe_trie.BpeTrie(VOCABULARY)
    want = {w: trie.encode_word(w.encode()) for w in ("hello", " world", "help", "helping")}
    monkeypatch.setattr(bpe_trie, "KEPT_WORDS", 3)
    trie.learn({"hello", " world"})
    trie.learn({"help", "helping"})
    for w in ("help", "helping"):
        assert trie.words[w][1] == ",".join(map(str, want[w]))


def test_bpe_matcher_gives_the_tokens_that_end_longest_first():
    """One step a byte finds all candidates; no length is tried that no token has."""
    trie = bpe_trie.BpeTrie(VOCABULARY)
    sound = set(trie.sound.values())
    for text in [" understandings", "é日本", "xq7zk" * 3, " " * 9 + "a", "\x00\xff", "internationalization", *random_texts(20)]:
        word, state = text.encode(), 0
        for end in range(1, len(word) + 1):
            while state and (state << 8 | word[end - 1]) not in trie.step:
                state = trie.fall[state]
            state = trie.step[state << 8 | word[end - 1]]
            found, token = [], trie.longest[state]
            while token >= 0:
                found.append(trie.sound[token])
                token = trie.shorter[token]
            assert found == [word[k:end] for k in range(end) if word[k:end] in sound]


def test_bpe_words_that_share_prefixes_are_exact():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    trie = bpe_trie.BpeTrie(VOCABULARY)
    draw = random.Random(6)
    words = sorted({"".join(draw.choice("aeinrst") for _ in range(draw.randint(1, 40))) for _ in range(3000)})
    for word, ids in zip(words, trie.encode_words([w.encode() for w in words])):
        assert ids == tokenizer.encode(word, add_special_tokens=False).ids


def test_unigram_counts_are_exact(docs):
    tokenizer = Tokenizer(models.Unigram(token_counts.vocabulary(PIECES), unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = TEXTS + random_texts(150)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(texts), PIECES).collect()}
    assert got == {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}


@pytest.mark.parametrize("operator", [lambda d: bpe_trie.encode_and_decode(d, VOCABULARY), lambda d: token_counts.token_counts(d, PIECES)])
def test_empty_table_and_repeats(docs, operator):
    assert operator(docs(["a"]).filter("false")).count() == 0
    rows = operator(docs([(None, "a b"), (2, "a b"), (2, "a b")])).collect()
    assert len(rows) == 3 and len({r.n_tokens for r in rows}) == 1


@pytest.mark.parametrize("operator", [lambda d: bpe_trie.encode_and_decode(d, VOCABULARY), lambda d: token_counts.token_counts(d, PIECES)])
def test_clashing_columns_and_null_ids(docs, operator):
    from pyspark.sql import functions as F

    plain = {r.doc_id: r.n_tokens for r in operator(docs([(1, "a b c"), (2, "x" * 20000)])).collect()}
    clash = docs([(1, "a b c"), (2, "x" * 20000), (None, "a b c")], n_tokens=F.lit("theirs"), ids=F.lit(7), decoded=F.lit(None))
    got = operator(clash).collect()
    assert len(got) == 3 and {r.doc_id: r.n_tokens for r in got if r.doc_id is not None} == plain
    assert [r.n_tokens for r in got if r.doc_id is None] == [plain[1]]
