"""Byte-level BPE over a trie of distinct words, and decoding.

The new words of many texts form a trie of their bytes, gone through depth first: in sorted
order each word continues the path of the one before it from where the two part. Every node
has the last token of the encoding of its prefix, which follows from the nodes above it: it is
the one vocabulary token that ends here and stays separate from the last token before it. So a
prefix that many words share is encoded once, and a word's tokens are read back up its path.
Every node also has the state of a matcher of all vocabulary tokens (Aho-Corasick), which names
the longest token that ends here; shorter ones follow from token to token, longest first.

Defined results: null text counts as empty and has no tokens; the special token's text is that
token wherever it stands; very long words cost time in proportion to their length; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from leafmark.llm.common import documents

# The byte-level alphabet's printable ranges, and the word pattern.
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s++""")
# The same pattern for texts of these characters only, in the faster engine.
PLAIN = re.compile(r"[^\t-\r -~¡-ª«-±´¶-¸»¿-ſ]")
LATIN = "A-Za-zªºÀ-ÖØ-öø-ſ"
PLAIN_WORDS = re.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]++| ?[0-9]++| ?[^\t-\r {LATIN}0-9]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]++""")
#: Distinct words whose encodings a worker keeps, and texts whose new words form one trie.
KEPT_WORDS, TEXTS = 500_000, 256
OUT = "doc_id bigint, ids array<int>, decoded string"


def byte_alphabet() -> dict[str, int]:
    """Letter of the vocabulary file for each byte: itself if printable, else one from 256 on."""
    printable = [b for span in PRINTABLE for b in span]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class BpeTrie:
    """One vocabulary and the encodings of the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}     # (left, right) -> (rank, joined)
        self.parts: dict[int, tuple[int, int, int]] = {}           # joined -> (rank, left, right)
        for rank, (left, right) in enumerate(spec["model"]["merges"] if not isinstance(spec["model"]["merges"][0], str) else
                                             [m.split(" ") for m in spec["model"]["merges"]]):
            a, b = spec["model"]["vocab"][left], spec["model"]["vocab"][right]
            c = spec["model"]["vocab"][left + right]
            self.rank[a, b] = (rank, c)
            if c not in self.parts:
                self.parts[c] = (rank, a, b)
        # A token that merging its own bytes does not give back is never in an encoding.
        self.sound = {t: b for b, t in self.id_of.items() if len(b) == 1 or self._merge(b) == [t]}
        self.length_of = {t: len(b) for t, b in self.sound.items()}
        self._match_tokens()
        self.reset()

    def reset(self) -> None:
        self.apart: dict[int, bool] = {}                           # left << 32 | right
        self.words = {s: (1, str(i), s.encode("utf-8"), array("i", [i]).tobytes()) for s, i in self.special.items()}

    def _match_tokens(self) -> None:
        """The matcher: ``step`` (state << 8 | byte -> state), ``fall`` (the state of the longest
        proper suffix), ``longest`` token that ends in a state, and the next ``shorter`` token."""
        step: dict[int, int] = {}
        fall, longest, levels = [0], [-1], [[0]]
        for token, word in self.sound.items():
            state = 0
            for depth, byte in enumerate(word, 1):
                following = step.get(state << 8 | byte)
                if following is None:
                    following = step[state << 8 | byte] = len(fall)
                    fall.append(state << 8 | byte)
                    longest.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(following)
                state = following
            longest[state] = token
        self.shorter: dict[int, int] = {}
        # Until its turn, ``fall`` of a state holds how it is reached; shallower states are done.
        for level in levels[1:]:
            for state in level:
                before, byte = fall[state] >> 8, fall[state] & 255
                at = None
                while before and at is None:
                    before = fall[before]
                    at = step.get(before << 8 | byte)
                fall[state] = at or 0
                if longest[state] < 0:
                    longest[state] = longest[fall[state]]
                else:
                    self.shorter[longest[state]] = longest[fall[state]]
        self.step, self.fall, self.longest = step, fall, longest

    def _merge(self, word: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals; for short byte strings."""
        ids = [self.id_of[word[k:k + 1]] for k in range(len(word))]
        while True:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                return ids
            k = best[1]
            ids[k:k + 2] = [self.rank[ids[k], ids[k + 1]][1]]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives just these two tokens again.

        Their merges are undone from the last one back; the two stay apart unless a merge over
        the seam would have come before the one just undone. Of equal ranks the left one is first.
        """
        known = self.apart.get(left << 32 | right)
        if known is None:
            a, b, limit = left, right, len(self.rank)
            while True:
                over = self.rank.get((a, b))
                if over is not None and over[0] < limit:
                    known = False
                    break
                of_a, of_b = self.parts.get(a), self.parts.get(b)
                if of_a is None and of_b is None:
                    known = True
                    break
                if of_b is None or (of_a is not None and of_a[0] > of_b[0]):
                    limit, a = of_a[0], of_a[2]
                else:
                    limit, b = of_b[0] + 1, of_b[1]
            self.apart[left << 32 | right] = known
        return known

    def encode_words(self, words: list[bytes]) -> Iterator[list[int]]:
        """Tokens of each of the sorted words; ``last`` and ``states`` go along the current path."""
        length_of, known, shorter = self.length_of, self.apart, self.shorter
        step, fall, longest = self.step.get, self.fall, self.longest
        before, last, states = b"", [-1], [0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1:], states[shared + 1:]
            state = states[shared]
            for end in range(shared + 1, len(word) + 1):
                byte = word[end - 1]
                following = step(state << 8 | byte)
                while following is None and state:
                    state = fall[state]
                    following = step(state << 8 | byte)
                state = following or 0
                token = longest[state]
                while True:
                    begin = end - length_of[token]
                    if begin == 0:
                        break
                    apart = known.get(last[begin] << 32 | token)
                    if apart or (apart is None and self._stay_apart(last[begin], token)):
                        break
                    token = shorter[token]
                last.append(token)
                states.append(state)
            before, end, ids = word, len(word), []
            while end:
                ids.append(last[end])
                end -= length_of[last[end]]
            ids.reverse()
            yield ids

    def encode_word(self, word: bytes) -> list[int]:
        return next(self.encode_words([word])) if word else []

    def learn(self, words: set[str]) -> None:
        """Encode the words not yet known; the store begins anew when it is full."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > KEPT_WORDS:
            self.reset()
            new = words.difference(self.words)
        ordered = sorted(new)                                      # the order of their UTF-8 bytes
        for word, ids in zip(ordered, self.encode_words([w.encode("utf-8") for w in ordered])):
            self.words[word] = (len(ids), ",".join(map(str, ids)), self.decode(ids), array("i", ids).tobytes())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=1)
def load(path: str) -> BpeTrie:
    return BpeTrie(path)


def split_words(trie: BpeTrie, text: str) -> list[str]:
    """Words of the text; a special token's text is a word of its own."""
    if not any(s in text for s in trie.special):
        return WORDS.findall(text) if PLAIN.search(text) else PLAIN_WORDS.findall(text)
    found: list[str] = []
    for part in regex.split("(" + "|".join(regex.escape(s) for s in trie.special) + ")", text):
        found.extend([part] if part in trie.special else WORDS.findall(part))
    return found


def _encoded(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(path)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                split = [split_words(trie, text) for text in part.column(1).to_pylist()]
                trie.learn(set().union(*split))
                known = trie.words
                ends, packed, decoded = [0], [], []
                for words in split:
                    found = [known[w] for w in words]
                    packed.append(b"".join([ids for _, _, _, ids in found]))
                    ends.append(ends[-1] + len(packed[-1]) // 4)
                    decoded.append(b"".join([raw for _, _, raw, _ in found]).decode("utf-8", errors="replace"))
                flat = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(decoded, pa.string()),
                ], schema=schema)

    return run


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded of every document."""
    return documents(docs).mapInArrow(_encoded(vocabulary), OUT)


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, from its ids and decoded text."""
    return encode_documents(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
