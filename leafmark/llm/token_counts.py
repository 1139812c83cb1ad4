"""Token counts under a unigram vocabulary, by Viterbi that carries scores and counts only.

An Aho-Corasick automaton enumerates the vocabulary matches of a batch's distinct words, all
in one pass; per position the best score and the number of pieces on its path are kept, never
the path. Ties follow the tokenizer: of equal scores the piece that begins first wins, a
character that no piece covers alone costs ten less than the lowest score, and it counts as
its UTF-8 bytes, for which the vocabulary has pieces.

Words begin at each blank, which is written as the vocabulary's own mark, and one mark stands
before the text. Defined results: null and empty texts have no tokens; repeated rows are
counted each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmark.llm.common import documents

# The mark of a blank, and what an uncovered character costs.
MARK, PENALTY = "▁", 10.0
KEPT_WORDS = 400_000


@lru_cache(maxsize=1)
def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and (MARK not in piece[1:]):           # no word has a mark inside
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Count the pieces of the words not yet known: one pass over all, laid end to end.

        Scores start at zero with each word, since no piece reaches over its beginning.
        """
        new = words.difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = {}
            new = words
        line = "".join(new)
        best, count = [0.0] * (len(line) + 1), [0] * (len(line) + 1)
        unknown, low = self.unknown, float("-inf")
        matches = self.matches.iter(line)
        found = next(matches, None)
        at = 0
        for word in new:
            best[at] = 0.0
            count[at] = 0
            for end in range(at + 1, at + len(word) + 1):
                top, pieces, single = low, 0, False
                while found is not None and found[0] == end - 1:
                    length, score = found[1]
                    begin = end - length
                    if begin >= at:
                        total = best[begin] + score
                        if total > top:
                            top, pieces = total, count[begin] + 1
                        single = single or length == 1
                    found = next(matches, None)
                if not single and best[end - 1] + unknown > top:
                    top = best[end - 1] + unknown
                    pieces = count[end - 1] + len(line[end - 1].encode("utf-8"))
                best[end], count[end] = top, pieces
            at += len(word)
            self.known[word] = count[at]

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = [MARK + w for w in text.replace(MARK, " ").split(" ")]
        if words[0] == MARK and len(words) > 1:              # the text begins with a mark of its own
            words = words[1:]
        self.learn(set(words))
        known = self.known
        return sum([known[w] for w in words])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens of every document under the vocabulary and scores of ``model``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = counter(model)
        for batch in batches:
            counts = [viterbi.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    return documents(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint")
