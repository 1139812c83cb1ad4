"""Byte-level BPE ids of a tokenizers JSON file, fast and exact.

The file's vocabulary is read into tiktoken's BPE engine, which gives the tokenizers library's ids
(ranks are the ids, merges follow them) for about a quarter of the CPU; a text that engine cannot
take (its pattern overflows the stack on very long blank runs) goes to the tokenizers library.
With ``special=False`` special-token strings in a text are plain text; with ``special=True``
they are the special tokens, as the library's default encoding reads them. Nothing is added.
"""

from __future__ import annotations

import os


def byte_level_table() -> dict[str, int]:
    """The byte-level BPE alphabet: printable bytes stand for themselves, the others are moved
    above 255 in byte order (rule of the GPT-2 byte-level encoding)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in own]
    table = {chr(b): b for b in own}
    table.update({chr(256 + k): b for k, b in enumerate(moved)})
    return table


class ByteLevelBpe:
    """``encode(text) -> list[int]`` for a byte-level BPE JSON file."""

    def __init__(self, path: str, library=None, special: bool = False):
        import json

        import public_tokenizers
        import tiktoken

        if library is None:
            # Each task is one core's work; the library's own thread pool would only contend.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = not special
        table = byte_level_table()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")} if special else {}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.library, self.special = library, special

    def encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all") if self.special else self.fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError):
            raise
        except BaseException:          # a panic of the engine: the library takes the text
            return self.library.encode(text, add_special_tokens=False).ids
