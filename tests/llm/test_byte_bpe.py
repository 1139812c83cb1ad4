"""The fast byte-level encoder gives the tokenizers library's ids, special tokens both ways."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmark.llm.byte_bpe import ByteLevelBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    draw = random.Random(9)
    letters = "ab é日 \n\t  .,'!0<|>endoftext'sll\x85\xa0🎉"
    some = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 400))) for _ in range(300)]
    return some + ["", "a<|endoftext|>b", " " * 2_000_000 + "x", "\n\t" * 400_000, "it's I'LL 12 ½ don't"]


@pytest.mark.parametrize("special", [False, True])
def test_same_ids_as_the_library(special):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = not special
    fast = ByteLevelBpe(PATH, special=special)
    for t in texts():
        assert fast.encode(t) == library.encode(t, add_special_tokens=False).ids
