"""Token ids of random texts against the tokenizers library itself."""

import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from strata.llm.word_tokens import WordEncoder


def test_ids_of_random_texts():
    path, rng = P.path("word_bpe_49k.json"), random.Random(6)
    lib, own = Tokenizer.from_file(path), WordEncoder.of(path)
    lib.encode_special_tokens = True
    words = ["dogs", "the", "I", "n", "hello", "don't", "it's", "quoted", "x1", "7", "42nd", "é", "Ça", "naïve", "über", "a.b", "\x1b", "×", "µ", "ß", "日本", "😀", "<unk>", "é"]
    marks = ["'", "'", ".", ",", "!", ";", ":", '"', "(", ")", "-", "_", "''", "...", "'s", "´", "\x7f"]
    for _ in range(30_000):
        parts = [rng.choice(marks) * rng.randint(0, 2) + rng.choice(words) + "".join(rng.choices(marks, k=rng.randint(0, 3))) for _ in range(rng.randint(0, 4))]
        text = rng.choice([" ", "  ", "\n", "\t"]).join(parts)
        assert np.frombuffer(own.encode_bytes(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
