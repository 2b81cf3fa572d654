"""Token ids of a word-level BPE tokenizer file, with a bounded cache of words.

The tokenizer drops white space and never joins tokens across it, so a text's ids are those
of its white-space separated chunks. Chunks repeat, so most are answered from the cache. Texts
with characters for which lower-casing, normalisation or white space could differ between
libraries are encoded whole by the ``tokenizers`` library.
"""

from __future__ import annotations

from array import array

import numpy as np

#: UTF-8 bytes of texts that the chunk path handles: ASCII without the separators 1C-1F, and
#: the letters U+00C0..U+00FF (lead byte C3).
PLAIN = bytes(b for b in [*range(0x00, 0x1C), *range(0x20, 0x80), 0xC3, *range(0x80, 0xC0)])
MARKS = ".,!?;:%$#*&|()[]{}\"=+@/\\<>~^_`-"
#: Words kept per Python worker, some 200 bytes each.
CACHE = 250_000
#: Words with marks at their end are kept up to this length.
SHORT = 9


class WordEncoder(dict):
    """Maps a lower-case chunk to the bytes of its ids (little-endian, 32 bits)."""

    _by_path: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow U+0100
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.letters = {c: "".join(names[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One per Python worker, so that the cache outlives a task."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        if word and len(word) < len(chunk) and word[-1].isalnum():  # else the marks belong to the piece before
            ids = self[word] + self[chunk[len(word) :]]
            if len(chunk) <= SHORT and len(self) < CACHE:
                self[chunk] = ids
            return ids
        if word.isalpha():
            ids = array("I", [t.id for t in self.model.tokenize(chunk if chunk.isascii() else chunk.translate(self.letters))]).tobytes()
        else:
            ids = self.whole(chunk)
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        if text.encode("utf-8", "surrogatepass").translate(None, PLAIN):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))
