"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a word the table stores the one token that can stand last in the
prefix's encoding: the token t for which the rest of the prefix ends in a token u such that
(u, t) is left alone by the merge rules. That last token is unique, so the encoding of a prefix
is read by following last tokens backwards. Appending bytes adds table entries and never
changes old ones; an edit needs new entries from the edited word on. Words with the same
beginning share their entries.

Two tokens are compatible if no merge rule joins parts of both while the two are being merged;
a token that merging can't produce from its own bytes is never a last token of a longer word.
As in byte-level BPE libraries, a word that is itself in the vocabulary is that token.

Defined cases: null text counts as empty and has no tokens; very long words are encoded in
linear table steps; repeated rows are each returned; an empty table gives an empty result;
further columns are ignored. Bytes that are missing in the vocabulary raise KeyError.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

#: Entries kept per Python worker.
WORDS, PIECES, PREFIXES, PAIRS = 600_000, 100_000, 400_000, 400_000
#: Chunks that are more than letters are kept up to this length.
SHORT = 9
MARKS = ".,!?;:%$#*&|()[]{}\"=+@/\\<>~^_`-"
SPACES = {"", *(chr(c) for c in [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])}


class ByteBpe:
    """Encoder and decoder for one vocabulary of ranks and one pattern of words."""

    _by_path: dict[tuple[str, str], ByteBpe] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        # the last token is unique, so likely lengths may be tried first
        self.sizes = sorted(range(1, max(map(len, ranks)) + 1), key=lambda n: (abs(n - 3), n))
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.sound: dict[int, bool] = {}
        self.last: dict[bytes, tuple] = {}
        self.words = Cached(self.word_ids, PIECES)
        self.spaced = Cached(self.after_space, WORDS)

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._by_path:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cls._by_path[path, pattern] = cls(ranks, pattern)
        return cls._by_path[path, pattern]

    def merged(self, data: bytes) -> list[int]:
        """Plain rank-order merging; only for the few bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def is_sound(self, token: int) -> bool:
        if token not in self.sound:
            self.sound[token] = self.merged(self.bytes_of[token]) == [token]
        return self.sound[token]

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token that touch its edge (side 0: left, 1: right) while it is being
        merged, each with the rank of the merge that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            data, until, known = self.bytes_of[token], 1 << 60, []
            while True:
                known.append((data, until))
                if len(data) == 1:
                    break
                until = self.ranks[data]
                data = self.halves(data)[side]
            self.spines[side][token] = known
        return known

    def halves(self, data: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge is this sound token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def compatible(self, a: int, b: int) -> bool:
        """True if no merge joins a part at the right edge of ``a`` and one at the left edge of
        ``b`` while both exist. Merges happen in the order of ranks, the left one first."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            get, right = self.ranks.get, self.spine(b, 0)
            known = True
            for u, u_ends in self.spine(a, 1):
                for v, v_ends in right:
                    r = get(u + v)
                    if r is not None and r < u_ends and r <= v_ends:
                        known = False
                        break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def last_token(self, data: bytes, end: int, before: list[int]) -> int:
        """The last token of data[:end], given those of all shorter prefixes."""
        get, sound = self.ranks.get, self.is_sound
        for size in self.sizes:
            if size > end:
                continue
            t = get(data[end - size : end])
            if t is not None and sound(t) and (size == end or self.compatible(before[end - size - 1], t)):
                return t
        raise KeyError(data[end - 1 : end])

    def extend(self, data: bytes, table: list[int]) -> None:
        """Appends the last tokens of the prefixes of ``data`` that ``table`` doesn't have yet."""
        for end in range(len(table) + 1, len(data) + 1):
            table.append(self.last_token(data, end, table))

    def read(self, data: bytes, table: list[int]) -> list[int]:
        ids, end = [], len(data)
        while end:
            ids.append(table[end - 1])
            end -= len(self.bytes_of[table[end - 1]])
        return ids[::-1]

    def word(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) > 48:
            self.extend(data, table := [])
            return self.read(data, table)
        # self.last: prefix -> (its last token, the entry of the rest); an entry's prefixes are all there
        last = self.last
        if len(last) >= PREFIXES:
            last.clear()
        n = len(data)
        k = n
        while k and data[:k] not in last:
            k -= 1
        get, sizes, sound, pairs = self.ranks.get, self.sizes, self.sound, self.pairs
        for end in range(k + 1, n + 1):
            for size in sizes:
                if size > end:
                    continue
                t = get(data[end - size : end])
                if t is None or not (sound[t] if t in sound else self.is_sound(t)):
                    continue
                if size == end:
                    last[data[:end]] = (t, None)
                    break
                rest = last[data[: end - size]]
                fits = pairs.get(rest[0] << 32 | t)
                if fits if fits is not None else self.compatible(rest[0], t):
                    last[data[:end]] = (t, rest)
                    break
            else:
                raise KeyError(data[end - 1 : end])
        ids, entry = [], last[data]
        while entry:
            ids.append(entry[0])
            entry = entry[1]
        ids.reverse()
        return ids

    def word_ids(self, word: str) -> bytes:
        return array("I", self.word(word.encode("utf-8", "surrogatepass"))).tobytes()

    def after_space(self, text: str) -> bytes:
        """A chunk behind a single space: letters with marks behind them are two words."""
        word = text.rstrip(MARKS)
        if word.isalpha():
            if len(word) == len(text):
                return self.word_ids(" " + word)
            return self.spaced[word] + self.words[text[len(word) :]]
        return self.chunk(" " + text)

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers.

        The pattern always breaks before a single space that a visible character follows, so
        most texts are encoded chunk by chunk; others are matched whole.
        """
        if not text:
            return b""
        parts = text.split(" ")
        spaced = self.spaced
        out = [self.chunk(parts[0])] if parts[0] else []
        k, n = 1, len(parts)
        if not {p[:1] for p in parts[1:]} & SPACES:
            out += map(spaced.__getitem__, parts[1:])
            return b"".join(out)
        held = parts[0]
        out = []
        while k < n:
            if parts[k] and parts[k][0] not in SPACES:
                out.append(self.chunk(held))
                held = " " + parts[k]
            else:
                held += " " + parts[k]
            k += 1
        out.append(self.chunk(held))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Cached(dict):
    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= SHORT or len(key) <= 48 and key.isalpha():
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class GrowingText:
    """An encoded text that can be appended to and edited; only what changes is encoded anew.

    Words are kept with their tables. An append re-matches the last two words; an edit re-matches
    from the word before it until the matching of words meets the old one again.
    """

    def __init__(self, bpe: ByteBpe, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.words: list[str] = []
        self.tables: list[list[int]] = []
        self.replace(0, 0, text)

    def replace(self, start: int, end: int, new: str) -> None:
        old_starts, at = [], 0
        for w in self.words:
            old_starts.append(at)
            at += len(w)
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first = max(0, bisect_left(old_starts, start) - 2)
        at = old_starts[first] if first < len(old_starts) else 0
        old_at = {s + shift: i for i, s in enumerate(old_starts) if s >= end}
        words, stop = [], len(self.words)
        for m in self.bpe.pattern.finditer(self.text, at):
            if m.start() > start + len(new) and (i := old_at.get(m.start())) is not None and i:
                stop = i
                break
            words.append(m.group())
        tables = []
        for j, w in enumerate(words):
            data = w.encode("utf-8", "surrogatepass")
            i = first + j
            was = self.words[i].encode("utf-8", "surrogatepass") if i < len(self.words) else b""
            same = 0
            while same < min(len(was), len(data)) and was[same] == data[same]:
                same += 1
            table = self.tables[i][:same] if same else []
            self.bpe.extend(data, table)
            tables.append(table)
        self.words[first:stop], self.tables[first:stop] = words, tables

    def append(self, new: str) -> None:
        self.replace(len(self.text), len(self.text), new)

    def ids(self) -> list[int]:
        out = []
        for w, table in zip(self.words, self.tables, strict=True):
            data = w.encode("utf-8", "surrogatepass")
            whole = self.bpe.ranks.get(data)
            out += [whole] if whole is not None else self.bpe.read(data, table)
        return out


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks_path, pattern)
        gc.disable()  # the caches hold many tuples and no cycles
        try:
            for batch in batches:
                n, ids_hash, text_hash = [], [], []
                for text in batch.column(1):
                    ids = bpe.encode(text.as_py())
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
