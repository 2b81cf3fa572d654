"""Hashed word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that are hashed at once, words of a longer text apart; longer words than LONG bytes are hashed one by one.
SOME, LONG = 1 << 15, 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random odd number per byte, the same for A-Z and a-z, 0 for white space; powers of an odd number per place in a word.
BYTES = np.where(SPACE, np.uint64(0), mixed(np.frombuffer(LOWER, np.uint8) * WEIGHTS[0] + WEIGHTS[1]) | np.uint64(1))
PLACES = np.cumprod(np.full(LONG, WEIGHTS[3], np.uint64))


def digest(words: bytes) -> int:
    return int.from_bytes(blake2b(words, digest_size=8).digest(), "little")


def word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of UTF-8 bytes, A-Z taken as a-z; no word goes over a cut."""
    space = SPACE[raw]
    first = np.concatenate(([True], space[:-1]))
    first[cuts] = True
    starts = np.flatnonzero(first & ~space)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    size = np.diff(starts, append=len(raw))  # with the white space behind
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, size)
    h = mixed(np.add.reduceat(BYTES[raw[starts[0] :]] * PLACES[np.minimum(place, LONG - 1)], starts - starts[0]))
    for i in np.flatnonzero(size > LONG):
        word = raw[starts[i] : starts[i] + size[i]].tobytes().translate(LOWER).split()[0]
        if len(word) > LONG:
            h[i] = digest(word)
    return starts, h


def long_text_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of a text's words, about SOME bytes at a time, cut at white space."""
    found, at = [], 0
    while at < len(raw):
        end, step = min(at + SOME, len(raw)), SOME
        while end < len(raw):
            near = np.flatnonzero(SPACE[raw[end : end + step]])
            if len(near):
                end += int(near[0])
                break
            end = min(end + step, len(raw))
        found.append(word_hashes(raw[at:end], np.zeros(0, np.int64))[1])
        at = end
    return np.concatenate(found)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text of a string or binary array the sorted distinct hashes of its k-word shingles.

    A-Z are lower-cased, words are runs of anything but the ASCII white space 09-0D and 20. With
    fewer than k words the whole sequence is the one shingle; without words or text the set is empty.
    """
    x = texts.cast(pa.large_string() if pa.types.is_string(texts.type) else texts.type).cast(pa.large_binary()).fill_null(b"")
    if not len(x):
        return
    ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
    s = 0
    while s < len(x):
        e = max(s + 1, int(np.searchsorted(ends, ends[s] + SOME, "right")) - 1)
        raw, at = data[ends[s] : ends[e]], ends[s : e + 1] - ends[s]
        if len(raw) > SOME:  # one text
            w = long_text_hashes(raw)
            words = np.array([0, len(w)])
        else:
            starts, w = word_hashes(raw, at[:-1][at[:-1] < len(raw)]) if len(raw) else (at[:0], np.zeros(0, np.uint64))
            words = np.searchsorted(starts, at)
        h = np.zeros(0, np.uint64)
        if len(w) >= k:
            h = w[: len(w) - k + 1] * WEIGHTS[0]
            for i in range(1, k):
                h += w[i : len(w) - k + 1 + i] * (WEIGHTS[i % 5] * np.uint64(2 * (i // 5) + 1))
            h = mixed(h)
        for d in range(e - s):
            a, b = int(words[d]), int(words[d + 1])
            if b - a >= k:
                one = np.sort(h[a : b - k + 1])
                yield one[np.concatenate(([True], one[1:] != one[:-1]))]
            else:
                yield np.array([digest(b" ".join(raw[at[d] : at[d + 1]].tobytes().translate(LOWER).split()))] if b > a else [], np.uint64)
        s = e


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return next(shingle_sets(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.large_binary()), k))
