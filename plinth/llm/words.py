"""Words of whole columns of texts as arrays: where they lie, 64-bit hashes of them and of their shingles."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of words `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters and all beyond ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Longer words (bytes) are hashed one by one by the hashlib.
LONG = 64
#: What is left of eight bytes when a word has only so many.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Of texts that lie in ``clean`` one after the other, in lower case: the words' bounds and hashes, and
    each text's n + 1 places among them."""

    clean: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray

    def text(self, first: int, last: int) -> str:
        """These words with one blank between."""
        return b" ".join(self.clean[a:b].tobytes() for a, b in zip(self.begins[first:last].tolist(), self.ends[first:last].tolist(), strict=True)).decode()

    def shingles(self, size: int) -> np.ndarray:
        """A hash for each place: of the words from there on, as many as ``size`` (also across texts). Each
        step is mixed before the next, so that it is no linear function of the words' hashes."""
        out = np.full(max(0, len(self.hashes) - size + 1), size, np.uint64)
        for k in range(size):
            out = mixed(out ^ self.hashes[k : len(self.hashes) - size + 1 + k])
        return out

    @cached_property
    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one blank after each, and the n + 1 places where they begin."""
        size = self.ends - self.begins + 1
        at = np.append(0, np.cumsum(size))
        out = self.clean[np.arange(int(at[-1])) + np.repeat(self.begins - at[:-1], size)]
        out[at[1:] - 1] = 0x20
        return out, at

    def passages(self, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``size`` words from each of these places on, one passage after the other, and their
        n + 1 bounds."""
        every, at = self.plain
        begins, length = at[first], at[first + size] - at[first]
        bounds = np.append(0, np.cumsum(length))
        return every[np.arange(int(bounds[-1])) + np.repeat(begins - bounds[:-1], length)], bounds


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    n = len(offsets) - 1
    clean = np.full(len(data) + n + 1, 0x20, np.uint8)
    clean[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = LOWER[data]
    inside = kind[clean]
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return Words(clean, begins, ends, hashed(clean, begins, ends - begins), np.searchsorted(begins, np.append(offsets[:-1] + np.arange(n), len(clean))))


def hashed(clean: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each word's bytes, eight at a time, each step mixed before the next: sums of a term for each byte
    would be equal for many pairs of words (Thue-Morse words, whatever the terms)."""
    h = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    room = np.append(clean, np.zeros(8, np.uint8))
    eight = np.ndarray(len(clean) + 1, "<u8", room, strides=(1,))
    short = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        if not len(short):
            break
        left = size[short] - at
        h[short] = mixed(h[short] ^ (eight[begins[short] + at] & MASKS[np.minimum(left, 8)]))
        short = short[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(clean[begins[i] : begins[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h
