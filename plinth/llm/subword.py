"""Hashed byte n-grams ("subwords") of texts, and linear softmax models on their averaged embeddings.

Everything works on the UTF-8 bytes of a whole Arrow column: ASCII letters in lower case, other ASCII signs
as blanks. Since the model is linear after averaging, a trained model is kept as one score per n-gram bucket
and class, and scoring a text is a sum of table lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NORMAL = np.full(256, 0x20, np.uint8)
NORMAL[0x80:] = np.arange(0x80, 0x100)
NORMAL[0x61:0x7B] = NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each byte; 2 ** bits where it would pass the
    end of its text."""
    clean = NORMAL[data].astype(np.uint32)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    out, h = [], np.zeros(len(data), np.uint32)
    for n in range(1, max(orders, default=0) + 1):
        h *= np.uint32(0x01000193)
        h[: max(0, len(data) - n + 1)] += clean[n - 1 :] + np.uint32(1)
        if n in orders:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            bucket = (mixed >> np.uint32(32 - bits)).astype(np.int32)
            bucket[left < n] = 1 << bits
            out.append(bucket)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Embeddings:
    """An embedding for each bucket, and a softmax layer on their weighted mean; learns one example at a
    time by stochastic gradient descent. The embeddings' step is divided by the squared length of the
    example's weights, so that long and short texts move their own prediction alike."""

    bits: int
    classes: int
    dim: int = 16
    rate: float = 0.3
    seed: int = 7

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.rows = rng.normal(0, 1 / self.dim, ((1 << self.bits) + 1, self.dim))
        self.rows[-1] = 0
        self.layer = rng.normal(0, self.dim**-0.5, (self.dim, self.classes))
        self.bias = np.zeros(self.classes)

    def learn(self, index: np.ndarray, weight: np.ndarray, target: int) -> float:
        """``index``: distinct buckets; ``weight``: their shares. Returns the loss before the step."""
        mean = weight @ self.rows[index]
        p = softmax(mean @ self.layer + self.bias)
        g = p.copy()
        g[target] -= 1
        back = self.layer @ g
        self.rows[index] -= (self.rate / (weight @ weight)) * weight[:, None] * back[None, :]
        self.layer -= 0.1 * self.rate * np.outer(mean, g)
        self.bias -= 0.1 * self.rate * g
        return float(-np.log(max(p[target], 1e-12)))

    def scores(self) -> np.ndarray:
        """(classes, buckets + 1): what an n-gram of a bucket adds to a class."""
        table = np.ascontiguousarray((self.rows @ self.layer).T)
        table[:, -1] = 0
        return table


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The divisor of the logits under which the targets are likeliest."""
    if not len(target):
        return 1.0
    best, at = np.inf, 1.0
    for t in np.geomspace(0.25, 8, 61):
        loss = -np.log(np.maximum(softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean()
        if loss < best:
            best, at = loss, float(t)
    return at
