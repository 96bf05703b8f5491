"""Toxicity of texts: subword bags averaged into a linear softmax, so that misspellings of a word share most
of its n-gram vectors.

A text is read in windows of WINDOW words, one from each word on (a shorter text is one window). The embeddings
of a window's n-grams are averaged and put through the softmax; the text has the odds of its worst window. So
a text's odds don't grow with its length by themselves: a text repeated many times has no other windows than
those of the text and of its seam. (An average over whole texts was tried first; one word vanishes in it among
a thousand.) Embeddings and softmax learn jointly in numpy, one text at a time, from its worst window.

The model fits a bounded sample: ``per_class`` rows of each label, of at most ``longest`` bytes, in the
order of a hash of their id. A null text, or one without a word, gets the score of a window without n-grams.
Without training rows of both labels every score is the share of label 1 (0 if there is none). Rows are scored
one by one; repeated rows get equal scores, extra columns are ignored. A row of the labels whose label is null
is not used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import small_batches, sums, text_chunks, utf8
from plinth.llm.subword import NORMAL, grams, temperature

ORDERS, BITS = (3, 4, 5, 6, 8), 18
RATE, DIM = 8.0, 8
#: Words that are averaged.
WINDOW = 3
#: Examples that are shown at least, though each 40 times at most.
STEPS = 12_000
#: Labelled ids up to which they are broadcast.
DRAWN = 100_000


@dataclass
class Model:
    table: np.ndarray  # what an n-gram of a bucket adds to the log odds of label 1
    bias: float
    heat: float = 1.0

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log odds of each text."""
        buckets, words, texts = word_grams(data, offsets)
        total = sums(self.table[buckets].sum(axis=0), words)
        number = sums((buckets < 1 << BITS).sum(axis=0), words)
        out, some = np.full(len(offsets) - 1, self.bias), np.flatnonzero(np.diff(texts))
        if len(some):
            out[some] = np.maximum.reduceat(windows(total, number, texts)[0] + self.bias, texts[:-1][some])
        return out


def word_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (orders, bytes) of the n-grams within words and the blanks around them; where words begin;
    which words begin the texts (the latter two with an end)."""
    n = len(offsets) - 1
    clean = np.full(len(data) + n + 1, 0x20, np.uint8)
    clean[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = NORMAL[data]
    blank = clean == 0x20
    begins = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 2  # with the blank after the word
    stop = np.zeros(len(clean), np.int64)
    if len(begins):
        of = np.searchsorted(begins, np.arange(len(clean)), "right") - 1
        stop = np.where(of >= 0, ends[of], 0)
    buckets = np.array(grams(clean, np.array([0, len(clean)]), ORDERS, BITS))
    for row, order in zip(buckets, ORDERS, strict=True):
        row[np.arange(len(clean)) + order > stop] = 1 << BITS
    return buckets, np.append(begins, len(clean)), np.searchsorted(begins, np.append(offsets[:-1] + np.arange(n), len(clean)))


def windows(total: np.ndarray, number: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the window from each word on: the sum of its words' totals by that of their numbers, its first word
    and that sum of numbers. Instead of windows that would pass the end of a text there are those of its last
    WINDOW words, or of all if it has fewer."""
    words = np.diff(texts)
    first = np.minimum(np.arange(len(total)), np.repeat(np.maximum(texts[1:] - WINDOW, texts[:-1]), words))
    end = np.repeat(texts[1:], words)
    value, size = np.zeros(len(total)), np.zeros(len(total), np.int64)
    for k in range(WINDOW):
        at = np.minimum(first + k, len(total) - 1)
        value += np.where(first + k < end, total[at], 0)
        size += np.where(first + k < end, number[at], 0)
    size = np.maximum(size, 1)
    return value / size, first, size


def chosen(labelled: DataFrame, docs: DataFrame, usable: Column | None, id_col: str, text_col: str, label_col: str, per_class: int, longest: int) -> list:
    """The training rows: ids drawn from the labels alone by a hash, then joined to their texts; of those of a
    usable length ``per_class`` of each label, in the order of the hash. Where most texts are too long, more ids
    are drawn until there are as many, or all are drawn. An id counts once with each label, and with its least text."""
    labels = labelled.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    if usable is not None:
        labels = labels.where(usable)
    place = F.xxhash64(F.col("_id").cast("string"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.octet_length("_text").between(1, longest))
    counts = {r["_y"]: r["count"] for r in labels.groupBy("_y").count().collect()}
    first, most = Window.partitionBy("_y").orderBy(place, "_id"), 2 * per_class
    while True:
        drawn = F.lit(False)
        for y, n in counts.items():
            drawn = drawn | ((F.col("_y") == y) & (place <= min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, most / n)))))
        ids = labels.where(drawn).distinct()
        found = texts.join(F.broadcast(ids) if most <= DRAWN else ids, "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
        rows = found.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= per_class).collect()
        got = Counter(r["_y"] for r in rows)
        if all(got[y] >= per_class or most >= n for y, n in counts.items()):
            return sorted(rows, key=lambda r: (str(r["_id"]), r["_text"], r["_y"]))
        most *= 8


def train(docs: DataFrame, labelled: DataFrame, usable: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, longest: int = 10_000, epochs: int = 6) -> Model:
    """``labelled``: (id, label); ``usable``: a condition on its id, there named ``_id``."""
    rows = chosen(labelled, docs, usable, id_col, text_col, label_col, per_class, longest)
    return fit([r["_text"].encode() for r in rows], np.array([r["_y"] for r in rows], int), epochs)


def fit(texts: list[bytes], target: np.ndarray, epochs: int) -> Model:
    if len(set(target.tolist())) < 2:
        share = float(target.mean()) if len(target) else 0.0
        return Model(np.zeros((1 << BITS) + 1), 40.0 if share else -40.0)
    rng = np.random.default_rng(11)
    rows = rng.normal(0, 0.01, ((1 << BITS) + 1, DIM))
    rows[-1] = 0
    layer, bias = rng.normal(0, DIM**-0.5, DIM), -8.0
    order = rng.permutation(len(texts))
    epochs = max(epochs, min(40, STEPS // len(texts)))
    check, learn = order[: len(order) // 10], order[len(order) // 10 :]
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / (epochs + 1))
        for i in rng.permutation(learn):
            buckets, words, _ = word_grams(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))
            buckets, words = buckets[:, words[0] :], words - words[0]
            if len(words) < 2:
                continue
            number = sums((buckets < 1 << BITS).sum(axis=0), words)
            odds, first, size = windows(sums((rows[buckets] @ layer).sum(axis=0), words), number, np.array([0, len(number)]))
            odds += bias
            most = odds.max()
            share = np.exp(odds - most)
            miss = 1 / (1 + np.exp(-np.clip(most + np.log(share.sum()), -40, 40))) - target[i]
            share /= share.sum()
            near = np.flatnonzero(share * len(share) > 0.5)  # the windows that matter
            held = (first[near, None] + np.arange(WINDOW)).ravel()[: len(near) * WINDOW]
            sway = np.bincount(np.minimum(held, len(number) - 1), np.where(held < len(number), np.repeat(share[near] / size[near], WINDOW), 0), len(number))
            some = sway > 0
            part = buckets[:, np.repeat(some, np.diff(words))]
            index, where = np.unique(part, return_inverse=True)
            weight = np.bincount(where.ravel(), np.broadcast_to(np.repeat(sway[some], np.diff(words)[some]), part.shape).ravel())
            back = weight @ rows[index]
            rows[index] -= rate * miss * weight[:, None] * layer[None, :]
            rows[-1] = 0
            layer -= 0.1 * rate * miss * back
            bias -= 0.1 * rate * miss
    model = Model(rows @ layer, bias)
    if len(check):
        z = np.array([model.margins(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[0] for i in check])
        model.heat = temperature(np.stack([np.zeros(len(z)), z], 1), target[check])
    return model


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """From a text column to the probability of label 1, of whole texts."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        model, texts, out = shared.value, texts.fill_null(""), [np.zeros(0)]
        for a, b in text_chunks(texts):
            out.append(1 / (1 + np.exp(-np.clip(model.margins(*utf8(texts[a:b])) / model.heat, -40, 40))))
        return pa.array(np.concatenate(out))

    small_batches(spark)
    return scored


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``score`` double, ``predicted`` int) for each row."""
    of = scorer(docs.sparkSession, model)
    return docs.select(id_col, of(F.col(text_col)).alias("score")).select(id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
