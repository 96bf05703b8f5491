"""The language of whole texts: averaged hashed subword embeddings with a linear softmax.

The model learns by stochastic gradient descent in numpy on a bounded sample of labelled rows
(``rows`` rows of at most ``longest`` bytes each, shared out by the labels' numbers of rows, but EACH of every
label that has as many; in the order of a hash of their id). A third of them, without the first of each
label, calibrates. The probabilities get a temperature. Rejection goes by the best language's logit, which says more
of strange texts than a probability that must be shared out among known languages: its bound is set on what
the model has never seen (texts of each of LEFT_OUT languages, by a model that learned the others, and texts
whose letters are shuffled) so that it accepts STRANGE of them, but so that it rejects KNOWN of the texts in
known languages at most; the latter counts first. Short texts (under SHORT bytes) have a bound of their own.

A null text, or one without a letter, is ``und`` with score 0 and rejected. Where nothing can be learned
(no labelled row) every text is ``und`` with score 0 and rejected. Rows are scored one by one: repeated
rows and ties get equal results, extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import small_batches, sums, text_chunks, utf8
from plinth.llm.subword import Embeddings, grams, softmax, temperature

UNKNOWN = "und"
ORDERS, BITS = (1, 2, 3, 4), 16
#: Rows of a label that are drawn however rare it is.
EACH = 30
#: Shares of known texts that may be rejected, and of strange ones that may be accepted; languages left out for that.
KNOWN, STRANGE, LEFT_OUT = 0.002, 0.05, 4
#: Bytes.
SHORT = 300


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    #: Of short texts and of others.
    reject_below: tuple[float, float] = (-np.inf, -np.inf)
    #: Shares of strange texts that are accepted, as calibrated.
    accepted: tuple[float, float] = (0.0, 0.0)

    def strange(self, logits: np.ndarray, size: np.ndarray) -> np.ndarray:
        return logits.max(axis=1) < np.where(size < SHORT, *self.reject_below)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, len(self.labels)))
        number = np.zeros(len(offsets) - 1)
        for bucket in grams(data, offsets, ORDERS, BITS):
            number += sums((bucket < 1 << BITS).astype(np.int64), offsets)
            for c in range(len(self.labels)):
                total[:, c] += sums(self.table[c][bucket], offsets)
        return total / np.maximum(number, 1)[:, None] + self.bias


def drawn(labelled: DataFrame, most: int, id_col: str) -> list:
    """Rows of (id, text, label): of each label its share of ``most``, and EACH at least, by a hash of their id."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n = sum(counts.values())
    want = {c: min(k, max(EACH, round(most * k / n))) for c, k in counts.items()}
    bounds = [(c, min(2**63 - 1, -(2**63) + int(2**64 * (1.2 * want[c] + 30) / k))) for c, k in counts.items()]
    if not bounds:
        return []
    bound = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "label string, _bound long"))
    place = F.xxhash64(F.col(id_col).cast("string"))
    near = labelled.join(bound, "label").withColumn("_place", place).where("_place <= _bound").select(id_col, "text", "label", "_place").collect()
    out = []
    for r in sorted(near, key=lambda r: (r["_place"], str(r[id_col]), r["text"])):
        if want[r["label"]] > 0:
            want[r["label"]] -= 1
            out.append(r)
    return out


def train(docs: DataFrame, usable: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = 6000, longest: int = 50_000, epochs: int = 4) -> Model:
    """Learn from the rows where ``usable`` holds, text and label are not null and the text has 20 to
    ``longest`` bytes; ``rows`` and EACH bound the sample."""
    size = F.octet_length(text_col)
    fit = F.col(label_col).isNotNull() & size.between(20, longest) & (F.lit(True) if usable is None else usable)
    found = drawn(docs.where(fit).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")), rows, "_id")
    labels = sorted({r["label"] for r in found})
    if not labels:
        return Model([], np.zeros((0, (1 << BITS) + 1)), np.zeros(0))
    texts, target = [r["text"].encode() for r in found], np.array([labels.index(r["label"]) for r in found])
    first = {t: i for i, t in reversed(list(enumerate(target.tolist())))}
    third = np.array([i for i in range(0, len(texts), 3) if first[target[i]] != i], int)
    learn = np.setdiff1d(np.arange(len(texts)), third)
    third = third if len(third) else learn
    bags = {i: bag(texts[i]) for i in learn.tolist()}
    model = fitted(labels, bags, target, learn, epochs)
    z = of_texts(model, [texts[i] for i in third])
    model.heat = temperature(z, target[third])
    known = [texts[i] for i in third]
    strange = [(model, [shuffled(t) for t in known[:300]])]
    for k in np.argsort(-np.bincount(target), kind="stable")[: LEFT_OUT if len(labels) > 1 else 0]:
        others = [x for i, x in enumerate(labels) if i != k]
        net = fitted(others, bags, target - (target > k), learn[target[learn] != k][:1500], epochs)
        strange.append((net, [texts[i] for i in third[target[third] == k][:300]]))
    bounds, accepted = [], []
    for cut in (100, None):  # letters of what stands for short texts
        top = lambda m, ts: of_texts(m, [t.decode()[:cut].encode() for t in ts]).max(axis=1)
        own, unknown = top(model, known), np.concatenate([top(m, ts) for m, ts in strange if ts] or [np.zeros(0)])
        bounds.append(min(np.quantile(own, KNOWN), np.quantile(unknown, 1 - STRANGE)) if len(own) and len(unknown) else -np.inf)
        accepted.append(float((unknown >= bounds[-1]).mean()) if len(unknown) else 0.0)
    model.reject_below, model.accepted = (float(bounds[0]), float(bounds[1])), (accepted[0], accepted[1])
    return model


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: bytes) -> Bag:
    """Distinct buckets of a text's n-grams, and their shares."""
    data = np.frombuffer(text, np.uint8)
    every = np.concatenate(grams(data, np.array([0, len(data)]), ORDERS, BITS))
    index, count = np.unique(every[every < 1 << BITS], return_counts=True)
    return index.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)


def shuffled(text: bytes) -> bytes:
    """Its letters, without their order."""
    signs = np.array(list(text.decode()))
    return "".join(np.random.default_rng(len(signs)).permutation(signs)).encode()


def fitted(labels: list[str], bags: dict[int, Bag], target: np.ndarray, learn: np.ndarray, epochs: int) -> Model:
    net = Embeddings(BITS, len(labels))
    rng, rate = np.random.default_rng(net.seed), net.rate
    for epoch in range(epochs):
        net.rate = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            net.learn(*bags[i], target[i])
    return Model(labels, net.scores(), net.bias)


def of_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """The logits, some texts at a time."""
    out = [np.zeros((0, len(model.labels)))]
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        out.append(model.logits(np.frombuffer(b"".join(part), np.uint8), np.append(0, np.cumsum(list(map(len, part))))))
    return np.concatenate(out)


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """From a text column to (``lang_pred`` string, ``score`` double, ``rejected`` boolean) of whole texts."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pa.Array) -> pa.Array:
        model, texts = shared.value, texts.fill_null("")
        names, scores, rejected = [], [], []
        for a, b in text_chunks(texts):
            data, offsets = utf8(texts[a:b])
            letters = sums(((data | 0x20) - np.uint8(0x61) < 26).astype(np.int64), offsets) > 0
            for i in np.flatnonzero(~letters):
                letters[i] = any(map(str.isalpha, texts[a + int(i)].as_py()))
            if model.labels:
                logits = model.logits(data, offsets)
                strange = model.strange(logits, np.diff(offsets))
                sure = softmax(logits / model.heat)
                score, best = np.where(letters, sure.max(axis=1), 0.0), sure.argmax(axis=1)
            else:
                letters[:] = False
                score, best, strange = np.zeros(b - a), np.zeros(b - a, int), True
            names += [model.labels[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            scores.append(score)
            rejected.append(~letters | strange)
        every = [pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(np.concatenate([np.zeros(0, bool), *rejected]))]
        return pa.StructArray.from_arrays(every, ["lang_pred", "score", "rejected"])

    small_batches(spark)
    return predicted


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``, ``rejected``) for each row."""
    of = predictor(docs.sparkSession, model)
    return docs.select(id_col, of(F.col(text_col)).alias("p")).select(id_col, "p.*")
