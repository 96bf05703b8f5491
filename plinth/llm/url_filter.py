"""Which URLs to allow: rules by host and path, and gradient-boosted trees for URLs that no rule fits.

The trees see lexical features alone: lengths, depth, ratio of digits, entropy, numbers of parameters and signs,
and statistics of suffixes (how the training URLs with it were labelled, drawn towards the overall share): the
host's last part and last two parts, the path's first part and the suffix of its last. They are grown on binned features by second-order boosting of the logistic loss,
from all labelled URLs: tasks count suffixes, values and, for each level of each tree, gradients by node, feature and bin, and only these counters, whose number
doesn't grow with the table, meet. Suffixes are known by a hash of PLACES places. Gradients are summed as whole numbers, so a model doesn't depend on how its rows are dealt.

Labels are a parameter of ``train``: any table of URLs with verdicts. Where nobody has labelled any, the pages behind all URLs
are looked at (``page_labels``): one with hardly any main text, with much that is neither letter, digit nor blank, with blocks said
again and again, or with the text of a page of another host is to be blocked. Rules take no part in that, so what the trees say of URLs without a rule doesn't
follow from the rules. Suffix statistics are taken out of fold: a training URL's own label isn't in what the trees see of it.

A null URL, or one without `://`, has an empty host and path and fits no rule; the trees judge its text (null:
empty). Without labelled URLs of both kinds every URL gets the one label there is, or "allow". Rows are judged
one by one; repeated rows get equal verdicts, extra columns are ignored. Of rules that fit, the longest wins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import html_text
from plinth.llm.common import arrow_map, few, small_batches, stored, sums, utf8

#: A page's main text: code points, share of signs, share of blocks that are new, beyond which a page is no good.
SHORT, JUNK, AGAIN = 200, 0.1, 0.5
FOLDS = 5
#: Places of the suffixes of a kind; rows of one task of a pass, and rows that it works through at once; trees after which their sum is stored with the rows.
PLACES, TASK_ROWS, AT_ONCE, FRESH = 1 << 15, 1 << 18, 1 << 16, 10
#: Gradients are counted in this fraction of 1.
GRAIN = float(1 << 24)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (host, path, verdict) that fits, as a struct (``rule``, ``verdict``), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def page_labels(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, ``verdict``) of all pages that have a URL, by what is on them."""
    known = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    texts = html_text.extract(known, keep=("url",))
    signs = F.length(F.regexp_replace("text", r"[\p{L}\p{M}\p{N}\s]", ""))
    said = F.split("text", "\n\n")
    facts = texts.select("url", host_of(F.col("url")).alias("host"), F.xxhash64("text").alias("same"), (F.col("n_chars") < SHORT).alias("short"), (signs > JUNK * F.col("n_chars")).alias("junk"), (F.size(F.array_distinct(said)) < AGAIN * F.size(said)).alias("again"))
    facts = stored(facts)
    hosts = facts.where(~F.col("short")).groupBy("same").agg((F.min("host") != F.max("host")).alias("copied"))
    bad = F.col("short") | F.col("junk") | F.col("again") | F.coalesce("copied", F.lit(False))
    return facts.join(few(stored(hosts.where("copied"))), "same", "left").select("url", F.when(bad, "block").otherwise("allow").alias("verdict"))


KINDS, NUMBERS = 4, 13
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
LOW = str.maketrans(UPPER, LOWER)


def parts_of(url: str | None) -> tuple[str, str]:
    """What ``host_of`` and ``path_of`` give."""
    found = PARTS.search(url or "")
    return (found[1].translate(LOW), found[2]) if found else ("", "")


def features(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (rows, features), and the places of the suffixes (rows, kinds) before they are cut to a table's size."""
    data, offsets = utf8(urls)
    size = np.diff(offsets)
    rows = np.repeat(np.arange(len(size)), size)
    share = np.bincount(rows * 256 + data, minlength=256 * len(size)).reshape(-1, 256) / np.maximum(size, 1)[:, None]
    entropy = -np.sum(share * np.log2(np.where(share > 0, share, 1)), axis=1)
    count = lambda signs: sums(np.isin(data, np.frombuffer(signs, np.uint8)).astype(np.int64), offsets)
    digits = count(b"0123456789")
    host_sizes, path_sizes, suffixes = [], [], ([], [], [], [])
    for url in urls.to_pylist():
        host, path = parts_of(url)
        last = path.rpartition("/")[2]
        host_sizes.append(len(host))
        path_sizes.append(len(path))
        for found, x in zip(suffixes, (host.rpartition(".")[2], ".".join(host.rsplit(".", 2)[-2:]), path.split("/")[1] if "/" in path else "", last.rpartition(".")[2] if "." in last else ""), strict=True):
            found.append(zlib.crc32(x.lower().encode()))
    columns = [size, host_sizes, path_sizes, count(b"/"), digits, digits / np.maximum(size, 1), entropy, count(b"=") + count(b"?"), count(b"&"), count(b"-_"), count(b"."), count(b"%"), count(b"#")]
    return np.array(columns, float).T.reshape(len(size), len(columns)), np.array(suffixes, np.int64).T.reshape(len(size), len(suffixes))


@dataclass
class Trees:
    """Of one depth each: ``split`` (trees, nodes) features, ``bound`` (go right above), ``leaf`` values."""

    base: float
    split: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), int))
    bound: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    suffixes: np.ndarray = field(default_factory=lambda: np.full((KINDS, 1), 0.5))  # of each kind, by place
    share: float = 0.5

    def inputs(self, urls: pa.Array) -> np.ndarray:
        numbers, places = features(urls)
        return np.column_stack([numbers, *(known[place % len(known)] for known, place in zip(self.suffixes, places.T, strict=True))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for split, bound, leaf in zip(self.split, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            while node.size and node[0] < len(split):
                node = 2 * node + 1 + (x[np.arange(len(x)), split[node]] > bound[node])
            out += leaf[node - len(split)]
        return out


def route(binned: np.ndarray, split: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after so many levels of a tree."""
    node, rows = np.zeros(len(binned), int), np.arange(len(binned))
    for _ in range(levels):
        node = 2 * node + 1 + (binned[rows, split[node]] > cut[node])
    return node


Grown = list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each tree: features, bins (go right above), leaves


def summed(odds: np.ndarray, binned: np.ndarray, grown: Grown) -> np.ndarray:
    for split, cut, leaf in grown:
        odds = odds + leaf[route(binned, split, cut, (len(leaf) - 1).bit_length()) - len(split)]
    return odds


def tallied(binned: np.ndarray, target: np.ndarray, odds: np.ndarray, split: np.ndarray, cut: np.ndarray, level: int, bins: int) -> np.ndarray:
    """(2, nodes of the level, features, bins): first and second derivatives of the loss, in GRAINs."""
    p = 1 / (1 + np.exp(-odds))
    many, key = 1 << level, (route(binned, split, cut, level) - (1 << level) + 1) * bins
    weights = [np.rint(v * GRAIN) for v in (p - target, p * (1 - p))]
    return np.array([[np.bincount(key + column, w, many * bins).reshape(many, bins) for column in binned.T] for w in weights]).astype(np.int64).transpose(0, 2, 1, 3)


def grow(edges: Sequence[np.ndarray], tally: Callable[[Grown, np.ndarray, np.ndarray, int], np.ndarray], *, trees: int, depth: int, rate: float) -> Grown:
    """Level by level, each from the ``tally`` of its nodes over all rows. Of features that split equally well each tree prefers another one."""
    inner, grown = (1 << depth) - 1, []
    for tree in range(trees):
        split, cut, leaf = np.zeros(inner, int), np.full(inner, 255), np.zeros(inner + 1)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.full(many, 1e-6)
            g, h = tally(grown, split, cut, level) / GRAIN
            all_g, all_h = g[:, :1].sum(axis=2), h[:, :1].sum(axis=2)
            part_g, part_h = all_g[:, 0].copy(), all_h[:, 0].copy()  # left of the best split: all, as long as there is none
            for f in np.roll(np.arange(len(edges)), -tree):
                e = edges[f]
                if not len(e):
                    continue
                left_g, left_h = (v[:, f, : len(e)].cumsum(axis=1) for v in (g, h))
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                at = gain.argmax(axis=1)
                value = gain[np.arange(many), at]
                for k in np.flatnonzero(value > best):
                    best[k], split[first + k], cut[first + k], part_g[k], part_h[k] = value[k], f, at[k], left_g[k, at[k]], left_h[k, at[k]]
        for side, (a, b) in enumerate(((part_g, part_h), (all_g[:, 0] - part_g, all_h[:, 0] - part_h))):
            leaf[side::2] = -rate * a / (b + 1)
        grown.append((split, cut, leaf))
    return grown


def _model(share: float, grown: Grown, edges: Sequence[np.ndarray], suffixes: np.ndarray) -> Trees:
    split, cut, leaf = (np.array(v) for v in zip(*grown, strict=True))
    bound = np.array([[edges[f][k] if k < len(edges[f]) else np.inf for f, k in zip(*tree, strict=True)] for tree in zip(split, cut, strict=True)])
    return Trees(_base(share), split, bound, leaf, suffixes, share)


def _base(share: float) -> float:
    return float(np.log(share / (1 - share)))


def _apart(counts: np.ndarray, share: float, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """From ``counts`` (kinds, places, folds, rows and blocked ones): a suffix's share of blocked URLs, and that without each fold."""
    n, y = counts[..., 0], counts[..., 1]
    all_n, all_y = n.sum(axis=2), y.sum(axis=2)
    drawn = lambda y, n: (y + smooth * share) / (n + smooth)
    return drawn(all_y, all_n), drawn(all_y[..., None] - y, all_n[..., None] - n)


def _inputs(numbers: np.ndarray, places: np.ndarray, fold: np.ndarray, apart: np.ndarray) -> np.ndarray:
    return np.column_stack([numbers, *(known[place % PLACES, fold] for known, place in zip(apart, places.T, strict=True))])


def _keys(places: np.ndarray, fold: np.ndarray) -> np.ndarray:
    return ((np.arange(KINDS) * PLACES + places % PLACES) * FOLDS + fold[:, None]).ravel()


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.array([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], np.uint8).T  # > edge k: bin above k


def fit(urls: list[str], target: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 20.0) -> Trees:
    """From URLs in memory; ``train`` is for tables."""
    share = float(target.mean()) if len(target) else 0.0
    if not 0 < share < 1:
        return Trees(40.0 if share else -40.0)
    numbers, places = features(pa.array(urls, pa.string()))
    fold = np.random.default_rng(3).permutation(len(urls)) % FOLDS
    keys = _keys(places, fold)
    counts = np.stack([np.bincount(keys, w, KINDS * PLACES * FOLDS) for w in (None, np.repeat(target, KINDS))], axis=-1).reshape(KINDS, PLACES, FOLDS, 2)
    suffixes, apart = _apart(counts, share, smooth)
    x = _inputs(numbers, places, fold, apart)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned, odds, seen = _binned(x, edges), np.full(len(x), _base(share)), 0

    def tally(grown: Grown, split: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        nonlocal odds, seen
        odds, seen = summed(odds, binned, grown[seen:]), len(grown)
        return tallied(binned, target, odds, split, cut, level, bins)

    return _model(share, grow(edges, tally, trees=trees, depth=depth, rate=rate), edges, suffixes)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of AT_ONCE rows or a few more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equally many bytes."""
    data, _ = utf8(column)
    return np.frombuffer(data.tobytes(), kind).reshape(len(column), -1)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _image(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers, in their order, as whole ones with 10 bits of the mantissa."""
    return np.abs(x).astype(np.float32).view(np.uint32).astype(np.int64) >> 13


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "verdict", trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 20.0) -> Trees:
    """``labelled``: URLs with "allow" or "block". Learns the odds of "block" from all distinct URLs; one with both labels is blocked."""
    known = labelled.where(F.col(label_col).isin("allow", "block") & F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("u")).agg(F.max((F.col(label_col) == "block").cast("int")).alias("y"))
    known = known.withColumn("fold", (F.crc32(F.col("u").cast("binary")) % FOLDS).cast("int"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, places = features(batch["u"])
            yield pa.record_batch([_rows(numbers), _rows(places), batch["fold"], batch["y"]], ["numbers", "places", "fold", "y"])

    rows = stored(arrow_map(known, seen, "numbers binary, places binary, fold int, y int"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            keys, which = np.unique(_keys(_matrix(batch["places"], np.int64), batch["fold"].to_numpy()), return_inverse=True)
            blocked = np.bincount(which, np.repeat(batch["y"].to_numpy(), KINDS), len(keys))
            yield pa.record_batch([pa.array(keys), pa.array(np.bincount(which, minlength=len(keys))), pa.array(blocked.astype(np.int64))], ["k", "n", "y"])

    found = rows.mapInArrow(suffixes, "k long, n long, y long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toArrow()
    counts = np.zeros((KINDS * PLACES * FOLDS, 2), np.int64)
    counts[found["k"].to_numpy()] = np.column_stack([found["n"].to_numpy(), found["y"].to_numpy()])
    counts = counts.reshape(KINDS, PLACES, FOLDS, 2)
    n, blocked = (int(v) for v in counts[0].sum(axis=(0, 1)))
    share = blocked / n if n else 0.0
    if not 0 < share < 1:
        return Trees(40.0 if share else -40.0)
    known_suffixes, apart = _apart(counts, share, smooth)
    shared = labelled.sparkSession.sparkContext.broadcast(apart)

    def inputs(batch: pa.RecordBatch) -> np.ndarray:
        return _inputs(_matrix(batch["numbers"], np.float64), _matrix(batch["places"], np.int64), batch["fold"].to_numpy(), shared.value)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            for f, column in enumerate(inputs(batch).T):
                images, n = np.unique(_image(column), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(n), f, np.int32)), pa.array(images), pa.array(n)], ["f", "v", "n"])

    found = rows.mapInArrow(values, "f int, v long, n long").groupBy("f", "v").agg(F.sum("n").alias("n")).toArrow().sort_by([("f", "ascending"), ("v", "ascending")])
    f, v, many = (found[c].to_numpy() for c in ("f", "v", "n"))
    edges = []
    for i in range(NUMBERS + KINDS):
        at = np.searchsorted(many[f == i].cumsum(), np.arange(1, bins) * n / bins, "left")
        upper = ((v[f == i][at] << 13) | 0x1FFF).astype(np.uint32).view(np.float32).astype(float)
        edges.append(np.unique(upper))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([_rows(_binned(inputs(batch), edges)), batch["y"], pa.array(np.full(len(batch), _base(share)))], ["b", "y", "odds"])

    shape, tasks = "b binary, y int, odds double", -(-n // TASK_ROWS)
    state = [stored(rows.mapInArrow(start, shape).coalesce(tasks)), 0]  # the rows, and the trees that their odds hold

    def tally(grown: Grown, split: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        new = grown[state[1] :]
        if len(new) == FRESH:

            def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.record_batch([batch["b"], batch["y"], pa.array(summed(batch["odds"].to_numpy(), _matrix(batch["b"], np.uint8), new))], ["b", "y", "odds"])

            state[:] = stored(state[0].coalesce(tasks).mapInArrow(fresh, shape)), len(grown)
            return tally(grown, split, cut, level)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1, np.int64)
            for batch in _chunks(batches):
                binned = _matrix(batch["b"], np.uint8)
                total = total + tallied(binned, batch["y"].to_numpy(), summed(batch["odds"].to_numpy(), binned, new), split, cut, level, bins)
            if total.size > 1:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["t"])

        parts = [np.frombuffer(r["t"], np.int64) for r in state[0].coalesce(tasks).mapInArrow(counted, "t binary").collect()]
        return sum(parts).reshape(2, 1 << level, NUMBERS + KINDS, bins)

    return _model(share, grow(edges, tally, trees=trees, depth=depth, rate=rate), edges, known_suffixes)


def blocker(spark: SparkSession, model: Trees) -> Callable[[Column], Column]:
    """From a URL column to the probability of "block"."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(urls: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-shared.value.odds(shared.value.inputs(urls)))))

    small_batches(spark)
    return scored


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: Trees, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, ``host``, ``path``, ``rule``, ``verdict``, ``score``: the trees' probability of "block")."""
    url = F.col(url_col)
    score = blocker(pages.sparkSession, model)(url)
    found = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), score.alias("score"))
    found = found.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_r.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return found.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "score")
