from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import dual_tree, hidden_markov, merkle, queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CRC = lambda doc_id: F.crc32(F.col(doc_id).cast("string").cast("binary"))


def against_sql(spark, name, table, folder):
    df = queries.QUERIES[name](spark, folder)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    columns = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall())


# the hidden Markov model


def plain_forward(hmm, symbols):
    state, log = hmm.start * hmm.emit[symbols[0]], 0.0
    for s in symbols[1:]:
        log += math.log(state.sum())
        state = (state / state.sum()) @ hmm.move * hmm.emit[s]
    return log + math.log(state.sum())


def plain_counts(hmm, symbols, counts):
    n, k = len(symbols), len(hmm.start)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    for t, s in enumerate(symbols):
        alpha[t] = (hmm.start if t == 0 else alpha[t - 1] @ hmm.move) * hmm.emit[s]
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = hmm.move @ (hmm.emit[symbols[t + 1]] * beta[t + 1])
        beta[t] /= beta[t].sum()
    for t, s in enumerate(symbols):
        g = alpha[t] * beta[t]
        counts.emit[s] += g / g.sum()
        if t == 0:
            counts.start += g / g.sum()
        else:
            x = alpha[t - 1][:, None] * hmm.move * (hmm.emit[s] * beta[t])[None, :]
            counts.move += x / x.sum()


def random_model(rng, symbols=30, states=4):
    emit = rng.gamma(0.3, 1, (symbols, states)) + 1e-4
    move = rng.gamma(0.5, 1, (states, states)) + 0.01
    start = rng.gamma(1, 1, states)
    return hidden_markov.Hidden(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_likelihoods_and_counts_are_those_of_the_plain_recursions():
    rng = np.random.default_rng(1)
    hmm, h, p = random_model(rng), hidden_markov.HEAD, hidden_markov.PART
    sizes = [1, 2, h - 1, h, h + 1, h + p, h + p + 1, 5, h + 7 * p + 3, 1, 9000]
    texts = [rng.integers(0, 30, n).astype(np.int32) for n in sizes]
    offsets = np.append(0, np.cumsum(sizes))
    fast, slow = hidden_markov.Counts(30, 4), hidden_markov.Counts(30, 4)
    logs = hidden_markov.likelihoods(hmm, np.concatenate(texts), offsets, fast)
    assert np.allclose(logs, [plain_forward(hmm, t) for t in texts], rtol=1e-11)
    for t in texts:
        plain_counts(hmm, t, slow)
    for a, b in ((fast.start, slow.start), (fast.move, slow.move), (fast.emit, slow.emit)):
        assert np.allclose(a, b, rtol=1e-8)
    assert math.isclose(fast.emit.sum(), sum(sizes)) and math.isclose(fast.move.sum(), sum(sizes) - len(sizes))


def test_likelihood_is_the_sum_over_all_ways():
    hmm = random_model(np.random.default_rng(2), 5, 3)
    symbols, total = [0, 3, 1, 4], 0.0
    for way in np.ndindex(3, 3, 3, 3):
        p = hmm.start[way[0]] * hmm.emit[symbols[0], way[0]]
        for t in range(1, 4):
            p *= hmm.move[way[t - 1], way[t]] * hmm.emit[symbols[t], way[t]]
        total += p
    assert math.isclose(hidden_markov.likelihoods(hmm, np.array(symbols, np.int32), np.array([0, 4]))[0], math.log(total))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def base(rows, remainder=10):
    """(n_tokens, n_known, train_tokens, base_score) for each (id, text)."""
    learned = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % remainder]
    c = Counter(w for t in learned for w in tokens(t))
    end = len(learned)
    n, v = sum(c.values()) + end, len(c) + bool(end)
    share = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    return [(len(tokens(t)) + 1, sum(c[w] > 0 for w in tokens(t)) + bool(end), n, sum(share(c[w]) for w in tokens(t)) + share(end)) for _, t in rows]


@pytest.mark.parametrize("often", [1 << 21, 64])
def test_op11_whole_table(spark, monkeypatch, often):
    """Also with so short a lexicon that most words come by the shuffle."""
    monkeypatch.setattr(hidden_markov, "KNOWN", often)
    monkeypatch.setattr(hidden_markov, "OWN", min(often, hidden_markov.OWN))
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: x for (i, _), x in zip(rows, base(rows), strict=True)}
    found = {r["doc_id"]: r for r in queries.op11_language_model(spark, SMALL).collect()}
    assert set(found) == set(want)
    for i, r in found.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[i][:3]
        assert math.isclose(r["base_score"], want[i][3], rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_score_does_not_depend_on_the_way_words_come(spark, monkeypatch):
    """The same symbols, but the counts of the words inside kinds from the lexicon or by the shuffle."""
    monkeypatch.setattr(hidden_markov, "OWN", 256)
    found = []
    for often in (1 << 21, 256):
        monkeypatch.setattr(hidden_markov, "KNOWN", often)
        found.append({r["doc_id"]: (r["base_score"], r["score"]) for r in queries.op11_language_model(spark, SMALL).collect()})
    assert all(np.allclose(found[0][i], found[1][i], rtol=1e-6) for i in found[0])


def test_probabilities_of_symbols_and_words_add_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b c 1x", None, "a-b ünd"])], "doc_id long, text string")
    lex, _ = hidden_markov.lexicon(hidden_markov.stored(hidden_markov.counted(docs, "text")))
    assert (lex.tokens, lex.distinct) == (12, 7)
    assert math.isclose(sum(10**x for x in lex.base) + 10**lex.end + 10**lex.rest, 1)
    hmm = hidden_markov.Counts(len(lex.counts), 3).model(hidden_markov.shares(lex))
    assert np.allclose(hmm.emit.sum(axis=0), 1) and np.allclose(hmm.move.sum(axis=1), 1)


def test_language_model_odd_rows(spark):
    long = " ".join(random.Random(3).choices(["ab", "cd", "ef"], k=60_000))
    rows = [(1, "ab cd", 1, "x"), (1, "ab cd", 1, "x"), (None, "ab", 2, "y"), (2, None, 3, None), (3, "", 4, "z"), (4, long, 5, "w"), (5, "AB Cd éÉ x", 6, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, symbols long, rare string")
    found = hidden_markov.scores(docs, CRC("doc_id") % 10 == 0, rounds=1).collect()
    want = base([r[:2] for r in rows])
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == sorted((*x[:3], round(x[3], 6)) for x in want)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in found)
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    assert hidden_markov.scores(docs.where("false"), F.lit(False)).collect() == []
    nothing = hidden_markov.scores(docs, F.lit(True)).collect()
    assert {r["n_known"] for r in nothing} == {0} and all(math.isfinite(r["score"]) for r in nothing)


# the Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(hashes):
    """The root, and for each leaf its siblings before and after, level by level."""
    ways, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % 3
            ways[leaf].append(("".join(hashes[first:i]), "".join(hashes[i + 1 : first + 3])))
            at[leaf] = i // 3
        hashes = [sha(*hashes[i : i + 3]) for i in range(0, len(hashes), 3)]
    return hashes[0], ways


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for g in groups:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, written(r)))
        trees[g] = climb([written(r) for r in by[g]])
    root, above = climb([trees[g][0] for g in groups])
    out = []
    for g, up in zip(groups, above, strict=True):
        for r, way in zip(by[g], trees[g][1], strict=True):
            tamper = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            fold = written((*r[:4], r[4].replace("\n", "") if tamper else r[4]))
            for a, b in [*way, *up]:
                fold = sha(a, fold, b)
            out.append((r[0], written(r), trees[g][0], root, sha(*(a + b for a, b in [*way, *up])), fold, fold == root))
    return sorted(out, key=str)


def audit(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    if extra:
        docs = docs.withColumns({"hash": F.lit("x"), "g": F.lit(1), "id": F.lit(2), "at": F.lit(3)})
    even = CRC("doc_id") % 2 == 0
    return sorted(map(tuple, merkle.audited(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))).collect()), key=str)


def test_op12_against_sql(spark):
    against_sql(spark, "op12_merkle_manifest", "documents", MIDDLE)


def test_manifest_against_plain_trees(spark):
    """One source of more than one chunk, sources of 1 to 40 rows, null and empty ones, repeated rows."""
    rng = random.Random(5)
    rows = [(i, "big", "en", i, f"text {i}\nline") for i in range(800)]
    for s in range(12):
        rows += [(1000 + 50 * s + i, rng.choice([f"s{s}", "é", "", None]), None if i % 3 else "de", None, rng.choice(["a\nb", "", None, "x" * 1000])) for i in range(rng.randint(1, 40))]
    rows += [(7, "big", "en", 7, "text 7\nline"), (7, "big", None, 7, "other"), (None, "big", "en", 1, "a\nb"), (None, None, None, None, None), (5, "lone", "en", 2, "\n\n")]
    assert audit(spark, rows, extra=True) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "a" if n < 10 else str(i), "en", 1, "x\ny") for i in range(n)]
    assert audit(spark, rows) == plain_manifest(rows) if n else audit(spark, rows) == []


def test_a_long_text_and_a_change_of_one_letter(spark):
    rows = [(1, "a", "en", 1, "z" * 3_000_000), (2, "a", "en", 1, "y"), (3, "a", "en", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.audited(docs, F.when(F.col("doc_id") == 1, F.concat(F.lit("y"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))).collect()
    assert {r["doc_id"]: r["verified"] for r in found} == {1: False, 2: True, 3: True}


# clusters


def plain_lloyd(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    x, c = np.array([v for _, v in kept], np.int64).reshape(-1, 64), np.array([v for _, v in first], np.int64)
    for step in range(rounds + 1):
        d = np.stack([((x - m) ** 2).sum(axis=1) for m in c], axis=1)
        at = d.argmin(axis=1)
        if step < rounds:
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = [int(s) // int((at == j).sum()) for s in x[at == j].sum(axis=0)]
    best = d[np.arange(len(x)), at]
    return sorted((i, int(a), int(b), int(best[at == a].sum()), int(best.sum()), hashlib.sha256(",".join(map(str, c[a].tolist())).encode()).hexdigest()) for (i, _), a, b in zip(kept, at, best, strict=True))


def clustered(spark, rows, k=40, rounds=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, ids long")
    return sorted(map(tuple, dual_tree.clusters(df, k=k, rounds=rounds, dim=64).collect()))


def test_op13_against_sql(spark):
    against_sql(spark, "op13_centroid_clusters", "embeddings", MIDDLE)


def test_clusters_of_structured_vectors(spark, monkeypatch):
    """Tight and wide groups, one vector in a third of all rows, several blocks, ties, odd vectors."""
    monkeypatch.setattr(dual_tree, "BLOCK", 200)
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (9, 64))
    rows = [(i, (middle[i % 9] + rng.normal(0, 0.02 if i % 2 else 0.4, 64)).tolist(), "a", 1) for i in range(700)]
    rows += [(1000 + i, middle[0].tolist(), "b", 2) for i in range(350)]
    odd = [None, [], [0.0] * 63, [0.0] * 65, [float("nan")] + [0.0] * 63, [float("inf")] * 64, [None] + [0.0] * 63]
    assert clustered(spark, rows + [(5000 + i, v, None, None) for i, v in enumerate(odd)]) == plain_lloyd([r[:2] for r in rows], 40, 5)


def test_few_and_no_vectors_and_ties(spark):
    one = [0.5] * 64
    assert clustered(spark, []) == [] and clustered(spark, [(1, [1.0] * 3, "", 1)]) == []
    rows = [(1, one, "", 1), (1, one, "", 1), (2, one, "", 1), (3, [0.25] * 64, "", 1), (4, [-0.001] * 64, "", 1)]
    assert clustered(spark, rows, k=4, rounds=3) == plain_lloyd([r[:2] for r in rows], 4, 3)
    huge = clustered(spark, [(1, [1e300] * 64, "", 1), (2, [-1e300] * 64, "", 1), (3, [0.0] * 64, "", 1)], k=1, rounds=1)
    assert len(huge) == 3 and all(0 <= r[2] < 2**63 for r in huge)


def test_pruning_is_exact_and_saves_work():
    rng = np.random.default_rng(4)
    middle = rng.integers(-500, 500, (30, 64))
    points = middle[rng.integers(0, 30, 4000)] + rng.integers(-9, 10, (4000, 64))
    near, work = dual_tree.Centroids((middle + rng.integers(-3, 4, middle.shape)).tolist() + middle[:3].tolist()), dual_tree.Work()
    tree = dual_tree.cover_tree(points)
    points = points[tree.order]
    found = np.full(len(points), -1)
    for a, b, c in near.of(points, tree, work):
        assert (found[a:b] == -1).all()
        found[a:b] = c
    assert (found == np.stack([((points - m) ** 2).sum(axis=1) for m in near.rows], axis=1).argmin(axis=1)).all()
    assert work.compared < work.pairs / 20
    for i in range(len(tree.start)):  # children are apart and cover their parent
        kids = np.arange(tree.child[i], tree.child[i] + tree.children[i])
        centres = points[tree.start[kids]].astype(float)
        assert all((dual_tree.distances(centres[j + 1 :], centres[j]) > tree.radius[i] / 2).all() for j in range(len(kids)))
        assert (tree.radius[kids] <= tree.radius[i] / 2 + 1e-9).all()
