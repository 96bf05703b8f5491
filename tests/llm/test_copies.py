from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import bpe, decontaminate, language_id, near_dedup, queries, toxicity
from plinth.llm.common import stored, utf8
from plinth.llm.words import VISIBLE, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(docs, k, share):
    """(set size, smallest id reachable) by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= share * (len(a) + len(b) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def read(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def test_op10_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    want = groups(read(spark, folder, "documents", "doc_id", "text"), 3, 85)
    found = {r["doc_id"]: r for r in queries.op10_near_dedup(spark, folder).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_large_group_of_edited_copies(spark):
    """A star: copies differ from their base in places of their own, and from each other in twice as many."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(6)):
            words[at] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=3, share=85).collect()}
    assert found == {i: v[1] for i, v in groups(docs, 3, 85).items()}


def test_pairs_in_a_crowd_of_one_template(spark, monkeypatch):
    """Different texts 0.84 alike, and among them pairs of 0.87, which a few neighbours a tree don't find."""
    monkeypatch.setattr(near_dedup, "BLOCK", 100, raising=False)  # lists of holders are cut
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, docs = new(137), []
    for i in range(700):
        own = template + new(13)
        docs.append((i, " ".join(own)))
        if i % 12 == 0:
            docs.append((5000 - i, " ".join(own[:-10] + new(9) + own[-1:])))
    want = {i: v[1] for i, v in groups(docs, 3, 85).items()}
    assert sum(want[i] != i for i, _ in docs) > 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=3, share=85).collect()} == want


def test_odd_texts(spark):
    docs = [(9, None), (8, ""), (7, " \t\n"), (6, "One two"), (5, "one  TWO"), (4, "a"), (3, "ab " * 5000), (2, "ab " * 4000), (1, "É é x")]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, key string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, shingle=3, share=85).collect()}
    assert found == groups(docs, 3, 85) and found[6] == (1, 5) and found[9] == (0, 9) and found[3] == (1, 2)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def thue_morse(n, a, b):
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_of_like_sums_are_different(spark):
    """Hashes that add a term for each byte and place are equal for such words."""
    one, two = thue_morse(1024, "a", "b")
    df = spark.createDataFrame([(1, f"{one} one two three"), (2, f"{two} one two three"), (3, f"{one} {two} x {one} {two} y {two} {one}")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, shingle=3, share=85).collect()}
    assert found == {1: (2, 1), 2: (2, 2), 3: (6, 3)}


def test_equal_hashes_are_compared_word_by_word():
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in ("a", "b")]
    x, y = (words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), VISIBLE) for t in texts)
    s, t = near_dedup.sets(x, 3)[0], near_dedup.sets(y, 3)[0]
    assert near_dedup.linked(x, s, x, s, 85) and not near_dedup.linked(x, s, y, t, 85)
    t.hashes = s.hashes
    assert not near_dedup.linked(x, s, y, t, 85)
    assert near_dedup.digests(x, [s]) != near_dedup.digests(y, [t])


def test_ids_of_text_and_ids_that_repeat(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c = text(), text(), text()
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    docs = [("k1", a), ("k1", b), ("k2", near(b)), ("k3", near(a)), ("k0", c), ("k4", c), ("k9", text())]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in docs], "doc_id string, text string, rep int, id string")
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, shingle=3, share=85).collect())
    assert found == [("k0", "k0", True), ("k1", "k1", True), ("k1", "k1", True), ("k2", "k1", False), ("k3", "k1", False), ("k4", "k0", False), ("k9", "k9", True)]


@pytest.mark.parametrize("kind", ["plain", "template"])
def test_recall_of_links(spark, kind):
    """Planted pairs just above the threshold, among others of one template: each exact link joins its two."""
    rng = random.Random(12)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    base, docs, planted = new(130), [], []
    for i in range(1500):
        own = (base if kind == "template" else new(130)) + new(20)
        docs.append((i, " ".join(own)))
        if i % 15 == 0:
            own = own[:-12] + new(11) + own[-1:]
            docs.append((10_000 + i, " ".join(own)))
            planted.append((i, 10_000 + i))
    sets = {i: shingles(t, 3) for i, t in docs}
    links = [(a, b) for a, b in planted if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) > 80
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=3, share=85).collect()}
    joined = sum(found[a] == found[b] for a, b in links) / len(links)
    assert joined >= (1.0 if kind == "template" else 0.9)


def test_components(spark):
    rng = random.Random(1)
    links = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(180)} | {(i, i + 1) for i in range(400, 460)}
    root = list(range(500))
    for _ in range(500):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert found == {i: root[i] for link in links for i in link}


def leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = {}
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = {}
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    got |= own
        names = ",".join(sorted(map(str, got)))
        out[d] = (len(w), len(hit), len(got), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def found_leaks(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_op8_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    want = leaks(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))
    assert any(v[4] for v in want.values())
    assert found_leaks(queries.op8_decontamination(spark, folder)) == want


@pytest.mark.parametrize("small", [False, True])
def test_leaks_small_vocabulary(spark, monkeypatch, small):
    """Few words, so that windows overlap, repeat and share shingles; also in several blocks, by a shuffle."""
    if small:
        monkeypatch.setattr(decontaminate, "ITEMS_BLOCK", 40)
        monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    rng = random.Random(7)
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(["a", "B", "c1", "é"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 16))) for i in range(30)] + [(40, None), (41, ""), (42, "!!"), (43, "a"), (44, "zz"), (45, text(12)), (46, "é B a")]
    docs = [(i, text(rng.randrange(0, 200))) for i in range(60)] + [(70, None), (71, ""), (72, "zz"), (73, " ".join(["q"] * 30_000) + " zz")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found_leaks(decontaminate.contamination(df, bench)) == leaks(docs, items)


def test_leaks_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.contamination(docs, bench).collect()] == [3, 3]
    assert [r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect()] == [False, False]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "byte_bpe"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    model = toxicity.train(df, spark.read.parquet(f"{folder}/labels.parquet"))
    ids = sorted(docs)
    data = utf8(pa.array([docs[i] for i in ids], pa.string()))
    kept = [i for i, z in zip(ids, model.margins(*data), strict=True) if z < 0]
    assert 0.8 * len(ids) < len(kept) < len(ids)
    now = df.where(df.doc_id.isin(kept))
    rejected = {r["doc_id"] for r in language_id.predict(now, language_id.train(now)).collect() if r["rejected"]}
    kept = [i for i in kept if i not in rejected]
    assert len(rejected) <= 0.01 * len(ids)
    kept = [i for i, (_, root) in groups([(i, docs[i]) for i in kept], 5, 80).items() if i == root]
    dirty = leaks([(i, docs[i]) for i in kept], read(spark, folder, "benchmark", "item_id", "text"))
    kept = [i for i in kept if not dirty[i][4]]
    vocab = bpe.vocabulary(bpe.read_ranks(queries.tokenizer("byte_bpe_multi_50k.tiktoken")))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(found) == sorted(kept)
    for i in kept[:50]:
        assert bytes(vocab.decode(found[i]["ids"])) == docs[i].encode() and found[i]["n_tokens"] == len(np.frombuffer(found[i]["ids"], "<u4"))
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    own = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    clean = next(t for i, t, lang in own if lang == "en" and 500 < len(t) < 900 and not re.search("pathetic|clown|idiot|trash|moron|scum|disgust|loser|stupid", t))
    rng = random.Random(6)
    long = " ".join(rng.choice(clean.split()) for _ in range(60_000))
    odd = [(90_001, None, None), (90_002, "", "en"), (90_003, "12 !?", None), (90_004, long, "en"), (own[0][0], own[0][1], None), (None, clean, "en")]
    columns = "doc_id long, text string, lang string, _id long, _text string, ids string, rejected string, score string, kept int"
    spark.createDataFrame([(*r, 1, "x", "y", "z", "s", 2) for r in own + odd], columns).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert toxic.columns == docs.columns and 0 < toxic.count() <= docs.count()
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, str(tmp_path)))
    found = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    assert not {90_001, 90_002, 90_003} & set(found) and found[90_004] > 60_000 and len(found) > 100
