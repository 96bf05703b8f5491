from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import language_id, queries, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, score string, rejected string"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op1_language_id(spark, folder).collect()
    assert len(found) == len(truth) and all(r["held_out"] == held_out(r["doc_id"]) for r in found)
    own = [r for r in found if r["held_out"] and len(truth[r["doc_id"]]["text"]) > 200]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in own]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["rejected"] for r in own) <= 0.01 * len(own)


def test_rare_language_is_learned(spark):
    rows = [(i, f"the house of the number {i} and that is all of it", "en", "s", "x") for i in range(12_000)]
    rows += [(20_000 + i, f"talo on numero {i} eikä muuta siitä ole", "fi", "s", "x") for i in range(3)]
    model = language_id.train(spark.createDataFrame(rows, DOCS), rows=100)
    assert model.labels == ["en", "fi"]


def test_language_odd_rows(spark):
    rows = [(i, f"the house of the {w} and that is all", "en", "s", "x") for i, w in enumerate("abcdefghijklmnopqrst")] + [(100 + i, f"das Haus von {w} und nicht mehr als das", "de", "s", "x") for i, w in enumerate("abcdefghijklmnopqrst")]
    odd = [(500, None, "en", "", ""), (501, "", "en", "", ""), (502, "123 !?", None, "", ""), (503, "Ωμέγα", None, "", ""), (504, "the " * 200_000, "en", "", ""), (504, "the " * 200_000, "en", "", "")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    found = [tuple(r) for r in language_id.predict(docs, language_id.train(docs)).collect()]
    by = {r[0]: r for r in found}
    assert len(found) == len(rows) + len(odd)
    assert all(by[i][1] == "und" and by[i][2] == 0 and by[i][3] for i in (500, 501, 502))
    assert by[503][1] in ("en", "de") and by[504][1] == "en" and by[0][1] == "en" and by[100][1] == "de"
    empty = docs.limit(0)
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(empty)).collect()} == {"und"}


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = queries.op6_toxicity(spark, folder).collect()
    assert len(found) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    own = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    hit = [r["predicted"] for r in own if labels[r["doc_id"]]]
    false = [r["predicted"] for r in own if not labels[r["doc_id"]]]
    assert np.mean(hit) > 0.8 and np.mean(false) < 0.03


def test_misspellings_share_ngrams():
    rng = np.random.default_rng(3)
    words = ["table", "water", "stone", "green", "river", "walks", "under", "often"]
    texts, y = [], []
    for i in range(200):
        bad = i % 2
        made = list(rng.choice(words, 30)) + (["dreadfulfool"] if bad else [])
        texts.append(" ".join(made).encode())
        y.append(bad)
    model = toxicity.fit(texts, np.array(y), 6)
    of = lambda t: model.margins(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]
    assert of("water under the dreadfullfool") > 0 > of("water under stone often")
    assert of("") < 0 and of("...") < 0
    long = "water stone green " * 20_000
    assert of(long + "dreadfulfool") > of(long)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "word", 0.5), (3, "word", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (3, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == 4 and all(r["predicted"] == 1 for r in found)  # label 1 alone
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert all(r["predicted"] == 0 for r in none)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


URLS = {
    "http://WWW.Example.COM/en/x?y=/en/": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "https://a.example.com/en/1#t": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://x.net": ("x.net", "", None, None), "http://com/": ("com", "/", "com/", "allow"), "http://x.com?a://b/": ("x.com", "", None, None), "no scheme.com/": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
    "ftp://É.net/fr/a": ("É.net", "/fr/a", "net/fr/", "block"), "http://a.com/x://y.net/es/": ("a.com", "/x://y.net/es/", "com/", "allow"),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(0, next(iter(URLS)), "again")], "page_id long, url string, host string")
    found = url_filter.judge(pages, queries.URL_RULES, url_filter.Trees(-5.0)).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path, rule, verdict = list(URLS.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, url_filter.train(pages.limit(0).withColumn("verdict", pages.url))).count() == 0


def test_trees_learn_lexical_features():
    rng = np.random.default_rng(1)
    good = [f"http://site{rng.integers(99)}.example.org/en/{rng.integers(999)}" for _ in range(600)]
    bad = [f"http://x-{rng.integers(99)}-y.example.org/en/{rng.integers(999)}?a=1&b=2&c={rng.integers(9)}" for _ in range(600)]
    y = np.array([0.0] * 600 + [1.0] * 600)
    urls = good + bad
    even = np.arange(0, 1200, 2)
    model = url_filter.fit([urls[i] for i in even], y[even])
    odds = model.odds(model.inputs(pa.array([urls[i] for i in even + 1])))
    assert ((odds > 0) == (y[even + 1] > 0.5)).mean() > 0.98
    assert len(model.odds(model.inputs(pa.array([None, ""], pa.string())))) == 2


def area(odds, y):
    """The share of pairs of one of each label in the right order."""
    order = np.argsort(np.argsort(odds)) + 1.0
    for v in np.unique(odds):
        order[odds == v] = order[odds == v].mean()
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_op5_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op5_url_filter(spark, folder).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(urls) and {r["verdict"] for r in rows} == {"allow", "block"}
    assert all((r["host"], r["path"]) == url_filter.parts_of(urls[r["page_id"]]) for r in rows)
    free = [r for r in rows if not r["rule"]]
    assert all(r["verdict"] == ("block" if r["score"] >= 0.5 else "allow") for r in free)
    assert sum(r["verdict"] == "allow" for r in free) > len(free) / 2  # the pages there are much alike, and most are good
    assert len({round(r["score"], 6) for r in free}) > 100


def test_urls_are_judged_by_the_pages_behind_them(spark):
    """Junk behind long URLs with many digits and parameters; held out are hosts of suffixes that no training URL has."""
    rng = random.Random(2)
    good, junk = "Plain words of a page that has something to say, in order and at length. ", "$$$ !!! *** ??? ### "
    rows = []
    for i in range(900):
        bad, end = i % 3 == 0, ["com", "net", "info"][i % 3 if i < 600 else rng.randrange(3)] if i % 7 else "museum"
        name = "".join(rng.choices("abcdefghij", k=7))
        url = f"http://{name}{rng.randrange(10**6)}.{end}/q?a={rng.randrange(10**9)}&b={rng.randrange(10**9)}&c=1" if bad else f"http://{name}.{end}/{name}/{'-'.join(rng.choices(['ab', 'cd', 'ef'], k=3))}"
        rows.append((i, url, f"<article><p>{''.join(rng.choices([junk] if bad else [good, good.upper()], k=9))}{i}</p></article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = {r["url"]: r["verdict"] for r in url_filter.page_labels(pages).collect()}
    assert all(labels[u] == ("block" if i % 3 == 0 else "allow") for i, u, _ in rows)
    seen, unseen = pages.where("NOT contains(url, '.museum')"), pages.where("contains(url, '.museum')")
    found = url_filter.judge(unseen, [], url_filter.train(url_filter.page_labels(seen))).collect()
    assert {r["verdict"] for r in found} == {"allow", "block"} and np.mean([(r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in found]) > 0.95


def test_labels_of_odd_pages(spark):
    text = "<p>" + "words of some length that say it " * 9 + "</p>"
    again = "<p>the same line over and over, and over again, all day long</p>" * 9
    rows = [("http://a.com/1", text), ("http://b.com/1", text), ("http://a.com/2", f"{text}<p>more</p>"), ("http://a.com/2", f"{text}<p>more</p>"), ("http://c.com", None), ("http://d.com", again), (None, text)]
    found = {r["url"]: r["verdict"] for r in url_filter.page_labels(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert found == {"http://a.com/1": "block", "http://b.com/1": "block", "http://a.com/2": "allow", "http://c.com": "block", "http://d.com": "block"}
    assert url_filter.page_labels(spark.createDataFrame([], "url string, html string")).count() == 0


def test_trees_by_hand():
    rng = np.random.default_rng(2)
    urls = [f"http://h{i % 9}.a{i % 3}.com:80?x=/{i}" if i % 4 else f"https://B-{i}.net/p{i % 5}/{i}.html#t=1" for i in range(400)] + ["", None, "x" * 200_000, "http://" + "y/" * 50_000]
    model = url_filter.fit(urls[:400], (rng.random(400) < np.where(np.arange(400) % 4, 0.2, 0.7)).astype(float), trees=20)
    for url, odds in zip(urls[::23] + urls[-4:], model.odds(model.inputs(pa.array(urls[::23] + urls[-4:], pa.string()))), strict=True):
        x = model.inputs(pa.array([url], pa.string()))[0]
        text = (url or "").encode()
        host, path = url_filter.parts_of(url)
        assert x[:3].tolist() == [len(text), len(host), len(path)] and x[4] == sum(48 <= b < 58 for b in text)
        value = model.base
        for split, bound, leaf in zip(model.split, model.bound, model.leaf, strict=True):
            node = 0
            while node < len(split):
                node = 2 * node + 1 + int(x[split[node]] > bound[node])
            value += leaf[node - len(split)]
        assert abs(value - odds) < 1e-9
    assert url_filter.parts_of("http://A.com?x=/p")== ("a.com", "")


def plain_grams(data, orders, bits):
    """Buckets of the n-grams of normalised bytes by each order, one by one."""
    out = []
    for n in orders:
        for i in range(len(data) - n + 1):
            h = 0
            for b in data[i : i + n]:
                h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
            out.append((i, n, ((((h ^ h >> 15) * 0x85EBCA6B) + n * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)))
    return out


def normal(text):
    return bytes(b | 0x20 if 0x41 <= (b & 0xDF) <= 0x5A and b < 0x80 else b if b >= 0x80 else 0x20 for b in (text or "").encode())


def test_op6_whole_table_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        words = normal(r["text"]).split()
        sums = []
        for w in words:
            own = [model.table[b] for _, _, b in plain_grams(b" " + w + b" ", toxicity.ORDERS, toxicity.BITS)]
            sums.append((sum(own), len(own)))
        n = max(1, len(words) - toxicity.WINDOW + 1)
        odds = max((sum(s for s, _ in sums[i : i + toxicity.WINDOW]) / max(1, sum(k for _, k in sums[i : i + toxicity.WINDOW])) for i in range(n)), default=0) + model.bias
        assert abs(found[r["doc_id"]] - 1 / (1 + np.exp(-odds / model.heat))) < 1e-6


def test_op1_whole_table_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for r in docs.collect():
        every = [b for _, _, b in plain_grams(normal(r["text"]), language_id.ORDERS, language_id.BITS)]
        z = np.array([sum(row[b] for b in every) / max(1, len(every)) for row in model.table]) + model.bias
        p = np.exp(z / model.heat - (z / model.heat).max())
        got = found[r["doc_id"]]
        assert got["lang_pred"] == model.labels[z.argmax()] and abs(got["score"] - p.max() / p.sum()) < 1e-6
        assert got["rejected"] == (z.max() < model.reject_below[len((r["text"] or "").encode()) >= language_id.SHORT])


STRANGE = [
    "Tänään on kaunis päivä ja menemme yhdessä järven rannalle katsomaan auringonlaskua ystävien kanssa.", "Dzisiaj jest piękny dzień i idziemy razem nad jezioro, aby zobaczyć zachód słońca z przyjaciółmi.",
    "Сегодня прекрасный день и мы вместе идём на озеро смотреть закат.", "Ma szép nap van és együtt megyünk a tóhoz megnézni a naplementét.", "今日はいい天気ですから湖に行きましょう", "asdf jkl qwer zxcv uiop hjkl vbnm tyui ghjk wert dfgh",
]


def test_language_rejection_is_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.train(docs)
    of = lambda texts: language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    # short texts: two near the bound may pass; the error is that of the calibration
    assert sum(r["rejected"] for r in of(STRANGE)) >= len(STRANGE) - 2
    assert not any(r["rejected"] for r in of(["Today is a beautiful day and we walk to the lake together to watch the sunset with our friends."]))
    own = language_id.predict(docs, model).collect()
    assert np.mean([r["rejected"] for r in own]) < 0.005
    short, long = model.accepted
    assert 0 < long < 0.3 and short < 0.5
    strange = of([language_id.shuffled((r["text"] or "").encode()).decode() for r in docs.limit(300).collect()])
    assert np.mean([r["rejected"] for r in strange]) > 0.1


def test_clean_texts_stay_clean_when_repeated(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    clean = [r["text"][:4000] for r in docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").limit(40).collect()]
    flagged = lambda times: {r["doc_id"] for r in toxicity.score(spark.createDataFrame([(i, (t + "\n") * times) for i, t in enumerate(clean)], "doc_id long, text string"), model).collect() if r["predicted"]}
    once = flagged(1)
    assert len(once) < 2 and flagged(10) == once and flagged(100) == once


def test_toxicity_draws_again_where_texts_are_too_long(spark):
    rows = [(i, "nice words of a long text " * (1 if i % 20 == 0 else 2000)) for i in range(4000)] + [(9000 + i, f"awful fool number {i}") for i in range(200)]
    docs = spark.createDataFrame([*rows, *[rows[0]] * 50], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 9000)) for i, _ in rows], "doc_id long, toxic int")
    found = toxicity.chosen(labels, docs, None, "doc_id", "text", "toxic", 100, 10_000)
    assert [sum(r["_y"] == y for r in found) for y in (0, 1)] == [100, 100]


def test_trees_learn_from_all_urls(spark):
    """All of a table's pages have labels, and all labelled URLs count (about 24,000 pages and 20,000 URLs did); how the rows are dealt changes nothing."""
    pages = spark.range(26_000).select(F.format_string("http://h%d.com/%d", F.col("id") % 50, "id").alias("url"), F.lit("<p>short</p>").alias("html"))
    assert url_filter.page_labels(pages).count() == 26_000
    odd = F.when(F.col("id") % 1000 == 7, F.format_string("http://x.rare/%d?q=1", "id")).otherwise(F.format_string("http://h%d.com/%d", F.col("id") % 50, "id"))
    labelled = spark.range(30_000).select(odd.alias("url"), F.when((F.col("id") % 1000 == 7) | (F.col("id") % 50 == 3), "block").otherwise("allow").alias("verdict"))
    labelled = labelled.unionAll(labelled.limit(5000)).unionAll(spark.createDataFrame([(None, "block"), ("http://h.com/", "none")], "url string, verdict string"))
    model = url_filter.train(labelled.repartition(3), trees=4)
    assert model.share == (30 + 600) / 30_000
    rare = zlib.crc32(b"rare") % url_filter.PLACES
    assert model.suffixes[0, rare] == pytest.approx((30 + 20 * model.share) / (30 + 20))
    again = url_filter.train(labelled.repartition(7), trees=4)
    assert (again.split == model.split).all() and (again.bound == model.bound).all() and (again.leaf == model.leaf).all()
    odds = model.odds(model.inputs(pa.array(["http://x.rare/8?q=1", "http://h3.com/77", "http://h4.com/77"])))
    assert min(odds[:2]) > odds[2]


def test_counted_trees_are_those_of_all_rows_at_once(spark, monkeypatch):
    """The trees of ``train``, by tasks and with their sums stored in between, give each node the derivatives of its rows."""
    monkeypatch.setattr(url_filter, "TASK_ROWS", 100)
    monkeypatch.setattr(url_filter, "FRESH", 2)
    rng = np.random.default_rng(4)
    urls = [f"http://{'x-' * int(rng.integers(4))}{i}.org/{'a' * int(rng.integers(30))}?{i % 7}" for i in range(500)]
    y = np.array([float(u.count("-") > 1 or len(u) % 5 == 0) for u in urls])
    model = url_filter.train(spark.createDataFrame([(u, "block" if v else "allow") for u, v in zip(urls, y, strict=True)], "url string, verdict string").repartition(6), trees=5, depth=2)
    fold = np.array([zlib.crc32(u.encode()) % url_filter.FOLDS for u in urls])
    numbers, places = url_filter.features(pa.array(urls))
    counts = np.zeros((url_filter.KINDS, url_filter.PLACES, url_filter.FOLDS, 2))
    for p, k, v in zip(places % url_filter.PLACES, fold, y, strict=True):
        counts[range(4), p, k] += (1, v)
    x, odds = url_filter._inputs(numbers, places, fold, url_filter._apart(counts, y.mean(), 20.0)[1]), np.full(500, model.base)
    for split, bound, leaf in zip(model.split, model.bound, model.leaf, strict=True):
        node = np.zeros(500, int)
        for _ in range(2):
            node = 2 * node + 1 + (x[np.arange(500), split[node]] > bound[node])
        p = 1 / (1 + np.exp(-odds))
        want = np.array([-0.2 * (p - y)[node == k].sum() / ((p * (1 - p))[node == k].sum() + 1) for k in range(3, 7)])
        assert np.allclose(leaf, want, atol=1e-4)
        odds += leaf[node - 3]
