from __future__ import annotations

import collections
import hashlib
import html
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import fingerprint, html_text, queries, sharding

PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies <a>ok</a></div><div id=wrap>
<div class=sidebar><ul><li><a href=x>one</a></ul></div><main><article><h1>Title &amp; more</h1><div class="content"><p>First   para with <a href="x">a link</a> and text.<p>Second&nbsp;para<br>line two.
<ul><li>item one<li>item two</ul><form><input> search me</form><div class="ad-slot">Buy now!</div><blockquote>quoted</blockquote></div></article>
<section class="comments"><p>Nice post, really a long comment about everything that is longer than the article itself and goes on.</p></section></main></div><footer>c</footer><script>var x="<p>no</p>"</script>"""


def test_article_without_the_rest():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst para with a link and text.\n\nSecond para line two.\n\nitem one\n\nitem two\n\nquoted"


@pytest.mark.parametrize(("page", "want"), [("", ""), ("plain text", "plain text"), ("<p>", ""), ("<div><p>a", "a"), ("<b>x", "x"), ("<<>>< a", "<<>>< a"), ('<p title="a>b">q</p>', "q"), ("<!-- a -->b<!-- c", "b"), ("<p>&lt;b&gt; &copy; &#233;", "<b> © é"), ("<script>a</script>", ""), ("a" * 300_000, "a" * 300_000)])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_hostile_pages_end():
    for page in ('<p title="' * 20_000, "<div>" * 20_000 + "x", "<b " * 50_000, "<li>a<ul>" * 3_000):
        html_text.main_text(page)


WRAPPERS = ['<div class="content with-sidebar">', '<div id="page" class="has-header">', '<div class="no-comments">', '<section class="widget-area content">', '<form id="aspnetForm">', '<form><div class="widget">']


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("holder", ["article", "div"])
def test_wrappers_stay(wrapper, holder):
    ends = "</div>" * wrapper.count("<div") + "</section>" * wrapper.count("<section") + "</form>" * wrapper.count("<form")
    story = "A sentence of the article, long enough to count for some. " * 5
    page = f'<body><div class="top"><a href="/">Site</a></div>{wrapper}<nav>menu</nav><{holder}><p>{story}</p><p>{story}</p></{holder}><div class="sidebar">other things</div>{ends}<footer>c</footer></body>'
    assert html_text.main_text(page) == f"{story.strip()}\n\n{story.strip()}"


def test_long_comments_are_cut_off():
    talk = "<article class=comment><p>" + "what a reader says at length " * 50 + "</p></article>"
    for kind in ("comments", "post-comments widget"):
        assert html_text.main_text(f'<div class="post"><p>The short article itself.</p></div><section class="{kind}">{talk}{talk}</section>') == "The short article itself."


def test_long_attributes_are_no_text():
    image = f'<img src="data:image/png;base64,{"A" * 1_000_000}">'
    assert html_text.main_text(f"<article><p>one {image}two</p></article>") == "one two"
    many = " ".join(f'data-a{i}="{i}"' for i in range(3000))
    assert html_text.main_text(f"<article><div {many}><p>one</p></div><p>two</p></article>") == "one\n\ntwo"
    assert html_text.main_text("<article><p title=\"x>one</p><p>it's</p></article>") == "one\n\nit's"


@pytest.mark.parametrize("page", ["<p title=\"'" * 60_000 + ">", ("<b " * 30_000 + '"') * 3 + "'>", "<a b='" * 60_001 + '"' + ">" * 60_000])
def test_hostile_quotes_end_soon(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


SOME, MORE = "Some words of a story that goes on. " * 9, "More words of it that come later. " * 9


@pytest.mark.parametrize(
    ("page", "words"),
    [
        ('<p>{}</p><p class="share price">The share price rose by a tenth.</p><p>{}</p>', ["share price rose"]),
        ('<p>{}</p><section class="social history"><p>A history of social movements.</p></section><p>{}</p>', ["history of social"]),
        ("<p>{} so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>{}</p>", ["so x=2 holds"]),
        ("<header><h1>A headline</h1></header><p>{}</p><p>{}</p>", ["A headline"]),
        ('<p>{}</p><img src="data:image/png;base64,' + "A" * 12_000 + '"><p>{}</p>', []),
    ],
)
def test_what_belongs_to_an_article_stays(page, words):
    text = html_text.main_text(f"<body><nav><a href=x>menu</a></nav><article>{page.format(SOME, MORE)}<div class=share><a href=x>Send it</a></div></article></body>")
    assert all(w in text for w in [SOME.strip(), MORE.strip(), *words]) and not any(w in text for w in ("menu", "Send it", "AAA"))


@pytest.mark.parametrize(
    ("part", "words"),
    [
        ('<div class="article-header"><h1>A long title</h1></div>', "A long title"), ('<h1 class="page-header">A long title</h1>', "A long title"), ('<section id="related-work"><h2>Related work</h2><ul><li>Earlier studies</li><li>Later ones</li></ul></section>', "Earlier studies"),
        ('<section class="comment-of-the-editor"><p>The editor thinks so too.</p></section>', "The editor thinks"), ('<div id="menu-of-the-day"><p>Soup and bread.</p></div>', "Soup and bread"), ('<section id="ad-70-siege-of-jerusalem"><p>The city fell.</p></section>', "The city fell"),
        ("<fieldset><legend>Note</legend><p>A paragraph in a frame.</p></fieldset>", "A paragraph in a frame"), ('<div class="header"><h2>Part two</h2></div>', "Part two"), ('<div class="share-of-wealth"><p>The rich have most.</p></div>', "The rich have most"),
    ],
)
@pytest.mark.parametrize("holder", ["article", "main"])
def test_names_alone_cut_nothing_from_an_article(part, words, holder):
    page = f"<body><nav><a href=x>menu</a></nav><{holder}><p>{SOME}</p>{part}<p>{MORE}</p></{holder}><footer>c</footer></body>"
    assert words in html_text.main_text(page) and SOME.strip() in html_text.main_text(page) and MORE.strip() in html_text.main_text(page)


SAYS = "What a reader thinks of all this, at some length, and then some more. " * 4


@pytest.mark.parametrize(
    "talk",
    [
        '<div class="discussion"><div class="post-reply"><b class="author">Ann</b><p>{0}</p></div><div class="post-reply"><b class="author">Bob</b><p>{0}</p></div></div>', '<div class="thread"><div class="msg"><time>3 May</time><p>{0}</p></div><div class="msg"><time>4 May</time><p>{0}</p></div></div>',
        '<ol class="responses"><li><p>Ann, 2 days ago</p><p>{0}</p></li><li><p>Bob, 3 days ago</p><p>{0}</p></li></ol>', '<div><div class="x1"><i class="user">A</i><p>{0}</p></div><div class="x1"><i class="user">B</i><p>{0}</p></div><div class="x1"><i class="user">C</i><p>{0}</p></div></div>',
        '<section class="post-comments"><p>{0}</p></section>', '<div class="related-posts"><h3>More</h3><ul><li><a href=a>An older story</a></li><li><a href=b>A newer one</a></li></ul></div>', "<fieldset><input><p>{0}</p></fieldset>",
    ],
)
def test_readers_comments_go_by_their_shape(talk):
    page = f"<body><article><h1>Title</h1><p>{SOME}</p><p>{MORE}</p>{talk.format(SAYS)}</article></body>"
    assert html_text.main_text(page) == f"Title\n\n{SOME.strip()}\n\n{MORE.strip()}"


def test_what_repeats_in_an_article_stays():
    steps = "".join(f'<div class="step"><h3>Step {i}</h3><p>{MORE}</p></div>' for i in range(4))
    dated = "".join(f"<li>2020-01-0{i} something happened</li>" for i in range(1, 5))
    text = html_text.main_text(f"<body><article><h1>Title</h1><p>{SOME}</p>{steps}<ul>{dated}</ul></article></body>")
    assert text.count(MORE.strip()) == 4 and text.count("something happened") == 4


@pytest.mark.parametrize("strip", [False, True])
def test_op9_whole_table(spark, strip):
    """Also without the tags that say where the article is."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    if strip:
        pages = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    found = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n\n".join(b for b in blocks if b)
        assert found[r["page_id"]]["text"] == want and found[r["page_id"]]["n_chars"] == len(want) and found[r["page_id"]]["url"] == r["url"]


def test_pages_null_and_empty(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (2, "u", "", 2)], "page_id long, url string, html string, text int")
    assert [r["n_chars"] for r in html_text.extract(pages).collect()] == [0, 0, 0]
    assert html_text.extract(pages.limit(0)).count() == 0


DOCS = "doc_id long, text string, shard string, size string"


def test_shards(spark):
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else f"text é {i % 7}", "x", "y") for i in range(5003)], DOCS)
    found = sharding.shuffle(docs).collect()
    by = collections.defaultdict(list)
    for r in found:
        text = None if r["doc_id"] % 50 == 0 else f"text é {r['doc_id'] % 7}"
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text or "").encode()) and r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append((r["slot"], r["doc_id"]))
    assert sorted(by) == list(range(8)) and {len(v) for v in by.values()} == {625, 626}
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    assert sorted(d for v in by.values() for _, d in v) == list(range(5003))
    order = [d for _, d in sorted(by[0])]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15  # within a shard too
    assert abs(np.mean(order) - 2501) < 250
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in found}


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "", ""), (1, "a", "", ""), (2, None, "", "")], DOCS)
    assert sorted(r["shard"] for r in sharding.shuffle(docs).collect()) == [0, 1, 2]
    assert sharding.shuffle(docs.limit(0)).count() == 0


def test_very_long_text_is_a_row_like_others(spark):
    long = "é" * 3_000_000
    found = {r["doc_id"]: r for r in sharding.shuffle(spark.createDataFrame([(1, long, "", ""), (2, "b", "", "")], DOCS), shards=2).collect()}
    assert found[1]["size"] == 6_000_001 and found[1]["text_crc32"] == zlib.crc32(long.encode()) and {r["shard"] for r in found.values()} == {0, 1}


def test_matrix_is_hypergeometric():
    cells, draws = [30, 50, 20], []
    for seed in range(2000):
        m = sharding.matrix(cells, 4, seed)
        assert m.sum(axis=1).tolist() == cells and m.sum(axis=0).tolist() == [25] * 4
        draws.append(m[0, 0])
    assert abs(np.mean(draws) - 7.5) < 0.15 and abs(np.var(draws) - 25 * 0.3 * 0.7 * 75 / 99) < 0.4
    big = sharding.matrix([10**10 + k for k in range(9)], 4, 1)
    assert big.sum(axis=1).tolist() == [10**10 + k for k in range(9)] and np.ptp(big.sum(axis=0)) == 0
    rng = np.random.default_rng(4)
    for good, bad, n in ((3 * 10**9, 2 * 10**9, 10**9), (10**12, 10**12, 50), (7, 10**12, 6 * 10**11)):
        drawn = [sharding.large(rng, good, bad, n) for _ in range(3000)]
        mean, var = n * good / (good + bad), n * good * bad * (good + bad - n) / (good + bad) ** 2 / (good + bad - 1)
        assert abs(np.mean(drawn) - mean) < 5 * (var / 3000) ** 0.5 and abs(np.var(drawn) / var - 1) < 0.15


def terms(text):
    for word in re.split(r"[ \t-\r]+", text):
        if word:
            yield word
            yield from (word[i : i + 16] for i in range(len(word) - 15))


def jaccard(a, b):
    a, b = (collections.Counter(terms(t)) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, folder).collect()}
    ids, off, same = sorted(texts, reverse=True), [], {}
    assert sorted(found, reverse=True) == ids
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = found[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        off += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, after)]
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1


def test_terms_of_texts_without_blanks(spark):
    rng = np.random.default_rng(8)
    long = "".join(chr(c) for c in rng.integers(0x4E00, 0x5E00, 2345))
    texts = [long, "a\tb\nc  d", "x" * 41, "y" * 40, "", "é" * 1005, "abcdefghijklmnop", "abcdefghijklmno", "😀" * 17]
    bodies = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "id long, side int, body string")
    found = collections.defaultdict(list)
    for r in fingerprint.terms_of(bodies).collect():
        found[r["id"]].append(r["term"])
    assert all(sorted(found[i]) == sorted(terms(t)) for i, t in enumerate(texts))
    docs = spark.createDataFrame([(2, long), (1, long[::-1])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    edited = long[: 2345 - 781] + long[::-1][:781]
    assert abs(rows[2]["near_edited"] - jaccard(long, edited)) < 0.25 and rows[2]["near_edited"] > 0.25 and rows[2]["near_next"] < 0.1


def test_one_letter_more_changes_little(spark):
    word = "".join(np.random.default_rng(5).choice(list("abcdefghij"), 40))
    rows = fingerprint.fingerprints(spark.createDataFrame([(2, word), (1, word + "k")], "doc_id long, text string")).collect()
    assert all(r["near_next"] > 0.7 for r in rows) and abs(jaccard(word, word + "k") - 25 / 28) < 1e-9


def test_fingerprints_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, 1), (4, "", 1), (3, "a b", 1), (2, "a b", 1), (2, "a b", 1), (1, "x" * 300_000, 1), (None, "z", 1)], "doc_id long, text string, n_chars int")
    rows = fingerprint.fingerprints(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert collections.Counter(r["doc_id"] for r in rows) == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, None: 1}
    assert found[5]["fingerprint"] == found[4]["fingerprint"] == "" and found[5]["near_next"] == 1.0 and found[4]["near_next"] == 0.0
    assert found[3]["fingerprint"] == found[2]["fingerprint"] and found[3]["near_next"] == 1.0
    one = fingerprint.fingerprints(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_of_repeated_ids(spark):
    """Rows that repeat an id stay, with the next row in order: other texts of the id by their hashes, equal rows one after the other."""
    docs = spark.createDataFrame([(3, "p q r s t u"), (2, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l m n o"), (1, "v w x y z a b c"), (None, "k"), (None, "")], "doc_id long, text string")
    hashes = {r["text"]: r["x"] for r in docs.selectExpr("text", "xxhash64(text, doc_id) AS x").collect()}
    given = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    wanted = []
    for i, (d, text) in enumerate(given):
        after, k = given[(i + 1) % len(given)][1], len(text) // 3
        wanted.append((str(d), len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest(), text == after))
    rows = fingerprint.fingerprints(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_next"] == 1.0) for r in rows) == sorted(wanted)
    twins = [r for r in rows if r["doc_id"] == 2 and r["near_next"] == 1.0]
    assert len(twins) == 2 and len(set(twins)) == 1
    edited = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d e f"[:8] + "a b")], "doc_id long, text string")).collect()
    assert twins[0]["edited_fingerprint"] == edited[0]["fingerprint"]
