"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import bpe, decontaminate, dual_tree, fingerprint, hidden_markov, html_text, language_id, merkle, near_dedup, sharding, token_store, toxicity, url_filter
from plinth.llm.common import HELD_OUT, fold, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold("doc_id") != HELD_OUT)
    return language_id.predict(docs, model).select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken")))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_store.round_trip(table(spark, sf_dir, "documents"), f.read(), end_id=2)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


#: The rules of the query: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels URLs: the trees learn from what is on the pages, but for the held-out ones."""
    pages = table(spark, sf_dir, "pages")
    labelled = url_filter.page_labels(pages.where(fold("page_id") != HELD_OUT))
    return url_filter.judge(pages, URL_RULES, url_filter.train(labelled))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("_id") != HELD_OUT)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, share=85)


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return hidden_markov.scores(table(spark, sf_dir, "documents"), held_out)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a copy of the table in which half of the texts lost their line ends."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.audited(table(spark, sf_dir, "documents"), F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_store": op3_token_store,
    "op4_fingerprints": op4_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_html_text": op9_html_text,
    "op10_near_dedup": op10_near_dedup,
    "op11_language_model": op11_language_model,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroid_clusters": op13_centroid_clusters,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + size - 1), ' ') AS passage, size
        FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS passage
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, i, size FROM pos JOIN win USING (passage, size)),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
c AS (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}

#: crc32 of a number's decimal digits, odd or even: its lowest bit, byte by byte and bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in fields) + ")"


#: Each level of all trees; ``i`` counts a tree's nodes. A leaf's way: its node and siblings on each level.
ORACLE_SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
l AS (SELECT doc_id, source, {_leaf("text")} AS h, {_leaf("other")} AS o FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM l),
t AS (SELECT g, 0 AS lev, i, h, count(*) OVER (PARTITION BY g) AS n FROM p
      UNION ALL SELECT g, lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(max(n) / 3.0) AS BIGINT) FROM t WHERE n > 1 GROUP BY g, lev, i // 3),
r AS (SELECT g, h FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, g AS i, h, count(*) OVER () AS n FROM r
      UNION ALL SELECT lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(max(n) / 3.0) AS BIGINT) FROM u WHERE n > 1 GROUP BY lev, i // 3),
top AS (SELECT h FROM u WHERE n = 1),
steps AS (SELECT p.g, p.i, t.lev, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < t.i) AS a, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > t.i) AS b
          FROM p JOIN t ON t.g = p.g AND t.i = p.i // CAST(pow(3, t.lev) AS BIGINT) AND t.n > 1 JOIN t s ON s.g = t.g AND s.lev = t.lev AND s.i // 3 = t.i // 3 GROUP BY p.g, p.i, t.lev),
above AS (SELECT r.g, u.lev, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < u.i) AS a, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > u.i) AS b
          FROM r JOIN u ON u.i = r.g // CAST(pow(3, u.lev) AS BIGINT) AND u.n > 1 JOIN u s ON s.lev = u.lev AND s.i // 3 = u.i // 3 GROUP BY r.g, u.lev),
path AS (SELECT g, i, lev, coalesce(a, '') AS a, coalesce(b, '') AS b FROM steps UNION ALL SELECT p.g, p.i, 1000 + lev, coalesce(a, ''), coalesce(b, '') FROM p JOIN above USING (g)),
ways AS (SELECT g, i, list({{'a': a, 'b': b}} ORDER BY lev) AS w FROM path GROUP BY g, i),
found AS (SELECT p.*, coalesce(w, []) AS w FROM p LEFT JOIN ways USING (g, i)),
fold AS (SELECT doc_id, h AS leaf, g, w, o AS f, 1 AS k FROM found UNION ALL SELECT doc_id, leaf, g, w, sha256(w[k].a || f || w[k].b), k + 1 FROM fold WHERE k <= len(w))
SELECT doc_id, leaf, r.h AS subroot, top.h AS root, sha256(array_to_string(list_transform(w, lambda x: x.a || x.b), '')) AS proof_sha256, f AS folded_root, f = top.h AS verified
FROM fold JOIN r USING (g), top WHERE k > len(w)"""


def _lloyd(k: int, rounds: int, dim: int) -> str:
    steps = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = """ + str(dim) + """ AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = """ + str(dim) + ")",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k})"]
    gap = "list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.x, min({{'d': CAST({gap} AS BIGINT), 'c': m.c}}) AS m FROM v, c{r} m GROUP BY ALL)")
        if r < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(f.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT c, list({mean} ORDER BY j) AS x FROM
(SELECT m.c AS c, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(j) GROUP BY ALL) GROUP BY c) f ON f.c = o.c)""")
    return f"""WITH {', '.join(steps)} SELECT vec_id, CAST(m.c AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} f ON f.c = a{rounds}.m.c"""


ORACLE_SQL["op13_centroid_clusters"] = _lloyd(40, 5, 64)
