"""Fingerprints of whole texts by consistent weighted sampling.

A text is a weighted set: the strings between its white space, and of each of them every run of RUN code points, each with its
number of occurrences. So a long string (a text in a writing without blanks, say) shares most terms with one that differs in a few
signs, and the rule is the same for all. For each of
SAMPLES samples and each term, hashes of both give r and c from the gamma law (2, 1) and b from the uniform
law; with the weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1), and the term with the
least a, together with its t, is the sample. Two texts agree in a sample as often as their generalised Jaccard
similarity says. All of it is DataFrame functions; a text's terms are counted and sampled where the text's
row lies, without a further exchange.

``near`` of two fingerprints is the share of samples that agree. A null text counts as empty; a text without
terms has the fingerprint of no samples, near 1 to another such and near 0 to the rest. Rows that repeat an id
are rows of their own, in the order of their texts' hashes; rows with the same id and text follow each other,
are worked out once and differ only in the last one's next document. A null id comes last. A table of one
document has itself as the next one. An empty table gives no rows; extra columns are ignored. Very long texts
are one row until their terms are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import stored

#: Samples are made AT_ONCE in a row, which keeps the generated code small enough to be compiled.
SAMPLES, AT_ONCE = 32, 4
#: Code points. Long strings are cut in pieces that overlap, so that no run is lost.
RUN, PIECE = 16, 1000
#: White space, and what is none.
BLANKS, SIGN = r"[ \t-\r]+", r"[^ \t-\r]"


#: A row is known by the hash of its id and that of its id and text: 128 bits. All joins go by both, so a text's rows stay where they are.
KEY = ["k", "x"]


def neighbours(groups: DataFrame) -> DataFrame:
    """``groups``: (k, x, id, m, n), a row for each id and text, which ``m`` rows have. Adds ``next`` (k, x) in
    descending order of id, ``before`` (k, x) and ``before_n`` of the group whose next one this is; the last
    one's next is the first. Groups are sorted in ranges; only the ranges' ends are looked at together."""
    order = [F.desc_nulls_last("id"), F.asc("x")]
    parts = stored(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    me = F.struct(*KEY, "n")
    placed = parts.select("*", F.lead(me).over(inside).alias("down"), F.lag(me).over(inside).alias("up"))
    ends = placed.groupBy("part").agg(F.max(F.when(F.col("up").isNull(), me)).alias("first"), F.max(F.when(F.col("down").isNull(), me)).alias("last"))
    line = Window.orderBy("part")
    whole = Window.partitionBy()
    ends = ends.select("part", F.coalesce(F.lead("first").over(line), F.min_by("first", "part").over(whole)).alias("after"), F.coalesce(F.lag("last").over(line), F.max_by("last", "part").over(whole)).alias("ahead"))
    down, up = F.coalesce("down", "after"), F.coalesce("up", "ahead")
    found = placed.join(F.broadcast(ends), "part")
    return found.select(*KEY, "id", "m", down["k"].alias("next_k"), down["x"].alias("next_x"), up["k"].alias("before_k"), up["x"].alias("before_x"), up["n"].alias("before_n"))


def sampled(terms: DataFrame) -> DataFrame:
    """``terms``: (k, x, twin, h, g, ln_own, ln_other), a row for each term and group g of AT_ONCE samples. Adds, for
    each sample j and weight, ``own_j`` and ``other_j``: 40 bits of ln a, then 23 of term and t; the least of
    a text is its sample. Each step is a projection of its own, so that what it makes is made once."""
    each, sides = range(AT_ONCE), ("own", "other")
    hashed = terms.select("*", *(F.expr(f"xxhash64(h, g * {AT_ONCE} + {j}, {salt})").alias(f"{n}{j}") for j in each for n, salt in (("u", 1), ("v", 2))))
    drawn = []
    for j in each:
        drawn.append(F.expr(f"-ln((((u{j} & 2097151) + 0.5D) / 2097152) * (((shiftrightunsigned(u{j}, 21) & 2097151) + 0.5D) / 2097152))").alias(f"r{j}"))
        drawn.append(F.expr(f"(shiftrightunsigned(u{j}, 42) + 0.5D) / 4194304").alias(f"b{j}"))
        drawn.append(F.expr(f"ln(-ln(((shiftrightunsigned(v{j}, 32) + 0.5D) / 4294967296D) * (((v{j} & 4294967295) + 0.5D) / 4294967296D)))").alias(f"c{j}"))
    ready = hashed.select(*KEY, "twin", "h", "g", "ln_own", "ln_other", *drawn)
    stepped = ready.select("*", *(F.expr(f"floor(ln_{w} / r{j} + b{j})").alias(f"t{j}_{w}") for j in each for w in sides))
    value = "shiftleft(CAST((c{j} - r{j} * (t{j}_{w} - b{j} + 1) + 100) * 8589934592D AS BIGINT), 23) | ((h ^ shiftleft(t{j}_{w}, 3)) & 8388607)"
    return stepped.select(*KEY, "twin", "g", *(F.expr(value.format(j=j, w=w)).alias(f"{w}_{j}") for j in each for w in sides))


def terms_of(bodies: DataFrame) -> DataFrame:
    """``bodies``: (..., body). The other columns and ``term``, a row for each occurrence. Pieces of long strings
    stand beside the strings with a blank before them, until they are taken apart into runs."""
    keys = [c for c in bodies.columns if c != "body"]
    pieces = F.regexp_extract_all("body", F.lit(f"(?=({SIGN}{{{RUN},{PIECE + RUN - 1}}})){SIGN}{{1,{PIECE}}}"), F.lit(1))
    parts = bodies.select(*keys, F.explode(F.concat(F.split("body", BLANKS), F.transform(pieces, lambda p: F.concat(F.lit(" "), p)))).alias("part")).where("part != ''")
    runs = F.regexp_extract_all(F.expr("substring(part, 2)"), F.lit(f"(?s)(?=(.{{{RUN}}}))."), F.lit(1))
    return parts.select(*keys, F.explode(F.when(F.startswith("part", F.lit(" ")), runs).otherwise(F.array("part"))).alias("term"))


def samples(bodies: DataFrame) -> DataFrame:
    """``bodies``: (k, x, twin, side 0, 1 or 2 for both, body), a key's rows in one partition. Per key: ``own``, ``other`` and
    ``twin_other``, arrays of the samples of sides 0 and 1, and of side 1 of the twin, in order (empty where there
    is none); keys without any term are left out."""
    terms = terms_of(bodies).select(*KEY, "twin", F.xxhash64("term").alias("h"), "side")
    counted = terms.groupBy(*KEY, "twin", "h").agg(F.sum(F.expr("CAST(side != 1 AS BIGINT)")).alias("own"), F.sum(F.expr("CAST(side != 0 AS BIGINT)")).alias("other"))
    logs = counted.select(*KEY, "twin", "h", *(F.expr(f"CASE WHEN {w} > 0 THEN ln(CAST({w} AS DOUBLE)) END").alias(f"ln_{w}") for w in ("own", "other")))
    groups = logs.select("*", F.explode(F.array(*map(F.lit, range(SAMPLES // AT_ONCE)))).alias("g"))
    least = sampled(groups).groupBy(*KEY, "twin", "g").agg(*(F.min(f"{w}_{j}").alias(f"{w}_{j}") for j in range(AT_ONCE) for w in ("own", "other")))
    row = F.struct("g", *(F.array(*(f"{w}_{j}" for j in range(AT_ONCE))).alias(w) for w in ("own", "other")))
    rows = [F.array_sort(F.collect_list(F.when(F.col("twin") == twin, row))).alias(name) for name, twin in (("rows", False), ("twins", True))]
    of = lambda rows, w: F.flatten(F.transform(rows, lambda r: r[w]))
    return least.groupBy(*KEY).agg(*rows).select(*KEY, of("rows", "own").alias("own"), of("rows", "other").alias("other"), of("twins", "other").alias("twin_other"))


def text_of(samples: Column) -> Column:
    """16 signs a sample; a text without terms has none."""
    return F.array_join(F.transform(F.filter(samples, lambda x: x.isNotNull()), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def near(a: Column, b: Column) -> Column:
    """The share of samples that agree; 16 signs of a fingerprint each, none of an empty one."""
    both = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    empty = lambda x: x.isNull() | x[0].isNull()
    return F.when(empty(a) & empty(b), 1.0).when(empty(a) | empty(b), 0.0).otherwise(F.aggregate(both, F.lit(0), lambda s, x: s + x) / F.lit(float(SAMPLES)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_chars`` long, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` strings,
    ``near_edited``, ``near_next`` doubles. The edited text has its last floor(n_chars / 3) code points
    replaced by the first as many of the next document, in descending order of id."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).select("id", "text", F.xxhash64("id").alias("k"), F.xxhash64("text", "id").alias("x"))
    groups = texts.groupBy(*KEY).agg(F.first("id").alias("id"), F.count("*").alias("m"), F.first(F.length("text")).alias("n"))
    order = stored(neighbours(groups))
    first = Window.partitionBy(*KEY).orderBy("x")
    once = texts.select(*KEY, "text").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    whole = once.join(order, KEY)
    heads = whole.select(F.col("before_k").alias("k"), F.col("before_x").alias("x"), F.expr("left(text, CAST(floor(before_n / 3) AS INT))").alias("head"))
    both = whole.select(*KEY, "id", "m", "next_k", "next_x", "text").join(heads, KEY)
    both = both.withColumn("n", F.length("text")).withColumn("third", F.expr("CAST(floor(n / 3) AS INT)"))
    # What both texts begin with, up to its last white space, is taken apart once.
    both = both.withColumn("same", F.regexp_extract(F.expr("left(text, n - third)"), r"(?s)^.*[ \t-\r]", 0)).withColumn("cut", F.length("same"))
    # Rows with one id and text have themselves as the next document but for the last one; theirs is the twin.
    body = lambda twin, side, text: F.struct(F.lit(twin).alias("twin"), F.lit(side).alias("side"), F.expr(text).alias("body"))
    last, again = "concat(left(text, n - third), head)", "concat(left(text, n - third), left(text, third))"
    each = F.array(body(False, 2, "same"), body(False, 0, "substring(text, cut + 1)"), body(False, 1, "concat(substring(text, cut + 1, n - third - cut), head)"))
    bodies = both.select(*KEY, F.explode(F.when(F.col("m") > 1, F.concat(each, F.array(body(True, 1, again)))).otherwise(each)).alias("b")).select(*KEY, "b.*")
    sha = lambda text: F.sha2(F.expr(text).cast("binary"), 256)
    facts = both.select(*KEY, "id", "m", "next_k", "next_x", F.col("n").cast("long").alias("n_chars"), sha(last).alias("sha"), F.when(F.col("m") > 1, sha(again)).alias("twin_sha"))
    signed = stored(facts.join(samples(bodies), KEY, "left"))
    found = signed.join(signed.select(F.col("k").alias("next_k"), F.col("x").alias("next_x"), F.col("own").alias("next")), ["next_k", "next_x"], "left")
    version = lambda times, sha, other, after: F.struct(times.alias("times"), F.col(sha).alias("sha"), F.col(other).alias("other"), F.col(after).alias("next"))
    one = F.lit(1).cast("long")
    versions = F.array(version(one, "sha", "other", "next"))
    versions = F.when(F.col("m") > 1, F.concat(versions, F.array(version(F.col("m") - 1, "twin_sha", "twin_other", "own")))).otherwise(versions)
    found = found.select("id", "n_chars", "own", F.explode(versions).alias("v")).select("id", "n_chars", "own", "v.*")
    text = lambda c: F.coalesce(text_of(F.col(c)), F.lit(""))
    rows = found.select(F.col("id").alias(id_col), "times", "n_chars", F.col("sha").alias("edited_sha256"), text("own").alias("fingerprint"), text("other").alias("edited_fingerprint"), near(F.col("own"), F.col("other")).alias("near_edited"), near(F.col("own"), F.col("next")).alias("near_next"))
    return rows.select(F.explode(F.sequence(one, "times")).alias("copy"), "*").drop("copy", "times")
