"""5. License scans: phrase places and an exact set-similarity join of text
blocks with license templates, with DataFrame functions only.

A text meets a template where a window of its words, line breaks or not, holds
at least ``threshold`` of the template's distinct words.  A window is as long as
the template divided by the threshold, so a notice may be wrapped and hold some
further words, but words scattered over a long line do not add up.  Blocks are
runs of twice the longest window, one beginning at each multiple of it: every
window lies whole in the block in whose first half it begins.  Blocks are joined
with templates, and of pairs that share enough words all windows are counted.

The words of all templates
are ranked by how many documents hold them, rarest first, over the whole
table.  With o words needed of a template T, a block that holds them shares one
of the first |T| - o + 1 words of T, and of its own first |B| - o + 1 words
(prefix filter); it has o template words at least (length filter); and at the
first shared word enough words must remain on both sides (positional filter).
Prefix words meet in an equi-join, and pairs that pass are counted exactly.

Joined are only words of some template: others cannot add to an overlap.
The template table and the ranks are bounded by the templates, a parameter;
they are the only things broadcast or brought to the driver.

Null text: empty.  No match: empty labels, score 0.  Repeated rows are
scanned one by one; a word repeated within a block counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Shares that copies of one text are dealt to.
SALTS = 16

#: The contract's [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ said positively: the
#: JVM's regex engine is some twenty times slower with the negated ranges.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels: fixed values of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices looked for: (label, notice).
TEMPLATES = [
    ("notice:agpl-3.0", "This program is licensed under the GNU Affero General Public License version 3"),
    ("notice:apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("notice:bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("notice:cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("notice:cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("notice:cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("notice:gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("notice:isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("notice:mit", "Released under the MIT License"),
    ("notice:mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("notice:mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("notice:reserved", "Copyright, all rights reserved"),
    ("notice:unlicense", "This is free and unencumbered software released into the public domain"),
]


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else.  lower() is quicker and differs only
    beyond ASCII, so it serves texts of ASCII letters alone."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, templates, threshold: float) -> DataFrame:
    """(label, tokens, needed, length) with distinct words of each notice and
    the number of words of its windows."""
    t = spark.createDataFrame(list(templates), "label string, notice string")
    t = t.select("label", words(lowered(F.col("notice"))).alias("all")).where("size(all) > 0").withColumn("tokens", F.array_distinct("all"))
    needed, length = F.size("tokens") * F.lit(float(threshold)) - 1e-9, F.size("all") / F.lit(float(threshold)) - 1e-9
    return t.select("label", "tokens", F.ceil(needed).cast("int").alias("needed"), F.ceil(length).cast("int").alias("length"))


def literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def places(w: Column, phrase: str) -> Column:
    """Starts (from 0) of the phrase's words in the array of words."""
    parts = phrase.split()
    holds = lambda k: lambda i: F.get(w, i + k) == parts[k]
    first = F.sequence(F.lit(0), F.size(w) - 1)
    for k in range(len(parts)):
        first = F.filter(first, holds(k))
    here = F.array_contains(w, parts[-1]) & F.array_contains(w, parts[0])
    return F.when(here, first).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict = PHRASES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, base_places (array of label,
    start), base_labels and notices (array of label, block, containment: of
    the best window that begins in the block's first half).  A notice at the
    border of two halves may be listed for both."""
    spark = docs.sparkSession
    made = (text, "n_words", "base_places", "base_labels", "notices")
    # The caller's columns travel as one, so none can clash with ours.
    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made]).alias("_doc")
    low = docs.select(keep, lowered(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_t"))
    tt = template_table(spark, templates, threshold)
    listed = tt.collect()  # bounded by the templates
    vocabulary = sorted({w for r in listed for w in r["tokens"]})
    # Global order: document counts over the whole table, rarest first.
    held = low.select(F.explode(F.array_intersect(literal(vocabulary), words(F.col("_t")))).alias("w"))
    count = {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}  # at most the vocabulary
    ranked = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    prefixes, whole = [], []
    for r in listed:
        tokens = sorted(r["tokens"], key=rank.__getitem__)
        whole.append((r["label"], tokens, r["length"]))
        prefixes += [(t, r["label"], i, len(tokens), r["needed"]) for i, t in enumerate(tokens[: len(tokens) - r["needed"] + 1])]
    rare = sorted({p[0] for p in prefixes})
    least = min((p[4] for p in prefixes), default=1)
    reach = max((x[2] for x in whole), default=1)

    d = low.select("_doc", "_t", words(F.col("_t")).alias("_w"))
    w = F.col("_w")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(reach)), lambda i: F.slice(w, i + 1, 2 * reach))
    blocks = F.filter(
        F.transform(runs, lambda r, i: F.struct(i.alias("block"), r.alias("words"), F.array_intersect(literal(ranked), r).alias("tokens"))),
        lambda b: (F.size(b["tokens"]) >= least) & F.arrays_overlap(b["tokens"], literal(rare)),
    )
    tagged = lambda label: lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start"))
    found = F.concat(*[F.transform(places(w, p), tagged(label)) for p, label in phrases.items()])
    d = d.select(
        "_doc",
        F.sha2("_t", 256).alias("_h"),
        F.size(w).cast("long").alias("n_words"),
        found.alias("base_places"),
        F.when(F.arrays_overlap(w, literal(rare)), blocks).alias("_blocks") if rare else F.lit(None).cast("array<struct<block:int,words:array<string>,tokens:array<string>>>").alias("_blocks"),
    )
    d = cut(d, "license-blocks")

    b = d.where("size(_blocks) > 0").select("_h", F.explode("_blocks").alias("b")).select("_h", "b.block", "b.words", "b.tokens")
    b = b.distinct()  # copies of a text are one
    head = b.select("*", F.posexplode(F.slice("tokens", 1, F.size("tokens") - least + 1)).alias("j", "token"))
    p = spark.createDataFrame(prefixes, "token string, label string, i int, size int, needed int")
    near = head.join(F.broadcast(p), "token").where((F.size("tokens") >= F.col("needed")) & (F.least(F.col("size") - F.col("i"), F.size("tokens") - F.col("j")) >= F.col("needed")))
    pairs = near.select("_h", "block", "words", "tokens", "label", "size", "needed").distinct()
    full = spark.createDataFrame(whole, "label string, of array<string>, length int")
    held = pairs.join(F.broadcast(full), "label").where(F.size(F.array_intersect("tokens", "of")) >= F.col("needed"))
    starts = F.sequence(F.lit(1), F.least(F.size("words"), F.lit(reach)))
    overlap = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("of", F.slice("words", i, F.col("length"))))))
    met = held.withColumn("overlap", overlap).where("overlap >= needed")
    notices = met.groupBy("_h").agg(F.sort_array(F.collect_list(F.struct("label", "block", (F.col("overlap") / F.col("size")).alias("containment")))).alias("notices"))
    # Only texts with a block can have a notice.  Copies of one text may be
    # many: its notices (a row per text) stand once for each salt.
    none = F.array().cast("array<struct<label:string,block:int,containment:double>>")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    notices = notices.select(F.col("_h").alias("_of"), "notices", salts.alias("_salt_of"))
    some = d.where("size(_blocks) > 0").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    some = some.join(notices, (F.col("_h") == F.col("_of")) & (F.col("_salt") == F.col("_salt_of")), "left")
    out = some.select("_doc", "n_words", "base_places", "notices").unionByName(
        d.where("_blocks IS NULL OR size(_blocks) <= 0").select("_doc", "n_words", "base_places", none.alias("notices"))
    )
    return out.select(
        "_doc.*",
        "n_words",
        "base_places",
        F.array_sort(F.array_distinct(F.transform("base_places", lambda x: x["label"]))).alias("base_labels"),
        F.coalesce("notices", none).alias("notices"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base_places", lambda x: x["start"])
    labels = F.array_sort(F.array_union("base_labels", F.transform("notices", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("notices", lambda x: x["containment"])), F.lit(0.0))
    return s.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base_places") > 0, 1.0).otherwise(best).alias("score"),
    )


def _oracle() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    phrase_rows = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    notice_rows = ", ".join("('{}', '{}')".format(label, n.replace("'", "''")) for label, n in TEMPLATES)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {low} AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d
), starts AS (
  SELECT rid, w, unnest(range(len(w))) AS i FROM w WHERE t LIKE '%license%' OR t LIKE '%cc%'
), base AS (
  SELECT rid, i, label FROM starts JOIN (VALUES {phrase_rows}) p(phrase, label, n) ON array_to_string(list_slice(w, i + 1, i + n), ' ') = phrase
), b AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY rid
), tt AS (
  SELECT label, regexp_extract_all(translate(notice, '{UPPER}', '{LOWER}'), '{word}') AS every FROM (VALUES {notice_rows}) n(label, notice)
), tw AS (
  SELECT label, unnest(list_distinct(every)) AS word, len(list_distinct(every)) AS size, ceil(len(list_distinct(every)) * 0.8 - 1e-9) AS needed,
    CAST(ceil(len(every) / 0.8 - 1e-9) AS BIGINT) AS length FROM tt
), occ AS (
  SELECT rid, label, i, word, size, needed, length FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) JOIN tw USING (word)
), windows AS (
  SELECT a.rid, a.label, a.i, a.size, a.needed, count(DISTINCT b.word) AS n
  FROM occ a JOIN occ b ON a.rid = b.rid AND a.label = b.label AND b.i BETWEEN a.i AND a.i + a.length - 1 GROUP BY ALL
), notices AS (
  SELECT rid, label, max(n) / any_value(size) AS c FROM windows WHERE n >= needed GROUP BY rid, label
), every AS (
  SELECT rid, label FROM base UNION SELECT rid, label FROM notices
), lists AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY rid
), base_lists AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT rid, label FROM base) GROUP BY rid
), best AS (
  SELECT rid, max(c) AS c FROM notices GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_lists.labels, '') AS base_labels, coalesce(lists.labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN base_lists USING (rid) LEFT JOIN lists USING (rid) LEFT JOIN best USING (rid)
"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES = {"op5_license_scan": _oracle()}
