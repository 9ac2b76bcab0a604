"""License scans by diagonal voting.

Rolling hashes of word k-grams of whole texts are matched with the positions of the
same grams in license templates.  A match of document position p with template
position t votes for diagonal p - t.  Votes are summed per (document, template,
diagonal), neighbouring diagonals (inserted or dropped words) are merged, and a
merged span counts when the template words it covers reach a share.  Base phrases
are templates too, but must match whole, on one diagonal.

Grams outside all templates cannot join, so the scan drops them on the spot: the
template table is a constant of this module, a few hundred hashes.

Defined results: null and empty texts have no words and no labels; each row is
scanned by itself, so equal ids or texts do not mix; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled
from .words import LETTERS, Words, slices

# Phrases and labels of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public notice texts of common licenses, with their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
PHRASE_K, NOTICE_K = 2, 3
SHIFT = 3      # diagonals at most so far apart are one span
SHARE = 0.6    # of a notice's words that a span must cover


def templates(phrases=PHRASES, notices=NOTICES) -> pd.DataFrame:
    """One row per gram of each template: template, label, base, words, k, at, gram, phrase."""
    rows = []
    texts = [(t, lab, True, PHRASE_K) for t, lab in phrases] + [(t, lab, False, NOTICE_K) for t, lab in notices]
    for n, (text, label, base, k) in enumerate(texts):
        w = Words(pa.array([text]), LETTERS)
        parts = text.split()
        grams, at = w.grams(k)
        rows += [(n, label, base, len(parts), k, int(i), int(g.astype(np.int64)), " ".join(parts[i : i + k])) for g, i in zip(grams, at)]
    return pd.DataFrame(rows, columns=["template", "label", "base", "words", "k", "at", "gram", "phrase"])


HIT = pa.struct([("k", pa.int32()), ("pos", pa.int64()), ("gram", pa.int64()), ("phrase", pa.string())])


def _hits(known: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 4 << 20):
            words = Words(batch.column(2), LETTERS, keep_spans=True)
            found: list[list] = [[] for _ in range(words.n)]
            for k, table in known.items():
                grams, at = words.grams(k)
                slot = np.minimum(np.searchsorted(table, grams), len(table) - 1)
                for j in np.flatnonzero(table[slot] == grams):
                    i = int(at[j])
                    d = int(words.doc[i])
                    found[d].append({"k": k, "pos": i - int(words.offset[d]), "gram": int(grams[j].astype(np.int64)), "phrase": " ".join(words.word(i + x) for x in range(k))})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.count), pa.array(found, pa.list_(HIT))], ["doc_id", "_rid", "n_words", "_hits"])

    return run


def spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, shift: int = SHIFT, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """The documents (_rid, doc_id, n_words) and the verified spans: _rid, label, base, first, last, score."""
    spark: SparkSession = docs.sparkSession
    table = templates(phrases, notices)
    known = {int(k): np.sort(part["gram"].to_numpy().astype(np.uint64)) for k, part in table.groupby("k")}
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_rid"), "text")
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, _rid long, n_words long, _hits array<struct<k int, pos long, gram long, phrase string>>"
    base = settled(rows.mapInArrow(_hits(known), shape), "license-hits")

    places = F.broadcast(spark.createDataFrame(table))  # a constant of this module
    hits = base.select("_rid", F.explode("_hits").alias("h")).select("_rid", "h.*")
    votes = hits.join(places, ["k", "gram"]).where(hits["phrase"] == places["phrase"])  # the words themselves verify the hash
    votes = votes.select("_rid", "template", "label", "base", "words", "k", "at", "pos", (F.col("pos") - F.col("at")).alias("diag"))
    by_diag = votes.groupBy("_rid", "template", "label", "base", "words", "k", "diag").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))

    whole = by_diag.where(F.col("base") & (F.size("ats") == F.col("words") - F.col("k") + 1))
    exact = whole.select("_rid", "label", "base", F.col("diag").alias("first"), (F.col("diag") + F.col("words") - 1).alias("last"), F.lit(1.0).alias("score"))

    line = Window.partitionBy("_rid", "template").orderBy("diag")
    step = F.when(F.col("diag") - F.lag("diag").over(line) <= shift, 0).otherwise(1)
    merged = by_diag.where(~F.col("base")).withColumn("_new", step).withColumn("_island", F.sum("_new").over(line))
    grouped = merged.groupBy("_rid", "template", "label", "words", "k", "_island").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), (F.max("last") + F.max("k") - 1).alias("last"))  # ats: at most the template's grams
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    loose = grouped.withColumn("score", covered / F.col("words")).where((F.col("score") >= share) & (F.col("last") - F.col("first") + 1 <= 2 * F.col("words")))
    return base.select("_rid", "doc_id", "n_words"), exact.unionByName(loose.select("_rid", "label", F.lit(False).alias("base"), "first", "last", "score"))


def license_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: words, base places with their first and last start, labels and the best score."""
    rows, found = spans(docs, **options)
    is_base = F.col("base")
    line = lambda labels: F.array_join(F.array_sort(labels), ",")
    per = found.groupBy("_rid").agg(
        F.count_if(is_base).alias("n_base"), F.min(F.when(is_base, F.col("first"))).alias("first_word"), F.max(F.when(is_base, F.col("first"))).alias("last_word"),
        line(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"), line(F.collect_set("label")).alias("labels"), F.max("score").alias("score"))
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    got = rows.join(per, "_rid", "left").fillna(none)
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.least(F.col("score"), F.lit(1.0)).alias("score"))


def _values() -> str:
    table = templates()
    return ", ".join(f"({r.template}, '{r.label}', {str(r.base).lower()}, {r.words}, {r.k}, {r.at}, '{r.phrase}')" for r in table.itertuples())


def license_sql() -> str:
    """The same result in DuckDB: word lists, their grams, diagonals, islands."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t(template, label, base, words, k, pos, phrase) AS (VALUES {_values()}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT rid, i - 1 AS place, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM p, (VALUES ({PHRASE_K}), ({NOTICE_K})) AS ks(k) WHERE i + k - 1 <= len(w)),
votes AS (SELECT g.rid, t.template, t.label, t.base, t.words, t.k, t.pos, g.place, g.place - t.pos AS diag FROM grams g JOIN t ON g.phrase = t.phrase AND g.k = t.k),
bydiag AS (SELECT rid, template, label, base, words, k, diag, count(DISTINCT pos) AS n, min(place) AS first, max(place) AS last FROM votes GROUP BY ALL),
exact AS (SELECT rid, label, true AS base, diag AS first, 1.0::DOUBLE AS score FROM bydiag WHERE base AND n = words - k + 1),
steps AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, template ORDER BY diag) <= {SHIFT} THEN 0 ELSE 1 END AS new FROM bydiag WHERE NOT base),
isles AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diag ROWS UNBOUNDED PRECEDING) AS island FROM steps),
bounds AS (SELECT rid, template, label, words, k, island, min(first) AS first, max(last) + max(k) - 1 AS last FROM isles GROUP BY ALL),
cover AS (SELECT i.rid, i.template, i.island, count(DISTINCT v.pos + s.o) AS covered FROM isles i JOIN votes v ON v.rid = i.rid AND v.template = i.template AND v.diag = i.diag
    CROSS JOIN (SELECT unnest(range({NOTICE_K})) AS o) s GROUP BY ALL),
loose AS (SELECT b.rid, b.label, false AS base, b.first, c.covered / b.words::DOUBLE AS score FROM bounds b JOIN cover c USING (rid, template, island)
    WHERE c.covered / b.words::DOUBLE >= {SHARE} AND b.last - b.first + 1 <= 2 * b.words),
allspans AS (SELECT * FROM exact UNION ALL SELECT * FROM loose),
per AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label)), ','), '') AS labels, max(score) AS score FROM allspans GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, least(coalesce(score, 0.0), 1.0)::DOUBLE AS score FROM d LEFT JOIN per USING (rid)
"""
