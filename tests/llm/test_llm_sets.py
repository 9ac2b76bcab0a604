"""Exact duplicates, n-gram join, decontamination and licenses against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, exact, graph, jaccard, licenses
from tickloom.llm.words import LETTERS, NOT_SPACE, Words

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(WORD, (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(n, seed, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(50)] for _ in range(3)]
    rows = []
    for i in range(n):
        words = list(base[i % 3])
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


def test_words_agree_with_regular_expressions():
    texts = ["A b\tC", "", None, "  Ärger\x0bÜ\x1fx ", "x" * 200 + " y", "один два-три 4\n", "a\x85b"]
    w = Words(pa.array(texts), NOT_SPACE, keep_spans=True)
    got = [[w.word(i) for i in range(w.offset[d], w.offset[d + 1])] for d in range(len(texts))]
    assert got == [re.findall(WORD, (t or "").translate(LOWER)) for t in texts]
    v = Words(pa.array(texts), LETTERS, keep_spans=True)
    got = [[v.word(i) for i in range(v.offset[d], v.offset[d + 1])] for d in range(len(texts))]
    assert got == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for t in texts]
    assert len(np.unique(w.hash)) == len({x for t in texts for x in re.findall(WORD, (t or "").translate(LOWER))})


@pytest.mark.parametrize("seed,edits", [(1, 2), (2, 4)])
def test_ngram_join_matches_all_pairs(spark, seed, edits):
    rows = near_copies(60, seed, edits) + [(100, ""), (101, None), (102, "a b"), (103, "A  b"), (104, " \n"), (105, "a b c d e")]
    got = jaccard.component_digest(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(tuple, got.collect())) == components(rows)


def test_one_of_each_keeps_the_rest(spark):
    rows = [(3, "one two three four five six", "x"), (1, "one two three four five six", "y"), (1, "one two three four five six", "z"), (4, None, "n"), (5, "", "e"), (5, "", "e"), (None, "alone in here with five words", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `key.x` string").withColumn("key", F.lit(1))
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == [(False, 1, rows[0][1]), (False, 4, ""), (False, 5, ""), (False, 5, ""), (True, 0, rows[-1][1])]


def test_one_of_each_tells_components_apart_whatever_their_ids(spark):
    base = [f"w{i}" for i in range(50)]
    near = " ".join([*base, "tail"])
    rows = [(None, "first text of no known id"), (None, "second text without any id"), (None, "second text without any id"), (7, "one thing said under seven"), (7, "another thing said under seven too"),
            (None, " ".join(base)), (None, near), (8, " ".join(["x", *base])), (8, near)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    apart = sorted((r.doc_id or 0, r.text) for r in kept if "w1 " not in r.text)
    assert apart == sorted((d or 0, t) for d, t in {r for r in rows if "w1 " not in r[1]})
    assert [r.doc_id for r in kept if "w1 " in r.text] == [8]


def test_ngram_join_of_an_empty_table(spark):
    assert jaccard.component_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("digest", [16, 1])
def test_exact_groups(spark, digest):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(9000))
    rows = [(5, long), (2, long.replace(" ", " \n\t", 7)), (9, long + "x"), (1, None), (0, ""), (7, " "), (8, "\n\n"), (3, "same"), (3, "same"), (None, "same")] + [(100 + i, f"text {i % 50} " * 40) for i in range(120)]
    got = exact.exact_groups(spark.createDataFrame(rows, DOCS).repartition(3), digest=digest).collect()
    norm = {}
    for d, t in rows:
        norm.setdefault(re.sub(SPACE, " ", t or ""), []).append(d)
    want = sorted(((d is None, d or 0), min(x for x in ids if x is not None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in norm.items() for d in ids)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(norm) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_equal_texts_are_cut_alike_wherever_they_stand():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    got = list(exact.chunks(pa.array([text, "before " * 9, text, "a" * 50_000])))
    assert got[0] == got[2] and len(got[0][1]) > 5
    assert all(b"".join(c) == t for t, c in got) and max(len(c) for _, cs in got for c in cs) <= exact.LONGEST


def brute_tiles(item, doc, least):
    free_i, free_d, out = [True] * len(item), [True] * len(doc), 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_i[i + k] and free_d[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if all(free_i[i : i + best]) and all(free_d[j : j + best]):
                free_i[i : i + best] = free_d[j : j + best] = [False] * best
                out += best


@pytest.mark.parametrize("seed", range(4))
def test_tiles_cover_what_greedy_tiling_covers(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(0, 6, 40).astype(np.uint64)
    doc = np.concatenate([item[20:], rng.integers(0, 6, 30).astype(np.uint64), item[:20]])
    got = decontaminate.tiles(item, doc)
    assert sum(t[2] for t in got) == brute_tiles(item.tolist(), doc.tolist(), 5)
    assert all((item[i : i + n] == doc[j : j + n]).all() and n >= 5 for i, j, n in got)


def test_reordered_passages_are_found_and_clean_documents_stay(spark):
    words = [f"q{i}" for i in range(30)]
    item = " ".join(words)
    reordered = "Intro text. " + " ".join(words[18:]).upper() + " -- and -- " + " ".join(words[:18])
    rows = [(1, reordered), (2, " ".join(words[:12])), (3, None), (4, ""), (5, "nothing of it"), (6, item), (6, item), (None, item)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(70, item), (71, "too short"), (72, None)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.item_words, r.covered_words) for r in got) == [(0, 70, 30, 30), (1, 70, 30, 30), (6, 70, 30, 30), (6, 70, 30, 30)]
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_blocks_of_a_large_benchmark_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    bench = [(i, " ".join(f"b{rng.randrange(500)}" for _ in range(20))) for i in range(30)]
    docs = [(i, f"before {bench[i % 30][1]} after" if i % 3 else "clean words only here today") for i in range(60)]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(a, b).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, decontaminate.contaminated(a, b).collect())) == whole and len(whole) >= 40


def test_license_places(spark):
    rows = [(1, "Released under the MIT License."), (2, "mit-license MIT  license; mit license"), (3, None), (4, ""), (5, "General public, license! general public"),
            (6, "you may not use this big file except in compliance with the license. You may obtain one copy of the license at"), (7, "permit license mitlicense"), (1, "apache license")]
    got = {(r.doc_id, r.n_words): r for r in licenses.license_digest(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_words int")).collect()}
    assert len(got) == len(rows)
    assert tuple(got[1, 5]) == (1, 5, 1, 3, 3, "mit", "mit", 1.0)
    assert tuple(got[2, 6]) == (2, 6, 3, 0, 4, "mit", "mit", 1.0)
    assert tuple(got[5, 5])[:7] == (5, 5, 1, 0, 0, "gpl", "gpl")
    assert got[6, 22].n_base == 0 and got[6, 22].labels == "apache" and 0.6 <= got[6, 22].score < 1
    assert tuple(got[7, 3]) == (7, 3, 0, None, None, "", "", 0.0) and got[1, 2].labels == "apache"
    assert got[3, 0].score == 0 and licenses.license_digest(spark.createDataFrame([], DOCS)).count() == 0
