"""Phrases, packing and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import codes, packing, phrases

DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---------------------------------------------------------------- phrases

def brute_phrases(rows, support=10, first=2000):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        got = []
        for p, a in f.items():
            if len(p) == 1 or a < support:
                continue
            if len(p) == 2 and any(len(q) == 3 and f[q] >= support and p in (q[:2], q[1:]) and 100 * f[q] >= 50 * a for q in f):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(got)[:first], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "new", "york", "city", "é", "ß", "x" * 70, "en", "de"]  # two are names of languages
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.randint(0, 12)):
            text.append(" ".join(rng.choices(words, k=rng.randint(1, 6))))
            if rng.random() < 0.4:
                text.append("new york  city")
        rows.append((i, rng.choice([". ", ", ", "\n", " \t", "!?"]).join(text), rng.choice(["en", "de", None, "und"])))
    return [*rows, (1, None, "en"), (None, "", "fr"), (2, " .,;", "es"), *[(7, "new york city of the a", "en")] * 30]


@pytest.mark.parametrize("parts", [1, 6])
def test_phrases_equal_brute_force(spark, parts):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = sorted(tuple(r) for r in phrases.collocations(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(rows) and len(got) > 40


def test_phrases_of_small_slices_ties_names_and_nothing(spark, monkeypatch):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 12)
    rows = [(i, f"b{i % 7} c. c b{i % 7}", "en") for i in range(140)]
    df = spark.createDataFrame([(*r, 1, 2.0, "s") for r in rows], DOCS + ", `a` int, `phrase` double, `_at` string")
    got = sorted(tuple(r) for r in phrases.collocations(df, first=9).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(rows, first=9) and [g[2] for g in got][:2] == ["b0 c", "b1 c"]


def test_words_are_the_same_whatever_the_chunk(monkeypatch):
    text = ["one two, three\tfour", "", "x" * 300 + " y", "é ü. a b c d e f g", "tail"]
    data, offsets = phrases.utf8(pa.array(text))
    langs = np.arange(5, dtype=np.uint64)
    whole = phrases.cut_words(data, offsets, langs)
    for size in (1, 5, 17):
        monkeypatch.setattr(phrases, "CHUNK", size)
        assert all((a == b).all() for a, b in zip(whole, phrases.cut_words(data, offsets, langs)))
    assert whole[3].tolist()[:4] == [False, True, False, True]


def test_lines_end_with_pieces_and_lose_no_phrase(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 1

    monkeypatch.setattr(phrases, "TaskContext", Task)
    rng = random.Random(2)
    texts = [". ".join(" ".join(rng.choices("abcdefg", k=rng.randint(0, 30))) for _ in range(20)) for _ in range(30)] + [None, "", "a " * 400]
    batch = pa.RecordBatch.from_arrays([pa.array([("x", "y")[i % 2] for i in range(len(texts))]), pa.array(texts)], ["lang", "text"])

    def counted(lines):
        monkeypatch.setattr(phrases, "LINE", lines)
        got, words = Counter(), Counter()
        for b in phrases._tokens(iter([batch])):
            for lang, shard, n, line in zip(*(c.to_pylist() for c in b.columns)):
                line = np.frombuffer(line, np.uint64)
                words[lang] += n
                assert shard == 1 and n == (line > 0).sum() and (lines > 1000 or len(line) < lines + 450)
                for x in (line, *phrases.grams(line)):
                    got.update(x[x > 0].tolist())
        return got, words

    assert counted(1 << 15) == counted(16) == counted(1)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 123_456_789_012_345, 523_456_789_012_347, 999_999_999_999_989
    rows = [("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, k long, a long")).first()
    assert got.score == 1_000_000 * a * a // (left * right)


# ---------------------------------------------------------------- packing

@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer(open(packing.default_tokenizer()).read())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbB'ıİIßÅåé̈̇́ẞ \u0085 \u001c\t\n\x0b.,;:!?<|>endoftext09٣ñ’“_-|\u0000😀ﬁΣσς", max_size=60))
def test_tokens_by_words_are_the_vocabularys(tokenizer, text):
    for t in (text, text + " <|endoftext|>" + text, "don't " + text):
        want = tokenizer.model.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(next(iter(tokenizer.encode([t.encode()]))), "<u4").tolist() == want


def test_best_fit_takes_the_fullest_bin():
    leader, place, fill = packing.best_fit(np.array([6, 5, 4, 3, 1, 1]), 10)
    assert leader.tolist() == [0, 1, 0, 1, 1, 1] and place.tolist() == [0, 0, 6, 5, 8, 9] and fill.tolist() == [10] * 6
    leader, _, fill = packing.best_fit(np.array([7, 7, 7]), 10)
    assert leader.tolist() == [0, 1, 2] and fill.tolist() == [7, 7, 7]


def packed_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS + ", length int, `_llm_key` string, ids string")
    got = packing.pack(packing.token_pieces(df, limit=64), 64, **options)
    return [r.asDict() for r in got.collect()], got


@pytest.mark.parametrize("options", [{}, {"per_task": 16, "fan": 2}, {"per_task": 8, "fan": 3, "carry": 2}, {"per_task": 8, "slack": 0}])
def test_packing_keeps_every_token_in_place(spark, tokenizer, options):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gamma!", "12", "naïve", "<|endoftext|>"], k=rng.choice([1, 3, 9, 20, 70, 300]))) for _ in range(250)]
    rows = [(i, t, "en", 1, "k", "x") for i, t in enumerate(texts)] + [(900, None, None, 1, "k", "x"), (901, "", "", 1, "k", "x"), (None, "a b", "", 1, "k", "x"), (7, "same", "", 1, "k", "x"), (7, "same", "", 1, "k", "x")]
    got, df = packed_rows(spark, rows, **options)
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids"]))
        assert len(r["ids"]) == 4 * r["length"] and 1 <= r["length"] <= 64
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    for i, text, *_ in rows:
        want = tokenizer.model.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i])
        if i == 7 and text == "same":
            continue
        if i != 7:
            assert b"".join(bytes(p[3]) for p in pieces) == np.array(want, "<u4").tobytes()
            assert [p[0] for p in pieces] == list(range(len(pieces))) and all(p[1] == 64 * p[0] for p in pieces)
    assert len(by_doc[7]) == 2 + -(-(len(tokenizer.model.encode(texts[7], add_special_tokens=False).ids) + 1) // 64)
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 64) * (1.1 if not options else 1.5) + 2
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(df).collect()}
    assert sum(len(x) for x in whole.values()) == 4 * total and set(whole) == set(bins)


def test_packing_of_items_that_do_not_fit_together(spark):
    items = spark.range(3000).selectExpr("id AS key", "cast(33 AS long) AS length")
    got = packing.assign(items, 64, per_task=100, fan=4, carry=10).collect()
    assert len({r.sequence_id for r in got}) == len(got) == 3000


def test_packing_digest_long_text_and_nothing(spark, tokenizer):
    assert packing.packed_digest(spark.createDataFrame([], DOCS)).collect() == []
    long = ("Lorem ipsum, dolor! " * 90_000) + "y" * 5000  # several segments and a long word
    got = packing.packed_digest(spark.createDataFrame([(1, long, None), (2, "short", None)], DOCS)).orderBy("doc_id", "piece").collect()
    want = np.array(tokenizer.model.encode(long, add_special_tokens=False).ids + [1], "<u4")
    mine = [r for r in got if r.doc_id == 1]
    assert [r.length for r in mine] == [4096] * (len(want) // 4096) + ([len(want) % 4096] if len(want) % 4096 else [])
    assert [r.ids_crc32 for r in mine] == [zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in mine]
    assert len({r.sequence_id for r in got}) == len(mine)


# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<double>, label int, code string"


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max([len(r[1]) for r in kept], default=0) // parts) * parts
    each = width // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(Fraction(x) * 1024) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    books = [[v[p * each : (p + 1) * each] for v in ints[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p * each : (p + 1) * each], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in ints]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for c in range(len(books[p])):
                mine = [v[p * each : (p + 1) * each] for v, g in zip(ints, got) if g[p][1] == c]
                if mine:
                    books[p][c] = [sum(x) // len(mine) for x in zip(*mine)]
    out, labels = [], Counter()
    for r, g in zip(kept, assign()):
        out.append((r[0], "".join(f"{i:02x}" for _, i in g), sum(d for d, _ in g), r[2]))
        labels[r[2]] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = (1 << 63) - 1
    return sorted(((i, c, min(e, top), min(labels[lab], top), sha) for i, c, e, lab in out), key=str)


def vector_rows(n, size, seed, spread=0.2):
    g = np.random.default_rng(seed)
    centres = g.normal(0, 1, (12, size))
    return [(i, [float(x) for x in centres[i % 12] + g.normal(0, spread, size)], None if i % 5 == 0 else i % 3, "z") for i in range(n)]


def check_codes(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = codes.code_digest(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_codes(rows)


def test_codes_equal_brute_force(spark):
    rows = vector_rows(420, 16, 1)
    odd = [(500, None, 1, "z"), (501, [1.0, None] * 8, 1, "z"), (502, [math.nan] * 16, 1, "z"), (503, [math.inf] + [0.0] * 15, 1, "z"),
           (None, [0.5] * 16, None, "z"), (3, rows[3][1], 2, "z"), (504, [0.25] * 5, 9, "z"), (505, [], 9, "z"), (506, [-0.0] * 16, 9, "z")]
    check_codes(spark, rows + odd)


def test_codes_of_few_equal_huge_and_no_vectors(spark):
    check_codes(spark, [(i, [0.125 * (i % 3)] * 8, i % 2, "z") for i in range(40)])
    check_codes(spark, [(i, [1e300 * (i - 3), 2.0**70, -1e18 * i, 1e-300], 0, "z") for i in range(9)])
    check_codes(spark, [(i, [3e6 * (i % 11), -2e6, 0.5, 7e6 + i], 0, "z") for i in range(300)])
    check_codes(spark, [(1, [], 0, "z"), (2, [], 0, "z")])
    assert codes.code_digest(spark.createDataFrame([], VECTORS)).collect() == []
    assert codes.code_digest(spark.createDataFrame([(1, None, 1, "z")], VECTORS)).collect() == []


@pytest.mark.parametrize("remembered", [0, 5, 1 << 16])
@pytest.mark.parametrize("spread", [1, 40, 3000])
def test_cells_give_the_nearest_entry(monkeypatch, remembered, spread):
    monkeypatch.setattr(codes, "REMEMBERED", remembered)
    monkeypatch.setattr(codes, "NEW_CELLS", 7)
    g = np.random.default_rng(spread)
    entries = np.floor(g.normal(0, 100, (60, 5)))
    entries[7] = entries[3]
    book = codes.PartBook(entries)
    for _ in range(3):
        x = np.floor(g.normal(0, spread, (200, 5)))
        x[:20] = entries[:20]
        code, error = book.nearest(x)
        square = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert code.tolist() == square.argmin(1).tolist() and error.tolist() == square.min(1).tolist()
    if remembered > 5:
        assert min(len(k) for k in book.cells.values()) < 60 or spread == 3000


def test_decoded_vectors_have_the_stated_error(spark):
    rows = vector_rows(300, 8, 3)
    kept = codes.settled(codes.kept_vectors(spark.createDataFrame(rows, VECTORS).select("vec_id", "embedding")), "v")
    books, width = codes.codebooks(kept)
    coded = codes.encode(kept, books, width)
    for r in codes.decode(coded, books).collect():
        ints = np.floor(np.array(rows[r.vec_id][1]) * 1024)
        assert r.error == ((ints - np.array(r.decoded) * 1024) ** 2).sum()
