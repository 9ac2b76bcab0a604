"""The pipeline on a small corpus against the stages' definitions, one after the other."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from test_llm_rows import WORD, fill
from test_llm_sets import components
from tickloom.llm import mixing


def draw(doc_id, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    digest = hashlib.md5(f"{mixing.SEED}|{'' if doc_id is None else doc_id}|{inner}".encode()).hexdigest()
    return int(digest[:13], 16) / 2**52


def expected(rows, items):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    stays = {d for d, _, c in components([(r[0], r[1]) for r in rows]) if d == c}
    rows = [r for r in rows if r[0] in stays]
    rows = [r for r in rows if not any(i in r[1] for i in items)]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(WORD, r[1]))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = fill(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    out = Counter()
    for r in rows:
        rate = want[r[3]] / sizes[r[3]]
        out[r[0]] += int(rate) + (draw(r[0], r[1]) < rate - int(rate))
    return +out


def test_run_equals_the_definitions(spark, tmp_path):
    rng = random.Random(8)
    item = " ".join(f"b{i}x" for i in range(20))
    rows = []
    for i in range(120):
        text = " ".join(f"{rng.choice('klmnp')}{rng.choice('aeiou')}{rng.randrange(60)}" for _ in range(rng.randint(8, 40)))
        rows.append((i, text, rng.choice(["en", "de", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(text)))
    rows += [(200 + i, rows[i][1] + " tail", "en", "s1", 0) for i in range(0, 60, 3)]        # near copies of the longer ones
    rows += [(300 + i, rows[i][1], "en", "s2", 0) for i in range(5)]                        # exact copies
    rows += [(400, f"before {item} after", "en", "s1", 0), (401, None, "en", "s1", 0), (402, "", None, "s1", 0), (403, "123 456", "de", None, 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*documents.columns, "shard", "slot"]
    out = got.collect()
    assert Counter(r.doc_id for r in out) == expected(rows, [item])
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in out)


def test_stages_take_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and out.columns[:5] == empty.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "mixing", "sharding"]
