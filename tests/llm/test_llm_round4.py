"""Components of few edges in few jobs, of many edges by joins and then in one task; workers that give memory back."""

import random

import pyarrow as pa
import pytest
from tickloom.llm import decontaminate, graph, words


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def mixed_edges():
    rng = random.Random(5)
    chain = list(range(1000, 1040))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *[(999, i) for i in range(20)], *[(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)], (7, 7), (-3, 1 << 60), (-3, 1 << 60)]
    return [e if rng.random() < 0.5 else e[::-1] for e in edges]


def test_components_of_few_edges_take_few_jobs(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)]
    edges = spark.createDataFrame(rows, "a long, b long")
    spark.sparkContext.setJobGroup("components", "components")
    try:
        got = graph.components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 6
    assert dict(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("most", [0, 3, 60, 1 << 18])
def test_components_are_the_same_by_joins_and_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "LOCAL_EDGES", most)
    rows = mixed_edges()
    got = graph.components(spark.createDataFrame(rows, "a long, b long").repartition(5)).collect()
    assert len(got) == len({r.node for r in got})
    assert dict(map(tuple, got)) == brute(rows)


def test_components_of_no_edges(spark):
    got = graph.components(spark.createDataFrame([(4, 4), (None, 3)], "a long, b long"))
    assert got.columns == ["node", "root"] and got.collect() == []


def test_a_run_gives_memory_back_once_its_rows_are_out(monkeypatch):
    seen = []
    monkeypatch.setattr(words, "give_back", lambda: seen.append("back"))
    run = words.tidy(lambda batches: (seen.append(b) or b * 10 for b in batches))
    assert list(run(iter([1, 2]))) == [10, 20] and seen == [1, 2, "back"]


def test_documents_are_matched_alike_in_slices_of_any_size(monkeypatch):
    class Shared:
        value = decontaminate.Block.of([1], pa.array([" ".join(f"b{i}" for i in range(12))]), 0.6)

    texts = [None, "", *[f"x{i} " + " ".join(f"{'bc'[i % 3 == 0]}{j}" for j in range(12)) for i in range(30)], None]
    got = []
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size)
        got.append(decontaminate._cleaner(Shared, 0.6)(pa.array(texts)).to_pylist())
    assert got[0] == got[1] == got[2] == [True, True, *[i % 3 == 0 for i in range(30)], True]
