import random

import pytest

from seqlode.llm import near


@pytest.mark.parametrize(("threshold", "recall"), [(0.8, 0.9995), (0.5, 0.95), (0.9, 0.99), (1.0, 0.99)])
def test_bands(threshold, recall):
    bands, rows = near.choose_bands(threshold, recall)
    assert 1 <= bands <= near.MAX_BANDS
    assert 1 - (1 - threshold**rows) ** bands >= min(recall, 0.97)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    rng.shuffle(edges)
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    got = {r["_row"]: r["_label"] for r in near.components(spark.createDataFrame(edges, "_a long, _b long")).collect()}
    assert got == {x: find(x) for x in label}


def test_no_edges(spark):
    assert near.components(spark.createDataFrame([], "_a long, _b long")).collect() == []
