"""Classes and numbers of links against the list of pairs."""

import random

import pytest

from strataweave.operators import near_dup


def classes_of(rows, pairs):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links, rep = dict.fromkeys(root, 0), {b: a for a, b, j in pairs if j == 1}
    for a, b, j in pairs:
        if j < 1:
            links[a] += 1
            links[b] += 1
    return {i: (find(i), links[rep.get(i, i)]) for i in root}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    template = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(90):  # a cluster of near copies
        words = list(template)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"w{rng.random()}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(200 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(20)]  # each like its neighbours only
    rows += [(300 + i, " ".join(f"u{rng.random()}" for _ in range(50))) for i in range(10)]
    rows += [(400 + i, rows[rng.randrange(110)][1]) for i in range(30)] + [(500, None), (501, ""), (502, "one"), (503, "one")]
    return rows


@pytest.mark.parametrize("small,block", [(16, 512), (1, 20), (2, 7), (1000, 512)])
def test_classes_are_those_of_the_pairs(spark, monkeypatch, rows, small, block):
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(4)
    pairs = [tuple(r) for r in near_dup.near_duplicate_pairs(df).collect()]
    monkeypatch.setattr(near_dup, "BLOCK", block)
    got = {r["row_id"]: (r["class_id"], r["n_links"]) for r in near_dup.near_duplicate_classes(df, small=small).collect()}
    assert got == classes_of(rows, pairs)


def test_no_rows(spark):
    assert near_dup.near_duplicate_classes(spark.createDataFrame([], "row_id long, text string")).collect() == []
