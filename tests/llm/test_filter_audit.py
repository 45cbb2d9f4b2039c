"""Filter audit against every order taken one at a time over the rows themselves."""

import itertools
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import filter_audit
from strataweave.llm.filter_audit import Walk, all_orders, audit_orders, text_masks, transpositions


def fails(text):
    w = brute.words(text)
    return (
        len(w) < 100,
        100 * len(set(w)) < 80 * len(w),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        re.search(r"[#$%&*|]", text) is not None,
    )


def audit(rows, labels):
    """rows: (doc_id, text, part)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    marked = []
    for d, text, part in rows:
        copy = d is not None and d > first[text or ""]
        marked.append((part or "", dict(zip("ABCDE", (*fails(text or ""), copy), strict=True)), d in good, d in toxic))
    out, shapley = {}, {}
    for part in {m[0] for m in marked}:
        mine = [m for m in marked if m[0] == part]
        for order in itertools.permutations("ABCDE"):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                here = [m for m in left if m[1][f]]
                redundant = sum(m[1][f] for m in gone)
                gone = gone + here
                left = [m for m in left if not m[1][f]]
                alone = sum(m[1][f] and sum(m[1].values()) == 1 for m in mine)
                out[part, "".join(order), step] = (len(left), len(here), redundant, alone, sum(m[2] for m in here), sum(m[3] for m in here))
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in rows}
    assert len(found) == len(rows)
    return found


def _rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n, extra="": " ".join(rng.choice(vocab) for _ in range(n)) + extra
    shared = say(150)
    rows = [(i, say(rng.choice([5, 99, 100, 120, 300]), rng.choice(["", " #", " ABCDEF" * 40])), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(60 + i, shared, rng.choice(["en", "de"])) for i in range(30)]
    rows += [(200, None, "en"), (201, "", None), (202, " \t", ""), (203, "A" * 3_000_000, "de"), (204, say(400_000), "fr"), (205, "a " * 99 + "a", "es")]
    rows += [(60, shared, "en"), (60, shared, "de"), (59, "other text of one id", "en"), (None, shared, "en"), (None, None, None), (None, "lone", "de")]
    return rows


def test_against_every_order(spark):
    rows = _rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 90, 3)] + [(3, 1, 1), (6, None, None), (None, 1, 1), (500, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    docs = docs.select("*", *[F.lit(9).alias(c) for c in ("part", "sha", "mask", "n", "good", "toxic", "is_first", "step", "kept")])
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    got = collected(filter_audit.filter_audit(docs, said))
    want = audit(rows, labels)
    assert len(got) == 600 * 5
    assert got == want
    for part in {k[0] for k in got}:  # a filter's total is that of all orders; all rows are kept or removed
        n = sum((r[2] or "") == part for r in rows)
        assert all(sum(got[part, o, s][1] for s in range(1, 6)) + got[part, o, 5][0] == n for o in map("".join, itertools.permutations("ABCDE")))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "x", None)], docs.schema)
    got = collected(filter_audit.filter_audit(some, labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_walk_visits_every_order_once_by_single_swaps(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in transpositions(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swaps_count_two_steps_only():
    rng = np.random.default_rng(3)
    mask = np.arange(32)
    walk = Walk(5, mask, rng.integers(0, 50, (3, 32)))
    counted = []
    once = walk._count
    walk._count = lambda i, before: (counted.append(i), once(i, before))
    moves = list(transpositions(5))
    for i in moves:
        walk.swap(i)
        fresh = Walk(5, mask, walk.counts)
        fresh.order = list(walk.order)
        for step in range(5):
            fresh._count(step, sum(1 << f for f in walk.order[:step]))
        assert (fresh.removed == walk.removed).all() and (fresh.kept == walk.kept).all()
    assert counted == [s for i in moves for s in (i, i + 1)]


def test_shapley_of_few_cells():
    # one row that fails A and B is taken by whichever comes first
    rows = all_orders([(3, 1, 0, 0)], "AB")
    assert rows == [("AB", 1, 0, 1, 0, 0, 0, 0, 1), ("AB", 2, 0, 0, 1, 0, 0, 0, 1), ("BA", 1, 0, 1, 0, 0, 0, 0, 1), ("BA", 2, 0, 0, 1, 0, 0, 0, 1)]


def test_other_filters_and_limits(spark):
    cells = spark.createDataFrame([("p", 1, 2, 0, 0), ("p", 1, 3, 1, 0), ("p", 6, 4, 0, 2)], "part string, mask long, n long, good long, toxic long")
    assert audit_orders(cells, "XYZ").count() == 18
    assert collected(audit_orders(cells, "XYZ"))["p", "XYZ", 1][:2] == (4, 5)
    with pytest.raises(ValueError, match="filters"):
        audit_orders(cells, "ABCDEFGHI")


def test_words_of_one_old_hash_are_told_apart():
    pair = ["rs18bf38azx6szdy", "ykjp6z5z?2+_3*u|"]
    masks = text_masks(pa.array([" ".join(pair * 1 + [f"x{i}" for i in range(98)]), "É" * 9 + "A", "É" * 8 + "AA"]))
    assert masks.tolist() == [8, 1, 5]
