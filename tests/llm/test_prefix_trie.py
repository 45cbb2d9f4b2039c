"""Prefix trie against a plain tree of tuples."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strataweave.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """Turns of each conversation in order: (role, text)."""
    found = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found.setdefault(c, []).append(((turn is not None, turn or 0), role, digest(role, text), text))
    return {c: [(role, text) for _, role, _, text in sorted(v)] for c, v in found.items()}


def rebuilt(rows):
    given = sequences(rows)
    out = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = given.get(base, [])[:h] + own[h:]
    return out


def trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in below)
    out = set()
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        out.add((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def built(spark, rows, block=pt.BLOCK):
    turns, convs = pt.placed_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    return rows_of(pt.prefix_trie(turns, convs, block))


def shared_conversations(rng, n, depth):
    """Conversations that begin as earlier ones do, copies and prefixes among them."""
    held, rows = [], []
    for c in rng.sample(range(5 * n), n):
        turns = list(rng.choice(held)) if held and rng.random() < 0.8 else []
        turns = turns[: rng.randint(0, depth)] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", "", None])) for _ in range(rng.randint(0, 3))]
        turns = turns or [("user", "a")]
        held.append(turns)
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("block", [2, 1024])
def test_trie_of_many_shared_turns(spark, block):
    rng = random.Random(block)
    rows = shared_conversations(rng, 150, 9)
    assert built(spark, rows, block) == trie(sequences(rows))


def test_query_splices_and_edges(spark):
    rng = random.Random(8)
    rows = shared_conversations(rng, 120, 6)
    rows += [(3000 + i, t, "user", f"turn {t}") for i in range(60) for t in range(4)]  # copies
    rows += [(7001, None, "user", "first"), (7001, 5, None, None), (7001, 5, "user", "tie"), (7001, 5, "user", "tie"), (7001, -3, "user", "x" * 3_000_000)]
    rows += [(None, 0, "user", "nobody's"), (-7, 0, "user", "negative"), (-5, 0, "user", "base"), (7002, 0, "user", ""), (7003, 0, "", "user")]
    rows += [(8000, t, "user", str(t % 3)) for t in range(500)] + [(8001, t, "user", str(t % 3)) for t in range(480)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).select("*", *[F.lit(1).alias(c) for c in ("pos", "digest", "bytes", "n", "depth", "owner", "_at", "_turn")])
    got = rows_of(pt.prefix_trie(*pt.spliced(*pt.placed_turns(df)), block=100))
    assert got == trie(rebuilt(rows))


def test_one_deep_chain_of_branches(spark):
    """Each conversation branches off the one before: a tree as high as there are conversations."""
    rows = [(c, t, "user", "same" if t < c else f"own {c}") for c in range(40) for t in range(c + 1)]
    assert built(spark, rows, 8) == trie(sequences(rows))


def test_empty_table_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pt.prefix_trie(*pt.spliced(*pt.placed_turns(empty))).collect() == []
    # 1 takes nothing from the absent 0 and loses its only turn
    assert zlib.crc32(b"1") % 9 > 1
    got = rows_of(pt.prefix_trie(*pt.spliced(*pt.placed_turns(spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)))))
    assert got == {(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())}


def test_search_takes_logarithmic_rounds(spark, monkeypatch):
    rows = [(c, t, "user", str(t)) for c in range(4) for t in range(100)]
    turns, convs = pt.placed_turns(spark.createDataFrame(rows, SCHEMA))
    rounds, real = [], pt.materialize
    monkeypatch.setattr(pt, "materialize", lambda df, name, *a: (rounds.append(name), real(df, name, *a))[1])
    found = pt.chains(turns, convs).collect()
    assert sorted((r["conv_id"], r["f"], r["parent"]) for r in found) == [(0, 0, None), (1, 101, 0), (2, 101, 0), (3, 101, 0)]
    assert rounds.count("search") <= 8
