"""Words that share a plain hash are told apart wherever a count or a link is decided."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from strataweave.llm import jaccard_join as jj, quality
from strataweave.llm import textblocks as tb
from strataweave.llm.identity import RID

#: two words of one plain hash, as found by drawing
FOUND = ("rs18bf38azx6szdy", "ykjp6z5z?2+_3*u|")


def step(h, data):
    return int(tb.mix(np.array([h ^ int.from_bytes(data, "little")], np.uint64))[0])


def collisions(rng, count):
    """Fresh pairs of printable 16-byte words with one plain hash: other first eight bytes, then the difference of the states put into the next eight."""
    alphabet = bytes(range(33, 127))
    draws = 400_000
    first = np.frombuffer(bytes(rng.choices(alphabet, k=16 * draws)), "<u8").reshape(2, draws)
    begin = tb.mix(np.array([16], np.uint64) * tb._MULT)
    states = tb.mix(begin ^ first[0]) ^ tb.mix(begin ^ first[1])
    tail = np.frombuffer(bytes(rng.choices(alphabet, k=8 * draws)), "<u8")
    other = (states ^ tail).view(np.uint8).reshape(-1, 8)
    good = np.flatnonzero(((other >= 33) & (other <= 126)).all(1))[:count]
    word = lambda i, side, t: first[side, i].tobytes() + t[i].tobytes()
    return [(word(i, 0, tail), word(i, 1, states ^ tail)) for i in good]


def words_of_one_hash(n):
    rng, found = random.Random(n), [tuple(w.encode() for w in FOUND)]
    while len(found) < n:
        found += collisions(rng, n - len(found))
    return [(a.decode(), b.decode()) for a, b in found]


@pytest.fixture(scope="module")
def pairs():
    return words_of_one_hash(30)


def test_the_pairs_do_share_a_plain_hash(pairs):
    w = tb.Words(pa.array([" ".join(p) for p in pairs]))
    h = w.hashes().reshape(-1, 2)
    assert (h[:, 0] == h[:, 1]).all() and len(np.unique(h[:, 0])) == len(pairs)
    for key in (b"one", b"another"):
        assert len(np.unique(w.keyed_hashes(key))) == 2 * len(pairs)


def test_counts_of_op3(pairs):
    a, b = pairs[0]
    texts = [f"{a}\n{b}", f"{a} p q {b} p q", " ".join(x for p in pairs for x in p), "\n".join(x for p in pairs for x in p)]
    s = quality.document_stats(pa.array(texts))
    got = list(zip(*(s[k].tolist() for k in quality.STATS), strict=True))
    assert got == [brute.quality(t) for t in texts]
    assert got[0][3] == got[1][4] == got[3][3] == 0


def test_components_of_op2(spark, pairs):
    docs = [(1, " ".join(a for a, _ in pairs).lower()), (2, " ".join(b for _, b in pairs).lower()), (3, " ".join(a for a, _ in pairs))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (27, 1, 0), 2: (27, 2, 0), 3: (27, 1, 0)}
    assert [r["doc_id"] for r in jj.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), k=5, percent=80).orderBy("doc_id").collect()] == [1, 2]


def test_links_are_verified_on_words(spark, monkeypatch):
    """With hashes of four bits, nearly all words collide: pairs are still judged by their words."""
    real = tb.Words.keyed_hashes
    monkeypatch.setattr(tb.Words, "keyed_hashes", lambda self, key: real(self, key) & np.uint64(15))
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[:i] + [f"x{rng.random()}"] + base[i + 1 :])) for i in range(8)] + [(8, " ".join(f"y{i}" for i in range(60))), (9, "a b"), (10, "b a"), (11, None)]
    rows = spark.createDataFrame([(i, t or "") for i, t in docs], f"{RID} long, text string")
    every = spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 12)], "a long, b long")
    got = {(r["a"], r["b"]): (r["both"], r["either"]) for r in jj.verified(every, rows).collect()}
    sets = {i: brute.shingles(t) for i, t in docs}
    want = {(i, j): (len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i in sets for j in sets if i < j and sets[i] | sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert got == want and want


def test_gram_sets():
    rng = random.Random(9)
    texts = ["", "a", "a b", "b a", " \n"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    for k in (1, 3, 4, 5):
        codes, off = tb.Words(pa.array(texts)).gram_sets(k)
        sets = [brute.shingles(t, k) for t in texts]
        assert np.diff(off).tolist() == [len(s) for s in sets]
        for i in range(len(texts)):
            for j in range(i):
                assert len(np.intersect1d(codes[off[i] : off[i + 1]], codes[off[j] : off[j + 1]])) == len(sets[i] & sets[j])


def test_codes_that_would_not_fit_are_numbered_anew():
    codes = np.arange(50) * (1 << 33)
    grams = tb.gram_codes(np.tile(codes, 3), 4)
    assert len(np.unique(grams)) == 50 and (grams[:50] == grams[50:100]).all()


def test_keyed_hashes_of_all_lengths():
    rng = random.Random(1)
    words = ["z" * n for n in range(1, 600)] + ["".join(rng.choices("ab", k=n)) for n in range(1, 600)]
    words = list(dict.fromkeys(words))
    h = tb.Words(pa.array([" ".join(words)])).keyed_hashes(b"key")
    one = [int(tb.Words(pa.array([f"  {w} "])).keyed_hashes(b"key")[0]) for w in words]
    assert h.tolist() == one and len(set(one)) == len(words)


def test_packed_blocks():
    rng = np.random.default_rng(3)
    for universe in (40, 10**6):
        sets = [np.unique(rng.integers(0, universe, n).astype(np.uint64)) for n in [30, 1, 25, 30] * 12]
        tokens, sizes, held = jj.packed(sets)
        assert held[:1] == (b"b" if universe == 40 else b"n")
        flat, off = jj.unpacked(tokens, sizes, held)
        assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [s.tolist() for s in sets]


def test_near_copies_of_a_block_cost_little_more_than_one():
    rng = np.random.default_rng(5)
    base = np.arange(800, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(800) > 0.02], rng.integers(10**6, 10**9, 8).astype(np.uint64)])) for _ in range(500)]
    assert sum(map(len, jj.packed(sets))) < sum(x.nbytes for x in sets) / 5


def test_disjoint():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 6))) for _ in range(30)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    x, y = rng.integers(0, 30, 300), rng.integers(0, 30, 300)
    want = [not set(sets[i].tolist()) & set(sets[j].tolist()) for i, j in zip(x, y, strict=True)]
    for block in (1, 50, 1 << 20):
        assert jj.disjoint(x, y, np.concatenate(sets), off, block).tolist() == want
