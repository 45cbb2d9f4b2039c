"""Shards and media against versions that share no code with the operators; phantom records; ways to a repeated window."""

import gzip
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import media, sharding, substring, warc


@pytest.mark.parametrize("n_shards", [1, 5, 24])
def test_shards_by_plain_rendezvous(spark, n_shards):
    rng = random.Random(n_shards)
    rows = [(rng.randint(-(2**62), 2**62), f"text {i}") for i in range(150)] + [(0, ""), (None, "x"), (7, None), (7, None)]
    out = sharding.external_shuffle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n_shards, seed=5, bucket_bytes=300).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out) == sorted((str(d), t or "") for d, t in rows)
    for r in out:
        assert (r["shard"], r["grown_shard"]) == (brute.rendezvous(r["doc_id"], n_shards, 5), brute.rendezvous(r["doc_id"], n_shards + 1, 5))
        assert (r["size"], r["text_crc32"]) == (len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))


def test_order_within_shards_is_the_buckets_shuffle(spark):
    rows = [(i, "x" * (i % 9)) for i in range(400)]
    out = sharding.external_shuffle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, seed=5).collect()
    for s in range(2):  # one bucket a shard: keys in order, then the seeded shuffle
        keys = [d for d, _ in rows if brute.rendezvous(d, 2, 5) == s]
        order = np.random.default_rng([5, s, 0]).permutation(len(keys))
        assert [r["doc_id"] for r in sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])] == [keys[i] for i in order]


@pytest.mark.parametrize("text", ["", "abc", "é漢 " * 700, "a" * 4096 + "z9" * 1500])
def test_media_by_a_plain_decoder(text):
    payload, _ = media.padded_payload(text)
    data = media.payload_to_avi(payload)
    chunks = brute.riff(data)
    frames = [body for name, body in chunks if name == b"00dc"]
    stored = b""
    for f in frames:
        width, height, pixels = brute.grey_jpeg(f)
        assert all(pixels[y][x] == pixels[y // 8 * 8][x // 8 * 8] for y in range(0, height, 3) for x in range(0, width, 5))
        stored += bytes(pixels[y][x] for y in range(0, height, 8) for x in range(0, width, 8))
    assert stored[: len(payload)] == payload and not any(stored[len(payload) :])
    index = dict(chunks)[b"idx1"]
    movi = data.index(b"movi")
    for i, f in enumerate(frames):  # the index leads to each frame
        name, at, size = index[16 * i : 16 * i + 4], *(int.from_bytes(index[16 * i + j : 16 * i + j + 4], "little") for j in (8, 12))
        assert name == b"00dc" and data[movi + at + 8 : movi + at + 8 + size] == f


@pytest.mark.parametrize("packed", [True, False])
def test_a_record_in_a_payload_is_no_record(packed):
    inner = gzip.decompress(warc.record("response", 99, "http://x/99", b"inner", None))
    plains = [gzip.decompress(warc.record("response", i, f"http://x/{i}", b"<p>" + (inner if i == 1 else b"text"), None)) for i in range(3)]
    at = len(plains[0])
    bad = bytearray(b"".join(plains))
    bad[at + plains[1].index(b"<p>") + 1] ^= 1  # one letter of the payload
    got = list(warc.salvage(gzip.compress(bytes(bad)) if packed else bytes(bad)))
    assert [r.headers["warc-record-id"] for r in got if isinstance(r, warc.Record)] == ["<urn:x-page:0>", "<urn:x-page:2>"]
    gaps = [g for g in got if isinstance(g, warc.Gap)]
    assert len(gaps) == 1 and "digest differs" in gaps[0].reason
    if not packed:
        assert (gaps[0].offset, gaps[0].end) == (at, at + len(plains[1]))


def test_both_ways_to_a_repeated_window(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(500)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, passage = say(120), say(50)
    docs = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(say(40) + passage + say(30))), (4, " ".join(say(11) + passage + say(60)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["searched"]: r["windows"] for r in substring.windows_found(df).collect()}
    assert found[False] >= 60 and found[True] >= 10 and sum(found.values()) == (120 - 19) + (50 - 19)
    want = {d: n for d, _, n, _ in brute.substring(docs)}
    assert {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(df).collect()} == want


def test_copies_from_other_blocks_are_found_by_the_index(monkeypatch):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(63))
    args = [np.zeros(4, np.int64), np.arange(4), np.zeros(4, np.int64), np.full(4, 44), pa.array([text] * 3 + [text.replace(" ", " z ", 1)])]
    got = substring._search(*args)
    assert sorted(zip(got["_rid"].to_pylist(), got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == [(1, 0, 63), (2, 0, 63), (3, 2, 64)]
    assert all(got["searched"].to_pylist())
    monkeypatch.setattr(substring.FMIndex, "back", lambda self, symbol, low, high: (low, low))
    assert substring._search(*args).num_rows == 0


STAGES = ["quality", "near_copies", "repeated_passages", "mixture", "encoding"]


@pytest.mark.parametrize("name", STAGES)
def test_values_of_stages_with_very_long_texts(spark, name):
    import corpus_pipeline as cp

    from strataweave.llm import queries
    from strataweave.session import table

    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(4000)]
    long = " ".join(rng.choice(vocab) for _ in range(500_000))
    other = " ".join(rng.choice(vocab) for _ in range(200))
    rows = [(1, long, "en", "a", 1), (2, "x" * 4_000_000, "en", "a", 1), (3, long + " end", "en", "b", 1), (4, other, "en", "b", 1), (5, f"{other} {long[:1500]}", "de", None, 1), (6, None, None, "a", None), (7, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    texts = {r[0]: r[1] or "" for r in rows}
    out = dict(cp.STAGES)[name](spark, docs, "/root/testdata/sf0.001").collect()
    ids = sorted(r["doc_id"] for r in out)
    if name == "quality":
        from strataweave.llm.quality import quality_rules, train_quality

        trees = train_quality(docs, table(spark, "/root/testdata/sf0.001", "labels"))
        verdict = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["kept"]) for r in quality_rules(docs, trees).collect()}
        assert ids == sorted(d for d, v in verdict.items() if v[2])
        assert all(verdict[d][:2] == (brute.quality(t)[0], brute.quality(t)[4]) for d, t in texts.items())
        assert not {2, 6, 7} & set(ids) and all(r["text"] == texts[r["doc_id"]] for r in out)
    elif name == "near_copies":
        assert ids == [1, 2, 4, 5, 6, 7] and all((r["text"] or "") == texts[r["doc_id"]] for r in out)
    elif name == "repeated_passages":
        gone = {d: n for d, _, n, _ in brute.substring(sorted(texts.items()))}
        assert ids == [d for d, t in sorted(texts.items()) if not gone[d] or gone[d] < len(brute.words(t))]
        for r in out:
            kept = len(brute.words(texts[r["doc_id"]])) - gone[r["doc_id"]]
            assert len(brute.words(r["text"])) == kept and (gone[r["doc_id"]] or (r["text"] or "") == texts[r["doc_id"]])
    elif name == "mixture":
        size = {d: len(brute.words(t)) for d, t in texts.items()}
        taken = {d: sum(len(brute.words(r["text"])) for r in out if r["doc_id"] == d) for d in size}
        assert all(taken[d] <= 2 * size[d] for d in size)
        of = {d: s for d, _, _, s, _ in rows}
        for source, (target, _) in brute.source_targets({s: sum(size[d] for d in size if of[d] == s) for s in set(of.values())}).items():
            assert abs(sum(taken[d] for d in size if of[d] == source) - target) < 1
    else:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        plain = tiktoken.Encoding("plain", pat_str=queries.pretoken_pattern(), mergeable_ranks=load_tiktoken_bpe(queries.ranks_path()), special_tokens={})
        assert ids == list(range(1, 8))
        for r in out:
            if r["doc_id"] != 2:  # a word of 4 MB is too long for the library itself
                assert list(r["ids"]) == plain.encode_ordinary(texts[r["doc_id"]])
