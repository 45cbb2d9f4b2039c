"""Numpy kernels against plain Python."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.llm import media, mixing, quality, substring, token_store, warc
from strataweave.llm import textblocks as tb

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab#\t\n\x0b \r é漢.'"), max_size=60)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words(texts):
    w = tb.Words(tb.strings(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        got = [bytes(w.buf[w.start[j] : w.end[j]]).decode() for j in range(w.ptr[i], w.ptr[i + 1])]
        assert got == brute.words(t)
    h = w.hashes()
    known = {}
    for j in range(len(h)):
        assert known.setdefault(bytes(w.buf[w.start[j] : w.end[j]]), h[j]) == h[j]
    assert len(set(known.values())) == len(known)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_quality_counts(texts):
    s = quality.document_stats(tb.strings(pa.array(texts, pa.string())))
    got = list(zip(*(s[k].tolist() for k in quality.STATS), strict=True))
    assert got == [brute.quality(t) for t in texts]


def test_word_counts_equal_words():
    column = pa.array(["a b", "", "  c", "d", "\n"])
    assert mixing.word_counts(column).tolist() == [2, 0, 1, 1, 0]


def test_monotone_trees():
    rng = np.random.default_rng(0)
    x = rng.random((800, 2))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * rng.standard_normal(800)) > 0.5).astype(float)
    t = quality.grow_trees(x, y, np.array([1, 0]))
    line = np.stack([np.linspace(-1, 2, 400), np.full(400, 0.4)], 1)
    assert (np.diff(t.score(line)) >= -1e-12).all()
    assert ((t.score(x) >= 0.5) == y).mean() > 0.8  # the target itself is neither monotone nor free of noise
    assert quality.grow_trees(np.zeros((0, 2)), np.zeros(0), np.zeros(2)).score(np.zeros((1, 2)))[0] == 0.5


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_media_round_trip(data):
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    back, frames, avi = media.avi_to_payload(media.payload_to_avi(payload))
    assert back == payload and avi["rate"] == 25


def test_media_general_decoder_and_walk_without_index():
    samples = np.random.default_rng(1).integers(0, 256, (3, 5), dtype=np.uint8)
    frame = media.encode_frame(samples)
    fast = media.decode_luma(frame)
    keep, media._is_dc_only = media._is_dc_only, lambda j: False
    try:
        assert (media.decode_luma(frame) == fast).all()
    finally:
        media._is_dc_only = keep
    avi = media.write_avi([frame, frame], 40, 24)
    assert media.read_avi(avi.replace(b"idx1", b"junk"))["frames"] == [frame, frame]
    with pytest.raises(media.MediaError):
        media.read_avi(b"no")


def test_shots():
    a, b = [9, 0, 0], [0, 0, 9]
    assert media.shots(np.array([a, a, b, b, b])) == [(0, 2), (2, 5)]
    assert media.shots(np.zeros((0, 3))) == [] and media.shots(np.array([a])) == [(0, 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(steps):
    values = np.cumsum([0, *steps])
    ef = token_store.EliasFano.encode(values)
    assert (ef.select(np.arange(len(values))) == values).all()
    import io

    again = token_store.EliasFano.read(io.BytesIO(ef.tobytes()), len(values), ef.low_bits, len(ef.high))
    assert (again.select(np.arange(len(values))) == values).all()
    bits = 8 * (len(ef.low) + len(ef.high))
    assert bits <= len(values) * (3 + np.log2(values[-1] / len(values) + 1)) + 1100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30), st.integers(0, 3), st.booleans())
def test_token_files(keys, nulls, narrow):
    import io

    keys = np.sort(np.array([k >> 40 for k in keys] if narrow else keys, np.int64))
    n = len(keys) + nulls
    if not n:
        return
    rng = np.random.default_rng(n)
    sizes = rng.integers(1, 2000, n)
    ids = rng.integers(0, 60_000, sizes.sum())
    out = io.BytesIO()
    token_store.write_store(out, keys, nulls, np.concatenate([[0], np.cumsum(sizes)]), [ids], 2)
    out.seek(0)
    t = token_store.TokenFile(out)
    got_keys, got = [], []
    for first, b in t.blocks(7, 1500):
        assert len(b) == 2 or b[-1] - b[0] <= 1500
        got_keys += t.keys(first, first + len(b) - 1).to_pylist()
        got += [t.ids(int(x), int(y)).tolist() for x, y in zip(b[:-1], b[1:], strict=True)]
    assert got_keys == keys.tolist() + [None] * nulls
    assert got == [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_encode_words_equals_whole_text():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", "  ", "Don't DO it (foo). Bar.Baz-QUX it's d'Or l'été x.'s", "Á. ́.a .́a 12ab3,4", "<|endoftext|> Σας ΟΔΟΣ", "漢字、かな. " * 40]
    ids, n = token_store.encode_words(pa.array(texts), path, 1)
    at = np.concatenate([[0], np.cumsum(n)])
    t = token_store._tokenizer(path)[0]
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids + [1]


def test_encode_words_equals_an_untouched_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["plain Text.", "a <|endoftext|> b", "", "a <|ENDOFTEXT|> b", "x<|startoftext|><|endoftext|>", "H\u0331 T\u0308 J\u030c", "É\u0331 A漢 KÉ", "A\u030a<|endoftext", "|> b", "Z\u200d\u0301 W=\u0338"]
    for some in (texts, texts[::-1], texts[:1], texts[1:2]):
        ids, n = token_store.encode_words(pa.array(some), path, 1)
        at = np.concatenate([[0], np.cumsum(n)])
        for i, x in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids + [1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abé1.' \n\t\u3000\xa0\x1c\u200b"), max_size=60))
def test_bpe_pieces_equal_whole_text(text):
    from strataweave.llm import bpe, queries

    c = bpe.codec(queries.ranks_path(), queries.pretoken_pattern())
    assert c.encode(text, 5, 3) == c.encode(text, 7, 2) == c.encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" + " " * 900_000 + "y", "\n" * 800_000, "a" * 300_000, "漢" * 100_000])
def test_bpe_very_long_runs(text):
    from strataweave.llm import bpe, queries

    c = bpe.codec(queries.ranks_path(), queries.pretoken_pattern())
    assert c.decode(c.encode(text)) == text.encode()


def test_source_targets():
    t = brute.source_targets({"b": 100, "a": 10, None: 5, "c": 50})
    assert {k: v[0] for k, v in t.items()} == {"a": 20.0, "b": 145.0, "c": 72.5, None: 10.0}
    assert brute.source_targets({}) == {} and brute.source_targets({"x": 0}) == {"x": (0.0, 0)}


def fm_segments(seed, sizes=(20, 63)):
    rng = random.Random(seed)
    sign = rng.choice([1, 2, 3, 50])
    base = [[rng.randint(1, sign) for _ in range(63)] for _ in range(4)]
    out = []
    for _ in range(rng.randint(1, 40)):
        t = list(rng.choice(base)) if rng.random() < 0.6 else [rng.randint(1, sign) for _ in range(63)]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(63)] = rng.randint(1, sign)
        n = rng.randint(*sizes)
        a = rng.randint(0, 63 - n)
        out.append(t[a : a + n])
    return out, sign, rng


def fm_repeats(segs, key):
    lengths = np.array([len(s) for s in segs])
    found = substring.repeated_windows(np.array(sum(segs, [])), lengths, np.array(key))
    return set(zip(*(f.tolist() for f in found), strict=True))


@pytest.mark.parametrize("seed", range(25))
def test_fm_index(seed):
    segs, _, rng = fm_segments(seed)
    seen, want = set(), set()
    for i, s in enumerate(segs):
        for j in range(len(s) - 19):
            g = tuple(s[j : j + 20])
            if g in seen:
                want.add((i, j))
            seen.add(g)
    # one key: an index after the other; a key each: all in one index
    assert fm_repeats(segs, [0] * len(segs)) == fm_repeats(segs, range(len(segs))) == want


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics(seed):
    segs, sign, rng = fm_segments(seed)
    fm = substring.FMIndex(np.array(sum(segs, [])), np.array([len(s) for s in segs]))
    texts = [[rng.randint(1, sign + 1) for _ in range(rng.randint(1, 40))] for _ in range(4)] + [segs[0][:30] + [sign + 1] + segs[-1][:20]]
    streamed = fm.statistics(np.array(sum(texts, [])), np.array([len(t) for t in texts]), least=1)
    got = {(t, i): (n, high - low) for t, i, n, low, high in zip(*(x.tolist() for x in streamed), strict=True)}
    occurs = lambda g: sum(s[k : k + len(g)] == g for s in segs for k in range(len(s) - len(g) + 1))
    want = {}
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for n in range(1, len(text) - i + 1):
                if not (count := occurs(text[i : i + n])):
                    break
                want[t, i] = (n, count)
    assert got == want


def test_the_index_finds_by_backward_search_alone(monkeypatch):
    segs, _, _ = fm_segments(3, (40, 63))
    segs += [s[3:30] for s in segs]
    ids, length = np.array(sum(segs, [])), np.array([len(s) for s in segs])
    fm = substring.FMIndex(ids, length)
    n = fm.n
    kept = [v for v in vars(fm).values() if isinstance(v, np.ndarray)]
    assert all(len(v) < n // 2 for v in kept)  # neither the text nor its suffix array
    monkeypatch.setattr(substring.FMIndex, "back", lambda self, symbol, low, high: (low, low))
    assert not fm_repeats(segs, [0] * len(segs))


def test_hashes_of_texts_that_polynomials_confuse():
    line = "a"
    for _ in range(12):
        line += line.translate(str.maketrans("ab", "ba"))
    for n in (64, 128, 256, 257, 512, 1024, 4096):
        x, y = line[:n], line[:n].translate(str.maketrans("ab", "ba"))
        texts = [f"{x}\n{y}", " ".join([x, "p", "q", y, "p", "q"]), f"{x}\n{y}\n{x}"]
        s = quality.document_stats(pa.array(texts))
        assert [tuple(s[k][i] for k in quality.STATS) for i in range(3)] == [brute.quality(t) for t in texts]
        w = tb.Words(pa.array([f"{x} {y}"]))
        assert len(set(w.hashes().tolist())) == 2


def test_salvage():
    records = [warc.record("response", i, f"http://x/{i}", (b"<p>%d</p>" % i) * 50, None) for i in range(6)]
    data = bytearray(b"".join(records))
    a = len(records[0]) + len(records[1])
    data[a + 20 : a + 60] = bytes(40)  # inside the third
    del data[len(data) - 10 :]  # the last is cut short
    got = list(warc.salvage(bytes(data)))
    gaps = [g for g in got if isinstance(g, warc.Gap)]
    assert [r.headers["warc-record-id"] for r in got if isinstance(r, warc.Record)] == [f"<urn:x-page:{i}>" for i in (0, 1, 3, 4)]
    assert [(g.offset, g.end) for g in gaps] == [(a, a + len(records[2])), (sum(map(len, records[:5])), len(data))]
    import gzip

    plain = gzip.decompress(records[0])
    assert [type(x).__name__ for x in warc.salvage(b"junk" + plain + plain[:30])] == ["Gap", "Record", "Gap"]
    assert list(warc.salvage(b"")) == []


def test_salvage_in_linear_time():
    import gzip
    import time

    good = gzip.decompress(warc.record("response", 1, "http://x/1", b"good", None))
    bad = b"WARC/1.1\r\nContent-Length: x\r\n" + b"y" * 64 + b"\r\n"
    for junk in (bad * 60_000, bad.replace(b"\r\n", b"\n") * 60_000, b"WARC/1.0\r\n" * 500_000):
        began = time.time()
        for data in (junk + b"\r\n\r\n" + good, gzip.compress(junk + b"\r\n\r\n" + good), junk):
            got = list(warc.salvage(data))
            assert sum(isinstance(r, warc.Record) for r in got) == (data is not junk)
            assert sum(isinstance(r, warc.Gap) for r in got) == 1
        assert time.time() - began < 60
    # a header line may name a version
    named = good.replace(b"Content-Type: application/http", b"Software: reads WARC/1.0\r\nContent-Type: application/http")
    assert [type(r).__name__ for r in warc.salvage(named)] == ["Record"]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_a_member(level):
    import gzip

    noise = random.Random(4)
    plains = [gzip.decompress(warc.record("response", i, f"http://x/{i}", bytes(noise.choices(range(256), k=9000)), None)) for i in range(30)]
    at = np.cumsum([0, *map(len, plains)])
    kept = lambda data: [int(r.headers["warc-record-id"][12:-1]) for r in warc.salvage(data) if isinstance(r, warc.Record)]
    gaps = lambda data: [(g.offset, g.end) for g in warc.salvage(data) if isinstance(g, warc.Gap)]
    whole = bytearray(b"".join(plains))
    assert kept(gzip.compress(bytes(whole), level)) == list(range(30))
    whole[at[7] + 600] ^= 1
    one = gzip.compress(bytes(whole), level)
    after = warc.record("response", 99, "http://x/99", b"after", None)
    # one bad record in a member
    assert kept(one + after) == [*range(7), *range(8, 30), 99]
    assert gaps(one + after) == [(0, len(one))]
    # a wrong checksum besides
    bad = one[:-8] + bytes(4) + one[-4:]
    assert kept(bad + after) == [*range(7), *range(8, 30), 99] and (0, len(bad)) in gaps(bad + after)
    # the end cut off
    assert kept(one[: len(one) * 2 // 3])[:18] == [*range(7), *range(8, 19)]
    # a stream that fails midway keeps what is before
    torn = one[: len(one) // 2] + b"\xff" * 200_000
    got = kept(torn + after)
    assert got[:12] == [*range(7), *range(8, 13)] and got[-1] == 99 and len(set(got)) == len(got)
