"""Every operator and stage on nulls, empty and very long texts, repeated rows, an empty table and clashing columns."""

import hashlib
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from strataweave.llm import bpe, jaccard_join, media, mixing, quality, queries, sharding, substring, token_store, url_filters, warc

#: columns named like outputs and like inner names
CLASHES = [
    "size", "target", "taken", "passes", "pass", "words", "position", "n_words", "n_removed", "kept_text", "kept_sha256", "ranges", "wanted", "_rid", "_sha", "_key", "_hash", "_source", "n_shingles", "component_id", "n_links",
    "score", "kept", "base_failed", "log_words", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "shard", "slot", "grown_shard", "_bucket", "_pos", "_turn", "text_crc32", "n_bytes", "media_sha256", "feature", "clips", "start", "ids_crc32", "_tie",
]


def _rows():
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(3000)]
    prose = " ".join(rng.choice(vocab) for _ in range(600_000))  # over 5 MB
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    return [
        (1, prose, "a"), (2, "x" * 5_000_000, "a"), (3, None, None), (4, "", "b"), (5, " \t\n", "b"), (6, shared, "a"), (7, shared + " z", None), (8, f"q {shared}", "c"),
        (6, shared, "a"), (6, shared, "a"), (9, "same", "a"), (10, "same", "a"), (None, shared, "a"), (None, None, None), (None, "n", None), (8, "another text of one id", "c"),
    ]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def listed(rows, *columns):
    return sorted(tuple("" if r[c] is None else str(r[c]) for c in columns) for r in rows)


def numbered(rows):
    """(given id, text, number) as ``identified`` numbers documents: distinct pairs by id, nulls last, and the text's SHA-256."""
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    pairs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda p: (p[0] is None, p[0] or 0, sha(p[1])))
    return pairs, {p: i for i, p in enumerate(pairs)}


def test_bpe(docs, rows, empty):
    path, pattern = queries.ranks_path(), queries.pretoken_pattern()
    got = bpe.encode_tokens(docs.where("doc_id is null or doc_id != 2"), path, pattern, with_ids=False).collect()
    want = sorted(("" if r[0] is None else str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows if r[0] != 2)
    assert listed(got, "doc_id", "decoded_sha256") == want
    assert bpe.encode_tokens(empty, path, pattern).count() == 0


def test_jaccard(docs, rows, empty):
    got = jaccard_join.jaccard_components(docs).collect()
    pairs, number = numbered(rows)
    want = {d: (n, pairs[c][0]) for d, n, c in brute.jaccard_components([(number[p], p[1]) for p in pairs])}
    assert listed(got, "doc_id", "n_shingles", "component_id") == sorted(("" if r[0] is None else str(r[0]), str(want[number[r[0], r[1] or ""]][0]), "" if want[number[r[0], r[1] or ""]][1] is None else str(want[number[r[0], r[1] or ""]][1])) for r in rows)
    assert jaccard_join.jaccard_components(empty).count() == 0
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns and jaccard_join.one_of_each(empty).count() == 0
    stay = {c for _, _, c in brute.jaccard_components([(number[p], p[1]) for p in pairs])}
    found = one.collect()
    assert listed(found, "doc_id") == sorted(("" if pairs[c][0] is None else str(pairs[c][0]),) for c in stay)
    assert all(r["_rid"] == 7 and r["_sha"] == 7 and r["size"] == 7 for r in found)


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (6, 1), (6, 0), (4, 0), (3, 0), (None, 1), (8, None)], "doc_id long, quality int")
    trees = quality.train_quality(docs, labels)
    got = quality.quality_rules(docs, trees).collect()
    want = sorted(("" if r[0] is None else str(r[0]), *map(str, brute.quality(r[1]))) for r in rows)
    assert listed(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    assert quality.quality_rules(empty, trees).count() == 0


def test_media(docs, rows, empty):
    some = docs.where("doc_id is null or doc_id > 1")
    got = media.text_media(some).collect()
    payload = lambda t: media.padded_payload(t)[0]
    assert listed(got, "doc_id", "payload_sha256") == sorted(("" if r[0] is None else str(r[0]), hashlib.sha256(payload(r[1])).hexdigest()) for r in rows if r[0] != 1)
    assert media.text_media(empty).count() == 0 and media.clips(media.text_media(empty, with_media=True), "doc_id").count() == 0


def test_mixing(docs, rows, empty):
    mixed = mixing.mix_sources(docs, keep=["doc_id", "source", "text", *CLASHES])
    got = mixed.collect()
    assert listed(got, "doc_id", "size") == sorted(("" if r[0] is None else str(r[0]), str(len(brute.words(r[1])))) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(brute.words(r[1]))
    targets = brute.source_targets(sizes)
    for source in sizes:
        own = [r for r in got if r["source"] == source]
        assert {r["target"] for r in own} == {targets[source][0]} and sum(r["taken"] for r in own) == int(targets[source][0])
    order = mixing.training_order(mixed)
    assert len(set(order.columns)) == len(order.columns)
    assert order.agg(F.sum("words")).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix_sources(empty, keep=["doc_id"]).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.external_shuffle(docs, 3, bucket_bytes=100).select("doc_id", "text_crc32", "shard", "slot").collect()
    assert listed(got, "doc_id", "text_crc32") == sorted(("" if r[0] is None else str(r[0]), str(zlib.crc32((r[1] or "").encode()))) for r in rows)
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.external_shuffle(empty, 3).count() == 0


def test_tokens(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    write = lambda df: token_store.read_tokens(token_store.write_tokens(df, path, token_store.token_folder(df)))
    got = sorted(write(docs).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(path)
    assert listed(got, "doc_id", "n_tokens") == sorted(("" if r[0] is None else str(r[0]), str(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1)) for r in rows)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is None, k or 0))
    assert write(empty).count() == 0


def test_substring(docs, rows, empty):
    got = substring.substring_dedup(docs, keep=["lang", *CLASHES]).collect()
    pairs, number = numbered(rows)
    want = {d: (n, gone, sha) for d, n, gone, sha in brute.substring([(number[p], p[1]) for p in pairs])}
    assert listed(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(("" if r[0] is None else str(r[0]), *map(str, want[number[r[0], r[1] or ""]])) for r in rows)
    assert substring.substring_dedup(empty).count() == 0


def test_pages(spark):
    long = "y" * 3_000_000
    given = [(1, f"http://a.com/{long}", long), (2, "http://a.com/en/x", None), (2, "http://a.com/en/x", None), (None, None, ""), (None, "no scheme", "<link rel=canonical href=/z>"), (3, "http://b.org/es/", f"<link rel=canonical href=http://a.com/{long}>"), (4, f"http://www.a.com/{long}/", long)]
    pages = spark.createDataFrame([(*g, 7, 7, 7, 7, 7) for g in given], "page_id long, url string, html string, host long, path long, rule long, verdict long, payload long")
    rules = url_filters.rules_table(spark, queries.URL_RULES)
    edges = lambda p: url_filters.link_edges(p).unionByName(url_filters.canonical_edges(p))
    judged = url_filters.judge_urls(pages, rules, edges(pages)).collect()
    assert listed(judged, "page_id", "verdict") == sorted([("1", "block"), ("2", "block"), ("2", "block"), ("", "allow"), ("", "allow"), ("3", "block"), ("4", "block")])
    assert url_filters.judge_urls(pages.limit(0), rules, edges(pages.limit(0))).count() == 0
    read = warc.read_archives(warc.write_archives(warc.plan_records(pages))).collect()
    assert listed(read, "page_id", "payload_bytes", "gap_reason") == sorted(("" if g[0] is None else str(g[0]), str(len(g[2] or "")), "") for g in given)


@pytest.mark.parametrize("name", ["quality", "near_copies", "repeated_passages", "mixture", "encoding"])
def test_stages(spark, docs, name):
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)[name]
    given = docs.where("doc_id is null or doc_id > 2").select(*cp.COLUMNS)
    out = stage(spark, given, "/root/testdata/sf0.001")
    rows = out.collect()
    if name != "encoding":
        assert out.columns == cp.COLUMNS
    if name == "near_copies":
        assert sum(r["text"] == "same" for r in rows) == 1 and sum(not (r["text"] or "").strip() for r in rows) == 4
    if name == "encoding":
        assert len(rows) == given.count()
    assert stage(spark, given.limit(0), "/root/testdata/sf0.001").count() == 0
