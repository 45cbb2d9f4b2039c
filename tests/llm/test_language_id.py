"""Language identification: Viterbi against a plain one, spans of mixed texts, held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import language_id as li, queries

VOCAB = {
    "en": "the and of with that this house water people would there other which about".split(),
    "de": "der und nicht mit dass dieses haus wasser leute würde dort andere welche über".split(),
    "ru": "и в не на что этот дом вода люди было там другой который около".split(),
    "uk": "і в не на що цей дім вода люди було там інший який біля".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(prose(rng, lang, 40), lang) for lang in VOCAB for _ in range(30)] + [(None, "en"), ("", "de"), ("x", None)]
    return li.learn_languages(spark.createDataFrame(rows, "text string, lang string").repartition(4))


def plain_path(score, switch, start):
    """Viterbi one word after another: staying goes before switching, then the lowest state."""
    k, best, back = score.shape[1], list(start), []
    for row in score:
        top = max(range(k), key=lambda s: (best[s], -s))
        came = [s if best[s] >= best[top] - switch else top for s in range(k)]
        back.append(came)
        best = [max(best[s], best[top] - switch) + row[s] for s in range(k)]
    at = max(range(k), key=lambda s: (best[s], -s))
    out = []
    for came in reversed(back):
        out.append(at)
        at = came[at]
    return out[::-1]


@pytest.mark.parametrize("run", [1, 3, 128])
def test_paths_in_runs_are_those_of_one_pass(run):
    rng = np.random.default_rng(run)
    for _ in range(60):
        count = rng.integers(0, 25, rng.integers(1, 6))
        ptr = np.concatenate([[0], np.cumsum(count)])
        k = int(rng.integers(1, 5))
        score = rng.integers(-9, 1, (ptr[-1], k)).astype(float)  # whole numbers: sums are exact
        start = rng.integers(-5, 1, k).astype(float)
        got = li.best_paths(score, ptr, 3.0, start, run)
        want = [s for a, b in zip(ptr[:-1], ptr[1:], strict=True) for s in plain_path(score[a:b], 3.0, start)]
        assert got.tolist() == want


def test_word_scores_are_sums_over_pairs_and_triples(model):
    w = li.LetterRuns(pa.array(["Über 12 haus!", "", "x"]))
    assert [("".join(map(chr, w.points[a:b]))) for a, b in zip(w.start, w.end, strict=True)] == ["über", "haus", "x"]
    score, fits = li.word_scores(w, model)
    for i, word in enumerate(["über", "haus", "x"]):
        points = [0, *map(ord, word), 0]
        keys = [points[j - 1] | points[j] << 21 for j in range(1, len(points))]
        keys += [points[j - 1] | points[j] << 21 | (points[j - 2] if j > 1 else 0) << 42 for j in range(1, len(points))]
        at = (li.mix(np.array(keys, np.uint64)) & np.uint64(li.BUCKETS - 1)).astype(int)
        want = model.table[at].astype(float).sum(0)
        names = np.array(model.names)
        assert set(names[fits[i]]) == {"de", "en"}
        assert np.allclose(score[i][fits[i]], want[fits[i]]) and (score[i][~fits[i]] == li.RULED_OUT).all()
    assert len(li.word_scores(w, model, block=3)[0]) == 3 and np.allclose(li.word_scores(w, model, block=3)[0], score)


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(4)
    english, german, russian = prose(rng, "en", 30), prose(rng, "de", 20), prose(rng, "ru", 10)
    text = f"{english}. {german}! {russian}"
    row = li.identify_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"]
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == [english, german, russian]
    letters = [sum(c.isalpha() for c in t) for t in (english, german, russian)]
    assert row["lang_pred"] == "en" and row["score"] == pytest.approx(letters[0] / sum(letters)) and row["n_spans"] == 3


def test_places_are_those_of_the_text(spark, model):
    text = "İ 12 \U0001f600 the house и вода"
    row = li.identify_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]][-1] == "и вода"


def test_script_narrows_candidates(spark, model):
    rows = [(1, "вода вода the вода"), (2, "ελληνικά"), (3, "漢字 the house"), (4, "12 !? 7"), (5, None), (6, ""), (7, " \n")]
    got = {r["doc_id"]: r for r in li.identify_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1]["lang_pred"] in ("ru", "uk")
    assert got[2]["lang_pred"] in model.names and got[2]["score"] == 0  # no language was seen in this script
    assert got[3]["lang_pred"] == "en" and 0.5 < got[3]["score"] < 1
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["n_spans"]) == ("und", 0, 0) for i in (4, 5, 6, 7))


def test_edges(spark, model):
    rng = random.Random(7)
    rows = [(1, prose(rng, "de", 800_000)), (2, "x" * 4_000_000), (3, "the house"), (3, "the house"), (None, "дом")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", *[F.lit(5).alias(c) for c in ("lang", "lang_pred", "score", "spans", "n_spans", "_said")])
    got = li.identify_languages(df, model).collect()
    assert sorted(got[0].asDict()) == ["_said", "doc_id", "lang", "lang_pred", "n_spans", "score", "spans", "text"]
    assert {(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] in (1, 3)} == {(1, "de"), (3, "en")} and len(got) == 5
    assert all(0 <= r["score"] <= 1 for r in got)
    assert li.identify_languages(df.limit(0), model).collect() == []
    none = li.learn_languages(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in li.identify_languages(df, none).collect()} == {("und", 0.0)}


def test_held_out_accuracy_and_inputs(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, rng.randint(3, 40)), lang if i % 11 else None, f"s{i % 3}") for i in range(600) for lang in [rng.choice(list(VOCAB))]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op11_language_id(spark, str(tmp_path)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got) and len(got) == 600
    held = [(got[r[0]]["lang_pred"], r[2]) for r in rows if r[2] and got[r[0]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    # labels of held-out documents change nothing
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, None) for i, t, lang, _ in rows]
    spark.createDataFrame(other, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    again = {r["doc_id"]: r for r in queries.op11_language_id(spark, str(tmp_path / "b")).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == (again[i]["lang_pred"], again[i]["score"]) for i in got)
