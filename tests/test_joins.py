"""Joins by place against all pairs; spans on line indexes; the windows' table function; batch files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataweave.operators import dedup, intervals, windows
from strataweave.sources import batches


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps(spark, width):
    rng = random.Random(width)
    span = lambda: sorted((rng.randint(-20, 60), rng.randint(-20, 60)))
    left = [(rng.choice("ab"), i, *span()) for i in range(60)] + [("a", 60, 9, 3), ("a", 61, None, 5), (None, 62, 0, 9)]
    right = [(rng.choice("ab"), i, *span()) for i in range(50)] + [("b", 50, -20, 60), ("b", 50, -20, 60), (None, 51, 0, 9), ("a", 52, 4, None)]
    x = spark.createDataFrame(left, "k string, i int, a0 int, a1 int")
    y = spark.createDataFrame(right, "k string, j int, b0 int, b1 int")
    got = sorted((r["k"], r["i"], r["j"]) for r in intervals.overlap_join(x, y, ["k"], width).collect())
    assert got == sorted((k, i, j) for k, i, a, b in left for k2, j, c, d in right if k is not None and k == k2 and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b)
    assert intervals.overlap_join(x.limit(0), y, ["k"], width).count() == 0


def test_as_of(spark):
    rng = random.Random(8)
    right = [("hot", rng.randint(0, 900), f"v{i}") for i in range(300)] + [("few", 5, "x"), ("few", 5, "y"), (None, 3, "n"), ("few", None, "lost")]
    left = [("hot", rng.randint(-5, 1000), i) for i in range(400)] + [("few", t, t) for t in (4, 5, 6)] + [(None, 9, 1), ("none", 1, 2), ("few", None, 7), ("few", 5, 5)]
    df = spark.createDataFrame(left, "k string, at int, i int").repartition(5).withColumn("found_", F.lit(0))
    got = sorted(((r["k"] or "", -99 if r["at"] is None else r["at"], r["i"], tuple(r["found"]) if r["found"] else None) for r in intervals.as_of_join(df, spark.createDataFrame(right, "k string, at int, v string"), ["k"], "at").collect()), key=str)
    find = lambda k, t: max(((a, v) for k2, a, v in right if k2 == k and a is not None and t is not None and a <= t), default=None)
    assert got == sorted(((k or "", -99 if t is None else t, i, find(k, t)) for k, t, i in left), key=str)


def test_a_hot_key_lies_in_several_partitions(spark, monkeypatch):
    kept, real = [], intervals.materialize
    monkeypatch.setattr(intervals, "materialize", lambda df, name: kept.append(real(df, name)) or kept[-1])
    left = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    marks = left.where("at % 100 = 0").withColumn("v", F.col("at") * 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = intervals.as_of_join(left, marks, ["k"], "at")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.where("found.v != 2 * (at - at % 100)").count() == 0 and got.count() == 4000
    assert kept[0].select("_part").distinct().count() > 1


def map_plain(src, dst, spans):
    src, dst = [[x.strip() for x in (t or "").split("\n")] for t in (src, dst)]

    def find(n):
        key = src[n - 1] if n is not None and 0 < n <= len(src) else ""
        hits = [i for i, x in enumerate(dst, 1) if x == key and key]
        return min(hits, key=lambda h: (abs(h - n * len(dst) / len(src)), h), default=None)

    out = []
    for a, b in spans:
        x, y = find(a), find(b)
        out.append((1, len(dst)) if x is None or y is None else (min(x, y), max(x, y)))
    return out


def test_spans_against_a_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda: "\n".join(rng.choice(["a", " b ", "c", "", "}", "}"]) for _ in range(rng.randint(1, 30)))
    texts = [text() for _ in range(8)] + [None, ""]
    rows = [(i, rng.randrange(10), rng.randrange(10), rng.choice([None, 0, 1, 5, 29, 40]), rng.randint(1, 30)) for i in range(200)]
    cut, real = [], dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, name: (cut.append((name, real(df, name))), cut[-1][1])[1])
    spans = spark.createDataFrame(rows, "span_id long, src int, dst int, start int, end int")
    got = {r["span_id"]: (r["new_start"], r["new_end"]) for r in dedup.map_spans(spans, spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")).collect()}
    assert got == {i: map_plain(texts[s], texts[d], [(a, b)])[0] for i, s, d, a, b in rows}
    # each text is cut once, however many spans name it
    assert dict(cut)["lines"].count() == sum(len((t or "").split("\n")) for t in texts)


def test_windows_by_table_function(spark):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice(["Alpha", "b_2", "+", "été"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 40))) for _ in range(12)] + ["", "\n\n", "one", None]
    files = spark.createDataFrame([(i, t, [], []) for i, t in enumerate(texts)], "row_id long, text string, spans array<struct<cls:int,start:int,end:int>>, labels array<int>")
    windows.register_windows(spark)
    files.createOrReplaceTempView("some_files")
    for body, overlap in ((7, 0.25), (40, 0.0), (1, 0.5)):
        got = spark.sql(f"select f.row_id, w.* from some_files f, lateral text_windows(f.text, {body}, {overlap}D) w where f.text is not null")
        want = windows.build_windows(files.where("text is not null"), body, overlap).select("row_id", "win", "s", "e", "l0", "l1", "tokens")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("select * from text_windows(cast(null as string), 5, 0.25D)").collect()[0]["tokens"] == []
    for wrong in ("5, 1.5D", "0, 0.5D", "cast(rand() as int), 0.5D"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"select * from text_windows('a b', {wrong})").collect()


def test_a_windower_of_ones_own(spark):
    class Letters(windows.LineWindower):
        token_type = "int"

        def body(self, length):
            return length - 2  # room for a frame

        def tokenize(self, text):
            return [(ord(c), 1) for c in text]

    windows.register_windows(spark, "letter_windows", Letters())
    got = spark.sql("select * from letter_windows('abcde', 4, 0.0D)")
    assert dict(got.dtypes)["tokens"] == "array<int>"
    assert [r["tokens"] for r in got.collect()] == [[97, 98], [99, 100], [100, 101]]


def test_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.randint(2, 99) for _ in range(rng.choice([0, 1, 7, 8, 9, 30, 500]))], [i % 4] * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, ids array<int>, labels array<int>").withColumn("length", F.size("ids")).repartition(5)
    placed = batches.token_batches(df, 256, 3)
    at = str(tmp_path / "b")
    batches.write_batches(placed, at, per_file=5)
    back = [r.asDict() for r in batches.read_batches(spark, at).collect()]
    assert sorted((r["row_id"], r["ids"][: r["length"]], r["labels"]) for r in back) == sorted(rows)
    by_batch = {}
    for r in back:
        by_batch.setdefault((r["part"], r["batch"]), []).append(r)
        assert r["mask"] == [1] * r["length"] + [0] * (len(r["ids"]) - r["length"]) and not any(r["ids"][r["length"] :])
    for held in by_batch.values():
        widths = {len(r["ids"]) for r in held}
        assert len(widths) == 1 and widths.pop() % 8 == 0
        assert sum(len(r["ids"]) for r in held) <= 256 or len(held) == 1
    # rows of like length are together: less padding than in the given order
    assert sum(len(r["ids"]) for r in back) < 0.6 * len(rows) * 504
    manifest = json.loads((tmp_path / "b" / "manifest.json").read_text())
    assert manifest["rows"] == 300 and manifest["tokens"] == sum(len(r["ids"]) for r in back)
    assert {f["file"] for f in manifest["files"]} == {p.name for p in (tmp_path / "b").glob("*.arrow")}
    assert all(len(f["batches"]) <= 5 for f in manifest["files"]) and not list((tmp_path / "b").glob("_staging*"))
    batches.write_batches(placed.where("row_id < 9"), at)  # replaces the files
    assert batches.read_batches(spark, at).count() == 9
    assert len(list((tmp_path / "b").glob("*.arrow"))) == len(json.loads((tmp_path / "b" / "manifest.json").read_text())["files"])
    batches.write_batches(placed.limit(0), str(tmp_path / "none"))
    assert batches.read_batches(spark, str(tmp_path / "none")).collect() == []
