"""Logits archives: numpy reads what we write, and we read what numpy writes, by ranges."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.sources import files as src
from strataweave.sources import npz

CLASSES = ["SWC-101", "SWC-104", "SWC-107"]


def archive(path, rows, seed, compressed=False, **extra):
    rng = np.random.default_rng(seed)
    data = {"logits": rng.standard_normal((rows, 3)).astype(np.float32), "labels": (rng.random((rows, 3)) < 0.3).astype(np.uint8), "row_id": rng.permutation(rows * 7)[:rows], "classes": np.asarray(CLASSES)} | extra
    path.parent.mkdir(parents=True, exist_ok=True)
    (np.savez_compressed if compressed else np.savez)(path, **data)
    return data


def cells(data, run, split):
    ids = data["row_id"] if len(data["row_id"]) else np.arange(len(data["logits"]))
    flags = data.get("exposed", [])
    return {(run, split, int(r), c, CLASSES[c], float(data["logits"][i, c]), int(data["labels"][i, c]), bool(flags[i]) if len(flags) else None) for i, r in enumerate(ids) for c in range(3)}


@pytest.mark.parametrize("compressed", [False, True])
def test_reads_what_numpy_writes(spark, tmp_path, compressed):
    a = archive(tmp_path / "one" / "logits_val.npz", 500, 1, compressed, exposed=np.zeros(0, np.uint8))
    b = archive(tmp_path / "deep" / "two" / "logits_test.npz", 77, 2, compressed, exposed=np.arange(77) % 2)
    c = archive(tmp_path / "two" / "logits_train.npz", 9, 3, compressed, row_id=np.zeros(0))
    (tmp_path / "two" / "thresholds.npz").write_bytes(b"not logits")
    df = npz.read_npz(spark, str(tmp_path), partition_bytes=1500)
    got = {tuple(r) for r in df.collect()}
    assert got == cells(a, "one", "val") | cells(b, "two", "test") | cells(c, "two", "train")
    # 15 bytes a row: 100 rows a partition where members are stored
    assert df.rdd.getNumPartitions() == (3 if compressed else 7)


@pytest.mark.parametrize("compression", ["stored", "deflated"])
def test_numpy_opens_what_we_write(spark, tmp_path, compression):
    rng = np.random.default_rng(5)
    values = rng.standard_normal((400, 3)).astype(np.float32)
    rows = [("m", "val" if i % 3 else "test", 1000 - i, c, float(values[i, c]), (i + c) % 2, i % 5 == 0) for i in range(400) for c in range(3)]
    df = spark.createDataFrame(rows, "run string, split string, row_id long, cls int, logit double, y int, exposed boolean").repartition(6)
    npz.write_npz(df, str(tmp_path / "runs"), CLASSES, compression)
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["runs/m/logits_test.npz", "runs/m/logits_val.npz"]
    for split in ("val", "test"):
        with np.load(tmp_path / "runs" / "m" / f"logits_{split}.npz", allow_pickle=False) as z:
            own = [i for i in range(399, -1, -1) if bool(i % 3) == (split == "val")]
            assert z["row_id"].tolist() == [1000 - i for i in own]
            assert (z["logits"] == values[own]).all() and z["logits"].dtype == np.float32
            assert z["labels"].tolist() == [[(i + c) % 2 for c in range(3)] for i in own] and z["labels"].dtype == np.uint8
            assert z["classes"].tolist() == CLASSES and z["exposed"].tolist() == [int(i % 5 == 0) for i in own]
    back = {tuple(r) for r in npz.read_npz(spark, str(tmp_path / "runs"), 100).collect()}
    assert back == {(run, split, r, c, CLASSES[c], np.float32(x).item(), y, e) for run, split, r, c, x, y, e in rows}


def test_large_splits_are_dealt_into_archives(spark, tmp_path):
    df = spark.range(90).select(F.lit("m").alias("run"), F.lit("val").alias("split"), F.col("id").alias("row_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cls")).withColumns({"logit": F.col("row_id") + F.col("cls") / 4, "y": F.lit(1)})
    at = str(tmp_path / "r")
    npz.write_npz(df, at, CLASSES, rows_per_file=25)
    assert sorted(p.name for p in (tmp_path / "r" / "m").glob("*.npz")) == [f"logits_val.{i:05d}.npz" for i in range(4)]
    got = npz.read_npz(spark, at)
    assert got.count() == 270 and got.where("exposed is not null").count() == 0
    assert got.select("row_id", "cls", "logit").exceptAll(df.selectExpr("row_id", "cls", "cast(logit as float) logit")).count() == 0
    npz.write_npz(df.where("row_id < 3"), at, CLASSES)  # replaces them
    assert sorted(p.name for p in (tmp_path / "r" / "m").glob("*.npz")) == ["logits_val.npz"]


def test_a_task_reads_its_range_only(tmp_path):
    data = archive(tmp_path / "m" / "logits_val.npz", 100_000, 4)

    class Counted:
        def __init__(self, f):
            self.f, self.bytes = f, 0

        def read(self, n=-1):
            out = self.f.read(n)
            self.bytes += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

    with open(tmp_path / "m" / "logits_val.npz", "rb") as f:
        counted = Counted(f)
        found = npz.describe(counted)
        headers, counted.bytes = counted.bytes, 0
        assert found.rows == 100_000 and found.classes == CLASSES and headers < 50_000
        got = list(npz._blocks(counted, found, 60_000, 60_500, 200))
        assert counted.bytes == 500 * (3 * 4 + 3 + 8)
        assert [a for a, _ in got] == [60_000, 60_200, 60_400]
        assert (np.concatenate([h["logits"] for _, h in got]) == data["logits"][60_000:60_500]).all()


def test_what_can_not_be_read_or_written_is_an_error(spark, tmp_path):
    def fails(match, **extra):
        archive(tmp_path / "bad" / "logits_val.npz", 4, 1, **extra)
        with pytest.raises(Exception, match=match):
            npz.read_npz(spark, str(tmp_path / "bad")).collect()

    fails("one shape", labels=np.zeros((4, 2), np.uint8))
    fails("row_id has shape", row_id=np.arange(3))
    fails("class names", classes=np.asarray(["a"]))
    fails("row order", logits=np.asfortranarray(np.zeros((4, 3), np.float32)))
    whole = spark.createDataFrame([("m", "val", 1, c, 0.5, 0) for c in range(3)], "run string, split string, row_id long, cls int, logit double, y int")
    with pytest.raises(Exception, match="not every class once"):
        npz.write_npz(whole.where("cls < 2"), str(tmp_path / "w"), CLASSES)
    with pytest.raises(Exception, match="file's name"):
        npz.write_npz(whole.withColumn("split", F.lit("a/b")), str(tmp_path / "w"), CLASSES)
    assert not list((tmp_path / "w").rglob("*.npz")) and not list((tmp_path / "w").glob("_staging*"))
    assert npz.read_npz(spark, str(tmp_path / "w")).count() == 0


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    writer = npz.NpzWriter({"path": str(tmp_path), "classes": "\n".join(CLASSES)}, False)
    rows = pa.RecordBatch.from_pylist([{"run": "m", "split": "val", "shard": -1, "row_id": 1, "logits": [0.5, 1.0, 2.0], "labels": [0, 1, 0], "exposed": None}], pa.schema([("run", pa.string()), ("split", pa.string()), ("shard", pa.int32()), ("row_id", pa.int64()), ("logits", pa.list_(pa.float32())), ("labels", pa.list_(pa.int32())), ("exposed", pa.bool_())]))
    writer.write(iter([rows]))  # of a lost executor
    counts = writer.write(iter([rows]))
    assert not list(tmp_path.rglob("logits_*.npz"))
    writer.commit([counts, None])
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["m/logits_val.npz"]
    writer.abort([counts])


def test_runs_of_archives_feed_the_commands(spark, tmp_path):
    data = archive(tmp_path / "ext" / "logits_val.npz", 30, 7, True)
    (tmp_path / "ext" / "test_results.json").write_text(json.dumps({"f1": 0.5}))
    got = src.read_run(spark, str(tmp_path / "ext"))
    assert {(r["split"], r["row_id"], r["cls"], r["logit"], r["y"]) for r in got.collect()} == {("val", r, c, x, y) for _, _, r, c, _, x, y, _ in cells(data, "ext", "val")}
