"""Commands end to end on a small generated checkout; sources and sinks."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from strataweave import cli
from strataweave.plans import build, evaluate
from strataweave.sources import files as src
from strataweave.sources import sinks
from strataweave.streaming.dedup import first_arrivals


def workbook(path, rows):
    """A small .xlsx: shared and inline strings, sparse cells."""
    shared = sorted({c for r in rows for c in r if c})
    cells = lambda r, n: "".join(f'<c r="{chr(65 + i)}{n}" t="s"><v>{shared.index(c)}</v></c>' if n % 2 else f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{c}</t></is></c>' for i, c in enumerate(r) if c)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{n}">{cells(r, n)}</row>' for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>")


@pytest.fixture(scope="module")
def checkout(tmp_path_factory):
    root = tmp_path_factory.mktemp("checkout")
    rng = random.Random(4)
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    audits = [["File Name", "Audit Company", "Project Name", "Audit Report Link", "Code Repository"]]
    for a in range(10):
        audits.append([f"audit{a}", "co", f"p{a}", "", f"https://github.com/own/repo{a % 6}"])
        for i in range(9):
            risky = rng.random() < 0.4
            body = [f"  uint {rng.choice(names)}{rng.randint(0, 99)} = {rng.randint(0, 9)};" for _ in range(rng.randint(5, 40))]
            if risky:
                body[2:2] = ["\t// SWC-107-Reentrancy: L4", "  call.value(x)();"]
            at = root / "contracts" / f"audit{a}"
            at.mkdir(parents=True, exist_ok=True)
            (at / f"F{i}.sol").write_text("\n".join([f"contract C{a}x{i} {{", *body, "}", ""]))
            if risky:
                notes = root / "annotations" / f"audit{a}"
                notes.mkdir(parents=True, exist_ok=True)
                (notes / f"F{i}.json").write_text(json.dumps({"filePath": f"x/audit{a}/F{i}.sol", "SWCs": [{"category": "SWC-107-Reentrancy", "lineNumber": "L4"}]}))
        (root / "contracts" / f"audit{a}" / "ITest.t.sol").write_text("contract T {}")
    workbook(root / "audits.xlsx", audits)
    (root / ".git").mkdir()
    (root / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (root / ".git" / "packed-refs").write_text("# pack-refs\nabc123 refs/heads/main\n")
    return root


@pytest.fixture(scope="module")
def built(spark, checkout, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("table") / "t.parquet")
    return out, build.build(spark, str(checkout), out, prefix="x/", min_class_files=5)


def test_build(spark, built):
    out, meta = built
    rows = spark.read.parquet(out).collect()
    assert meta["counts"]["dropped_test_mock"] == 10 and meta["source_commit"] == "abc123"
    assert [c["swc"] for c in meta["classes"]] == ["SWC-107"] and sum(meta["classes"][0]["per_fold"]) == meta["classes"][0]["n_files"]
    assert sorted(r["row_id"] for r in rows) == list(range(len(rows)))
    folds = {}
    for r in rows:
        assert "SWC-" not in r["source_code"] and "\n\n" not in r["source_code"] and "\t" not in r["source_code"]
        spans = json.loads(r["spans_json"])
        assert sorted({s["cls"] for s in spans}) == list(r["labels"])
        for s in spans:
            assert 1 <= s["start"] <= s["end"] <= r["n_lines"] and "call.value" in r["source_code"].split("\n")[s["start"] - 1]
        assert folds.setdefault(r["group_id"], r["fold"]) == r["fold"]
        assert r["codebase"].startswith("github:own/repo")
    assert src.read_meta(out)["fingerprint"] == meta["fingerprint"]
    card = build.data_card(meta)
    assert "| 0 | SWC-107 | Reentrancy |" in card and "| ranges |" in card and "## Annotated lines" in card
    side = out.replace(".parquet", ".meta.json")
    kept = open(side).read()
    os.remove(side)  # the metadata is in the footers too
    assert src.read_meta(out)["fingerprint"] == meta["fingerprint"]
    open(side, "w").write(kept)
    tax = src.taxonomy(spark, meta).collect()
    assert len(tax) == 1 and tax[0]["title"] == "Reentrancy" and tax[0]["scored"]


def test_annotation_without_file_is_refused(spark):
    raw = spark.createDataFrame([("a/x.sol", "x")], "rel_path string, text string")
    notes = spark.createDataFrame([("a/y.sol", "SWC-1", "1")], "rel_path string, category string, line_field string")
    with pytest.raises(ValueError):
        build.clean_files(raw, notes)


def test_balance_and_runs(spark, built, tmp_path):
    out, _ = built
    bal = str(tmp_path / "b.parquet")
    meta = build.balance(spark, out, bal)
    assert meta["counts"]["positive_rows"] >= meta["counts"]["negative_rows"] > 0
    assert sum(p["labelled"] for p in meta["balance"]["per_fold"]) == meta["counts"]["positive_rows"] == sum(meta["classes"][0]["per_fold"])
    assert "| all |" in (tmp_path / "b.card.md").read_text()
    runs = str(tmp_path / "runs")
    config = evaluate.RunConfig.load(table=out, out=runs, test_fold=0, val_fold=1, max_length=50)
    report = evaluate.dry_run(spark, config)
    assert report["train"]["label_visibility"] == 1.0 and report["sample"]["positive"] > 0
    a = evaluate.baseline(spark, config, run="m_f0")
    b = evaluate.tfidf(spark, config, run="n_f0", max_features=300)
    assert 0 <= a["f1"] <= 1 and b["macro_ap"] > 0.9
    mixed = evaluate.blend(spark, config, f"{runs}/m_f0", f"{runs}/n_f0")
    assert mixed["weight"] <= 0.5
    gated = evaluate.moe(spark, config, [f"{runs}/m_f0", f"{runs}/n_f0"], epochs=60, hidden=32, rate=0.01, batch=16, patience=60)
    assert gated["moe"]["best_val_macro_ap"] > 0.8 and abs(sum(gated["moe"]["mean_gate_weight_test"].values()) - 1) < 1e-3
    assert json.loads((tmp_path / "runs" / "moe" / "gate.json").read_text())["n_experts"] == 2
    with pytest.raises(ValueError, match="two runs"):
        evaluate.moe(spark, config, [f"{runs}/m_f0"])
    text = evaluate.collect(spark, runs)
    assert "n_f0" in text and "different datasets" not in text
    assert "| m | 0 |" in evaluate.cv_summary(spark, runs)


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("table: t  # where\nout: o\nseed: 7\noverlap: 0.5\n")
    c = evaluate.RunConfig.load(str(path), seed=9)
    assert (c.table, c.seed, c.overlap) == ("t", 9, 0.5)
    for bad in ({"what": 1}, {"test_fold": 1, "val_fold": 1}, {"overlap": 1.0}, {"input_mode": "x"}):
        with pytest.raises((ValueError, TypeError)):
            evaluate.RunConfig.load(str(path), **bad)


def test_sources(spark, tmp_path):
    assert [src.column_index(x) for x in ("A1", "Z9", "AA1", "AB12")] == [0, 25, 26, 27]
    assert src.read_pairs(spark, str(tmp_path / "none.csv")).count() == 0
    pairs = spark.createDataFrame([(1, 2, 0.123456)], src.PAIRS)
    sinks.write_pairs(pairs, str(tmp_path / "p.csv"))
    assert src.read_pairs(spark, str(tmp_path / "p.csv")).first()["jaccard"] == 0.1235
    for bad in ({"classes": [{"index": 1, "swc": "a"}]}, {"classes": [{"index": 0, "swc": "a"}], "eval_classes": [4]}):
        with pytest.raises(ValueError):
            src.taxonomy(spark, bad)
    with pytest.raises(FileNotFoundError):
        src.read_meta(str(tmp_path / "x.parquet"))
    import pyarrow as pa
    import pyarrow.parquet as pq

    other = pa.table({"row_id": [1]}).replace_schema_metadata({"other_meta": json.dumps({"classes": [], "version": "v"}), "flat_meta": "[1]"})
    pq.write_table(other, tmp_path / "other.parquet")
    assert src.read_meta(str(tmp_path / "other.parquet")) == {"classes": [], "version": "v"}
    head = [f" {c}" for c in src.AUDIT_COLUMNS]
    rows = [(0, head), (1, ["n", "old"]), (2, [" n ", "c"]), (3, ["", "x"])]
    table = spark.createDataFrame(rows, "row_no long, cells array<string>")
    assert [tuple(r) for r in src.audit_index(table).collect()] == [("n", "c", "", "", "")]
    with pytest.raises(Exception, match="no column"):
        src.audit_index(table.select("row_no", F.slice("cells", 1, 3).alias("cells"))).collect()


def test_cli_parses():
    a = cli.parser().parse_args(["build", "--raw", "r", "--out", "o", "--keep-tests"])
    assert a.keep_tests and a.min_class_files == 20
    with pytest.raises(SystemExit):
        cli.main(["train"])


def test_stream(spark, tmp_path):
    at = tmp_path / "in"
    spark.createDataFrame([("a b", 1), ("a  b", 2), ("c", 3)], "text string, s long").select("text", F.timestamp_seconds("s").alias("ts")).write.parquet(str(at))
    stream = spark.readStream.schema("text string, ts timestamp").parquet(str(at))
    q = first_arrivals(stream).writeStream.format("memory").queryName("arrived").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").count() == 2


def test_queries_have_twins():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
