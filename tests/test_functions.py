"""Scalar library on small cases."""

import pytest
from pyspark.sql import functions as F

from strataweave.functions import numeric as num
from strataweave.functions import text as tx


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(*columns).first()


def test_canonicalize_and_ranges(spark):
    text = "a\n// SWC-107-Reentrancy: L4\n\n  b(); // swc-101: L5\n\tc();  \n"
    c = one(spark, tx.canonicalize(F.col("t")).alias("c"), t=text)["c"]
    assert c["text"] == "a\n  b();\n    c();" and list(c["kept"]) == [1, 4, 5] and list(c["deleted"]) == [2, 3, 6]
    assert [tuple(m) for m in c["markers"]] == [(2, "SWC-107", True), (4, "SWC-101", False)]
    kept = F.array(*[F.lit(k) for k in c["kept"]])
    for a, b, want in ((4, 5, (2, 3)), (3, 5, (2, 3)), (1, 2, (1, 1)), (6, 6, (3, 3)), (-4, 99, (1, 3))):
        r = one(spark, tx.map_range(F.lit(a), F.lit(b), kept, F.lit(6)).alias("r"))["r"]
        assert tuple(r) == want
    none = F.array().cast("array<int>")
    assert tuple(one(spark, tx.map_range(F.lit(3), F.lit(4), none, F.lit(1)).alias("r"))["r"]) == (1, 1)


def test_layout_twins_are_equal(spark):
    texts = ["if (x) {\n\ty;\n}", "if (x) {   \n\n    y;\n}\n"]
    got = [one(spark, tx.canonicalize(F.col("t"))["text"].alias("t"), t=t)["t"] for t in texts]
    assert got[0] == got[1]


def test_tabs_go_to_column_stops(spark):
    for line in ("\ta", "ab\tc", "abcd\te\t\tf", "none", ""):
        assert one(spark, tx.expand_tabs(F.col("t")).alias("x"), t=line)["x"] == line.expandtabs(4)


@pytest.mark.parametrize(
    ("value", "kind", "ranges"),
    [("L21-23", "ranges", [(21, 23)]), ("L5, L9", "ranges", [(5, 5), (9, 9)]), ("L10-12、20-25", "ranges", [(10, 12), (20, 25)]), ("7-2；", "ranges", [(2, 7)]), ("L1，L3;L4", "ranges", [(1, 1), (3, 3), (4, 4)]), ("all contract", "whole", []), ("All", "whole", []), ("N/A", "none", []), ("", "none", []), (None, "none", []), ("// SWC-101", "marker", []), ("smaller", "none", []), ("L995.1009", "ranges", [(995, 1009)])],
)
def test_line_field(spark, value, kind, ranges):
    r = spark.createDataFrame([(value,)], "v string").select(tx.parse_line_field(F.col("v")).alias("p")).first()["p"]
    assert r["kind"] == kind and [tuple(x) for x in r["ranges"]] == ranges


def test_spans_fall_back_to_markers_then_file(spark):
    text = "// SWC-107\na\nb // SWC-107\n"
    spans = lambda field, swc: one(spark, tx.annotation_spans(F.lit(field), tx.canonicalize(F.col("t")), F.lit(swc)).alias("s"), t=text)["s"]
    assert [tuple(x) for x in spans("", "SWC-107")["spans"]] == [(1, 1), (2, 2)]
    assert [tuple(x) for x in spans("", "SWC-100")["spans"]] == [(1, 2)] and spans("", "SWC-100")["source"] == "unknown"
    assert [tuple(x) for x in spans("L2-3", "SWC-107")["spans"]] == [(1, 2)]


def test_identity_and_scope(spark):
    r = one(spark, tx.normalize_code(F.col("t")).alias("n"), tx.is_interface_only(F.col("t")).alias("i"), t=" interface A {} /* x\n*/ // y\n  interface B {} ")
    assert r["n"] == "interface A {} interface B {}" and r["i"]
    reason = lambda text, path, labelled: one(spark, tx.scope_reason(F.lit(text), F.lit(path), F.lit(labelled)).alias("r"))["r"]
    assert reason(" \n", "a.sol", False) == "empty" and reason("x", "test/a.sol", False) == "test_mock"
    assert reason("interface I {}", "a.sol", False) == "interface_only" and reason("", "test/a.sol", True) is None


def test_decode(spark):
    df = spark.createDataFrame([(b"\xef\xbb\xbfa\r\nb\rc",), (b"caf\xe9",)], "b binary").select(tx.decode_bytes(F.col("b")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["a\nb\rc", "café"]


def test_shingles_and_line_starts(spark):
    r = one(spark, tx.shingles(tx.words(F.col("t")), 2).alias("g"), tx.line_starts(F.col("t")).alias("s"), t="a b a b\nc")
    assert list(r["g"]) == ["a b", "b a", "b c"] and list(r["s"]) == [0, 8]
    r = one(spark, tx.shingles(tx.words(F.col("t")), 5).alias("g"), t="")
    assert list(r["g"]) == [""]


def test_scores(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan,), (inf,), (-inf,), (3.0,)], "x double")
    assert [r[0] for r in df.select(num.finite(F.col("x"))).collect()] == [0.0, 20.0, -20.0, 3.0]
    assert [round(r[0], 3) for r in df.select(num.sigmoid(F.col("x"))).collect()][1:] == [1.0, 0.0, 0.953]
    loss = one(spark, num.weighted_bce(F.lit(0.0), F.lit(1.0), F.lit(3.0)).alias("l"))["l"]
    assert abs(loss - 3 * 0.6931471805599453) < 1e-12
