"""Readers: raw source files, workbooks, annotations, tables with metadata, results."""

from __future__ import annotations

import io
import json
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from strataweave.functions.text import decode_bytes
from strataweave.session import path_exists, read_text
from strataweave.sources.npz import read_npz
from strataweave.sources.sinks import META

# Header names of the workbook (fixed values)
AUDIT_COLUMNS = {"File Name": "audit_dir", "Audit Company": "company", "Project Name": "project", "Audit Report Link": "report", "Code Repository": "repo"}
PAIRS = "row_a long, row_b long, jaccard double"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_sources(spark: SparkSession, root: str, pattern: str = "*.sol") -> DataFrame:
    """(rel_path, text) of all files below root: one partitioned scan, decoded in SQL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split(":", 1)[-1].rstrip("/") if "://" not in root else re.sub(r"^[a-z]+://", "", root).rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base) + "/", "")
    return files.select(rel.alias("rel_path"), decode_bytes(F.col("content")).alias("text"))


def column_index(reference: str) -> int:
    """0-based column of a cell reference such as AB12."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - ord("A") + 1
    return n - 1


def workbook_rows(data: bytes) -> list[list[str]]:
    """Rows of the first sheet (by name) of an .xlsx workbook; absent cells are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        joined = lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEET}t"))
        shared = [joined(i) for i in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        out = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_SHEET}row"):
            cells = {}
            for cell in row.iter(f"{_SHEET}c"):
                value = cell.findtext(f"{_SHEET}v") or ""
                kind = cell.get("t")
                cells[column_index(cell.get("r"))] = joined(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: (row_no, cells) of a small .xlsx file."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "row_no long, cells array<string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _WorkbookReader(self.options["path"])


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        with system.open_input_file(at) as f:
            data = f.read()
        yield from enumerate(workbook_rows(data))


def audit_index(rows: DataFrame) -> DataFrame:
    """(audit_dir, company, project, report, repo) of workbook rows (row_no, cells), by header name.

    Cells are trimmed, rows without a file name dropped; of repeated names the last row counts. A missing column is an error.
    """
    head = rows.where("row_no = 0").select(F.transform("cells", lambda c: F.trim(c)).alias("head"))  # one row

    def at(name: str):
        place = F.array_position("head", name).cast("int")
        checked = F.when(place > 0, place).otherwise(F.raise_error(F.lit(f"no column {name!r}")).cast("int"))
        return F.trim(F.coalesce(F.try_element_at("cells", checked), F.lit("")))

    named = rows.where("row_no > 0").crossJoin(F.broadcast(head)).select("row_no", *[at(n).alias(c) for n, c in AUDIT_COLUMNS.items()]).where("audit_dir != ''")
    fields = [c for c in AUDIT_COLUMNS.values() if c != "audit_dir"]
    return named.groupBy("audit_dir").agg(F.max_by(F.struct(*fields), "row_no").alias("r")).select("audit_dir", "r.*")


def read_annotations(spark: SparkSession, root: str, prefix: str, pattern: str = "*.json") -> DataFrame:
    """(rel_path, category, line_field): one row for each annotation of the JSON files below root; of equal paths the last file counts.

    A file holds an annotated file, or an array of them. A path without the prefix is an error.
    """
    schema = "filePath string, SWCs array<struct<category:string,lineNumber:string>>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root).withColumn("file", F.col("_metadata.file_path"))
    checked = F.when(F.col("filePath").startswith(prefix), F.substring(F.col("filePath"), F.lit(len(prefix) + 1), F.length("filePath"))).otherwise(F.raise_error(F.concat(F.lit("unexpected path "), F.coalesce("filePath", F.lit("null")))))
    last = raw.select(checked.alias("rel_path"), "file", "SWCs").groupBy("rel_path").agg(F.max_by("SWCs", "file").alias("SWCs"))
    return last.select("rel_path", F.explode_outer("SWCs").alias("a")).select("rel_path", F.col("a.category").alias("category"), F.col("a.lineNumber").alias("line_field"))


def footer_values(spark: SparkSession, path: str) -> dict[str, str]:
    """Key-value metadata of a Parquet file, or of a folder's first one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    if system.getFileStatus(at).isDirectory():
        at = min((f.getPath() for f in system.listStatus(at) if f.getPath().getName().endswith(".parquet")), key=lambda p: p.getName(), default=None)
        if at is None:
            return {}
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
    try:
        return dict(reader.getFooter().getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()


def read_meta(path: str, spark: SparkSession | None = None) -> dict:
    """Metadata of a table: the JSON beside it, else from its first column or its footer.

    A footer of another writer counts if a key that ends in ``_meta`` holds a JSON document with classes.
    """
    spark = spark or SparkSession.active()
    side = re.sub(r"\.parquet$", "", path) + ".meta.json"
    if path_exists(spark, side):
        return json.loads(read_text(spark, side))
    if path_exists(spark, path):
        for field in spark.read.parquet(path).schema.fields:
            if META in field.metadata:
                return json.loads(field.metadata[META])
        for key, value in sorted(footer_values(spark, path).items()):
            if key.endswith("_meta"):
                found = json.loads(value)
                if isinstance(found, dict) and "classes" in found:
                    return found
    raise FileNotFoundError(f"no metadata beside or in {path}")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows, metadata)."""
    return spark.read.parquet(path), read_meta(path, spark)


def taxonomy(spark: SparkSession, meta: dict) -> DataFrame:
    """(cls, swc, title, scored) from metadata; class numbers must be 0 to K-1, scored ones among them (absent: all)."""
    classes = sorted(meta["classes"], key=lambda c: c["index"])
    if [c["index"] for c in classes] != list(range(len(classes))):
        raise ValueError("class numbers must be 0 to K-1")
    scored = set(meta.get("eval_classes", range(len(classes))))
    if not scored <= set(range(len(classes))):
        raise ValueError("scored classes must be among the classes")
    return spark.createDataFrame([(c["index"], c["swc"], c.get("title", "unknown"), c["index"] in scored) for c in classes], "cls int, swc string, title string, scored boolean")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Near-duplicate pairs; a missing file gives none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], PAIRS)
    return spark.read.schema(PAIRS).option("header", "true").csv(path)


def read_logits(spark: SparkSession, root: str) -> DataFrame:
    """(run, split, row_id, cls, logit, y) of all runs below root, partitioned by run and split."""
    return spark.read.parquet(root)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(split, row_id, cls, logit, y) of one run: its Parquet logits, or its archives where there are none."""
    found = read_logits(spark, f"{path}/logits") if path_exists(spark, f"{path}/logits") else read_npz(spark, path)
    return found.select("split", "row_id", "cls", F.col("logit").cast("double").alias("logit"), "y")


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Result documents ``<run>/test_results.json``: (run, f1, macro_ap, precision, recall, fingerprint, smoke); unreadable ones and smoke runs are left out."""
    schema = "f1 double, macro_ap double, diagnostics struct<precision_macro_tuned:double,recall_macro_tuned:double>, dataset struct<fingerprint:string,max_samples:long>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "test_results.json").json(root)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/test_results\.json$", 1)
    return raw.select(run.alias("run"), "f1", "macro_ap", F.col("diagnostics.precision_macro_tuned").alias("precision"), F.col("diagnostics.recall_macro_tuned").alias("recall"), F.col("dataset.fingerprint").alias("fingerprint"), F.col("dataset.max_samples").alias("max_samples")).where("f1 is not null and max_samples is null")


def git_head(root: str) -> str | None:
    """Commit of a checkout: a loose reference, a packed one, or a detached head."""
    git = Path(root) / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref:"):
            return head
        name = head.split(None, 1)[1]
        if (git / name).exists():
            return (git / name).read_text().strip()
        packed = dict(reversed(line.split(None, 1)) for line in (git / "packed-refs").read_text().splitlines() if " " in line and line[0] not in "#^")
        return packed.get(name)
    except OSError:
        return None
