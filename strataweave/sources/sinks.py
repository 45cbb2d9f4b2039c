"""Writers: tables with metadata, CSV side files, JSON documents, Markdown reports, fingerprints."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.session import write_text


#: name of the metadata among a column's own, which Parquet footers carry
META = "table_meta"


def write_table(rows: DataFrame, path: str, meta: dict) -> None:
    """Zstandard Parquet with the metadata in its footers (as metadata of the first column), and as JSON beside it."""
    first, *rest = rows.columns
    marked = rows.select(F.col(first).alias(first, metadata={META: json.dumps(meta)}), *rest)
    marked.write.mode("overwrite").option("compression", "zstd").parquet(path)
    write_json(re.sub(r"\.parquet$", "", path) + ".meta.json", meta)


def write_json(path: str, document: dict) -> None:
    write_text(SparkSession.active(), path, json.dumps(document, indent=2))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    write_csv(pairs.select("row_a", "row_b", F.round("jaccard", 4).alias("jaccard")), path)


def write_logits(logits: DataFrame, path: str) -> None:
    """Logits of runs, partitioned by run and split so that readers prune."""
    logits.write.mode("overwrite").partitionBy("run", "split").parquet(path)


def python_list(values: Column) -> Column:
    """An array of numbers as ``[1, 2]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]"))


def fingerprint(rows: DataFrame, suffix: str = "", block: int = 100_000) -> DataFrame:
    """(fingerprint,): SHA-256 over the rows' digests in row_id order. rows: row_id, content_id, fold, labels, spans_json.

    Lines are hashed in blocks of row ids, and the blocks' digests in order, so that no
    task holds the whole table.
    """
    line = F.concat_ws("|", "content_id", F.col("fold").cast("string"), python_list(F.col("labels")), F.col("spans_json"))
    blocks = rows.select(F.floor(F.col("row_id") / block).alias("b"), "row_id", F.concat(line, F.lit("\n")).alias("line")).groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "line"))), lambda r: r["line"]), ""), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda r: r["d"]), "")
    return blocks.agg(F.sha2(F.concat(joined, F.lit(suffix)), 256).alias("fingerprint"))


def markdown(rows: DataFrame, columns: dict[str, str], formats: dict[str, str] | None = None) -> str:
    """A table of a small report DataFrame (its rows are collected)."""
    out = ["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    for r in rows.collect():
        out.append("| " + " | ".join("" if r[c] is None else format(r[c], (formats or {}).get(c, "")) for c in columns) + " |")
    return "\n".join(out) + "\n"
