"""The ``build`` and ``balance`` commands: raw files to a labelled, grouped, fold-assigned table."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import text as tx
from strataweave.operators import dedup, grouping, near_dup, sampling
from strataweave.operators.numbering import numbered
from strataweave.plans.titles import title
from strataweave.session import materialize, write_text
from strataweave.sources import files as src
from strataweave.sources import sinks

SPAN = "array<struct<swc:string,start:int,end:int>>"


def clean_files(raw: DataFrame, annotations: DataFrame, keep_tests: bool = False, keep_interfaces: bool = False) -> DataFrame:
    """Canonical text, spans by class and scope of each file. raw: rel_path, text; annotations: rel_path, category, line_field.

    Adds reason (null: in scope), n_markers and the counters of line kinds. An
    annotation without its file, or a marker that survives, is an error.
    """
    if lost := annotations.join(raw.select("rel_path"), "rel_path", "left_anti").select("rel_path").distinct().limit(3).collect():
        raise ValueError(f"annotations without file, e.g. {[r[0] for r in lost]}")
    base = tx.canonicalized(raw, F.col("text")).select("rel_path", tx.audit_dir(F.col("rel_path")).alias("audit_dir"), "c")
    noted = base.join(annotations.withColumn("swc", tx.category(F.col("category"))), "rel_path", "left")
    got = tx.annotation_spans(F.col("line_field"), F.col("c"), F.col("swc"))
    each = noted.withColumn("got", F.when(F.col("swc").isNotNull(), got))
    spans = F.flatten(F.collect_list(F.transform("got.spans", lambda s: F.struct(F.col("swc").alias("swc"), s["start"].alias("start"), s["end"].alias("end")))))
    files = each.groupBy("rel_path").agg(
        F.first("audit_dir").alias("audit_dir"), F.first("c").alias("c"), F.array_sort(F.array_distinct(spans)).alias("spans"), F.array_sort(F.collect_set("swc")).alias("swc"),
        F.count("category").alias("n_annotations"), F.count_if(F.col("category").isNotNull() & F.col("swc").isNull()).alias("n_unparsed"),
        *[F.count_if(F.col("got.source") == k).alias(f"line_{k}") for k in ("ranges", "whole", "marker", "unknown")],
    )
    text = F.col("c.text")
    guarded = F.when(text.rlike(r"(?i)//\s*swc-"), F.raise_error(F.concat(F.lit("a marker survived in "), F.col("rel_path")))).otherwise(text)
    out = files.select("rel_path", "audit_dir", guarded.cast("string").alias("text"), "spans", "swc", F.size("c.markers").alias("n_markers"), "n_annotations", "n_unparsed", *[f"line_{k}" for k in ("ranges", "whole", "marker", "unknown")])
    return out.withColumn("reason", tx.scope_reason(F.col("text"), tx.path_in_audit(F.col("rel_path")), F.size("swc") > 0, keep_tests, keep_interfaces))


def merge_copies(files: DataFrame) -> DataFrame:
    """Exact duplicates with the union of their spans, mapped to the representative where texts differ."""
    reps = dedup.exact_duplicates(files.select("rel_path", "audit_dir", "text", "spans", "swc"))
    # texts go by their digest: a text reaches the lines' table once, whatever the number of its spans
    digest = lambda c: F.sha2(c, 256)
    keyed = files.select(tx.content_hash(F.col("text")).alias("norm_hash"), "rel_path", digest("text").alias("src"), F.explode("spans").alias("p")).join(reps.select("norm_hash", F.col("rel_path").alias("rep"), digest("text").alias("dst")), "norm_hash").where("rel_path != rep")
    same = keyed.where("src = dst").select("norm_hash", F.col("p.swc").alias("swc"), F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    other = keyed.where("src != dst").select(F.struct("norm_hash", "rel_path", F.col("p.swc").alias("swc"), F.col("p.start").alias("start"), F.col("p.end").alias("end")).alias("span_id"), "src", "dst", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    texts = files.select(digest("text").alias("text_id"), "text").dropDuplicates(["text_id"])
    mapped = dedup.map_spans(other, texts).select("span_id.norm_hash", "span_id.swc", F.col("new_start").alias("start"), F.col("new_end").alias("end"))
    more = same.unionByName(mapped).groupBy("norm_hash").agg(F.collect_list(F.struct("swc", "start", "end")).alias("more"))
    union = F.array_sort(F.array_distinct(F.concat("spans", F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN)))))
    return reps.join(more, "norm_hash", "left").withColumn("spans", union).drop("more", "swc")


def with_row_ids(rows: DataFrame, order: str = "norm_hash") -> DataFrame:
    """row_id: 0-based position in the order of a column."""
    return numbered(rows, "row_id", F.col(order)).select("row_id", *rows.columns)


def build_table(files: DataFrame, audits: DataFrame, min_class_files: int = 20, n_folds: int = 5, seed: int = 42, keep_project_level: bool = False, near_dup_threshold: float = 0.8, near_dup_group_cap: int = 300, test_fold: int = 0, val_fold: int = 1, eval_min_files: int = 0) -> dict:
    """Rows, classes, excluded rows, pairs and reports of cleaned files (see ``clean_files``)."""
    merged = materialize(merge_copies(files.where("reason is null")), "merged")
    classes = materialize(dedup.select_classes(merged, "swc_all", min_class_files, keep_project_level, eval_min_files), "classes")
    labelled = dedup.label_rows(merged, classes)
    excluded = labelled.where("excluded").select("rel_path", F.lit("only_rare_classes").alias("reason"), F.array_join("swc_all", ";").alias("swc"))
    numbers = F.broadcast(classes.where("cls is not null").agg(F.map_from_entries(F.collect_list(F.struct("swc", "cls"))).alias("numbers")))  # one row
    spans = F.filter(F.transform("spans", lambda s: F.struct(F.try_element_at("numbers", s["swc"]).alias("cls"), s["swc"].alias("swc"), s["start"].alias("start"), s["end"].alias("end"))), lambda s: s["cls"].isNotNull())
    rows = labelled.where("not excluded").crossJoin(numbers).withColumn("spans", F.array_sort(spans)).drop("numbers", "excluded")
    named = rows.join(audits.select("audit_dir", F.col("company").alias("audit_company"), F.col("project").alias("project_name"), "repo"), "audit_dir", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    based = named.select("norm_hash", "content_id", "rel_path", "audit_dir", empty("audit_company").alias("audit_company"), empty("project_name").alias("project_name"), tx.codebase_key(F.col("repo"), F.col("audit_dir")).alias("codebase"), F.col("text").alias("source_code"), tx.n_lines(F.col("text")).alias("n_lines"), F.length("text").cast("long").alias("n_chars"), "n_copies", "copy_audit_dirs", "swc_all", "labels", "spans", F.to_json("spans").alias("spans_json"))
    table = materialize(with_row_ids(based), "rows")
    pairs = materialize(near_dup.near_duplicate_pairs(table, "row_id", "source_code", near_dup_threshold, seed=seed), "pairs")
    groups = grouping.capped_groups(table, pairs, near_dup_group_cap)
    grouped = materialize(table.join(groups, "codebase"), "grouped")
    folds = grouping.stratified_folds(grouped, n_folds, seed)
    final = grouped.join(folds, "group_id").drop("norm_hash")
    leakage = near_dup.leakage_report(final.select("row_id", "fold", (F.size("labels") > 0).alias("positive")), pairs, test_fold, val_fold)
    return {"rows": final, "classes": classes, "excluded": excluded, "pairs": pairs, "leakage": leakage, "n_folds": n_folds}


def build(spark: SparkSession, raw: str, out: str, prefix: str = "", **params) -> dict:
    """The command: read a checkout (contracts/, annotations/, audits.xlsx), write the table and its side files; returns the metadata."""
    keep = {k: params.pop(k, False) for k in ("keep_tests", "keep_interfaces")}
    spark.dataSource.register(src.WorkbookSource)
    audits = src.audit_index(spark.read.format("workbook").load(f"{raw}/audits.xlsx"))
    sources = src.read_sources(spark, f"{raw}/contracts")
    files = materialize(clean_files(sources, src.read_annotations(spark, f"{raw}/annotations", prefix), **keep), "files")
    made = build_table(files, audits, **params)
    rows = materialize(made["rows"], "final")
    n_folds = made["n_folds"]
    per_fold: dict[int, list[int]] = {}
    for r in dedup.per_fold_counts(rows, made["classes"], n_folds).orderBy("cls", "fold").collect():
        per_fold.setdefault(r["cls"], []).append(r["positives"])
    listed = made["classes"].withColumn("title", title(F.col("swc"))).orderBy("status", "cls", "swc").collect()
    included = [r for r in listed if r["status"] == "included"]
    counts = files.agg(F.count("*").alias("files"), F.count_if(F.col("reason").isNull()).alias("in_scope_files"), *[F.count_if(F.col("reason") == k).alias(f"dropped_{k}") for k in ("empty", "test_mock", "interface_only")], F.sum("n_markers").alias("markers_stripped"), F.sum("n_annotations").alias("annotation_instances"), *[F.sum(f"line_{k}").alias(f"line_{k}") for k in ("ranges", "whole", "marker", "unknown")]).first().asDict()
    counts |= rows.agg(F.count("*").alias("rows"), F.count_if(F.size("labels") > 0).alias("positive_rows"), F.count_if(F.size("labels") == 0).alias("negative_rows"), F.count_distinct("codebase").alias("codebases"), F.count_distinct("group_id").alias("groups")).first().asDict()
    folds = rows.groupBy("fold").agg(F.count("*").alias("rows"), F.count_if(F.size("labels") > 0).alias("positive_rows")).orderBy("fold").collect()
    meta = {
        "version": re.sub(r"\.parquet$", "", out).rsplit("/", 1)[-1], "source_commit": src.git_head(raw) or "unknown", "built_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "params": params | keep,
        "classes": [{"index": r["cls"], "swc": r["swc"], "title": r["title"], "n_files": r["n_files"], "per_fold": per_fold.get(r["cls"], [])} for r in included],
        "excluded_classes": {k: [{"swc": r["swc"], "title": r["title"], "n_files": r["n_files"]} for r in listed if r["status"] == k] for k in ("project_level", "rare")},
        "counts": counts, "folds": {"rows": [r["rows"] for r in folds], "positive_rows": [r["positive_rows"] for r in folds]}, "leakage": made["leakage"].first().asDict(), "fingerprint": sinks.fingerprint(rows).first()[0],
    }
    if params.get("eval_min_files"):
        meta["eval_classes"] = [r["cls"] for r in included if r["scored"]]
    stem = re.sub(r"\.parquet$", "", out)
    sinks.write_table(rows, out, meta)
    sinks.write_csv(made["excluded"], f"{stem}.excluded.csv")
    sinks.write_pairs(made["pairs"], f"{stem}.neardup.csv")
    write_text(spark, f"{stem}.card.md", data_card(meta))
    return meta


def _table(head: list[str], rows: list[list]) -> list[str]:
    return [f"| {' | '.join(head)} |", "|" + "---|" * len(head), *(f"| {' | '.join(map(str, r))} |" for r in rows), ""]


def _class_rows(meta: dict) -> list[list]:
    scored = set(meta.get("eval_classes", [c["index"] for c in meta["classes"]]))
    return [[c["index"], c["swc"], c["title"], c["n_files"], "yes" if c["index"] in scored else "no", *c["per_fold"]] for c in meta["classes"]]


def data_card(meta: dict) -> str:
    """Markdown description of a table from its metadata: counts, classes and rows by fold, what is left out, leakage, kinds of annotated lines."""
    counts, folds = meta["counts"], [f"fold {i}" for i in range(len(meta["folds"]["rows"]))]
    out = [f"# Table {meta['version']}", "", f"Fingerprint `{meta['fingerprint'][:16]}`, source `{str(meta['source_commit'])[:12]}`, built {meta.get('built_at', '')}.", "", "## Counts", ""]
    out += _table(["count", "n"], [[k, v] for k, v in sorted(counts.items()) if not k.startswith("line_")])
    out += ["## Classes", ""]
    sums = [["", "", "rows", "", "", *meta["folds"]["rows"]], ["", "", "rows with a class", "", "", *meta["folds"]["positive_rows"]]]
    out += _table(["class", "id", "title", "files", "scored", *folds], _class_rows(meta) + sums)
    for kind, why in (("project_level", "reported once for a project"), ("rare", "in too few files")):
        if left := meta.get("excluded_classes", {}).get(kind):
            out += [f"Left out, {why}: " + ", ".join(f"{e['swc']} {e['title']} ({e['n_files']})" for e in left) + ".", ""]
    out += ["## Leakage", "", *_table(["measure", "value"], [[k, v] for k, v in meta["leakage"].items()])]
    out += ["## Annotated lines", "", *_table(["read as", "annotations"], [[k.removeprefix("line_"), v] for k, v in sorted(counts.items()) if k.startswith("line_")])]
    return "\n".join(out)


def balanced_card(meta: dict) -> str:
    """Markdown description of a balanced table: what each fold kept, and its classes."""
    b, folds = meta["balance"], [f"fold {i}" for i in range(len(meta["folds"]["rows"]))]
    out = [f"# Balanced table {meta['version']}", "", f"Fingerprint `{meta['fingerprint'][:16]}`, from `{b['from']}` (`{str(b['from_fingerprint'])[:16]}`).", ""]
    out += [f"All labelled rows, and in each fold {b['safe_ratio']:g} unlabelled ones for each of them (seed {b['seed']}).", ""]
    per = [[p["fold"], p["labelled"], p["unlabelled_before"], p["unlabelled_kept"], p["labelled"] + p["unlabelled_kept"]] for p in b["per_fold"]]
    out += _table(["fold", "labelled", "unlabelled before", "unlabelled kept", "rows"], [*per, ["all", *(sum(p[i] for p in per) for i in range(1, 5))]])
    out += ["## Classes", "", *_table(["class", "id", "title", "files", "scored", *folds], _class_rows(meta))]
    return "\n".join(out)


def balance(spark: SparkSession, table: str, out: str, safe_ratio: float = 1.0, seed: int = 42) -> dict:
    """The command: all labelled rows and a seeded part of the others; counts are made anew."""
    rows, meta = src.read_table(spark, table)
    kept = materialize(sampling.balance(rows, safe_ratio, seed), "balanced")
    stem_in, stem = re.sub(r"\.parquet$", "", table), re.sub(r"\.parquet$", "", out)
    pairs = near_dup.pairs_within(src.read_pairs(spark, f"{stem_in}.neardup.csv"), kept)
    by_fold = lambda df: {r["fold"]: r for r in df.groupBy("fold").agg(F.count("*").alias("rows"), F.count_if(F.size("labels") > 0).alias("positive_rows")).collect()}
    before, now = by_fold(rows), by_fold(kept)
    n_folds = max(before, default=-1) + 1
    of = lambda found, f, name: found[f][name] if f in found else 0
    per_fold = [{"fold": f, "labelled": of(now, f, "positive_rows"), "unlabelled_before": of(before, f, "rows") - of(before, f, "positive_rows"), "unlabelled_kept": of(now, f, "rows") - of(now, f, "positive_rows")} for f in range(n_folds)]
    counts = kept.agg(F.count("*").alias("rows"), F.count_if(F.size("labels") > 0).alias("positive_rows"), F.count_if(F.size("labels") == 0).alias("negative_rows"), F.count_distinct("group_id").alias("groups")).first().asDict()
    counts["rows_before_balancing"] = sum(r["rows"] for r in before.values())
    positives: dict[int, dict[int, int]] = {}
    for r in kept.select("fold", F.explode("labels").alias("cls")).groupBy("cls", "fold").agg(F.count("*").alias("n")).collect():
        positives.setdefault(r["cls"], {})[r["fold"]] = r["n"]
    classes = [c | {"n_files": sum(positives.get(c["index"], {}).values()), "per_fold": [positives.get(c["index"], {}).get(f, 0) for f in range(n_folds)]} for c in meta["classes"]]
    meta = meta | {"version": stem.rsplit("/", 1)[-1], "classes": classes, "balance": {"safe_ratio": safe_ratio, "seed": seed, "from": meta.get("version"), "from_fingerprint": meta.get("fingerprint"), "per_fold": per_fold}, "counts": meta["counts"] | counts, "folds": {"rows": [of(now, f, "rows") for f in range(n_folds)], "positive_rows": [of(now, f, "positive_rows") for f in range(n_folds)]}, "fingerprint": sinks.fingerprint(kept, f"safe_ratio={safe_ratio}|seed={seed}").first()[0]}
    sinks.write_table(kept, out, meta)
    sinks.write_pairs(pairs, f"{stem}.neardup.csv")
    write_text(spark, f"{stem}.card.md", balanced_card(meta))
    return meta
