"""The commands ``train --dry-run``, ``baseline``, ``tfidf``, ``blend``, ``moe``, ``collect`` and ``cvsummary``."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import features, gating, linear, metrics, near_dup, sampling, windows
from strataweave.session import materialize, read_text
from strataweave.sources import files as src
from strataweave.sources import sinks


@dataclass
class RunConfig:
    """Settings of a run. Unknown names are refused; overrides win over the file."""

    table: str
    out: str
    test_fold: int = 0
    val_fold: int = 1
    seed: int = 42
    max_length: int = 1024
    overlap: float = 0.25
    input_mode: str = "window"
    neg_ratio: float = 0.3
    oversample: bool = True
    oversample_threshold: int = 100
    oversample_target: int = 300
    oversample_factor: float = 5.0
    threshold_strategy: str = "f1"
    temperature_scaling: bool = False
    max_samples: int | None = None

    def __post_init__(self):
        if not 0 <= self.overlap < 1:
            raise ValueError("overlap must be in [0, 1)")
        if self.test_fold == self.val_fold:
            raise ValueError("test and val folds must differ")
        if self.input_mode not in ("window", "truncate"):
            raise ValueError(f"unknown input mode {self.input_mode!r}")

    @classmethod
    def load(cls, path: str | None = None, **overrides) -> RunConfig:
        values: dict = {}
        if path:
            for line in read_text(SparkSession.active(), path).splitlines() if "://" in path else open(path):
                name, colon, value = re.sub(r"(^|\s)#.*$", "", line).partition(":")
                if colon and name.strip():
                    values[name.strip()] = _scalar(value.strip())
        values |= {k: v for k, v in overrides.items() if v is not None}
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**values)


def _scalar(value: str):
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    if value.lower() in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value.strip("'\"")


def load_splits(spark: SparkSession, config: RunConfig) -> tuple[dict[str, DataFrame], DataFrame, dict]:
    rows, meta = src.read_table(spark, config.table)
    parts = sampling.split_folds(rows, config.test_fold, config.val_fold)
    if config.max_samples:
        parts = tuple(sampling.cap_rows(p, config.max_samples, config.seed) for p in parts)
    return dict(zip(("train", "val", "test"), parts, strict=True)), src.taxonomy(spark, meta), meta


def dry_run(spark: SparkSession, config: RunConfig) -> dict:
    """Windows of all splits and the training sample; reports without a model."""
    splits, tax, meta = load_splits(spark, config)
    report = {}
    for name, part in splits.items():
        f = part.select("row_id", F.col("source_code").alias("text"), "spans", "labels")
        w = windows.build_windows(f, config.max_length, config.overlap, config.input_mode)
        report[name] = windows.window_stats(w, f).first().asDict()
        if name == "train":
            ids = w.select(F.xxhash64("row_id", "win").alias("win_id"), "labels", "file_annotated")
            sample = sampling.resample_windows(ids, config.neg_ratio, config.oversample_threshold, config.oversample_target, config.oversample_factor, config.seed, config.oversample)
            report["sample"] = {r["why"]: r["n"] for r in sample.groupBy("why").agg(F.count("*").alias("n")).collect()}
    write_run_documents(config, tax, meta, report)
    return report


def write_run_documents(config: RunConfig, tax: DataFrame, meta: dict, report: dict) -> None:
    """What a run leaves beside its results: windows_report, config and taxonomy as JSON."""
    sinks.write_json(f"{config.out}/windows_report.json", report)
    sinks.write_json(f"{config.out}/config.json", asdict(config))
    sinks.write_json(f"{config.out}/taxonomy.json", {"classes": [r.asDict() for r in tax.orderBy("cls").collect()], "version": meta.get("version")})


def grid(rows: DataFrame, tax: DataFrame) -> DataFrame:
    """(row_id, cls, y) on the whole grid, exploded from class numbers in the taxonomy, one row for each class."""
    classes = sorted(r["cls"] for r in tax.select("cls").collect())
    return rows.select("row_id", "labels", F.explode(F.array(*map(F.lit, classes))).alias("cls")).select("row_id", "cls", F.array_contains("labels", F.col("cls")).cast("int").alias("y"))


def report_run(spark: SparkSession, config: RunConfig, out: str, run: str, val: DataFrame, test: DataFrame, tax: DataFrame, meta: dict, splits: dict[str, DataFrame], extra: dict | None = None, train: DataFrame | None = None) -> dict:
    """Evaluate logits and write results, thresholds and logits; those of train are for a gate."""
    temperature = metrics.fit_temperature(val) if config.temperature_scaling else 1.0
    pairs = src.read_pairs(spark, re.sub(r"\.parquet$", "", config.table) + ".neardup.csv")
    exposed = near_dup.exposed_rows(pairs, splits["test"].select("row_id"), splits["train"])
    s = metrics.summarize(test, val, tax.where("scored"), exposed, temperature, config.threshold_strategy)
    overall = s["overall"].first().asDict()
    per_class = [r.asDict() for r in s["per_class"].orderBy("cls").collect()]
    results = {"f1": overall["f1"], "macro_ap": overall["macro_ap"], "diagnostics": overall, "temperature": temperature, "per_class": per_class, "dataset": {"fingerprint": meta.get("fingerprint"), "test_fold": config.test_fold, "val_fold": config.val_fold, "max_samples": config.max_samples}} | (extra or {})
    sinks.write_json(f"{out}/{run}/test_results.json", results)
    sinks.write_json(f"{out}/{run}/thresholds.json", {"strategy": config.threshold_strategy, "temperature": temperature, "thresholds": [r.asDict() for r in s["thresholds"].orderBy("cls").collect()]})
    named = {"train": train, "val": val, "test": test}
    logits = reduce(DataFrame.unionByName, (df.select("row_id", "cls", "logit", "y").withColumn("split", F.lit(k)) for k, df in named.items() if df is not None))
    sinks.write_logits(logits.withColumn("run", F.lit(run)), f"{out}/{run}/logits")
    return results


def _linear(spark: SparkSession, config: RunConfig, run: str, featured: dict[str, DataFrame], size: int, tax: DataFrame, meta: dict, splits: dict[str, DataFrame], **how) -> dict:
    classes = [r["cls"] for r in tax.orderBy("cls").collect()]
    fit = linear.run_linear(featured["train"], featured["val"], featured["test"], size, classes, tax.where("scored"), **how)
    return report_run(spark, config, config.out, run, fit["val"], fit["test"], tax, meta, splits, {"c": fit["c"], "val_macro_ap": fit["val_macro_ap"]}, fit["train"])


def tfidf(spark: SparkSession, config: RunConfig, run: str = "tfidf", max_features: int = 200_000) -> dict:
    """TF-IDF, lengths and logistic regression."""
    splits, tax, meta = load_splits(spark, config)
    texts = {k: v.select("row_id", F.col("source_code").alias("text"), "labels") for k, v in splits.items()}
    every = reduce(DataFrame.unionByName, texts.values())
    weights = features.tfidf(every, texts["train"], max_features=max_features)
    rows = reduce(DataFrame.unionByName, (v.select("row_id", "n_chars", "n_lines") for v in splits.values()))
    lengths = features.length_features(rows, splits["train"])
    # the two lengths are terms of their own; a term of the text has no space at its start
    weights = weights.unionByName(lengths.select("row_id", F.explode(F.array(*[F.struct(F.lit(f" {c}").alias("term"), F.col(c).alias("weight")) for c in ("log_chars", "log_lines")])).alias("p")).select("row_id", "p.term", "p.weight"))
    weights = materialize(weights, "weights")
    ids = materialize(features.term_ids(weights), "term-ids")
    featured = {k: materialize(linear.sparse_rows(v.select("row_id", "labels"), weights, ids), f"rows-{k}") for k, v in texts.items()}
    return _linear(spark, config, run, featured, max(1, ids.count()), tax, meta, splits)


def baseline(spark: SparkSession, config: RunConfig, run: str = "length") -> dict:
    """Logistic regression on two length features, C = 1, without a penalty on the intercept."""
    splits, tax, meta = load_splits(spark, config)
    featured = {k: linear.dense_rows(features.length_features(v.select("row_id", "labels", "n_chars", "n_lines"), splits["train"]).select("row_id", "labels", "log_chars", "log_lines"), "log_chars", "log_lines") for k, v in splits.items()}
    return _linear(spark, config, run, featured, 2, tax, meta, splits, grid=(1.0,), penalize_intercept=False)


def _run_logits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    got = src.read_run(spark, path)
    return {k: got.where(F.col("split") == k).drop("split") for k in ("train", "val", "test")}


def blend(spark: SparkSession, config: RunConfig, run_a: str, run_b: str, run: str = "blend") -> dict:
    """Linear blend of two runs; its weight is the best on val."""
    splits, tax, meta = load_splits(spark, config)
    a, b = _run_logits(spark, run_a), _run_logits(spark, run_b)
    metrics.assert_aligned(a["val"], b["val"])
    metrics.assert_aligned(a["test"], b["test"])
    w = metrics.best_weight(metrics.blend_weights(a["val"], b["val"])).first()
    return report_run(spark, config, config.out, run, metrics.blend(a["val"], b["val"], w["w"]), metrics.blend(a["test"], b["test"], w["w"]), tax, meta, splits, {"weight": w["w"], "val_macro_ap": w["macro_ap"]})


def moe(spark: SparkSession, config: RunConfig, experts: list[str], run: str = "moe", hidden: int = 512, epochs: int = 50, rate: float = 3e-4, batch: int = 64, top_k: int = 4, even: float = 0.5, patience: int = 8) -> dict:
    """A gate over finished runs: fitted on their train logits, chosen on val by macro average precision, reported on test.

    Smoke runs, runs of different tables and runs that aren't aligned are refused. The fit takes ``gating.MAX_ROWS``
    rows of train and of val at most; all rows are scored.
    """
    if len(experts) < 2:
        raise ValueError("a gate needs two runs or more")
    splits, tax, meta = load_splits(spark, config)
    results = {path: json.loads(read_text(spark, f"{path}/test_results.json")) for path in experts}
    if smoke := [path for path, r in results.items() if r["dataset"].get("max_samples")]:
        raise ValueError(f"smoke runs: {smoke}")
    if len({r["dataset"].get("fingerprint") for r in results.values()}) > 1:
        raise ValueError("the runs use different tables")
    runs = {path.rstrip("/").rsplit("/", 1)[-1]: _run_logits(spark, path) for path in experts}
    first, n_classes = next(iter(runs.values())), tax.count()
    for other in list(runs.values())[1:]:
        for split in ("train", "val", "test"):
            metrics.assert_aligned(first[split], other[split])
    rows = {split: materialize(gating.stacked({n: r[split] for n, r in runs.items()}, n_classes), f"stacked-{split}") for split in ("train", "val", "test")}
    gate, best = gating.fit_gate(gating.bounded_sample(rows["train"], config.seed), gating.bounded_sample(rows["val"], config.seed), len(runs), hidden, epochs, rate, batch, top_k, even, patience, config.seed)
    mixed = {split: gating.apply_gate(rows[split], gate, list(runs)) for split in ("val", "test")}
    logits = {split: gating.long_logits(mixed[split]).join(first[split].select("row_id", "cls", "y"), ["row_id", "cls"]) for split in mixed}
    used = gating.usage(mixed["test"].select("row_id", F.explode("usage").alias("expert", "weight")))
    extra = {"moe": {"experts": list(runs), "top_k": min(top_k, len(runs)), "best_val_macro_ap": best, "mean_gate_weight_test": {r["expert"]: round(r["usage"], 4) for r in used.collect()}}}
    report = report_run(spark, config, config.out, run, logits["val"], logits["test"], tax, meta, splits, extra)
    sinks.write_json(f"{config.out}/{run}/gate.json", {"row": [w.tolist() for w in gate.row], "cls": [w.tolist() for w in gate.cls], "n_experts": gate.n_experts, "n_classes": gate.n_classes, "top_k": gate.top_k})
    return report


def collect(spark: SparkSession, root: str) -> str:
    """Markdown of all runs, best first; a note where datasets differ."""
    runs = src.read_results(spark, root)
    text = sinks.markdown(runs.orderBy(F.desc("f1"), "run"), {"run": "run", "f1": "F1", "macro_ap": "macro AP", "precision": "precision", "recall": "recall"}, {"f1": ".4f", "macro_ap": ".4f", "precision": ".4f", "recall": ".4f"})
    if runs.agg(F.count_distinct("fingerprint")).first()[0] > 1:
        text += "\nThe runs use different datasets.\n"
    return text


def cv_summary(spark: SparkSession, root: str) -> str:
    """Markdown of models over folds (runs named model_f0, model_f1, ...)."""
    return sinks.markdown(metrics.cross_validation(src.read_results(spark, root)), {"model": "model", "folds": "folds", "mean_f1": "mean F1", "sd_f1": "sd", "mean_precision": "precision", "mean_recall": "recall"}, {"mean_f1": ".4f", "sd_f1": ".4f", "mean_precision": ".4f", "mean_recall": ".4f"})
