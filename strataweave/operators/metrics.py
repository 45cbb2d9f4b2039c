"""Multi-label evaluation in long form: one row for each (row_id, cls) with y and a score.

Inputs may carry run, split or fold columns; pass them as ``by`` to evaluate all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.numeric import finite, log_sigmoid, sigmoid, weighted_bce
from strataweave.operators.numbering import running_sums

#: thresholds i / 20
GRID = [i * 0.05 for i in range(1, 20)]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1_of(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def decide(scores: DataFrame, thresholds: DataFrame | float, score: str = "prob") -> DataFrame:
    """Adds pred: score at or above the class's threshold (cls, threshold) or one for all."""
    if isinstance(thresholds, int | float):
        return scores.withColumn("threshold", F.lit(float(thresholds))).withColumn("pred", (F.col(score) >= float(thresholds)).cast("int"))
    return scores.join(thresholds.select("cls", "threshold"), "cls").withColumn("pred", (F.col(score) >= F.col("threshold")).cast("int"))


def confusion(decided: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per class: support, tp, fp, fn, precision, recall, f1 (0 where undefined)."""
    y, p = F.col("y") == 1, F.col("pred") == 1
    counted = decided.groupBy(*(by or []), "cls").agg(F.count_if(y).alias("support"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    precision, recall, f1 = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def averages(decided: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro and macro precision, recall and F1, and the share of rows with every class right."""
    by = by or []
    per_class = confusion(decided, by)
    p, r, f = f1_of(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    total = per_class.groupBy(*by).agg(p.alias("precision_micro"), r.alias("recall_micro"), f.alias("f1_micro"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"))
    right = decided.groupBy(*by, "row_id").agg(F.bool_and(F.col("pred") == F.col("y")).alias("ok")).groupBy(*by).agg(F.avg(F.col("ok").cast("int")).alias("exact_match"))
    return total.join(right, by) if by else total.crossJoin(right)  # one row each


def average_precision(scores: DataFrame, by: list[str] | None = None, score: str = "prob") -> DataFrame:
    """Per class: positives and average precision, the sum of recall steps times precision over distinct scores downwards; 0 without positives.

    Rows are first counted by distinct score, with map-side combine; the running
    sums go over ranges of scores, so that no task holds a class.
    """
    by = [*(by or []), "cls"]
    steps = scores.groupBy(*by, F.col(score).alias("s")).agg(F.sum("y").cast("long").alias("tp"), F.count("*").alias("n"))
    run = running_sums(steps, by, [F.desc("s")], ["tp", "n"])
    part = F.col("tp") * (F.col("tp_sum") / F.col("n_sum"))
    return run.groupBy(*by).agg(F.sum("tp").alias("positives"), F.sum(part).alias("_a")).select(*by, "positives", ratio(F.col("_a"), F.col("positives")).alias("average_precision"))


def macro_average_precision(scores: DataFrame, by: list[str] | None = None, score: str = "prob") -> DataFrame:
    """Mean over classes with a positive; 0 without any."""
    by = by or []
    aps = average_precision(scores, by, score)
    return aps.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("positives") > 0, F.col("average_precision"))), F.lit(0.0)).alias("macro_ap"))


def tune_thresholds(scores: DataFrame, strategy: str = "f1", score: str = "prob") -> DataFrame:
    """(cls, threshold, score, support): first grid value with the best f1, recall or precision; 0.5 without positives.

    A row counts towards every grid value up to its score, so rows are first counted by
    the number of grid values that they reach: 20 bins for each class, no cross join.
    """
    reached = sum((F.col(score) >= t).cast("int") for t in GRID)
    bins = scores.groupBy("cls", reached.alias("i")).agg(F.sum("y").cast("long").alias("pos"), (F.count("*") - F.sum("y")).cast("long").alias("neg"))
    total = bins.groupBy("cls").agg(F.sum("pos").alias("support"))
    every = total.select("cls", "support", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(GRID, 1)])).alias("g")).select("cls", "support", "g.i", "g.threshold")
    down = Window.partitionBy("cls").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = lambda name: F.sum(F.coalesce(name, F.lit(0))).over(down)
    run = every.join(bins, ["cls", "i"], "left").select("cls", "support", "i", "threshold", above("pos").alias("tp"), above("neg").alias("fp"))
    p, r, f = f1_of(F.col("tp"), F.col("fp"), F.col("support") - F.col("tp"))
    judged = run.withColumn("score", {"f1": f, "recall": r, "precision": p}.get(strategy, f))
    best = judged.groupBy("cls", "support").agg(F.max_by(F.struct("threshold", "score"), F.struct("score", -F.col("i"))).alias("b"))
    some = F.col("support") > 0
    return best.select("cls", F.when(some, F.col("b.threshold")).otherwise(0.5).alias("threshold"), F.when(some, F.col("b.score")).otherwise(0.0).alias("score"), "support")


def max_pool(windows: DataFrame, files: DataFrame | None = None, value: str = "logit") -> DataFrame:
    """(row_id, cls, value): the largest over a file's windows. With ``files`` (row_id), a file without window is an error."""
    pooled = windows.groupBy("row_id", "cls").agg(F.max(value).alias(value))
    if files is not None and (lost := files.join(windows.select("row_id").distinct(), "row_id", "left_anti").limit(5).collect()):
        raise ValueError(f"files without windows: {[r['row_id'] for r in lost]}")
    return pooled


def validation_bundle(windows: DataFrame) -> DataFrame:
    """One row: macro_ap, f1_macro and f1_micro at 0.5 of files, whose logits and labels are the largest of their windows, and window_f1_micro. windows: row_id, cls, logit, y."""
    files = max_pool(windows).join(max_pool(windows, value="y"), ["row_id", "cls"]).withColumn("prob", sigmoid(F.col("logit")))
    at_half = averages(decide(files, 0.5)).select("f1_macro", "f1_micro")
    each = averages(decide(windows.withColumn("prob", sigmoid(F.col("logit"))), 0.5)).select(F.col("f1_micro").alias("window_f1_micro"))
    return macro_average_precision(files).crossJoin(at_half).crossJoin(each)  # one row each


def summarize(test: DataFrame, val: DataFrame, scored: DataFrame | None = None, exposed: DataFrame | None = None, temperature: float = 1.0, strategy: str = "f1") -> dict:
    """Evaluation of logits (row_id, cls, logit, y): thresholds from val for all classes, then reports over the scored ones.

    Returns thresholds and per_class as DataFrames and overall as a one-row one.
    """
    prob = sigmoid(F.col("logit") / F.lit(temperature))
    test, val = test.withColumn("prob", prob), val.withColumn("prob", prob)
    thresholds = tune_thresholds(val, strategy)
    if scored is not None:
        test = test.join(scored.select("cls"), "cls", "left_semi")
    decided = decide(test, thresholds)
    per_class = confusion(decided).join(average_precision(test).drop("positives"), "cls").join(thresholds.select("cls", "threshold"), "cls")
    overall = per_class.agg(F.avg("f1").alias("f1"), F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("f1_macro_supported_only"), F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("average_precision"))), F.lit(0.0)).alias("macro_ap"), F.count("*").alias("n_classes"), F.count_if(F.col("support") > 0).alias("n_supported"))
    base, tuned = averages(decide(test, 0.5)), averages(decided)
    rows = test.groupBy("row_id").agg(F.max("y").alias("y")).agg(F.count("*").alias("n_test_files"), F.count_if(F.col("y") == 1).alias("n_test_positive_files"))
    overall = overall.crossJoin(base.select(F.col("f1_macro").alias("f1_macro_at_half"))).crossJoin(tuned.select(F.col("f1_micro").alias("f1_micro_tuned"), F.col("precision_macro").alias("precision_macro_tuned"), F.col("recall_macro").alias("recall_macro_tuned"))).crossJoin(rows)
    if exposed is not None:
        clean = confusion(decided.join(exposed.where("exposed").select("row_id"), "row_id", "left_anti"))
        some = F.col("support") > 0
        overall = overall.crossJoin(clean.agg(F.coalesce(F.avg(F.when(some, F.col("f1"))), F.lit(0.0)).alias("f1_unexposed_supported"), F.count_if(some).alias("f1_unexposed_n_supported"))).crossJoin(exposed.agg(F.count_if("exposed").alias("test_files_exposed_to_train")))
    return {"thresholds": thresholds, "per_class": per_class, "overall": overall, "temperature": temperature}


def fit_temperature(val: DataFrame, rounds: int = 25) -> float:
    """T > 0 with the least mean cross entropy of logit / T: golden section over log T, all candidate points of a round in one aggregate."""
    low, high = -3.0, 3.0
    for _ in range(max(1, rounds // 5)):
        points = [low + (high - low) * i / 16 for i in range(17)]
        y = F.col("y").cast("double")
        loss = lambda t: -F.avg(y * log_sigmoid(F.col("logit") * float(2.718281828459045**-t)) + (1 - y) * log_sigmoid(-F.col("logit") * float(2.718281828459045**-t)))
        got = val.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(points)]).first()
        if got[0] is None:
            return 1.0
        best = min(range(17), key=lambda i: got[i])
        low, high = points[max(0, best - 1)], points[min(16, best + 1)]
    return float(2.718281828459045 ** ((low + high) / 2))


def mean_weighted_bce(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(loss,): mean over all cells of the weighted cross entropy; weights: cls, pos_weight."""
    return scores.join(weights, "cls").agg(F.avg(weighted_bce(F.col("logit"), F.col("y").cast("double"), F.col("pos_weight"))).alias("loss"))


def pos_weights(labels: DataFrame, cap: float) -> DataFrame:
    """(cls, pos_weight): negatives over positives, within 1 and cap. labels: row_id, cls, y on the whole grid."""
    pos, n = F.sum("y"), F.count("*")
    return labels.groupBy("cls").agg(F.greatest(F.lit(1.0), F.least(F.lit(float(cap)), (n - pos) / F.greatest(pos, F.lit(1)))).alias("pos_weight"))


def assert_aligned(a: DataFrame, b: DataFrame) -> None:
    """Two runs must cover the same (row_id, cls) with equal labels."""
    x, y = a.select("row_id", "cls", F.col("y").alias("ya")), b.select("row_id", "cls", F.col("y").alias("yb"))
    bad = x.join(y, ["row_id", "cls"], "full_outer").where("ya is null or yb is null or ya != yb").limit(3).collect()
    if bad:
        raise ValueError(f"runs differ, e.g. at {[tuple(r) for r in bad]}")


def blend(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    joined = a.join(b.select("row_id", "cls", F.col("logit").alias("_b")), ["row_id", "cls"])
    return joined.withColumn("logit", F.lit(weight) * F.col("logit") + F.lit(1 - weight) * F.col("_b")).drop("_b")


def blend_weights(val_a: DataFrame, val_b: DataFrame, steps: int = 10) -> DataFrame:
    """(w, macro_ap) for w = 0, 1/steps, ... 1; logits are w a + (1 - w) b. One exploded pass scores all weights."""
    joined = val_a.join(val_b.select("row_id", "cls", F.col("logit").alias("_b")), ["row_id", "cls"])
    each = joined.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(steps + 1)]))).withColumn("w", F.col("i") / F.lit(float(steps)))
    mixed = each.withColumn("prob", sigmoid(F.col("w") * F.col("logit") + (1 - F.col("w")) * F.col("_b")))
    return macro_average_precision(mixed, ["w"]).withColumn("macro_ap", F.round("macro_ap", 6))


def best_weight(weights: DataFrame) -> DataFrame:
    """The weight with the best macro AP, of equal ones that closest to 0.5, then the smaller."""
    return weights.agg(F.max_by(F.struct("w", "macro_ap"), F.struct("macro_ap", -F.round(F.abs(F.col("w") - 0.5), 6), -F.col("w"))).alias("b")).select("b.w", "b.macro_ap")


def expert_gate(scores: DataFrame, top_k: int) -> DataFrame:
    """Softmax over the top_k scores of each row (row_id, expert, score); others have weight 0. Equal scores: smaller expert."""
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "expert")))
    top = F.max("score").over(Window.partitionBy("row_id"))
    e = F.when(F.col("_r") <= top_k, F.exp(F.col("score") - F.col("_top"))).otherwise(0.0)
    weighed = ranked.withColumn("_top", top).withColumn("_e", e)
    return weighed.withColumn("weight", F.col("_e") / F.sum("_e").over(Window.partitionBy("row_id"))).select("row_id", "expert", "score", "weight")


def gated_logits(experts: DataFrame, gate: DataFrame, class_scores: DataFrame) -> DataFrame:
    """Half the row gate's and half the class gate's mix of experts (row_id, expert, cls, logit); class_scores are softmaxed over experts."""
    own = Window.partitionBy("row_id", "cls")
    soft = class_scores.withColumn("_e", F.exp(F.col("score") - F.max("score").over(own))).withColumn("class_weight", F.col("_e") / F.sum("_e").over(own)).select("row_id", "expert", "cls", "class_weight")
    joined = experts.withColumn("logit", finite(F.col("logit"))).join(gate.select("row_id", "expert", "weight"), ["row_id", "expert"]).join(soft, ["row_id", "expert", "cls"])
    return joined.groupBy("row_id", "cls").agg(F.sum(0.5 * F.col("logit") * (F.col("weight") + F.col("class_weight"))).alias("logit"))


def attention_pool(windows: DataFrame) -> DataFrame:
    """Per class softmax over a file's windows of ``attention``, applied to ``value``: (row_id, cls, pooled)."""
    own = Window.partitionBy("row_id", "cls")
    e = windows.withColumn("_e", F.exp(F.col("attention") - F.max("attention").over(own)))
    return e.groupBy("row_id", "cls").agg((F.sum(F.col("_e") * F.col("value")) / F.sum("_e")).alias("pooled"))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the numbers whose mask is 1; 0 without any."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    return ratio(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))


def last_token(vectors: Column, mask: Column) -> Column:
    """The last element whose mask is 1, or null."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1)
    return F.try_element_at(kept, F.lit(-1))["v"]


def assert_reproduced(now: float, selected: float, tolerance: float = 0.01) -> None:
    """A metric must come out as when its model was selected."""
    if abs(now - selected) > tolerance:
        raise ValueError(f"not reproduced: {now} against {selected}")


def cross_validation(results: DataFrame, pattern: str = r"^(.*)_f(\d+)$") -> DataFrame:
    """Runs (run, f1, precision, recall) by model: mean and population deviation of F1, mean precision and recall, folds; best first."""
    named = results.withColumn("model", F.regexp_extract("run", pattern, 1)).withColumn("fold", F.regexp_extract("run", pattern, 2)).where("model != ''").withColumn("fold", F.col("fold").cast("int"))
    per = named.groupBy("model").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("sd_f1"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.array_join(F.transform(F.array_sort(F.collect_list("fold")), lambda f: f.cast("string")), ",").alias("folds"), F.count("*").alias("n_folds"))
    return per.orderBy(F.desc("mean_f1"), "model")
