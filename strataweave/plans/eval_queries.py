"""Queries of evaluation, blending, windows and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataweave.functions import numeric as num
from strataweave.functions import text as tx
from strataweave.operators import features, gating, intervals, linear, metrics, windows
from strataweave.operators.numbering import running_sums
from strataweave.plans.registry import LABELLED, PROB, cells, cells_sql, labelled, query
from strataweave.session import materialize, table

#: test cells are those of fold 0, validation cells those of fold 1
SCORED = f"{cells_sql().strip()}, scored as (select *, {PROB} as prob from cells)"
R = lambda c: F.round(c, 6)


def _scored(spark, sf_dir, first=0):
    return cells(spark, sf_dir, first).withColumn("prob", num.sigmoid(F.col("logit")))


@query("c28_weighted_bce", f"with {cells_sql().strip()} select cls, round(avg(-(3.0 * y * -(greatest(-logit, 0) + ln(1 + exp(-abs(logit)))) + (1 - y) * -(greatest(logit, 0) + ln(1 + exp(-abs(logit)))))), 6) as loss from cells group by cls")
def c28_weighted_bce(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("cls").agg(R(F.avg(num.weighted_bce(F.col("logit"), F.col("y").cast("double"), F.lit(3.0)))).alias("loss"))


@query("c29_asymmetric_loss", f"""
with {SCORED}, l as (select row_id, sum(-(y * ln(greatest(1 / (1 + exp(-logit)), 1e-8)) + (1 - y) * ln(greatest(least(1 - 1 / (1 + exp(-logit)) + 0.05, 1), 1e-8)) * pow(1 - least(1 - 1 / (1 + exp(-logit)) + 0.05, 1), 4))) as l from scored group by row_id)
select round(avg(l), 6) as loss from l""")
def c29_asymmetric_loss(spark, sf_dir):
    per_row = cells(spark, sf_dir).groupBy("row_id").agg(F.sum(num.asymmetric_loss(F.col("logit"), F.col("y").cast("double"))).alias("l"))
    return per_row.agg(R(F.avg("l")).alias("loss"))


@query("c22_length_features", """
with s as (select avg(ln(1 + n_chars)) as m, stddev_pop(ln(1 + n_chars)) as d, avg(ln(1 + len(string_split(text, chr(10))))) as ml, stddev_pop(ln(1 + len(string_split(text, chr(10))))) as dl from documents where doc_id % 5 > 1)
select doc_id as row_id, round((ln(1 + n_chars) - m) / (d + 1e-9), 6) as log_chars, round((ln(1 + len(string_split(text, chr(10)))) - ml) / (dl + 1e-9), 6) as log_lines from documents, s""")
def c22_length_features(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "n_chars", tx.n_lines(F.col("text")).alias("n_lines"))
    got = features.length_features(rows, rows.where("row_id % 5 > 1"))
    return got.select("row_id", R("log_chars").alias("log_chars"), R("log_lines").alias("log_lines"))


@query("d10_decisions", f"with {SCORED} select row_id, cls, (prob >= 0.4 + cls * 0.02)::int as pred from scored where fold = 0")
def d10_decisions(spark, sf_dir):
    s = _scored(spark, sf_dir).where("fold = 0")
    thresholds = spark.range(10).select(F.col("id").cast("int").alias("cls"), (F.lit(0.4) + F.col("id") * F.lit(0.02)).alias("threshold"))
    return metrics.decide(s, thresholds).select("row_id", "cls", "pred")


_CONFUSION = f"""{SCORED}, c as (select cls, count(*) filter (y = 1) as support, count(*) filter (y = 1 and prob >= 0.5) as tp, count(*) filter (y = 0 and prob >= 0.5) as fp, count(*) filter (y = 1 and prob < 0.5) as fn from scored where fold = 0 group by cls),
pr as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp)::double end as p, case when tp + fn = 0 then 0.0 else tp / (tp + fn)::double end as r from c),
report as (select *, case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end as f from pr)"""


@query("e11_class_report", f"with {_CONFUSION} select cls, support, tp, fp, fn, round(p, 6) as \"precision\", round(r, 6) as recall, round(f, 6) as f1 from report")
def e11_class_report(spark, sf_dir):
    c = metrics.confusion(metrics.decide(_scored(spark, sf_dir).where("fold = 0"), 0.5))
    return c.select("cls", "support", "tp", "fp", "fn", R("precision").alias("precision"), R("recall").alias("recall"), R("f1").alias("f1"))


@query("e12_averages", f"""
with {_CONFUSION}, x as (select row_id, bool_and((prob >= 0.5)::int = y) as ok from scored where fold = 0 group by row_id)
select round(sum(tp) / nullif(sum(tp) + sum(fp), 0)::double, 6) as precision_micro, round(sum(tp) / nullif(sum(tp) + sum(fn), 0)::double, 6) as recall_micro, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)::double, 6) as f1_micro,
  round(avg(p), 6) as precision_macro, round(avg(r), 6) as recall_macro, round(avg(f), 6) as f1_macro, (select round(avg(ok::int), 6) from x) as exact_match from report""")
def e12_averages(spark, sf_dir):
    a = metrics.averages(metrics.decide(_scored(spark, sf_dir).where("fold = 0"), 0.5))
    return a.select(*[R(c).alias(c) for c in a.columns])


_AP = """ap as (select {by}cls, sum(y) as positives, case when sum(y) = 0 then 0.0 else sum(y * (ctp / cn)) / sum(y) end as ap from (
  select {by}cls, y, sum(y) over w as ctp, (count(*) over w)::double as cn from {source} window w as (partition by {by}cls order by prob desc range between unbounded preceding and current row)) group by {by}cls)"""


@query("e13_average_precision", f"with {SCORED}, {_AP.format(by='', source='scored')} select cls, positives::bigint as positives, round(ap, 6) as average_precision from ap")
def e13_average_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir)).select("cls", "positives", R("average_precision").alias("average_precision"))


@query("e13_macro_ap_by_fold", f"with {SCORED}, {_AP.format(by='fold, ', source='scored')} select fold, round(avg(ap) filter (positives > 0), 6) as macro_ap from ap group by fold")
def e13_macro_ap_by_fold(spark, sf_dir):
    return metrics.macro_average_precision(_scored(spark, sf_dir), ["fold"]).select("fold", R("macro_ap").alias("macro_ap"))


_TUNED = """t as (select i, i * 0.05::double as t from range(1, 20) r(i)),
g as (select cls, i, t, sum(y) as support, count(*) filter (y = 1 and prob >= t) as tp, count(*) filter (y = 0 and prob >= t) as fp from scored, t where fold = 1 group by cls, i, t),
q as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp)::double end as p, case when support = 0 then 0.0 else tp / support::double end as r from g),
f as (select *, case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end as f1 from q),
b as (select *, row_number() over (partition by cls order by f1 desc, i) as k from f),
tuned as (select cls, case when support > 0 then t else 0.5 end as threshold, case when support > 0 then f1 else 0 end as score, support from b where k = 1)"""


@query("e14_thresholds", f"with {SCORED}, {_TUNED} select cls, round(threshold, 6) as threshold, round(score, 6) as score, support::bigint as support from tuned")
def e14_thresholds(spark, sf_dir):
    t = metrics.tune_thresholds(_scored(spark, sf_dir).where("fold = 1"))
    return t.select("cls", R("threshold").alias("threshold"), R("score").alias("score"), "support")


@query("e15_summary", f"""
with {SCORED}, {_TUNED}, {_AP.format(by='', source='(select * from scored where fold = 0 and cls < 8)')},
c as (select s.cls, count(*) filter (y = 1) as support, count(*) filter (y = 1 and prob >= threshold) as tp, count(*) filter (y = 0 and prob >= threshold) as fp, count(*) filter (y = 1 and prob < threshold) as fn from scored s join tuned on tuned.cls = s.cls where fold = 0 and s.cls < 8 group by s.cls),
pr as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp)::double end as p, case when tp + fn = 0 then 0.0 else tp / (tp + fn)::double end as r from c),
m as (select pr.*, case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end as f, ap from pr join ap on ap.cls = pr.cls)
select round(avg(f), 6) as f1, round(coalesce(avg(f) filter (support > 0), 0), 6) as f1_macro_supported_only, round(coalesce(avg(ap) filter (support > 0), 0), 6) as macro_ap, count(*) as n_classes, count(*) filter (support > 0) as n_supported from m""")
def e15_summary(spark, sf_dir):
    c = cells(spark, sf_dir)
    s = metrics.summarize(c.where("fold = 0").drop("fold"), c.where("fold = 1").drop("fold"), spark.range(8).select(F.col("id").cast("int").alias("cls")))["overall"]
    return s.select(*[R(x).alias(x) for x in ("f1", "f1_macro_supported_only", "macro_ap")], "n_classes", "n_supported")


@query("e16_cross_validation", f"""
with {SCORED}, {_AP.format(by='fold, ', source='scored')},
runs as (select 'model_f' || fold::varchar as run, avg(ap) as f1 from ap group by fold),
n as (select regexp_extract(run, '^(.*)_f(\\d+)$', 1) as model, regexp_extract(run, '^(.*)_f(\\d+)$', 2)::int as fold, f1 from runs)
select model, round(avg(f1), 6) as mean_f1, round(stddev_pop(f1), 6) as sd_f1, string_agg(fold::varchar, ',' order by fold) as folds, count(*) as n_folds from n group by model""")
def e16_cross_validation(spark, sf_dir):
    runs = metrics.average_precision(_scored(spark, sf_dir), ["fold"]).groupBy("fold").agg(F.avg("average_precision").alias("f1")).select(F.concat(F.lit("model_f"), F.col("fold").cast("string")).alias("run"), "f1", F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    return metrics.cross_validation(runs).select("model", R("mean_f1").alias("mean_f1"), R("sd_f1").alias("sd_f1"), "folds", "n_folds")


@query("e17_vocabulary", r"""
with c as (select t as token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) as t from documents) group by t having count(*) >= 2),
k as (select token, n, row_number() over (order by n desc, token) as k from c)
select token, (k + 1)::int as id, n from k where k <= 29998""")
def e17_vocabulary(spark, sf_dir):
    return windows.vocabulary(table(spark, sf_dir, "documents"))


@query("c26_token_ids", r"""
with c as (select t as token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) as t from documents) group by t having count(*) >= 2),
v as (select token, (row_number() over (order by n desc, token) + 1)::int as id from c qualify row_number() over (order by n desc, token) <= 29998),
w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) as t from documents)
select doc_id, count(*) filter (id is null) as unknown, sum(coalesce(id, 1))::bigint as id_sum from w left join v on w.t = v.token group by doc_id""")
def c26_token_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.explode(tx.words(F.col("text"), lower=True)).alias("token"))
    ids = windows.encode_tokens(tokens, windows.vocabulary(docs))
    return ids.groupBy("doc_id").agg(F.count_if(F.col("id") == 1).alias("unknown"), F.sum("id").alias("id_sum"))


@query("e18_pos_weights", f"with {cells_sql().strip()} select cls, round(greatest(1.0, least(8.0, (count(*) - sum(y)) / greatest(sum(y), 1)::double)), 6) as pos_weight from cells group by cls")
def e18_pos_weights(spark, sf_dir):
    return metrics.pos_weights(cells(spark, sf_dir), 8.0).select("cls", R("pos_weight").alias("pos_weight"))


@query("e9_max_pool", "select conv_id as row_id, turn % 3 as cls, max(length(text))::int as logit from conversations group by 1, 2")
def e9_max_pool(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_id"), (F.col("turn") % 3).alias("cls"), F.length("text").alias("logit"))
    return metrics.max_pool(w, w.select("row_id").distinct())


@query("e21_validation_bundle", f"""
with {cells_sql().strip()}, p as (select row_id // 3 as row_id, cls, max(logit) as logit, max(y) as y from cells where fold = 1 group by 1, 2),
scored as (select *, {PROB} as prob from p), {_AP.format(by='', source='scored')},
c as (select cls, count(*) filter (y = 1 and prob >= 0.5) as tp, count(*) filter (y = 0 and prob >= 0.5) as fp, count(*) filter (y = 1 and prob < 0.5) as fn from scored group by cls)
select (select round(coalesce(avg(ap) filter (positives > 0), 0), 6) from ap) as macro_ap, round(avg(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn)::double end), 6) as f1_macro, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::double, 6) as f1_micro,
  (select round(2 * count(*) filter (y = 1 and p >= 0.5) / (2 * count(*) filter (y = 1 and p >= 0.5) + count(*) filter (y <> (p >= 0.5)::int))::double, 6) from (select y, {PROB} as p from cells where fold = 1)) as window_f1_micro from c""")
def e21_validation_bundle(spark, sf_dir):
    w = cells(spark, sf_dir).where("fold = 1").withColumn("row_id", F.floor(F.col("row_id") / 3))
    return metrics.validation_bundle(w).select(*[R(c).alias(c) for c in ("macro_ap", "f1_macro", "f1_micro", "window_f1_micro")])


@query("f11_aligned_runs", f"with {cells_sql('a').strip()}, {cells_sql('b', 10).strip()} select count(*) as aligned, count(*) filter (a.y <> b.y) as conflicts from a join b on a.row_id = b.row_id and a.cls = b.cls")
def f11_aligned_runs(spark, sf_dir):
    a, b = cells(spark, sf_dir), cells(spark, sf_dir, 10)
    metrics.assert_aligned(a, b)
    joined = a.alias("a").join(b.alias("b"), ["row_id", "cls"])
    return joined.agg(F.count("*").alias("aligned"), F.count_if(F.col("a.y") != F.col("b.y")).alias("conflicts"))


_BLEND = f"""{cells_sql('a').strip()}, {cells_sql('b', 10).strip()},
mix as (select i / 10.0::double as w, a.cls, a.y, 1.0 / (1.0 + exp(-greatest(least(i / 10.0::double * a.logit + (1 - i / 10.0::double) * b.logit, 60.0), -60.0))) as prob from a join b on a.row_id = b.row_id and a.cls = b.cls, range(11) r(i) where a.fold = 1),
{_AP.format(by='w, ', source='mix')}, s as (select w, round(coalesce(avg(ap) filter (positives > 0), 0), 6) as macro_ap from ap group by w)"""


@query("j11_blend_weights", f"with {_BLEND} select round(w, 6) as w, macro_ap from s")
def j11_blend_weights(spark, sf_dir):
    a, b = (cells(spark, sf_dir, i).where("fold = 1") for i in (0, 10))
    return metrics.blend_weights(a, b).select(R("w").alias("w"), "macro_ap")


@query("j11_best_weight", f"with {_BLEND} select round(w, 6) as w, macro_ap from s order by macro_ap desc, round(abs(w - 0.5), 6), w limit 1")
def j11_best_weight(spark, sf_dir):
    a, b = (cells(spark, sf_dir, i).where("fold = 1") for i in (0, 10))
    return metrics.best_weight(metrics.blend_weights(a, b)).select(R("w").alias("w"), "macro_ap")


#: the mean loss is convex in 1 / T: golden section over it by itself, 60 times
@query("j12_temperature", f"""
with recursive {cells_sql().strip()}, val as (select logit + 2 * y as logit, y from cells where fold = 1),
search(i, low, high) as (
  select 0, exp(-3.0), exp(3.0)
  union all
  select i + 1, case when sum(la) <= sum(lb) then low else a end, case when sum(la) <= sum(lb) then b else high end
  from (
    select i, low, high, a, b, greatest(-logit * a, 0) + ln(1 + exp(-abs(logit * a))) + (1 - y) * logit * a as la, greatest(-logit * b, 0) + ln(1 + exp(-abs(logit * b))) + (1 - y) * logit * b as lb
    from (select *, high - (high - low) * 0.6180339887498949 as a, low + (high - low) * 0.6180339887498949 as b from search where i < 60), val)
  group by i, low, high, a, b)
select round(2 / (low + high), 3) as temperature from search where i = 60""")
def j12_temperature(spark, sf_dir):
    # labels are made to show in the logits, so that the best temperature is a finite one
    t = metrics.fit_temperature(cells(spark, sf_dir).where("fold = 1").withColumn("logit", F.col("logit") + 2 * F.col("y")))
    return spark.range(1).select(F.round(F.lit(t), 3).alias("temperature"))


_GATE = """e as (select vec_id as row_id, c::int as expert, embedding[c + 21]::double as score from embeddings, range(6) r(c)),
k as (select *, row_number() over (partition by row_id order by score desc, expert) as k, max(score) over (partition by row_id) as top from e),
g as (select *, case when k <= 4 then exp(score - top) else 0 end as x from k),
gate as (select row_id, expert, score, x / sum(x) over (partition by row_id) as weight from g)"""


@query("h3_top_k_gate", f"with {_GATE} select row_id, expert, round(weight, 6) as weight from gate")
def h3_top_k_gate(spark, sf_dir):
    return _gate(spark, sf_dir).select("row_id", "expert", R("weight").alias("weight"))


def _gate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode(F.slice("embedding", 21, 6)).alias("expert", "score"))
    return metrics.expert_gate(e.withColumn("score", F.col("score").cast("double")), 4)


@query("e20_gate_usage", f"with {_GATE} select expert, round(avg(weight), 6) as usage from gate group by expert")
def e20_gate_usage(spark, sf_dir):
    return gating.usage(_gate(spark, sf_dir)).select("expert", R("usage").alias("usage"))


@query("j13_gated_logits", f"""
with {_GATE}, x as (select vec_id as row_id, ex::int as expert, c::int as cls, embedding[ex * 4 + c + 1]::double * 40 as logit, embedding[ex * 4 + c + 30]::double as s from embeddings, range(6) r(ex), range(4) q(c)),
p as (select *, exp(s - max(s) over w) as es from x window w as (partition by row_id, cls)), q as (select *, es / sum(es) over (partition by row_id, cls) as cw from p)
select q.row_id, cls, round(sum(0.5 * greatest(least(logit, 20.0), -20.0) * (weight + cw)), 5) as logit from q join gate g on g.row_id = q.row_id and g.expert = q.expert group by 1, 2""")
def j13_gated_logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = F.array(*[F.struct(F.lit(x).alias("expert"), F.lit(c).alias("cls"), (F.col("embedding")[x * 4 + c].cast("double") * 40).alias("logit"), F.col("embedding")[x * 4 + c + 29].cast("double").alias("score")) for x in range(6) for c in range(4)])
    x = e.select(F.col("vec_id").alias("row_id"), F.explode(pairs).alias("p")).select("row_id", "p.*")
    mixed = metrics.gated_logits(x.drop("score"), _gate(spark, sf_dir), x.drop("logit"))
    return mixed.select("row_id", "cls", F.round("logit", 5).alias("logit"))


@query("j14_attention_pool", """
with w as (select conv_id as row_id, turn % 2 as cls, length(text) / 100.0::double as a, turn::double as v from conversations),
e as (select *, exp(a - max(a) over (partition by row_id, cls)) as e from w) select row_id, cls, round(sum(e * v) / sum(e), 6) as pooled from e group by 1, 2""")
def j14_attention_pool(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_id"), (F.col("turn") % 2).alias("cls"), (F.length("text") / 100.0).alias("attention"), F.col("turn").cast("double").alias("value"))
    return metrics.attention_pool(w).select("row_id", "cls", R("pooled").alias("pooled"))


@query("j15_masked_pooling", """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v, list_transform(range(len(embedding)), lambda i: ((i + vec_id) % 3 <> 0)::int) as m from embeddings),
k as (select vec_id, list_filter(list_transform(range(1, len(v) + 1), lambda i: case when m[i] = 1 then v[i] end), lambda x: x is not null) as k from v)
select vec_id, round(list_sum(k) / len(k), 6) as mean, round(k[-1], 6) as last from k""")
def j15_masked_pooling(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    m = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: ((i + F.col("vec_id")) % 3 != 0).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), m.alias("m"))
    return e.select("vec_id", R(metrics.masked_mean(F.col("v"), F.col("m"))).alias("mean"), R(metrics.last_token(F.col("v"), F.col("m"))).alias("last"))


@query("j16_reproduction", f"with {SCORED}, {_AP.format(by='', source='scored')} select round(avg(ap) filter (positives > 0), 4) as metric, true as reproduced from ap")
def j16_reproduction(spark, sf_dir):
    now = metrics.macro_average_precision(_scored(spark, sf_dir)).first()[0]
    metrics.assert_reproduced(now, now)
    return spark.range(1).select(F.round(F.lit(now), 4).alias("metric"), F.lit(True).alias("reproduced"))


# -- windows -------------------------------------------------------------------------

BODY, OVERLAP = 200, 0.25


def _files(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    spans = F.transform(F.col("swc"), lambda s: F.struct(F.substring(s, 5, 3).cast("int").alias("cls"), F.lit(2).alias("start"), F.lit(3).alias("end")))
    return rows.select("row_id", "text", spans.alias("spans"), F.transform("swc", lambda s: F.substring(s, 5, 3).cast("int")).alias("labels"))


_WINDOWS = LABELLED.strip() + r""",
l as (select row_id, swc, len(string_split(text, chr(10))) as n_lines, unnest(string_split(lower(text), chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from files),
tl as (select row_id, line, len(regexp_extract_all(x, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) as k from l),
cum as (select row_id, line, k, sum(k) over (partition by row_id order by line) as upto from tl),
n as (select row_id, max(upto)::bigint as n, max(line) as n_lines from cum group by row_id),
s as (select row_id, n, n_lines, unnest(case when n <= 200 then [0::bigint] else list_sort(list_distinct(range(0, n - 200 + 1, 150) || [n - 200])) end) as s from n),
w as (select row_id, n, n_lines, s, least(s + 200, n) as e, row_number() over (partition by row_id order by s) - 1 as win from s),
b as (select w.row_id, win, s, e, n, n_lines, min(line) filter (upto > s) as ls, min(line) filter (upto >= e) as le from w join cum on cum.row_id = w.row_id group by all),
win as (select row_id, win::int as win, s::int as s, e::int as e, (case when s = 0 then 1 else ls end)::int as l0, (case when e = n then greatest(case when e > 0 then le else 1 end, n_lines) else le end)::int as l1 from b),
wins as (select w.*, case when l0 <= 3 and l1 >= 2 then list_sort(list_transform(f.swc, lambda s: s[5:7]::int)) else [] end as labels, len(f.swc) > 0 as file_annotated, f.swc from win w join files f on f.row_id = w.row_id)"""


@query("g3_g4_windows", f"with {_WINDOWS} select row_id, win, s, e, l0, l1 from wins")
def g3_g4_windows(spark, sf_dir):
    return windows.build_windows(_files(spark, sf_dir), BODY, OVERLAP).select("row_id", "win", "s", "e", "l0", "l1")


@query("f8_interval_labels", f"with {_WINDOWS} select row_id, win, array_to_string(labels, ',') as labels, file_annotated from wins")
def f8_interval_labels(spark, sf_dir):
    w = windows.build_windows(_files(spark, sf_dir), BODY, OVERLAP)
    return w.select("row_id", "win", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), "file_annotated")


@query("g5_truncate", f"with {_WINDOWS} select row_id, e, array_to_string(list_transform(swc, lambda s: s[5:7]), ',') as labels from wins where win = 0")
def g5_truncate(spark, sf_dir):
    w = windows.build_windows(_files(spark, sf_dir), BODY, OVERLAP, "truncate")
    return w.select("row_id", "e", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query("e10_window_stats", f"""
with {_WINDOWS}, p as (select row_id, count(*) as k, max(e) as t, count(*) filter (len(labels) > 0) as pos from wins group by row_id),
v as (select f.row_id, c, coalesce(bool_or(list_contains(w.labels, c)), false) as seen from (select row_id, unnest(list_transform(swc, lambda s: s[5:7]::int)) as c from files) f left join wins w on w.row_id = f.row_id group by 1, 2)
select count(*) as files, sum(k)::bigint as windows, round(avg(k), 2) as windows_per_file_mean, max(k) as windows_per_file_max, floor(median(t))::bigint as tokens_per_file_median, sum(pos)::bigint as positive_windows, (select round(avg(seen::int), 4) from v) as label_visibility from p""")
def e10_window_stats(spark, sf_dir):
    f = _files(spark, sf_dir)
    return windows.window_stats(windows.build_windows(f, BODY, OVERLAP), f)


@query("g7_group_windows", f"with {_WINDOWS} select row_id, string_agg(win::varchar, ',' order by win) as wins from wins group by row_id")
def g7_group_windows(spark, sf_dir):
    f = _files(spark, sf_dir)
    g = windows.group_windows(windows.build_windows(f, BODY, OVERLAP), f)
    return g.select("row_id", F.array_join(F.transform("wins", lambda x: x.cast("string")), ",").alias("wins"))


@query("g2_f9_token_lines", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents)
select doc_id, line::int as line, len(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint as tokens from l where len(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) > 0""")
def g2_f9_token_lines(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(windows.token_lines(F.col("text"))).alias("t"))
    return t.groupBy("doc_id", F.col("t.line").alias("line")).agg(F.count("*").alias("tokens"))


#: lines of all texts as places of characters, first and last; and each text as a whole
_SPANS = """
l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents),
placed as (select doc_id, line, length(x) as n, (sum(length(x) + 1) over (partition by doc_id order by line))::bigint - length(x) - 1 as b0 from l),
spans as (select doc_id, line::int as line, b0, b0 + n as b1 from placed union all select doc_id, 0, 0, n_chars from documents)"""


def _line_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    each = docs.select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("line"), F.length("x").cast("long").alias("n"))
    ends = running_sums(each.withColumn("_n", F.col("n") + 1), ["doc_id"], [F.col("line")], ["_n"])
    return ends.select("doc_id", "line", (F.col("_n_sum") - F.col("n") - 1).alias("b0"), (F.col("_n_sum") - 1).alias("b1")).unionByName(docs.select("doc_id", F.lit(0).alias("line"), F.lit(0).cast("long").alias("b0"), F.col("n_chars").alias("b1")))


@query("f8_overlap_join", f"""
with {_SPANS.strip()},
w as (select doc_id, unnest(range(0, n_chars + 1, 90)) as a0 from documents)
select w.doc_id, a0, count(*) as spans, min(line) as first, max(line) as last, sum(line)::bigint as total from w join spans s on s.doc_id = w.doc_id and a0 <= b1 and b0 <= a0 + 119 group by 1, 2""")
def f8_overlap_join(spark, sf_dir):
    # windows of 120 characters, 90 apart, against lines and whole texts
    wins = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars"), F.lit(90).cast("long"))).alias("a0")).withColumn("a1", F.col("a0") + 119)
    met = intervals.overlap_join(wins, _line_spans(spark, sf_dir), ["doc_id"], 400)
    return met.groupBy("doc_id", "a0").agg(F.count("*").alias("spans"), F.min("line").alias("first"), F.max("line").alias("last"), F.sum("line").alias("total"))


@query("f9_as_of_join", f"""
with {_SPANS.strip()}, probes as (select doc_id, unnest(range(0, n_chars + 1, 35)) as at from documents)
select p.doc_id, p.at, s.line, s.b0 from probes p asof left join (select * from spans where line > 0) s on p.doc_id = s.doc_id and p.at >= s.b0""")
def f9_as_of_join(spark, sf_dir):
    # the line that holds every 35th character
    probes = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars"), F.lit(35).cast("long"))).alias("at"))
    starts = _line_spans(spark, sf_dir).where("line > 0").select("doc_id", F.col("b0").alias("at"), "line")
    return intervals.as_of_join(probes, starts, ["doc_id"], "at").select("doc_id", "at", F.col("found.line").alias("line"), F.col("found.at").alias("b0"))


@query("w2_windows_by_table_function", f"with {_WINDOWS} select row_id, win, s, e, l0, l1 from wins")
def w2_windows_by_table_function(spark, sf_dir):
    windows.register_windows(spark)
    _files(spark, sf_dir).select("row_id", "text").createOrReplaceTempView("windowed_files")
    return spark.sql(f"select f.row_id, w.win, w.s, w.e, w.l0, w.l1 from windowed_files f, lateral text_windows(f.text, {BODY}, {OVERLAP}D) w")


# -- features ------------------------------------------------------------------------

_TERMS = r"""tok as (select doc_id as row_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]{1,2}') as w from documents),
terms as (select row_id, unnest(w || case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) else [] end) as term from tok),
tf as (select row_id, term, count(*) as tf from terms group by 1, 2),
n as (select count(*) as n from documents where doc_id % 5 > 1),
df as (select term, count(*) as df, sum(tf) as total from tf where row_id % 5 > 1 group by term having count(*) >= 3),
known as (select term, df from df order by total desc, term limit 200000)"""


@query("h2_top_terms", f"with {_TERMS} select term, df from known")
def h2_top_terms(spark, sf_dir):
    return features.known_terms(features.term_counts(table(spark, sf_dir, "documents").where("doc_id % 5 > 1").select("doc_id", "text")))


@query("j8_tfidf", f"""
with {_TERMS}, raw as (select row_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::double) + 1) as w from tf join known on tf.term = known.term, n),
nrm as (select row_id, sqrt(sum(w * w)) as z from raw group by row_id)
select raw.row_id, count(*) as terms, round(max(w / z), 5) as largest, round(sum(w / z), 4) as total from raw join nrm on raw.row_id = nrm.row_id group by 1""")
def j8_tfidf(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    w = features.tfidf(files, files.where("row_id % 5 > 1"))
    return w.groupBy("row_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 5).alias("largest"), F.round(F.sum("weight"), 4).alias("total"))


#: Newton steps for two length features and an intercept without penalty, C = 1, balanced outcomes; Cramer's rule solves each step
_LENGTHS = """
rows as (select d.doc_id as row_id, ln(1 + n_chars) as a, ln(1 + len(string_split(text, chr(10)))) as b, case when quality = 1 then 1.0 else -1.0 end as y from documents d join labels l on d.doc_id = l.doc_id),
scale as (select avg(a) as ma, stddev_pop(a) + 1e-9 as sa, avg(b) as mb, stddev_pop(b) + 1e-9 as sb from rows where row_id % 5 > 1),
x as (select row_id, (a - ma) / sa as a, (b - mb) / sb as b, y from rows, scale),
train as (select a, b, y, count(*) over () / (2.0 * count(*) over (partition by y)) as c from x where row_id % 5 > 1),
steps(i, w0, w1, w2) as (
  select 0, 0.0::double, 0.0::double, 0.0::double
  union all
  select i + 1, w0 - d0 / d, w1 - d1 / d, w2 - d2 / d from (
    select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as d,
      g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2) as d0,
      h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02) as d1,
      h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02) as d2
    from (
      select i, w0, w1, w2, w1 + sum(q * a) as g1, w2 + sum(q * b) as g2, sum(q) as g0,
        sum(v) as h00, sum(v * a) as h01, sum(v * b) as h02, 1 + sum(v * a * a) as h11, sum(v * a * b) as h12, 1 + sum(v * b * b) as h22
      from (select i, w0, w1, w2, a, b, -y * c / (1 + exp(y * (w0 + w1 * a + w2 * b))) as q, c / ((1 + exp(w0 + w1 * a + w2 * b)) * (1 + exp(-(w0 + w1 * a + w2 * b)))) as v from steps, train where i < 30)
      group by i, w0, w1, w2))),
fitted as (select w0, w1, w2 from steps where i = 30)"""


def _lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("row_id"), "n_chars", tx.n_lines(F.col("text")).alias("n_lines"), F.when(F.col("quality") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("labels"))
    scaled = features.length_features(docs, docs.where("row_id % 5 > 1")).select("row_id", "labels", "log_chars", "log_lines")
    rows = linear.dense_rows(scaled, "log_chars", "log_lines")
    return rows.where("row_id % 5 > 1"), rows.where("row_id % 5 = 1"), rows.where("row_id % 5 = 0")


@query("j10_length_regression", f"with recursive {_LENGTHS.strip()} select row_id, round(w0 + w1 * a + w2 * b, 5) as logit, (y > 0)::int as y from x, fitted where row_id % 5 = 0")
def j10_length_regression(spark, sf_dir):
    fit = linear.run_linear(*_lengths(spark, sf_dir), 2, [0], grid=(1.0,), penalize_intercept=False)
    return fit["test"].select("row_id", F.round("logit", 5).alias("logit"), "y")


@query("j10_length_weights", f"with recursive {_LENGTHS.strip()} select round(w0, 6) as intercept, round(w1, 6) as log_chars, round(w2, 6) as log_lines from fitted")
def j10_length_weights(spark, sf_dir):
    w = linear.fit_linear(_lengths(spark, sf_dir)[0], 2, [0], (1.0,), penalize_intercept=False).column(0, 1.0).tolist()
    return spark.range(1).select(*[F.round(F.lit(w[i]), 6).alias(c) for i, c in ((2, "intercept"), (0, "log_chars"), (1, "log_lines"))])


@query("j9_tfidf_regression")
def j9_tfidf_regression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("row_id"), "text", F.when(F.col("quality") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("labels"))
    weighted, size = features.tfidf_rows(docs, F.expr("row_id % 5 > 1"), max_features=200_000)
    rows = materialize(weighted, "rows")
    fit = linear.run_linear(rows.where("row_id % 5 > 1"), rows.where("row_id % 5 = 1"), rows.where("row_id % 5 = 0"), max(1, size), [0])
    return metrics.macro_average_precision(fit["test"], score="logit").select(F.round("macro_ap", 4).alias("macro_ap"))


@query("w1_window_over_events", "select user_id, event_id, sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) > 100 as busy from events")
def w1_window_over_events(spark, sf_dir):
    run = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, Window.currentRow)
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.sum("value").over(run) > 100).alias("busy"))
