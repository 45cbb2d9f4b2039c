"""Queries over the file table: aggregation, joins, sets, sampling, near duplicates, grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import text as tx
from strataweave.operators import dedup, graph, grouping, near_dup, sampling
from strataweave.operators.numbering import numbered
from strataweave.plans.registry import LABELLED, MARKED_LINES, NORMAL, labelled, marked_text, query
from strataweave.plans.titles import TITLES, title
from strataweave.session import ship, table
from strataweave.sources import sinks

DEDUPED = LABELLED.strip() + rf""",
h as (select *, sha1({NORMAL}) as norm_hash from files),
r as (select *, row_number() over (partition by norm_hash order by -len(swc), rel_path) as k from h),
u as (select norm_hash, list_sort(list_distinct(flatten(list(swc)))) as swc_all, count(*) as n_copies, list_sort(list_distinct(list(audit_dir))) as dirs from h group by norm_hash),
merged as (select r.row_id, r.rel_path, r.codebase, r.lang, r.text, r.fold, u.* from r join u on r.norm_hash = u.norm_hash where k = 1)"""

CLASSES = DEDUPED + """,
counts as (select swc, count(*) as n_files from (select unnest(swc_all) as swc from merged) group by swc),
status as (select *, case when swc in ('SWC-102', 'SWC-103') then 'project_level' when n_files >= 20 then 'included' else 'rare' end as status from counts),
classes as (select swc, n_files, status, case when status = 'included' then (row_number() over (partition by status order by n_files desc, swc) - 1)::int end as cls, status = 'included' and n_files >= 100 as scored from status)"""

ROWS = CLASSES + """,
flat as (select norm_hash, s.* from (select norm_hash, unnest(swc_all) as swc from merged) m join classes s on m.swc = s.swc),
per_file as (select norm_hash, list_sort(list(cls) filter (cls is not null)) as labels, bool_or(status = 'rare') as has_rare from flat group by norm_hash),
labelled_rows as (select m.*, coalesce(labels, []) as labels, coalesce(has_rare and len(coalesce(labels, [])) = 0, false) as excluded from merged m left join per_file p on m.norm_hash = p.norm_hash)"""


def _merged(spark, sf_dir):
    return dedup.exact_duplicates(labelled(spark, sf_dir))


def _classes(merged):
    return dedup.select_classes(merged, least_files=20, eval_least_files=100)


def _rows(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    classes = _classes(merged)
    return dedup.label_rows(merged, classes), classes


@query("e1_exact_dedup", f"with {DEDUPED} select norm_hash, left(norm_hash, 16) as content_id, rel_path, n_copies, array_to_string(dirs, ',') as copy_audit_dirs from merged")
def e1_exact_dedup(spark, sf_dir):
    return _merged(spark, sf_dir).select("norm_hash", "content_id", "rel_path", "n_copies", F.array_join("copy_audit_dirs", ",").alias("copy_audit_dirs"))


@query("e1_flagship", f"with {DEDUPED} select lang, count(*) as unique_files, sum(n_copies)::bigint as files, round(avg(list_contains(swc_all, 'SWC-101')::int), 6) as positive_rate from merged group by lang")
def e1_flagship(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("unique_files"), F.sum("n_copies").alias("files"), F.round(F.avg(F.array_contains("swc_all", "SWC-101").cast("int")), 6).alias("positive_rate"))


@query("e2_label_union", f"with {DEDUPED} select norm_hash, array_to_string(swc_all, ',') as swc_all from merged where len(swc_all) > 0")
def e2_label_union(spark, sf_dir):
    return _merged(spark, sf_dir).where(F.size("swc_all") > 0).select("norm_hash", F.array_join("swc_all", ",").alias("swc_all"))


@query("e3_class_counts", f"with {CLASSES} select swc, n_files, status, cls from classes")
def e3_class_counts(spark, sf_dir):
    return _classes(_merged(spark, sf_dir)).select("swc", "n_files", "status", "cls")


@query("d4_d6_class_support", f"with {CLASSES} select cls, swc, n_files, scored from classes where status = 'included'")
def d4_d6_class_support(spark, sf_dir):
    return _classes(_merged(spark, sf_dir)).where("status = 'included'").select("cls", "swc", "n_files", "scored")


@query("d5_excluded_rows", f"with {ROWS} select rel_path, 'only_rare_classes' as reason, array_to_string(swc_all, ';') as swc from labelled_rows where excluded")
def d5_excluded_rows(spark, sf_dir):
    rows, _ = _rows(spark, sf_dir)
    return rows.where("excluded").select("rel_path", F.lit("only_rare_classes").alias("reason"), F.array_join("swc_all", ";").alias("swc"))


@query("dm6_file_table", f"with {ROWS} select norm_hash, rel_path, codebase, n_copies, array_to_string(swc_all, ',') as swc_all, array_to_string(labels, ',') as labels, len(string_split(text, chr(10)))::bigint as n_lines, length(text)::bigint as n_chars, (row_number() over (order by norm_hash) - 1)::bigint as row_id from labelled_rows where not excluded")
def dm6_file_table(spark, sf_dir):
    from strataweave.plans.build import with_row_ids

    rows, _ = _rows(spark, sf_dir)
    kept = rows.where("not excluded").select("norm_hash", "rel_path", "codebase", "n_copies", F.array_join("swc_all", ",").alias("swc_all"), F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), tx.n_lines(F.col("text")).alias("n_lines"), F.length("text").cast("long").alias("n_chars"))
    return with_row_ids(kept)


@query("e4_counters", rf"""
with {MARKED_LINES.strip()}
select count(distinct doc_id) as files, count(*) filter (regexp_matches(x, '(?i)//\s*SWC-')) as markers, count(*) filter (y = '') as deleted_lines, count(*) as lines from lines""")
def e4_counters(spark, sf_dir):
    c = tx.canonicalized(table(spark, sf_dir, "documents"), marked_text()).select("c")
    return c.agg(F.count("*").alias("files"), F.sum(F.size("c.markers")).alias("markers"), F.sum(F.size("c.deleted")).alias("deleted_lines"), F.sum("c.n_annot_lines").alias("lines"))


@query("e5_class_by_fold", f"with {ROWS}, g as (select c.cls, f::bigint as fold from classes c, range(5) r(f) where c.cls is not null), s as (select fold, unnest(labels) as cls from labelled_rows where not excluded) select g.cls, g.fold::int as fold, count(s.cls) as positives from g left join s on g.cls = s.cls and g.fold = s.fold group by 1, 2")
def e5_class_by_fold(spark, sf_dir):
    rows, classes = _rows(spark, sf_dir)
    return dedup.per_fold_counts(rows.where("not excluded"), classes, 5)


@query("e5_fold_rollup", f"with {LABELLED.strip()} select fold, lang, count(*) as files, count(*) filter (len(swc) > 0) as positive from files group by rollup (fold, lang)")
def e5_fold_rollup(spark, sf_dir):
    return labelled(spark, sf_dir).rollup("fold", "lang").agg(F.count("*").alias("files"), F.count_if(F.size("swc") > 0).alias("positive"))


@query("e6_group_sizes", f"with {LABELLED.strip()}, g as (select codebase, count(*) as n from files group by codebase) select count(*) as codebases, max(n) as largest_rows, round(avg(n), 6) as mean_rows from g")
def e6_group_sizes(spark, sf_dir):
    return grouping.group_sizes(labelled(spark, sf_dir)).select(F.col("groups").alias("codebases"), "largest_rows", F.round("mean_rows", 6).alias("mean_rows"))


@query("e7_thin_classes", f"with {ROWS}, g as (select c.cls, f::bigint as fold from classes c, range(5) r(f) where c.cls is not null), s as (select fold, unnest(labels) as cls from labelled_rows where not excluded), n as (select g.cls, g.fold, count(s.cls) as k from g left join s on g.cls = s.cls and g.fold = s.fold group by 1, 2) select cls, min(k) as least, min(k) < 3 as thin from n group by cls")
def e7_thin_classes(spark, sf_dir):
    rows, classes = _rows(spark, sf_dir)
    return dedup.thin_classes(rows.where("not excluded"), classes, 5)


@query("e19_fingerprints", f"with {LABELLED.strip()} select count(distinct sha1(codebase || '|' || fold::varchar)) as fingerprints from files")
def e19_fingerprints(spark, sf_dir):
    return labelled(spark, sf_dir).agg(F.count_distinct(F.sha1(F.concat_ws("|", "codebase", F.col("fold").cast("string")))).alias("fingerprints"))


@query("e22_split_distribution", f"with {LABELLED.strip()} select case fold when 0 then 'test' when 1 then 'val' else 'train' end as split, s as swc, count(*) as files from (select fold, unnest(swc) as s from files) group by 1, 2")
def e22_split_distribution(spark, sf_dir):
    return dedup.split_distribution(labelled(spark, sf_dir), "swc").withColumnRenamed("label", "swc")


@query("d3_split_files", f"with {LABELLED.strip()} select case fold when 0 then 'test' when 1 then 'val' else 'train' end as split, count(*) as files, sum(row_id)::bigint as id_sum from files group by 1")
def d3_split_files(spark, sf_dir):
    parts = sampling.split_folds(labelled(spark, sf_dir))
    named = [p.select("row_id").withColumn("split", F.lit(n)) for n, p in zip(("train", "val", "test"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("split").agg(F.count("*").alias("files"), F.sum("row_id").alias("id_sum"))


@query("f1_left_join_labels", "select d.doc_id, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id")
def f1_left_join_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("f2_anti_join", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def f2_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("f3_dimension_join", "with c as (select lang, count(*) as n from documents group by lang) select d.doc_id, d.lang, c.n as lang_files from documents d left join c on d.lang = c.lang")
def f3_dimension_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(docs.groupBy("lang").agg(F.count("*").alias("lang_files")), "lang", "left").select("doc_id", "lang", "lang_files")


@query("f10_nearest_equal_line", """
with d as (select doc_id, string_split(text, chr(10)) as src, string_split('intro' || chr(10) || text, chr(10)) as dst from documents),
t as (select doc_id, src, dst, unnest(range(1, len(dst) + 1)) as hit from d),
e as (select doc_id, least(2, len(src)) as n, len(src) as ns, len(dst) as nd, trim(src[least(2, len(src))]) as key from d),
m as (select e.doc_id, e.nd, t.hit, row_number() over (partition by e.doc_id order by abs(t.hit - e.n * e.nd / e.ns::double), t.hit) as k from e join t on e.doc_id = t.doc_id and trim(t.dst[t.hit]) = e.key and e.key <> '')
select e.doc_id, coalesce(m.hit, 1)::int as new_start, coalesce(m.hit, e.nd)::int as new_end from e left join m on e.doc_id = m.doc_id and m.k = 1""")
def f10_nearest_equal_line(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    at = F.least(F.lit(2), F.size(tx.lines(F.col("text"))))
    spans = docs.select(F.col("doc_id").alias("span_id"), F.col("text").alias("src"), F.concat(F.lit("intro\n"), "text").alias("dst"), at.alias("start"), at.alias("end"))
    return dedup.map_spans_by_text(spans).select(F.col("span_id").alias("doc_id"), "new_start", "new_end")


@query("f12_class_dimension", f"with {CLASSES}, t(n, title) as (values {', '.join(f"('{k}', '{v}')" for k, v in TITLES.items())}) select swc, coalesce(title, 'unknown') as title, n_files from classes left join t on n = replace(swc, 'SWC-', '')")
def f12_class_dimension(spark, sf_dir):
    return _classes(_merged(spark, sf_dir)).select("swc", title(F.col("swc")).alias("title"), "n_files")


@query("g1_positional_ids", "select doc_id, (row_number() over (partition by source order by doc_id) - 1)::int as pos, (dense_rank() over (order by source) - 1)::int as group_id from documents")
def g1_positional_ids(spark, sf_dir):
    placed = numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "at", F.col("source"), F.col("doc_id"))
    firsts = numbered(placed.groupBy("source").agg(F.min("at").alias("first")), "group_id", F.col("source"))
    return placed.join(firsts, "source").select("doc_id", (F.col("at") - F.col("first")).cast("int").alias("pos"), F.col("group_id").cast("int").alias("group_id"))


@query("g6_shingles", rf"""
with w as (select doc_id, regexp_extract_all({NORMAL}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') as w from documents),
g as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) else [array_to_string(w, ' ')] end as g from w)
select doc_id, len(g)::int as n_shingles, md5(array_to_string(list_sort(g), '|')) as digest from g""")
def g6_shingles(spark, sf_dir):
    tokens = tx.bound(table(spark, sf_dir, "documents").select("doc_id", "text"), "t", tx.words(tx.normalize_code(F.col("text"))))
    return tx.bound(tokens, "g", tx.shingles(F.col("t"), 5)).select("doc_id", F.size("g").alias("n_shingles"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest"))


@query("h1_sorted_pairs", "select s.doc_id as a, t.doc_id as b, s.n_chars from documents s join documents t on s.text = t.text and s.doc_id < t.doc_id order by n_chars desc, a, b")
def h1_sorted_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    return docs.alias("s").join(docs.alias("t"), "h").where("s.doc_id < t.doc_id").select(F.col("s.doc_id").alias("a"), F.col("t.doc_id").alias("b"), F.col("s.n_chars").alias("n_chars")).orderBy(F.desc("n_chars"), "a", "b")


@query("h4_balance", f"""
with {LABELLED.strip()}, w as (select fold, round_even(count(*) * 0.2, 0)::bigint as want from files where len(swc) > 0 group by fold),
o as (select row_id, fold, row_number() over (partition by fold order by sha1('42|' || fold::varchar || '|' || row_id::varchar)) as k from files where len(swc) = 0)
select row_id, fold from files where len(swc) > 0 union all select o.row_id, o.fold from o join w on o.fold = w.fold where k <= want""")
def h4_balance(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("row_id", "fold", F.col("swc").alias("labels"))
    return sampling.balance(rows, safe_ratio=0.2).select("row_id", "fold")


@query("h5_cap_rows", f"""
with {LABELLED.strip()}, p as (select row_id from files where len(swc) > 0 order by sha1('42|' || row_id::varchar) limit 50),
n as (select row_id from files where len(swc) = 0 order by sha1('42|' || row_id::varchar) limit 50) select * from p union all select * from n""")
def h5_cap_rows(spark, sf_dir):
    return sampling.cap_rows(labelled(spark, sf_dir).select("row_id", F.col("swc").alias("labels")), 100).select("row_id")


def _repeats_sql(cells: str, item: str, threshold: int, target: int, factor: float, seed: int) -> str:
    """Repeats of items of rare classes: cells has the item and cls."""
    return f"""
counts as (select cls, count(*) as c from {cells} group by cls having count(*) < {threshold}),
wanted as (select cls, c, trunc(least({target} - c, ({factor} - 1.0) * c))::int as need from counts),
draws as (select cls, c, unnest(range(1, need + 1)) as copy from wanted where need > 0),
places as (select cls, copy, ('0x' || substr(sha1('{seed}|' || cls::varchar || '|' || copy::varchar), 1, 8))::bigint % c + 1 as k from draws),
pool as (select cls, {item}, row_number() over (partition by cls order by sha1('{seed}|' || cls::varchar || '|' || {item}::varchar)) as k from {cells} where cls in (select cls from wanted where need > 0)),
repeats as (select pool.{item}, places.copy::int as copy from places join pool on pool.cls = places.cls and pool.k = places.k)"""


_NUMBERS = "list_transform(swc, lambda s: s[5:7]::int)"


@query("h6_resample_windows", f"""
with {LABELLED.strip()}, w as (select row_id as win_id, case when row_id % 2 = 0 then {_NUMBERS} else [] end as labels, len(swc) > 0 as annotated from files),
cells as (select win_id, unnest(labels) as cls from w), {_repeats_sql("cells", "win_id", 60, 120, 5.0, 42).strip()},
easy as (select win_id, row_number() over (order by sha1('42|' || win_id::varchar)) as k, round_even(count(*) over () * 0.3, 0) as want from w where len(labels) = 0 and not annotated),
al as (select win_id, 'positive' as why, 0 as copy from w where len(labels) > 0 union all select win_id, 'hard_negative', 0 from w where len(labels) = 0 and annotated
  union all select win_id, 'easy_negative', 0 from easy where k <= want union all select win_id, 'repeat', copy from repeats)
select *, sha1('42|' || why || '|' || win_id::varchar || '|' || copy::varchar) as position from al""")
def h6_resample_windows(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    numbers = F.transform("swc", lambda s: F.substring(s, 5, 3).cast("int"))
    w = rows.select(F.col("row_id").alias("win_id"), F.when(F.col("row_id") % 2 == 0, numbers).otherwise(F.array().cast("array<int>")).alias("labels"), (F.size("swc") > 0).alias("file_annotated"))
    return sampling.resample_windows(w, threshold=60, target=120)


@query("h7_epoch_files", f"""
with {LABELLED.strip()}, f as (select row_id, {_NUMBERS} as labels from files),
cells as (select row_id, unnest(labels) as cls from f), {_repeats_sql("cells", "row_id", 50, 150, 5.0, 43).strip()},
others as (select row_id, row_number() over (order by sha1('42|1|' || row_id::varchar)) as k, round_even(count(*) over () * 0.5, 0) as want from f where len(labels) = 0),
al as (select row_id, 'labelled' as why, 0 as copy from f where len(labels) > 0 union all select row_id, 'unlabelled', 0 from others where k <= want union all select row_id, 'repeat', copy from repeats)
select *, sha1('42|1|' || why || '|' || row_id::varchar || '|' || copy::varchar) as position from al""")
def h7_epoch_files(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("row_id", F.transform("swc", lambda s: F.substring(s, 5, 3).cast("int")).alias("labels"))
    return sampling.epoch_files(rows, epoch=1, neg_ratio=0.5)


@query("h8_length_sort", "select doc_id, n_chars, ntile(4) over (order by n_chars, doc_id)::int as part from documents")
def h8_length_sort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sampling.length_sorted(docs, "n_chars", "doc_id", 4).sort("part", "n_chars", "doc_id")


@query("i1_i4_set_operations", """
with a as (select doc_id from documents where lang = 'en'), b as (select doc_id from labels where quality = 1)
select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b)
union all select 'except', count(*) from (select * from a except select * from b) union all select 'union_all', count(*) from (select * from a union all select * from b)""")
def i1_i4_set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("except", a.subtract(b))).union(count("union_all", a.union(b)))


#: distinct 5-token shingles of each document
_GRAMS = rf"""
w as (select doc_id, regexp_extract_all({NORMAL}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') as w from documents),
g as (select doc_id, case when len(w) >= 5 then list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]))) else [array_to_string(w, ' ')] end as g from w)"""

#: all pairs at the threshold by exact counts: LSH misses one of 0.8 in 5,000
_NEAR = f"""{_GRAMS.strip()},
reps as (select g, min(doc_id) as rep, len(g) as n from g group by g),
copies as (select r.rep as row_a, g.doc_id as row_b, 1.0::double as jaccard from g join reps r on g.g = r.g where g.doc_id <> r.rep),
tokens as (select rep, n, unnest(g) as token from reps),
met as (select a.rep as row_a, b.rep as row_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::double as jaccard from tokens a join tokens b on a.token = b.token and a.rep < b.rep group by 1, 2),
near as (select * from met where jaccard >= 0.8 union all select * from copies)"""


@query("j3_near_duplicates", f"with {_NEAR} select row_a, row_b, jaccard from near")
def j3_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicate_pairs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"))


@query("j3_near_duplicate_classes", f"""
with recursive {_NEAR.strip().removeprefix('recursive ')}, two as (select row_a as a, row_b as b, jaccard from near union all select row_b, row_a, jaccard from near),
reach(a, b) as (select a, a from two union select r.a, t.b from reach r join two t on r.b = t.a),
class as (select a as doc_id, min(b) as class_id from reach group by a),
links as (select a as doc_id, count(*) as n from two where jaccard < 1 group by a),
firsts as (select row_b as doc_id, row_a as rep from near where jaccard = 1)
select d.doc_id as row_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(l.n, 0) as n_links
from documents d left join class c on c.doc_id = d.doc_id left join firsts f on f.doc_id = d.doc_id left join links l on l.doc_id = coalesce(f.rep, d.doc_id)""")
def j3_near_duplicate_classes(spark, sf_dir):
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"))


#: pairs that SQL can make too: equal texts, and neighbours of one source of equal language
_PAIRS = "pairs as (select a.doc_id as row_a, b.doc_id as row_b, round(least(a.n_chars, b.n_chars) / greatest(a.n_chars, b.n_chars)::double, 6) as jaccard from documents a join documents b on b.doc_id = a.doc_id + 7 and a.lang = b.lang where least(a.n_chars, b.n_chars) / greatest(a.n_chars, b.n_chars)::double >= 0.8)"


def _pairs(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_a"), "lang", F.col("n_chars").alias("x"))
    b = table(spark, sf_dir, "documents").select((F.col("doc_id") - 7).alias("row_a"), "lang", F.col("n_chars").alias("y"))
    share = F.least("x", "y") / F.greatest("x", "y").cast("double")
    return a.join(b, ["row_a", "lang"]).where(share >= 0.8).select("row_a", (F.col("row_a") + 7).alias("row_b"), F.round(share, 6).alias("jaccard"))


@query("f6_exposed_rows", f"with {LABELLED.strip()}, {_PAIRS}, two as (select row_a, row_b from pairs union all select row_b, row_a from pairs) select row_id, exists (select 1 from two t join files f on f.row_id = t.row_b and f.fold not in (0, 1) where t.row_a = e.row_id) as exposed from files e where fold = 0")
def f6_exposed_rows(spark, sf_dir):
    files = labelled(spark, sf_dir)
    return near_dup.exposed_rows(_pairs(spark, sf_dir), files.where("fold = 0").select("row_id"), files.where("fold not in (0, 1)"))


@query("f7_pairs_within", f"with {_PAIRS} select * from pairs where row_a in (select doc_id from labels) and row_b in (select doc_id from labels)")
def f7_pairs_within(spark, sf_dir):
    return near_dup.pairs_within(_pairs(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id")))


@query("e8_leakage", f"""
with {LABELLED.strip()}, {_PAIRS}, two as (select row_a, row_b from pairs union all select row_b, row_a from pairs),
f2 as (select t.row_a as row_id, bool_or(a.fold <> b.fold) as crossed, bool_or(a.fold in (0, 1) and b.fold not in (0, 1)) as trained from two t join files a on a.row_id = t.row_a join files b on b.row_id = t.row_b group by 1),
m as (select f.fold, len(f.swc) > 0 as positive, coalesce(crossed, false)::int as c, coalesce(trained, false)::int as t from files f left join f2 on f.row_id = f2.row_id)
select (select count(*) from pairs) as near_dup_pairs, (select count(*) from pairs p join files a on a.row_id = p.row_a join files b on b.row_id = p.row_b where a.fold <> b.fold) as cross_fold_pairs,
  round(coalesce(avg(c), 0), 4) as rows_with_cross_fold_twin, round(coalesce(avg(t) filter (fold = 0), 0), 4) as test_rows_with_train_twin,
  round(coalesce(avg(t) filter (fold = 0 and positive), 0), 4) as test_positive_rows_with_train_twin, round(coalesce(avg(t) filter (fold = 1), 0), 4) as val_rows_with_train_twin from m""")
def e8_leakage(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("row_id", "fold", (F.size("swc") > 0).alias("positive"))
    return near_dup.leakage_report(rows, _pairs(spark, sf_dir))


@query("j5_capped_groups", f"""
with recursive {LABELLED.strip()}, {_PAIRS},
codes as (select codebase, count(*)::bigint as n, row_number() over (order by codebase) as k from files group by codebase),
sizes as (select list(n order by k) as n, sum(n)::bigint // 4 as cap from codes),
linked as (select x.k as p, y.k as q, pairs.* from pairs join files a on a.row_id = row_a join files b on b.row_id = row_b join codes x on x.codebase = least(a.codebase, b.codebase) join codes y on y.codebase = greatest(a.codebase, b.codebase) where a.codebase <> b.codebase),
strongest as (select p, q, min(struct_pack(j := -jaccard, a := row_a, b := row_b)) as o from linked group by 1, 2),
steps as (select p, q, row_number() over (order by o) as i from strongest),
state(i, g) as (
  select 0::bigint, list(k order by k) from codes
  union all
  select s.i, case when g[p] <> g[q] and list_sum(list_transform(range(1, len(g) + 1), lambda x: case when g[x] = g[p] or g[x] = g[q] then n[x] else 0 end)) <= cap
    then list_transform(g, lambda x: case when x = greatest(g[p], g[q]) then least(g[p], g[q]) else x end) else g end
  from state join steps s on s.i = state.i + 1, sizes),
last as (select g from state order by i desc limit 1),
roots as (select codebase, g[k] as root from codes, last)
select codebase, (dense_rank() over (order by root) - 1)::bigint as group_id from roots""")
def j5_capped_groups(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("row_id", "codebase")
    cap = rows.count() // 4
    return grouping.capped_groups(rows, _pairs(spark, sf_dir), cap)


@query("j6_components", f"""
with recursive {_PAIRS}, two as (select row_a as a, row_b as b from pairs union select row_b, row_a from pairs),
reach(a, b) as (select a, a from two union select r.a, t.b from reach r join two t on r.b = t.a)
select a as node, min(b) as component from reach group by a""")
def j6_components(spark, sf_dir):
    return graph.connected_components(_pairs(spark, sf_dir), "row_a", "row_b")


#: the greedy assignment, one group a step; the state is rows by fold, and positives by fold and class
@query("j7_folds", f"""
with recursive {LABELLED.strip()},
r as (select row_id // 9 as g, list_transform(swc, lambda s: s[5:7]::int) as labels from files),
sizes as (select g, count(*)::bigint as n from r group by g),
cells as (select g, c, count(*)::bigint as n from (select g, unnest(labels) as c from r) group by 1, 2),
total as (select c, sum(n)::bigint as t, row_number() over (order by c) as k from cells group by c),
per as (select s.g, s.n, list(coalesce(x.n, 0) order by t.k) as own, min(case when x.n > 0 then t.t end) as rarest, coalesce(sum(x.n), 0) as positives from sizes s cross join total t left join cells x on x.g = s.g and x.c = t.c group by 1, 2),
ordered as (select *, row_number() over (order by rarest nulls last, positives desc, n desc, sha1('42|group|' || g::varchar)) as i from per),
fixed as (select list(t order by k) as t, (select sum(n) from sizes) / 5.0::double as want from total),
state(i, g, fold, have_rows, have) as (
  select 0::bigint, null::bigint, null::bigint, [0, 0, 0, 0, 0]::bigint[], (select list_transform(range(5), lambda f: list_transform(t, lambda x: 0::bigint)) from fixed)
  union all
  select i, g, best, list_transform(range(1, 6), lambda f: have_rows[f] + case when f = best + 1 then n else 0 end), list_transform(range(1, 6), lambda f: list_transform(range(1, len(own) + 1), lambda c: have[f][c] + case when f = best + 1 then own[c] else 0 end))
  from (
    select *, list_min(list_transform(list_filter(range(5), lambda f: abs(need[f + 1] - list_max(need)) <= greatest(1e-5 * greatest(abs(need[f + 1]), abs(list_max(need))), 1e-8)), lambda f: sha1('42|fold|' || g::varchar || '|' || f::varchar) || f::varchar))[41:]::bigint as best
    from (
      select o.i, o.g, o.n, o.own, s.have_rows, s.have, list_transform(range(1, 6), lambda f: case when positives > 0
        then coalesce(list_sum(list_transform(list_filter(range(1, len(own) + 1), lambda c: own[c] > 0), lambda c: 1 - have[f][c] * 5 / t[c]::double)), 0) + 0.5::double * ((want - have_rows[f]) / want) else (want - have_rows[f]) / want end) as need
      from state s join ordered o on o.i = s.i + 1, fixed)))
select g as group_id, fold from state where i > 0""")
def j7_folds(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    numbers = F.transform("swc", lambda s: F.substring(s, 5, 3).cast("int"))
    return grouping.stratified_folds(rows.select((F.col("row_id") / 9).cast("long").alias("group_id"), numbers.alias("labels")))


@query("b9_fingerprint", f"""
with {LABELLED.strip()}, l as (select row_id, sha1(text) || '|' || fold::varchar || '|[' || array_to_string(list_transform(swc, lambda s: s[5:]), ', ') || ']|[]' || chr(10) as line from files),
b as (select row_id // 100000 as b, sha256(string_agg(line, '' order by row_id)) as d from l group by 1)
select sha256(string_agg(d, '' order by b) || 'x=1') as fingerprint from b""")
def b9_fingerprint(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("row_id", F.sha1("text").alias("content_id"), "fold", F.transform("swc", lambda s: F.substring(s, 5, 3)).alias("labels"), F.lit("[]").alias("spans_json"))
    return sinks.fingerprint(rows, "x=1")


@query("g8_pack_files", """
with recursive w as (select conv_id as row_id, list(turn::bigint order by turn) as all_windows from conversations group by 1),
c as (select row_id, case when len(all_windows) > 6 then list_sort(list_transform(list_sort(list_transform(all_windows, lambda x: sha1('42|' || row_id::varchar || '|' || x::varchar) || x::varchar))[:6], lambda s: s[41:]::bigint)) else all_windows end as windows from w),
o as (select row_id % 4 as part, row_id, windows, len(windows)::bigint as k, row_number() over (partition by row_id % 4 order by row_id) as i from c),
p(part, i, row_id, windows, batch, filled) as (
  select part, i, row_id, windows, 0::bigint, k from o where i = 1
  union all
  select o.part, o.i, o.row_id, o.windows, case when p.filled > 0 and p.filled + o.k > 16 then p.batch + 1 else p.batch end, case when p.filled > 0 and p.filled + o.k > 16 then o.k else p.filled + o.k end from p join o on o.part = p.part and o.i = p.i + 1)
select part::int as partition, batch, row_id, array_to_string(windows, ',') as windows from p""")
def g8_pack_files(spark, sf_dir):
    ship(spark)
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("row_id")).agg(F.array_sort(F.collect_list(F.col("turn").cast("long"))).alias("windows"))
    packed = sampling.pack_files(turns.withColumn("part", F.col("row_id") % 4), window_batch=16, max_windows=6, by="part")
    return packed.withColumn("windows", F.array_join(F.transform("windows", lambda w: w.cast("string")), ","))
