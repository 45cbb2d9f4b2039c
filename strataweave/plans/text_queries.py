"""Queries of the scalar library (projections and predicates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import numeric as num
from strataweave.functions import text as tx
from strataweave.operators import dedup, windows
from strataweave.plans.registry import MARKED, MARKED_LINES, NORMAL, cells, cells_sql, marked_text, query
from strataweave.plans.titles import TITLES, title
from strataweave.session import table

_JOINED = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ";")


@query("c1_canonicalize", rf"""
with {MARKED_LINES.strip()}
select doc_id, count(*)::int as n_annot_lines, count(*) filter (y <> '')::int as n_lines, count(*) filter (y = '')::int as n_deleted,
  count(*) filter (regexp_matches(x, '(?i)//\s*SWC-'))::int as n_markers,
  md5(string_agg(y, chr(10) order by i) filter (y <> '')) as text_md5
from lines group by doc_id""")
def c1_canonicalize(spark, sf_dir):
    docs = tx.canonicalized(table(spark, sf_dir, "documents"), marked_text())
    return docs.select("doc_id", "c.n_annot_lines", "c.n_lines", F.size("c.deleted").alias("n_deleted"), F.size("c.markers").alias("n_markers"), F.md5("c.text").alias("text_md5"))


@query("c2_markers", rf"""
with {MARKED_LINES.strip()}
select doc_id, i::int as line, 'SWC-' || nullif(regexp_extract(x, '(?i)//\s*SWC-(\d+)', 1), '') as swc, regexp_matches(x, '(?i)^\s*//\s*SWC-') as own
from lines where regexp_matches(x, '(?i)//\s*SWC-')""")
def c2_markers(spark, sf_dir):
    docs = tx.canonicalized(table(spark, sf_dir, "documents"), marked_text()).select("doc_id", F.explode("c.markers").alias("m"))
    return docs.select("doc_id", "m.line", "m.swc", "m.own")


@query("c3_map_lines", rf"""
with {MARKED_LINES.strip()},
k as (select doc_id, i from lines where y <> ''),
n as (select doc_id, count(*) as n_annot, count(*) filter (y <> '') as n_kept, max(doc_id % 7) as a from lines group by doc_id)
select n.doc_id,
  greatest(1, least(1 + (select count(*) from k where k.doc_id = n.doc_id and k.i < greatest(1, least(a, n_annot))), n_kept))::int as start,
  greatest(greatest(1, least(1 + (select count(*) from k where k.doc_id = n.doc_id and k.i < greatest(1, least(a, n_annot))), n_kept)),
    greatest(1, least((select count(*) from k where k.doc_id = n.doc_id and k.i <= greatest(1, least(a + 3, n_annot))), n_kept)))::int as "end"
from n""")
def c3_map_lines(spark, sf_dir):
    docs = tx.canonicalized(table(spark, sf_dir, "documents"), marked_text()).select("doc_id", "c", (F.col("doc_id") % 7).cast("int").alias("a"))
    return docs.select("doc_id", tx.map_range(F.col("a"), F.col("a") + 3, F.col("c.kept"), F.col("c.n_annot_lines")).alias("r")).select("doc_id", "r.start", "r.end")


#: line fields in the formats in use
FIELDS = ["L21-23", "L5, L9", "L10-12、20-25", "205-253", "all contract", "N/A", "swc-101 here", "no number", " ", "L9;3，7-2"]


@query("c5_line_field", f"""
with s as (select doc_id, trim([{', '.join(f"'{f}'" for f in FIELDS)}][(doc_id % 10)::int + 1] || case when doc_id // 10 % 3 = 1 then '; L' || n_chars::varchar || '-L' || len(string_split(text, chr(10)))::varchar else '' end) as s from documents),
p as (select doc_id, s, list_filter(list_transform(regexp_split_to_array(s, '[,、，;]'), lambda x: regexp_extract_all(x, '\\d+')), lambda x: len(x) > 0) as n from s),
k as (select *, case when upper(s) in ('', 'N/A', 'NA', 'NONE', '-') then 'none' when regexp_matches(s, '(?i)swc-') then 'marker' when regexp_matches(s, '(?i)\\ball\\b') then 'whole' when len(n) > 0 then 'ranges' else 'none' end as kind from p)
select doc_id, kind, case when kind = 'ranges' then array_to_string(list_transform(n, lambda x: least(x[1]::int, x[-1]::int)::varchar || '-' || greatest(x[1]::int, x[-1]::int)::varchar), ';') else '' end as ranges
from k""")
def c5_line_field(spark, sf_dir):
    # every third ten with a range of the text's own size
    more = F.when(F.floor(F.col("doc_id") / 10) % 3 == 1, F.concat(F.lit("; L"), F.col("n_chars").cast("string"), F.lit("-L"), tx.n_lines(F.col("text")).cast("string"))).otherwise("")
    field = F.concat(F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (F.col("doc_id") % 10 + 1).cast("int")), more)
    return table(spark, sf_dir, "documents").select("doc_id", tx.parse_line_field(field).alias("p")).select("doc_id", "p.kind", _JOINED("p.ranges").alias("ranges"))


@query("c6_annotation_spans", rf"""
with {MARKED_LINES.strip()},
k as (select doc_id, list(i order by i) as kept from lines where y <> '' group by doc_id),
n as (select doc_id, count(*) as n_annot, count(*) filter (y <> '') as n_kept from lines group by doc_id),
j as (select n.doc_id, n_annot, n_kept, coalesce(kept, []) as kept, n.doc_id % 4 as f from n left join k on n.doc_id = k.doc_id),
s as (select *, case f when 0 then 2 else 1 end as a, case f when 0 then 3 else 2 end as b from j)
select doc_id, case f when 0 then 'ranges' when 1 then 'whole' when 2 then 'marker' else 'unknown' end as source,
  case when f in (1, 3) then '1-' || greatest(n_kept, 1)::varchar
    when f = 0 then greatest(1, least(1 + len(list_filter(kept, lambda z: z < least(2, n_annot))), n_kept))::varchar || '-' || greatest(greatest(1, least(1 + len(list_filter(kept, lambda z: z < least(2, n_annot))), n_kept)), greatest(1, least(len(list_filter(kept, lambda z: z <= least(3, n_annot))), n_kept)))::varchar
    else greatest(1, least(1 + len(list_filter(kept, lambda z: z < least(2, n_annot))), n_kept))::varchar || '-' || greatest(1, least(1 + len(list_filter(kept, lambda z: z < least(2, n_annot))), n_kept))::varchar end as spans
from s""")
def c6_annotation_spans(spark, sf_dir):
    field = F.element_at(F.array(F.lit("L2-3"), F.lit("all"), F.lit("see marker"), F.lit("unclear")), (F.col("doc_id") % 4 + 1).cast("int"))
    swc = F.when(F.col("doc_id") % 4 == 3, "SWC-999").otherwise(F.concat(F.lit("SWC-"), (F.col("doc_id") % 37 + 100).cast("string")))
    docs = tx.canonicalized(table(spark, sf_dir, "documents"), marked_text()).select("doc_id", tx.annotation_spans(field, F.col("c"), swc).alias("s"))
    return docs.select("doc_id", "s.source", _JOINED("s.spans").alias("spans"))


@query("c7_category", r"""
with c as (select doc_id, case doc_id % 3 when 0 then '  SWC-' || (100 + doc_id % 37)::varchar || '-' || text when 1 then 'swc-101 ' || text else text end as c from documents)
select doc_id, 'SWC-' || nullif(regexp_extract(c, '^\s*SWC-(\d+)', 1), '') as swc from c""")
def c7_category(spark, sf_dir):
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  SWC-"), (F.col("doc_id") % 37 + 100).cast("string"), F.lit("-"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("swc-101 "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.category(given).alias("swc"))


@query("c8_strip_comments", r"""
select page_id, regexp_replace(html || chr(10) || url || chr(10) || '/* a' || chr(10) || 'b */ code /*' || html || '*/', '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g') as code from pages""")
def c8_strip_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_comments(F.concat("html", F.lit("\n"), "url", F.lit("\n/* a\nb */ code /*"), "html", F.lit("*/"))).alias("code"))


@query("c10_content_hash", f"select doc_id, sha1({NORMAL}) as norm_hash, left(sha1({NORMAL}), 16) as content_id from documents")
def c10_content_hash(spark, sf_dir):
    h = tx.content_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("norm_hash"), F.substring(h, 1, 16).alias("content_id"))


@query("c11_paths", r"""
with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as p from pages)
select page_id, split_part(p, '/', 1) as audit_dir, regexp_replace(p, '^[^/]*/', '') as rest from p""")
def c11_paths(spark, sf_dir):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", tx.audit_dir(p).alias("audit_dir"), tx.path_in_audit(p).alias("rest"))


@query("c12_codebase_key", r"""
with l as (select doc_id, source, case doc_id % 6 when 0 then 'https://GitHub.com/Own/Repo' || (doc_id % 9)::varchar || '.git' when 1 then 'see gitlab.com/A/b?x' when 2 then 'GitHub - Team/Lib.js: text'
  when 3 then 'at 0x' || repeat(chr(65 + (doc_id % 6)::int), 40) when 4 then 'https://tronscan.org/#/contract/T' || doc_id::varchar || '/code' else '' end as s from documents)
select doc_id, case
  when regexp_matches(s, '(?i)\b(github|gitlab)\.com/([^/\s]+)/([^/\s#?;,]+)') then lower(regexp_extract(s, '(?i)\b(github|gitlab)\.com/([^/\s]+)/([^/\s#?;,]+)', 1)) || ':' || lower(regexp_extract(s, '(?i)\b(github|gitlab)\.com/([^/\s]+)/([^/\s#?;,]+)', 2)) || '/' || regexp_replace(lower(regexp_extract(s, '(?i)\b(github|gitlab)\.com/([^/\s]+)/([^/\s#?;,]+)', 3)), '\.git$', '')
  when regexp_matches(s, '(?i)GitHub\s*-\s*([\w.-]+)/([\w.-]+)') then 'github:' || lower(regexp_extract(s, '(?i)GitHub\s*-\s*([\w.-]+)/([\w.-]+)', 1)) || '/' || lower(regexp_extract(s, '(?i)GitHub\s*-\s*([\w.-]+)/([\w.-]+)', 2))
  when regexp_matches(s, '0x[0-9a-fA-F]{40}') then 'addr:' || lower(regexp_extract(s, '0x[0-9a-fA-F]{40}'))
  when regexp_matches(s, 'tronscan\.org/#/contract/(\w+)') then 'tron:' || regexp_extract(s, 'tronscan\.org/#/contract/(\w+)', 1)
  else 'dir:' || source end as codebase from l""")
def c12_codebase_key(spark, sf_dir):
    k = F.col("doc_id") % 6
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    link = (
        F.when(k == 0, F.concat(F.lit("https://GitHub.com/Own/Repo"), text(F.col("doc_id") % 9), F.lit(".git"))).when(k == 1, "see gitlab.com/A/b?x").when(k == 2, "GitHub - Team/Lib.js: text")
        .when(k == 3, F.concat(F.lit("at 0x"), F.repeat(F.char(F.col("doc_id") % 6 + 65), F.lit(40)))).when(k == 4, F.concat(F.lit("https://tronscan.org/#/contract/T"), text("doc_id"), F.lit("/code"))).otherwise("")
    )
    return table(spark, sf_dir, "documents").select("doc_id", tx.codebase_key(link, F.col("source")).alias("codebase"))


_CODE = ["abstract contract A {}", "interface I {} interface J {}", "library L {} interface I {}", "pragma x;", "contract  C$ is D {}"]


@query("c13_declarations", rf"""
with c as (select doc_id, [{', '.join(f"'{c}'" for c in _CODE)}][(doc_id % 5)::int + 1] || chr(10) || text || case when doc_id % 4 = 0 then ' interface ' || text else '' end as t from documents),
k as (select doc_id, list_transform(regexp_extract_all(t, '\b(abstract\s+contract|contract|library|interface)\s+[A-Za-z_$][\w$]*', 1), lambda x: regexp_replace(x, '^abstract\s+', '')) as kinds from c)
select doc_id, array_to_string(kinds, ',') as kinds, len(kinds) > 0 and len(list_filter(kinds, lambda x: x <> 'interface')) = 0 as interface_only from k""")
def c13_declarations(spark, sf_dir):
    more = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" interface "), "text")).otherwise("")
    code = F.concat(F.element_at(F.array(*[F.lit(c) for c in _CODE]), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("\n"), "text", more)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.declaration_kinds(code), ",").alias("kinds"), tx.is_interface_only(code).alias("interface_only"))


_PATHS = ["a/Test/x.sol", "src/MockToken.sol", "src/Mockery.sol", "b/Token.t.sol", "c/my_test_x.sol", "d/TokenHarness.sol", "e/latest/y.sol", "FUZZ/z.sol"]


@query("c14_test_paths", rf"""
with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') || '/' || [{', '.join(f"'{p}'" for p in _PATHS)}][(page_id % 8)::int + 1] as p from pages)
select page_id, p as path, regexp_matches(p, '(?i)(^|/)(test|tests|testing|mock|mocks|harness|harnesses|echidna|fuzz|fuzzing|certora)/')
  or regexp_matches(p, '(^|/)(Test|Mock)[A-Z0-9_][^/]*\.sol$|(Test|Mock|Mocks|Tester|Harness)\.sol$') or regexp_matches(p, '(?i)\.t\.sol$|(^|/)[^/]*[_-](test|mock)[^/]*\.sol$') as is_test from p""")
def c14_test_paths(spark, sf_dir):
    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("page_id") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), tx.is_test_or_mock(path).alias("is_test"))


@query("c15_text_stats", "select doc_id, len(string_split(text, chr(10)))::bigint as n_lines, length(text)::bigint as n_code_points from documents")
def c15_text_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.n_lines(F.col("text")).alias("n_lines"), F.length("text").cast("long").alias("n_code_points"))


@query("c17_titles", f"""
with t(n, title) as (values {', '.join(f"('{k}', '{v}')" for k, v in TITLES.items())}),
s as (select doc_id, (case when doc_id % 2 = 0 then 'SWC-' else '' end) || (100 + doc_id % 40)::varchar as swc from documents)
select doc_id, swc, coalesce(title, 'unknown') as title from s left join t on t.n = replace(upper(swc), 'SWC-', '')""")
def c17_titles(spark, sf_dir):
    swc = F.concat(F.when(F.col("doc_id") % 2 == 0, "SWC-").otherwise(""), (F.col("doc_id") % 40 + 100).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", swc.alias("swc"), title(swc).alias("title"))


@query("c18_span_json", """
select doc_id, '[{"cls":' || (n_chars % 3)::varchar || ',"swc":"' || source || '","start":1,"end":' || len(string_split(text, chr(10)))::varchar || '}]' as spans_json, len(string_split(text, chr(10)))::int as last_line from documents""")
def c18_span_json(spark, sf_dir):
    span = F.struct((F.col("n_chars") % 3).cast("int").alias("cls"), F.col("source").alias("swc"), F.lit(1).alias("start"), tx.n_lines(F.col("text")).cast("int").alias("end"))
    json = table(spark, sf_dir, "documents").select("doc_id", tx.span_json(F.array(span)).alias("spans_json"))
    back = F.from_json("spans_json", "array<struct<cls:int,swc:string,start:int,end:int>>")
    return json.select("doc_id", "spans_json", back[0]["end"].alias("last_line"))


@query("c19_multi_hot", """
select doc_id, c::int as cls, (c in (n_chars % 4, len(string_split(text, chr(10))) % 6))::int as y from documents, range(6) r(c)""")
def c19_multi_hot(spark, sf_dir):
    labels = F.array((F.col("n_chars") % 4).cast("int"), (tx.n_lines(F.col("text")) % 6).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(dedup.multi_hot(labels, 6)).alias("cls", "y"))


@query("c20_sigmoid", f"with {cells_sql().strip()} select row_id, cls, round(1.0 / (1.0 + exp(-greatest(least(logit * 100, 60.0), -60.0))), 6) as prob from cells")
def c20_sigmoid(spark, sf_dir):
    return cells(spark, sf_dir).select("row_id", "cls", F.round(num.sigmoid(F.col("logit") * 100), 6).alias("prob"))


@query("c21_finite", f"with {cells_sql().strip()}, v as (select row_id, cls, case when cls = 0 then 'nan'::double when cls = 1 then 'infinity'::double when cls = 2 then '-infinity'::double else logit * 50 end as x from cells) select row_id, cls, round(case when isnan(x) then 0.0 else greatest(least(x, 20.0), -20.0) end, 6) as x from v")
def c21_finite(spark, sf_dir):
    x = F.when(F.col("cls") == 0, F.lit(float("nan"))).when(F.col("cls") == 1, F.lit(float("inf"))).when(F.col("cls") == 2, F.lit(float("-inf"))).otherwise(F.col("logit") * 50)
    return cells(spark, sf_dir).select("row_id", "cls", F.round(num.finite(x), 6).alias("x"))


@query("c23_words", r"""
with w as (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') as w from documents)
select doc_id, len(w)::int as n_words, md5(array_to_string(w, ' ')) as words_md5 from w""")
def c23_words(spark, sf_dir):
    docs = tx.bound(table(spark, sf_dir, "documents").select("doc_id", "text"), "w", tx.words(F.col("text")))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query("c24_code_tokens", r"""
with w as (select page_id, regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]{1,2}') as w from pages)
select page_id, len(w)::int as n_tokens, array_to_string(w, ' ') as tokens from w""")
def c24_code_tokens(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", tx.code_tokens(F.col("html")).alias("w"))
    return pages.select("page_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query("c25_line_starts", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)
select doc_id, i::int as line, coalesce(sum(length(x) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from l""")
def c25_line_starts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.line_starts(F.col("text"))).alias("i", "start"))
    return docs.select("doc_id", (F.col("i") + 1).alias("line"), "start")


@query("c27_frame_and_pad", """
with b as (select conv_id, turn, list_transform(range(1, turn % 6 + 1), lambda x: (x + 10)::int) as body from conversations),
f as (select conv_id, turn, [101::int] || body || [102::int] as ids from b)
select conv_id, turn, array_to_string(ids || list_transform(range(0, ((8 - len(ids) % 8) % 8)::bigint), lambda x: 0::int), ' ') as ids, len(ids)::int as n from f""")
def c27_frame_and_pad(spark, sf_dir):
    body = F.when(F.col("turn") % 6 > 0, F.transform(F.sequence(F.lit(1), F.greatest((F.col("turn") % 6).cast("int"), F.lit(1))), lambda x: x + 10)).otherwise(F.array().cast("array<int>"))
    ids = windows.frame(body, [101], [102])
    full, mask = windows.padded(F.col("ids"), F.size("ids"))
    framed = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"))
    return framed.select("conv_id", "turn", F.array_join(F.transform(full, lambda x: x.cast("string")), " ").alias("ids"), F.aggregate(mask, F.lit(0), lambda a, m: a + m).alias("n"))


@query("d1_scope_filter", rf"""
with p as (select doc_id, source || '/' || [{', '.join(f"'{p}'" for p in _PATHS)}][(doc_id % 8)::int + 1] as p, case when doc_id % 11 = 0 then ' ' else [{', '.join(f"'{c}'" for c in _CODE)}][(doc_id % 5)::int + 1] || chr(10) || text end as t, doc_id % 7 = 0 as labelled from documents),
r as (select *, case when labelled then null when regexp_replace(t, '\s+', '', 'g') = '' then 'empty'
  when regexp_matches(p, '(?i)(^|/)(test|tests|testing|mock|mocks|harness|harnesses|echidna|fuzz|fuzzing|certora)/') or regexp_matches(p, '(^|/)(Test|Mock)[A-Z0-9_][^/]*\.sol$|(Test|Mock|Mocks|Tester|Harness)\.sol$') or regexp_matches(p, '(?i)\.t\.sol$|(^|/)[^/]*[_-](test|mock)[^/]*\.sol$') then 'test_mock'
  when regexp_matches(t, '\binterface\s+[A-Za-z_$]') and not regexp_matches(t, '\b(contract|library)\s+[A-Za-z_$]') then 'interface_only' end as reason from p)
select coalesce(reason, 'in_scope') as reason, count(*) as files from r group by 1""")
def d1_scope_filter(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("doc_id") % 8 + 1).cast("int")))
    code = F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.concat(F.element_at(F.array(*[F.lit(c) for c in _CODE]), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("\n"), "text"))
    reason = tx.scope_reason(code, path, F.col("doc_id") % 7 == 0)
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(reason, F.lit("in_scope")).alias("reason")).agg(F.count("*").alias("files"))


@query("d2_marker_guard", rf"""
with {MARKED_LINES.strip()}, t as (select doc_id, string_agg(y, chr(10) order by i) filter (y <> '') as t from lines group by doc_id)
select count(*) as texts, count(*) filter (regexp_matches(t, '(?i)//\s*swc-')) as survivors, count(*) filter (regexp_matches({MARKED.replace('doc_id', 'd.doc_id')}, '(?i)//\s*swc-')) as before from t join documents d on d.doc_id = t.doc_id""")
def d2_marker_guard(spark, sf_dir):
    docs = tx.canonicalized(table(spark, sf_dir, "documents"), marked_text()).select(marked_text().alias("m"), F.col("c.text").alias("t"))
    leak = r"(?i)//\s*swc-"
    return docs.agg(F.count("*").alias("texts"), F.count_if(F.col("t").rlike(leak)).alias("survivors"), F.count_if(F.col("m").rlike(leak)).alias("before"))
