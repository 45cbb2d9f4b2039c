"""SQL twins of the operators' queries, for DuckDB: plain statements of what the operators must find."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def jaccard_components(k: int = 4, percent: int = 85) -> str:
    """All pairs that share a shingle, counted exactly; components by reachability; n_links over distinct sets."""
    gram = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return rf"""
with recursive word_lists as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
sets as (
  select doc_id, case when len(w) >= {k} then list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: {gram}))) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end as s
  from word_lists),
distinct_sets as (select s, min(doc_id) as rep, len(s) as n from sets where len(s) > 0 group by s),
tokens as (select rep, n, unnest(s) as token from distinct_sets),
met as (select a.rep as a, b.rep as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from tokens a join tokens b on a.token = b.token and a.rep < b.rep group by 1, 2),
links as (select a, b from met where 100 * common >= {percent} * (na + nb - common)),
two as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, a from two union select r.a, t.b from reach r join two t on r.b = t.a),
component as (select a as rep, min(b) as component from reach group by a),
degree as (select a as rep, count(*) as n_links from two group by a)
select x.doc_id, len(x.s)::bigint as n_shingles, coalesce(c.component, d.rep, x.doc_id) as component_id, coalesce(g.n_links, 0) as n_links
from sets x left join distinct_sets d on x.s = d.s left join component c on c.rep = d.rep left join degree g on g.rep = d.rep"""


QUALITY_BASE = rf"""
with base as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from base),
dup as (select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from lines where regexp_matches(line, '{WORD}') group by doc_id),
grams as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from base where len(w) >= 3),
counted as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from grams),
covered as (select doc_id, count(distinct i + j)::bigint as n_repeat_words from counted, range(3) r(j) where c > 1 group by doc_id),
counts as (
  select b.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from base b left join dup d on b.doc_id = d.doc_id left join covered c on b.doc_id = c.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts"""

PAYLOADS = """
with d as (select doc_id, coalesce(text, '') as t, strlen(coalesce(text, ''))::bigint as n_bytes from documents),
p as (select *, greatest(64, (n_bytes + 63) // 64 * 64)::bigint as payload_bytes from d)
select doc_id, n_bytes, payload_bytes, sha256(t || repeat(chr(0), payload_bytes - n_bytes)) as payload_sha256 from p"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Base32 of 160 bits: 20 bits, as five hex digits, are four letters
WARC = f"""
with payloads as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
firsts as (select h, min(page_id) as first from payloads group by h)
select page_id, strlen(payload)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: '{_BASE32}'[(('0x' || h[i // 4 * 5 + 1 : i // 4 * 5 + 5])::bigint >> (15 - 5 * (i % 4)) & 31) + 1]), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from payloads join firsts using (h)"""


def repeated_passages(window: int = 20) -> str:
    """Windows as strings of words; those that are not the first of their kind cover their words."""
    return rf"""
with word_lists as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from word_lists),
starts as (select doc_id, i, i <= len(w) - {window - 1} and row_number() over (partition by case when i <= len(w) - {window - 1} then array_to_string(w[i : i + {window - 1}], ' ') end order by doc_id, i) > 1 as again, w[i] as word from places),
marked as (select doc_id, i, word, bool_or(again) over (partition by doc_id order by i rows between {window - 1} preceding and current row) as gone from starts),
kept as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from marked group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from word_lists w left join kept k on w.doc_id = k.doc_id"""


def schedule_time(y: str, knots: tuple[float, ...]) -> str:
    """Time by which the fraction ``y`` of a schedule is due; the schedule is linear between equally spaced knots."""
    step = 1 / (len(knots) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False)]
    total, cases = sum(areas), []
    for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        start, slope = sum(areas[:i]) / total, (b - a) / step
        due = f"greatest({y} - {start}::double, 0) * {total}::double"
        x = f"{due} / {a}::double" if not slope else f"(sqrt(greatest({a * a}::double + {due} * {2 * slope}::double, 0)) - {a}::double) / {slope}::double"
        last = i == len(areas) - 1
        cases.append(f"{'else' if last else f'when {y} < {start + areas[i] / total}::double then'} {i * step}::double + least(greatest({x}, 0), {step}::double)")
    return f"case {' '.join(cases)} end"


def mixture(weights: tuple[int, ...] = (5, 2, 1), schedules: tuple[tuple[float, ...], ...] = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5)), seed: int = 23) -> str:
    """Targets, words taken and training positions of two passes."""
    pick = lambda of: "case " + " ".join(f"when place = {i} then {of(i)}" for i in range(len(weights))) + " end"
    y = lambda e: f"((source_size * {e} + place_at) / greatest(target, 1.0::double))"
    words = lambda e: f"greatest(0, least(size, floor(target)::bigint - source_size * {e} - place_at))"
    shown = ", ".join(f"({words(e)})::bigint as words_{e + 1}, case when {words(e)} > 0 then round({pick(lambda i, e=e: schedule_time(y(e), schedules[i]))}, 9) end as position_{e + 1}" for e in range(2))
    return rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size, ('0x' || md5('{seed}|' || coalesce(doc_id::varchar, 'null') || '|' || coalesce(text, ''))[1:15])::bigint as h
  from documents),
totals as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % {len(weights)} as place from sized group by source),
caps as (select *, {pick(lambda i: f"{weights[i]}::double")} as w, 2.0::double * source_size as cap from totals),
filled as (
  select *, row_number() over f as r,
    (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as unit
  from caps window f as (order by cap / w, source nulls last)),
free as (select min(r) as r, arg_min(unit, r) as unit from filled where unit * w <= cap),
plan as (select source, source_size, place, case when free.r is null or filled.r < free.r then cap else free.unit * w end as target from filled cross join free),
placed as (select s.doc_id, s.size, p.source_size, p.target, p.place, (sum(s.size) over (partition by s.source order by h, s.size rows unbounded preceding) - s.size)::bigint as place_at from sized s join plan p on s.source is not distinct from p.source)
select doc_id, size, source_size, target, ({words(0)} + {words(1)})::bigint as taken, {shown} from placed"""


#: orders of the filters from a product of letters; each step counts the cells of its part
FILTER_AUDIT = rf"""
with given as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
said as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
cut as (select *, regexp_extract_all(t, '{WORD}') as w, min(doc_id) over (partition by t) as first_id from given),
masks as (
  select doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first_id, false)::int as mask
  from cut),
cells as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from masks left join said using (doc_id) group by part, mask),
letters(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from letters a, letters b, letters c, letters d, letters e where a.b + b.b + c.b + d.b + e.b = 31 and len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (select filter_order, step, bits[step] as bit, list_sum(list_prepend(0, bits[1:step - 1]))::int as before from orders, range(1, 6) r(step)),
counted as (
  select part, filter_order, step, bit, sum(case when mask & (before | bit) = 0 then n else 0 end) as kept, sum(case when mask & (before | bit) = bit then n else 0 end) as removed,
    sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & (before | bit) = bit then good else 0 end) as good_lost, sum(case when mask & (before | bit) = bit then toxic else 0 end) as toxic_lost
  from cells, steps group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from counted"""


#: prefixes as lists of digests; CRC-32 by its polynomial, as DuckDB has no function for it
PREFIX_TRIE = """
with byte_table as (
  select list(list_reduce(list_prepend(i, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as crc from range(256) r(i)),
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), d) as pos, d, bytes
  from (select *, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d, strlen(coalesce(text, '')) as bytes from conversations where conv_id is not null)),
given as (select conv_id, list({'d': d, 'bytes': bytes} order by pos) as turns from turns group by conv_id),
hashed as (
  select conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 9 as h
  from given, byte_table),
rebuilt as (
  select g.conv_id, list_concat(coalesce(b.turns, [])[1:g.h], g.turns[g.h + 1:]) as turns
  from hashed g left join given b on b.conv_id = g.conv_id - g.conv_id % 5),
prefixes as (select conv_id, len(turns) as n, depth, list_transform(turns[1:depth], lambda t: t.d) as path, coalesce(turns[depth].bytes, 0) as bytes from (select *, unnest(range(0, len(turns) + 1)) as depth from rebuilt)),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256
  from prefixes group by path, depth),
above as (select a.path, a.n_convs, a.bytes, unnest(range(0, a.depth + 1)) as d, not exists (select 1 from nodes c where c.depth = a.depth + 1 and c.path[1:a.depth] = a.path) as leaf from nodes a),
subtree as (select path[1:d] as path, sum((n_convs - 1) * bytes) as saved, count_if(leaf) as leaves from above group by 1),
kids as (select path[1:depth - 1] as path, count(*) as n from nodes where depth > 0 group by 1)
select x.conv_id, x.depth, p.conv_id as parent_conv_id, x.n_convs, coalesce(k.n, 0) as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, x.ends_sha256
from nodes x join subtree s on s.path = x.path left join kids k on k.path = x.path left join nodes p on p.depth = x.depth - 1 and p.path = x.path[1:x.depth - 1]"""
