"""The queries opN_<name> over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import twins
from strataweave.session import ship, table


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the rank file."""
    from strataweave.llm.bpe import encode_tokens

    ship(spark)
    return encode_tokens(table(spark, sf_dir, "documents"), ranks_path(), pretoken_pattern(), keep=["doc_id"], with_ids=False)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents: 4-word shingles, Jaccard of at least 0.85."""
    from strataweave.llm.jaccard_join import jaccard_components

    ship(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rule and boosted-tree verdict of every document."""
    from strataweave.llm.quality import STATS, quality_rules, train_quality

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    trees = train_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, trees, keep=["doc_id"]).select("doc_id", *STATS, "base_failed", "kept", "score")


def op7_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as AVI motion-JPEG and back, with its timed clips."""
    from pyspark.sql import functions as F

    from strataweave.llm.media import text_media

    ship(spark)
    return text_media(table(spark, sf_dir, "documents")).withColumn("clips", F.to_json("clips"))


#: action and host/path of the rules of op4
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by rules and alias classes: canonical links, meta refreshes and canonical forms."""
    from strataweave.llm.url_filters import canonical_edges, judge_urls, link_edges, rules_table

    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, rules_table(spark, URL_RULES), link_edges(pages).unionByName(canonical_edges(pages)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives and read them back."""
    from pyspark.sql import functions as F

    from strataweave.llm.warc import plan_records, read_archives, write_archives

    ship(spark)
    read = read_archives(write_archives(plan_records(table(spark, sf_dir, "pages"))), with_payload=False)
    # these archives are its own: a gap in them is an error
    lost = F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "gap_reason")).cast("boolean")
    return read.where(F.when(F.col("gap_reason").isNotNull(), lost).otherwise(F.lit(True))).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document, and when, by pass."""
    from pyspark.sql import functions as F

    from strataweave.llm.mixing import mix_sources

    ship(spark)
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    at = lambda i: F.try_element_at("passes", F.lit(i + 1))
    each = [c for i in range(2) for c in (F.coalesce(at(i)["words"], F.lit(0)).alias(f"words_{i + 1}"), F.round(at(i)["position"], 9).alias(f"position_{i + 1}"))]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", *each).orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shuffled shards."""
    from pyspark.sql import functions as F

    from strataweave.llm.sharding import external_shuffle

    ship(spark)
    out = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-id files with Elias-Fano boundaries, and back."""
    import public_tokenizers

    from strataweave.llm.token_store import read_tokens, token_folder, write_tokens

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), token_folder(docs)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without repeated 20-word windows."""
    from strataweave.llm.substring import substring_dedup

    ship(spark)
    return substring_dedup(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    from pyspark.sql import functions as F

    from strataweave.llm.language_id import identify_languages, learn_languages

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = identify_languages(docs, learn_languages(docs.where(~held_out)), keep=["doc_id"], spans=False)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all 120 orders of five filters remove from all documents, by language."""
    from strataweave.llm.filter_audit import filter_audit

    ship(spark)
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each with the first turns of the first of its five."""
    from strataweave.llm.prefix_trie import placed_turns, prefix_trie, spliced

    ship(spark)
    return prefix_trie(*spliced(*placed_turns(table(spark, sf_dir, "conversations"))))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and base rule of op3, which SQL can express."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded bytes of op1, which are the text's."""
    return op1_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 reads back from its files."""
    return op7_avi_mjpeg(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filters": op4_url_filters,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_avi_mjpeg": op7_avi_mjpeg,
    "op8_sharding": op8_sharding,
    "op9_token_store": op9_token_store,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_language_id": op11_language_id,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
    "bpe_round_trip": bpe_round_trip,
    "media_payloads": media_payloads,
    "quality_base_counts": quality_base_counts,
}

_RULE_ROWS = ", ".join(f"('{action}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}')" for action, rule in URL_RULES)

SQL: dict[str, str] = {
    "op2_jaccard_join": twins.jaccard_components(),
    "op5_warc": twins.WARC,
    "op6_mixing": twins.mixture(),
    "op10_substring_dedup": twins.repeated_passages(),
    "op12_filter_audit": twins.FILTER_AUDIT,
    "op13_prefix_trie": twins.PREFIX_TRIE,
    "bpe_round_trip": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents",
    "media_payloads": twins.PAYLOADS,
    "quality_base_counts": twins.QUALITY_BASE,
    "op4_url_filters": rf"""
with recursive rules(action, rule_host, rule_path, rule) as (values {_RULE_ROWS}),
named as (
  select page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1), '') as query
  from pages),
tags as (
  select host, path, query, host || path || query as a, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) as t
  from named),
full_targets as (
  select a, case when t like '//%' then 'http:' || t when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then t when t like '/%' then 'http://' || host || t
    when t like '#%' then 'http://' || host || path || query when t like '?%' then 'http://' || host || path || t
    else 'http://' || host || case when path = '' then '/' else regexp_extract(path, '(?s)^(.*/)', 1) end || t end as t
  from (select * replace (replace(t, '&amp;', '&') as t) from tags) where t != ''),
forms as (
  select host || path || query as a, regexp_replace(host, '^(www|m|mobile|amp)\.([^.]+\.)', '\2') || regexp_replace(path, '/+$', '') as front,
    array_to_string(list_filter(string_split(substr(query, 2), '&'), lambda p: p != '' and not regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)')), '&') as rest
  from named),
links as (
  select a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(t, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1) as b
  from full_targets
  union select a, front || case when rest = '' then '' else '?' || rest end from forms),
both_ways as (select a, b from links where a != '' and b != '' and a != b union select b, a from links where a != '' and b != '' and a != b),
reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
classes as (select a as node, min(b) as component from reach group by a),
places as (select distinct host, path from named union select distinct regexp_extract(node, '^([^/?#]*)', 1), regexp_extract(node, '^[^/?#]*([^?#]*)', 1) from classes),
hits as (
  select p.host, p.path, r.rule, r.action, row_number() over (partition by p.host, p.path order by length(r.rule) desc, r.action, r.rule desc) as k
  from places p join rules r on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)),
best as (select host, path, rule, action from hits where k = 1),
said as (
  select c.component, max(case when b.action = 'allow' then 2 else 1 end) as said
  from classes c join best b on b.host = regexp_extract(c.node, '^([^/?#]*)', 1) and b.path = regexp_extract(c.node, '^[^/?#]*([^?#]*)', 1) group by 1)
select n.page_id, n.host, n.path, b.rule,
  case when b.action is not null then b.action when s.said = 1 then 'block' else 'allow' end as verdict, c.component as url_class
from named n left join best b on n.host = b.host and n.path = b.path
left join classes c on c.node = n.host || n.path || n.query
left join said s on s.component = c.component""".replace("\\\\", "\\"),
}
