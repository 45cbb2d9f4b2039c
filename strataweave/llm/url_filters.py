"""URL filters: host and path rules, and redirect equivalence. SQL functions only.

Rules are matched by an equi-join on every suffix of the host; of those whose
path begins the url's path the longest wins. Urls joined by redirects, canonical
links or a common canonical form make up classes (distributed connected components); a blocked member
blocks the members without a rule of their own, unless a member is allowed by a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators.graph import connected_components
from strataweave.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"^(?s)(?:.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
CANONICAL = (r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
REFRESH = (r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")

#: host prefixes and query parameters that don't make another page
ALIAS_HOST = r"^(?:www|m|mobile|amp)\.(?=[^.]+\.)"
TRACKING = r"^(?:utm_[^=]*|ref|gclid|fbclid)(?:=|$)"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query): all empty for null or without ``://``; only A-Z of the host are lower-cased."""
    get = lambda i: F.coalesce(F.regexp_extract(url, _SPLIT, i), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2), get(3)


def node(host: Column, path: Column, query: Column) -> Column:
    """A url without scheme and fragment."""
    return F.concat(host, path, query)


def canonical_node(host: Column, path: Column, query: Column) -> Column:
    """The node of a url's canonical form: host without ``www.`` and the like, path without slashes at its end, query without tracking parameters."""
    kept = F.array_join(F.filter(F.split(F.substring(query, F.lit(2), F.length(query)), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return node(F.regexp_replace(host, ALIAS_HOST, ""), F.regexp_replace(path, "/+$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def canonical_edges(pages: DataFrame, url: str = "url") -> DataFrame:
    """(a, b): each url and its canonical form, where they differ. Null and unparsed urls have no edge; repeated urls repeat it."""
    host, path, query = url_parts(F.col(url))
    return pages.select(node(host, path, query).alias("a"), canonical_node(host, path, query).alias("b")).where("a != '' and a != b and b != ''")


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(action, rule_host, rule_path, rule) from pairs like ("block", "com/en/")."""
    some = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule")) for a, r in rules or [("", "")]])
    listed = spark.range(1).select(F.explode(some).alias("r")).select("r.*").where("rule != ''")
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring(F.col("rule"), F.lit(1), slash - 1)).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.substring(F.col("rule"), slash, F.length("rule"))).otherwise(F.lit(""))
    return listed.select("action", F.translate(host, UPPER, LOWER).alias("rule_host"), path.alias("rule_path"), "rule")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for the distinct hosts and paths with a rule; equal lengths: allow, then the larger rule."""
    names = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    spread = urls.select("host", "path").where("host != ''").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    hits = spread.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.col("action") == "allow", "rule"))
    return hits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/``, without its ``.`` and ``..`` segments."""
    segments = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    left = F.aggregate(segments, F.array().cast("array<string>"), step)
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(left) > 0), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(left, "/"), end)).otherwise(path)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's url and the targets of all its canonical links and meta refreshes; targets without a host are resolved against the page's url.

    ``&amp;`` in a target is ``&``. Null html or url, empty targets and targets of other schemes without ``://`` give no edge; repeated rows and tags repeat it.
    """
    host, path, query = url_parts(F.col(url))
    here = pages.select(F.col(html).alias("_html"), host.alias("_host"), path.alias("_path"), query.alias("_query"), node(host, path, query).alias("a")).where(F.col("_html").rlike(CANONICAL[0]) | F.col("_html").rlike(REFRESH[0]))
    targets = lambda tag, attr: F.transform(F.regexp_extract_all("_html", F.lit(tag), F.lit(0)), lambda t: F.replace(F.regexp_extract(t, attr, 1), F.lit("&amp;"), F.lit("&")))
    found = here.select("_host", "_path", "_query", "a", F.explode(F.concat(targets(*CANONICAL), targets(*REFRESH))).alias("t")).where("t != ''")
    t, p, rest = F.col("t"), F.regexp_extract("t", r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract("t", r"(?s)^([^?#]*)(.*)$", 2)
    folder = F.when(F.col("_path") == "", "/").otherwise(F.regexp_extract("_path", r"(?s)^(.*/)", 1))
    merged = F.when(p.startswith("/"), p).otherwise(F.concat(folder, p))
    own = F.concat(F.lit("http://"), F.col("_host"))
    resolved = F.when(t.startswith("#"), F.concat(own, "_path", "_query")).when(t.startswith("?"), F.concat(own, "_path", t)).otherwise(F.concat(own, _without_dots(merged), rest))
    full = F.when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t).otherwise(resolved)
    h, p, q = url_parts(full)
    return found.select("a", node(h, p, q).alias("b")).where("a != '' and b != ''")


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, url_class (null for urls without alias).

    Null and unparsed urls have empty parts, no rule, and verdict allow. Repeated rows
    are judged alike; empty pages, rules or edges are fine; further columns of the
    inputs are not read, so they can't clash. edges (a, b) may also come from crawl logs; they may repeat, and chains,
    hubs and cycles of any size are fine.
    """
    host, path, query = url_parts(F.col(url))
    named = pages.select(F.col(key), host.alias("host"), path.alias("path"), node(host, path, query).alias("node"))
    ruled = named.join(match_rules(named, rules), ["host", "path"], "left")
    classes = connected_components(edges)
    ends = classes.select(F.regexp_extract("node", r"^([^/?#]*)", 1).alias("host"), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1).alias("path"), "component")
    # written, so that it is broadcast where it is small enough and a large class's members need not meet
    said = materialize(ends.join(match_rules(ends, rules), ["host", "path"]).groupBy("component").agg(F.max(F.when(F.col("action") == "allow", 2).otherwise(1)).alias("_said")), "said")
    members = classes.join(said, "component", "left").select(F.col("node"), F.col("component").alias("url_class"), "_said")
    verdict = F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("_said") == 1, "block").otherwise("allow")
    return ruled.join(members, "node", "left").select(key, "host", "path", "rule", verdict.alias("verdict"), "url_class")
