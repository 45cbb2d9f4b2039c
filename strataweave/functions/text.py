r"""Text and source-file expressions: layout, annotation lines, identities, tokens.

Everything here is a Column built from SQL functions. Python's ``\w`` is spelled
``[\p{L}\p{N}_]``, as Java's own is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the annotation format and of scope (fixed values)
MARKER = r"(?i)//\s*SWC-"
COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
CODE = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]{1,2}"
DECLARATION = r"\b(abstract\s+contract|contract|library|interface)\s+[A-Za-z_$][\w$]*"
RANGE_SEPARATORS = "[,、，;]"
TEST_DIRECTORY = r"(?i)(^|/)(test|tests|testing|mock|mocks|harness|harnesses|echidna|fuzz|fuzzing|certora)/"
TEST_NAME = r"(^|/)(Test|Mock)[A-Z0-9_][^/]*\.sol$|(Test|Mock|Mocks|Tester|Harness)\.sol$"
TEST_SUFFIX = r"(?i)\.t\.sol$|(^|/)[^/]*[_-](test|mock)[^/]*\.sol$"
HOSTED = r"(?i)\b(github|gitlab)\.com/([^/\s]+)/([^/\s#?;,]+)"
TITLED = r"(?i)GitHub\s*-\s*([\w.-]+)/([\w.-]+)"
ADDRESS = "0x[0-9a-fA-F]{40}"
TRON = r"tronscan\.org/#/contract/(\w+)"


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once for each row, however often lambdas refer to it: the optimizer does not inline it past a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1; one leading BOM dropped; CRLF becomes LF."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r\n"), F.lit("\n"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def expand_tabs(line: Column, width: int = 4) -> Column:
    """Tabs to column stops: each part is padded to a multiple of ``width`` before the next."""
    parts = F.split(line, "\t", -1)
    padded = lambda acc, part: F.concat(acc, F.repeat(F.lit(" "), F.lit(width) - F.length(acc) % width), part)
    return F.when(F.contains(line, F.lit("\t")), F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), padded)).otherwise(line)


def clean_line(line: Column) -> Column:
    """A line without annotation marker, tabs and trailing white space."""
    return F.regexp_replace(expand_tabs(F.regexp_replace(line, MARKER + r"[\s\S]*$", "")), r"\s+$", "")


def line_info(text: Column) -> Column:
    """array(struct(y, marker)) of a text's lines: the clean line, and its marker as struct(line, swc, own) or null."""
    mark = lambda x, i: F.when(x.rlike(MARKER), F.struct((i + 1).alias("line"), F.concat(F.lit("SWC-"), F.nullif(F.regexp_extract(x, MARKER + r"(\d+)", 1), F.lit(""))).alias("swc"), (F.regexp_extract(x, r"(?i)^(\s*)//\s*SWC-", 0) != "").alias("own")))
    return F.transform(lines(text), lambda x, i: F.struct(clean_line(x).alias("y"), mark(x, i).alias("marker")))


def canonical(info: Column) -> Column:
    """struct(text, kept, deleted, markers, n_annot_lines, n_lines) of ``line_info``.

    kept and deleted are 1-based line numbers of the given text; a marker's swc is
    null without a number, own says that only white space stands before it.
    """
    number = lambda keep: F.filter(F.transform(info, lambda x, i: F.when((x["y"] != "") == F.lit(keep), i + 1)), lambda i: i.isNotNull())
    cleaned = F.filter(F.transform(info, lambda x: x["y"]), lambda y: y != "")
    return F.struct(
        F.array_join(cleaned, "\n").alias("text"), number(True).alias("kept"), number(False).alias("deleted"),
        F.filter(F.transform(info, lambda x: x["marker"]), lambda m: m.isNotNull()).alias("markers"), F.size(info).alias("n_annot_lines"), F.size(cleaned).alias("n_lines"),
    )


def canonicalize(text: Column) -> Column:
    """``canonical`` of a text; ``canonicalized`` is faster for tables."""
    return canonical(line_info(text))


def canonicalized(df: DataFrame, text: Column, name: str = "c") -> DataFrame:
    """Add the canonical form of a text, its lines cleaned once."""
    return bound(bound(df, "_info", line_info(text)), name, canonical(F.col("_info"))).drop("_info")


def map_line(n: Column, kept: Column, n_annot: Column, end: bool = False) -> Column:
    """Line of the canonical text: the next kept line (``end``: the one before), the other way at the border; 1 in an empty text."""
    at = F.greatest(F.lit(1), F.least(n, n_annot))
    place = F.size(F.filter(kept, lambda k: k <= at)) if end else F.size(F.filter(kept, lambda k: k < at)) + 1
    return F.greatest(F.lit(1), F.least(place, F.size(kept)))


def map_range(a: Column, b: Column, kept: Column, n_annot: Column) -> Column:
    start = map_line(a, kept, n_annot)
    return F.struct(start.alias("start"), F.greatest(start, map_line(b, kept, n_annot, end=True)).alias("end"))


def parse_line_field(value: Column) -> Column:
    """struct(kind, ranges): kind is none, marker, whole or ranges; a range spans the first and last number of its part."""
    s = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    numbers = F.transform(F.split(s, RANGE_SEPARATORS, -1), lambda p: F.regexp_extract_all(p, F.lit(r"(\d+)"), F.lit(1)))
    found = F.filter(numbers, lambda x: F.size(x) > 0)
    ends = lambda x: F.array(F.element_at(x, 1).cast("int"), F.element_at(x, -1).cast("int"))
    ranges = F.transform(found, lambda x: F.struct(F.array_min(ends(x)).alias("start"), F.array_max(ends(x)).alias("end")))
    kind = F.when(F.upper(s).isin("", "N/A", "NA", "NONE", "-"), "none").when(s.rlike("(?i)swc-"), "marker").when(s.rlike(r"(?i)\ball\b"), "whole").when(F.size(found) > 0, "ranges").otherwise("none")
    return F.struct(kind.alias("kind"), F.when(kind == "ranges", ranges).otherwise(F.filter(ranges, lambda _: F.lit(False))).alias("ranges"))


def annotation_spans(field: Column, canonical: Column, swc: Column) -> Column:
    """struct(source, spans): never empty. Without usable numbers the markers of the class stand in, else the whole file."""
    kept, n_annot = canonical["kept"], canonical["n_annot_lines"]
    whole = F.array(F.struct(F.lit(1).alias("start"), F.greatest(canonical["n_lines"], F.lit(1)).alias("end")))
    own = F.filter(canonical["markers"], lambda m: m["swc"] == swc)
    line = lambda m: map_line(m["line"] + m["own"].cast("int"), kept, n_annot)
    from_markers = F.transform(own, lambda m: F.struct(line(m).alias("start"), line(m).alias("end")))
    parsed = parse_line_field(field)
    kind = parsed["kind"]
    source = F.when(kind.isin("ranges", "whole"), kind).when(F.size(own) > 0, "marker").otherwise("unknown")
    spans = F.when(kind == "ranges", F.transform(parsed["ranges"], lambda r: map_range(r["start"], r["end"], kept, n_annot))).when((kind == "whole") | (F.size(own) == 0), whole).otherwise(from_markers)
    return F.struct(source.alias("source"), spans.alias("spans"))


def category(value: Column) -> Column:
    """``SWC-n`` at the start of a category, or null."""
    return F.concat(F.lit("SWC-"), F.nullif(F.regexp_extract(value, r"^\s*SWC-(\d+)", 1), F.lit("")))


def strip_comments(text: Column) -> Column:
    """Comments become a space; string literals are not spared."""
    return F.regexp_replace(text, COMMENT, " ")


def normalize_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_comments(text), r"\s+", " "), "^ | $", "")


def content_hash(text: Column) -> Column:
    return F.sha1(normalize_code(text))


def declaration_kinds(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(DECLARATION), F.lit(1)), lambda k: F.regexp_replace(k, r"^abstract\s+", ""))


def is_interface_only(text: Column) -> Column:
    """At least one declaration, and all of them interfaces; comments should be stripped before."""
    kinds = declaration_kinds(text)
    return (F.size(kinds) > 0) & F.forall(kinds, lambda k: k == "interface")


def is_test_or_mock(path: Column) -> Column:
    return path.rlike(TEST_DIRECTORY) | path.rlike(TEST_NAME) | path.rlike(TEST_SUFFIX)


def audit_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def path_in_audit(path: Column) -> Column:
    return F.regexp_replace(path, "^[^/]*/", "")


def codebase_key(link: Column, directory: Column) -> Column:
    """Key of a code repository: hosted repository, page title, address, or the directory."""
    s = F.coalesce(link, F.lit(""))
    part = lambda pattern, i: F.lower(F.regexp_extract(s, pattern, i))
    address = F.regexp_extract(s, ADDRESS, 0)
    tron = F.regexp_extract(s, TRON, 1)
    return (
        F.when(s.rlike(HOSTED), F.concat(part(HOSTED, 1), F.lit(":"), part(HOSTED, 2), F.lit("/"), F.regexp_replace(part(HOSTED, 3), r"\.git$", "")))
        .when(s.rlike(TITLED), F.concat(F.lit("github:"), part(TITLED, 1), F.lit("/"), part(TITLED, 2)))
        .when(address != "", F.concat(F.lit("addr:"), F.lower(address)))
        .when(tron != "", F.concat(F.lit("tron:"), tron))
        .otherwise(F.concat(F.lit("dir:"), directory))
    )


def scope_reason(text: Column, path: Column, labelled: Column, keep_tests: bool = False, keep_interfaces: bool = False) -> Column:
    """Why an unlabelled file is out of scope, by the first reason that holds; null: in scope."""
    out = F.when(labelled, F.lit(None).cast("string")).when(F.regexp_replace(text, r"\s+", "") == "", "empty")
    if not keep_tests:
        out = out.when(is_test_or_mock(path), "test_mock")
    if not keep_interfaces:
        out = out.when(is_interface_only(strip_comments(text)), "interface_only")
    return out


def n_lines(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def words(text: Column, lower: bool = False) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(WORD), F.lit(0))


def column_index(reference: Column) -> Column:
    """0-based column of a cell reference such as AB12; null without letters."""
    letters = F.regexp_extract(reference, "^([A-Z]+)", 1)
    digits = F.transform(F.split(letters, ""), lambda x: F.ascii(x) - 64)
    return F.nullif(F.aggregate(digits, F.lit(0), lambda n, d: F.when(d > 0, n * 26 + d).otherwise(n)), F.lit(0)) - 1


def code_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE), F.lit(0))


def line_starts(text: Column) -> Column:
    """0-based offset of each line."""
    first = F.array(F.lit(0).cast("long"))
    return F.slice(F.aggregate(lines(text), first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1))), F.lit(1), F.size(lines(text)))


def runs(tokens: Column, k: int) -> Column:
    """All runs of k tokens without spaces, joined by a space; none for fewer tokens. One pass of a pattern whose matches overlap, as each is looked at ahead of its first place."""
    run = r"(?<![^ ])(?=(" + "[^ ]+ " * (k - 1) + "[^ ]+))"
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(run), F.lit(1))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct k-grams joined by a space; fewer tokens give one gram, none the empty one."""
    return F.when(F.size(tokens) < k, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(runs(tokens, k)))


def span_json(spans: Column) -> Column:
    return F.to_json(spans)
