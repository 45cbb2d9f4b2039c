"""How queries and their SQL twins are registered, and the inputs that they derive from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its twin."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def marked_text() -> Column:
    """A document's text as an annotated source file: markers, tabs and blank lines added."""
    head = F.concat(F.lit("\t// swc-"), (F.col("doc_id") % 37 + 100).cast("string"), F.lit("-Name: L"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("\n"))
    return F.concat(head, F.replace(F.col("text"), F.lit(". "), F.lit(".\t")), F.lit("\n  \t\nlast line // SWC-Other\nend"))


MARKED = "(chr(9) || '// swc-' || (doc_id % 37 + 100)::varchar || '-Name: L' || (doc_id % 5 + 1)::varchar || chr(10) || replace(text, '. ', '.' || chr(9)) || chr(10) || '  ' || chr(9) || chr(10) || 'last line // SWC-Other' || chr(10) || 'end')"

#: annotated lines of the marked texts: doc_id, i, x (given), y (clean)
MARKED_LINES = rf"""
raw_lines as (select doc_id, unnest(string_split({MARKED}, chr(10))) as x, unnest(range(1, len(string_split({MARKED}, chr(10))) + 1)) as i from documents),
cut_lines as (select doc_id, i, x, regexp_replace(x, '(?i)//\s*SWC-[\s\S]*$', '') as c from raw_lines),
lines as (select doc_id, i, x, regexp_replace(list_reduce(string_split(c, chr(9)), lambda a, p: a || repeat(' ', 4 - length(a) % 4) || p), '\s+$', '') as y from cut_lines)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: row_id, rel_path, audit_dir, codebase, lang, text, fold, swc (array), quality, toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    swc = F.array_compact(F.array(F.when(F.col("quality") == 1, "SWC-101"), F.when(F.col("toxic") == 1, "SWC-104"), F.when(F.col("lang") == "de", "SWC-102"), F.when(F.col("doc_id") % 97 == 0, "SWC-132")))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("row_id"), path.alias("rel_path"), F.col("source").alias("audit_dir"), F.col("source").alias("codebase"), "lang", "text", (F.col("doc_id") % 5).alias("fold"), swc.alias("swc"), "quality", "toxic")


LABELLED = """
files as (
  select d.doc_id as row_id, source || '/' || d.doc_id::varchar as rel_path, source as audit_dir, source as codebase, lang, text, d.doc_id % 5 as fold, quality, toxic,
    list_filter([case when quality = 1 then 'SWC-101' end, case when toxic = 1 then 'SWC-104' end, case when lang = 'de' then 'SWC-102' end, case when d.doc_id % 97 = 0 then 'SWC-132' end], lambda x: x is not null) as swc
  from documents d left join labels l on d.doc_id = l.doc_id)"""

#: normalised identity of ``text``
NORMAL = r"trim(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g'), '\s+', ' ', 'g'))"


def cells(spark: SparkSession, sf_dir: str, first: int = 0) -> DataFrame:
    """Logits in long form: row_id, cls 0-9, logit (ten embedding components), y, fold."""
    e = table(spark, sf_dir, "embeddings")
    part = e.select(F.col("vec_id").alias("row_id"), "label", (F.col("vec_id") % 5).alias("fold"), F.posexplode(F.slice("embedding", first + 1, 10)).alias("cls", "v"))
    return part.select("row_id", "cls", (F.col("v").cast("double") * 4).alias("logit"), (F.col("label") == F.col("cls")).cast("int").alias("y"), "fold")


def cells_sql(name: str = "cells", first: int = 0) -> str:
    return f"""
{name} as (select vec_id as row_id, c::int as cls, embedding[{first} + c + 1]::double * 4 as logit, (label = c)::int as y, vec_id % 5 as fold from embeddings, range(10) r(c))"""


PROB = "1.0 / (1.0 + exp(-greatest(least(logit, 60.0), -60.0)))"
