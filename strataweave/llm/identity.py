"""A unique id for each document, whatever the key column holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.numbering import numbered

RID = "_rid"


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(docs with a unique non-null long ``_rid``, map to the given rows).

    Keys are whole numbers: they are cast to long, and a text that is no number is an error in ANSI mode, else a null key.
    Unique non-null keys are their own ids and the map is None. Otherwise the
    distinct pairs of key and text are numbered in the order of key (nulls last) and the text's
    SHA-256; rows that repeat such a pair are one document; the map holds
    (_rid, key) once for each given row.
    """
    docs = docs.withColumn(key, F.col(key).cast("long"))
    seen = docs.agg(F.count("*").alias("n"), F.count(key).alias("known"), F.count_distinct(key).alias("distinct")).first()
    if seen["n"] == seen["distinct"]:
        return docs.withColumn(RID, F.col(key)), None
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    pairs = docs.select(F.col(key).alias("_pair_key"), sha.alias("_pair_sha")).distinct()
    pairs = numbered(pairs, RID, F.col("_pair_key").asc_nulls_last(), F.col("_pair_sha"))
    marked = docs.withColumn("_own_sha", sha)
    joined = marked.join(pairs, marked[key].eqNullSafe(pairs["_pair_key"]) & (marked["_own_sha"] == pairs["_pair_sha"])).drop("_pair_key", "_pair_sha", "_own_sha")
    return joined.dropDuplicates([RID]), joined.select(RID, key)


def given_rows(result: DataFrame, back: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """A result by ``_rid`` with the key of each given row in the place of ``_rid``."""
    if back is None:
        return result.withColumnRenamed(RID, key)
    return back.join(result, RID).drop(RID)
