"""TF-IDF and length features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.functions.text import code_tokens
from strataweave.session import materialize, ship

#: tokens of texts that are counted at a time
TOKENS = 1 << 17


def _grams(part: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Terms of some rows at once, by length: tokens are numbered, longer terms are pairs of numbers, and only different terms become text.

    For each length: (row, number of the term and times there, ordered by both; the terms' texts).
    """
    lists = part.column("tokens")
    off = np.asarray(lists.offsets, np.int64)
    held = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    codes, words = held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary
    n = np.diff(off)
    owner = np.repeat(np.arange(len(n)), n)
    left = np.repeat(off[1:] - off[0], n) - np.arange(len(codes))  # tokens from here to the row's end
    gram, text = codes, words
    for k in range(1, most + 1):
        if k > 1:  # a term of k tokens: the number of its first k - 1 and that of its last
            live = np.flatnonzero(left >= k)
            pairs = gram[live] * max(len(words), 1) + codes[live + k - 1]
            seen = pa.array(pairs).dictionary_encode()
            first, last = np.divmod(seen.dictionary.to_numpy(), max(len(words), 1))
            text = pc.binary_join_element_wise(text.take(pa.array(first)), words.take(pa.array(last)), " ")
            gram = np.zeros(len(codes), np.int64)
            gram[live] = seen.indices.to_numpy(zero_copy_only=False)
        else:
            live = np.arange(len(codes))
        size = max(len(text), 1)
        found, tf = np.unique(owner[live] * size + gram[live], return_counts=True)
        yield found // size, found % size, tf, text


def _parts(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off = np.asarray(batch.column("tokens").offsets, np.int64)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + tokens, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, TOKENS):
            names = [n for n in part.schema.names if n != "tokens"]
            rows, terms, counts = [], [], []
            for row, number, tf, text in _grams(part, most):
                rows.append(row)
                terms.append(text.take(pa.array(number)).cast(pa.string()))
                counts.append(tf)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in names), pa.concat_arrays(terms), pa.array(np.concatenate(counts).astype(np.int64))], names=[*names, "term", "tf"])

    return run


def term_counts(rows: DataFrame, text: str = "text", most: int = 2) -> DataFrame:
    """The other columns of rows, term, tf: all runs of 1 to ``most`` code tokens, counted within each row without a shuffle. Case is kept; null texts have none."""
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c != text]
    tokens = rows.select(*keep, code_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return tokens.mapInArrow(_counted(most), schema)


def known_terms(counts: DataFrame, min_df: int = 3, max_features: int = 200_000) -> DataFrame:
    """(term, df): terms of at least min_df rows, of these the max_features most frequent, ties by term."""
    per_term = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return per_term.orderBy(F.desc("total"), "term").limit(max_features).select("term", "df")


def tfidf(files: DataFrame, train: DataFrame, text: str = "text", min_df: int = 3, max_features: int = 200_000) -> DataFrame:
    """(row_id, term, weight) in long form: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1.

    Document frequencies and the choice of terms come from the rows of files that are in ``train`` too, by row_id. Texts are
    tokenised once, into a written table; the terms, at most max_features rows, are written too, so that the planner
    knows their size when it chooses the join; rows meet by row_id in one shuffle.
    """
    marked = files.select("row_id", text).join(train.select("row_id", F.lit(True).alias("_train")), "row_id", "left")
    counts = materialize(term_counts(marked, text), "terms")
    n = marked.agg(F.count("_train").alias("n"))
    known = known_terms(counts.where("_train"), min_df, max_features)
    idf = materialize(known.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")  # n is one row
    raw = counts.join(idf, "term").select("row_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row_id")))
    return raw.select("row_id", "term", (F.col("w") / norm).alias("weight"))


def tfidf_rows(rows: DataFrame, train: Column, text: str = "text", min_df: int = 3, max_features: int = 200_000, most: int = 2) -> tuple[DataFrame, int]:
    """The other columns of rows with ids and values, the weights of ``tfidf`` by the number of the term in term order, and the number of terms.

    Document frequencies and the choice of terms come from the rows where ``train`` holds. Texts are tokenised once, into a written
    table; frequencies are summed up in each batch before terms are shuffled, and the terms chosen, at most max_features,
    are broadcast, so that neither the terms of all rows are written nor rows shuffled.
    """
    spark = rows.sparkSession
    ship(spark)
    keep = [c for c in rows.columns if c != text]
    tokens = materialize(rows.select(*keep, F.coalesce(train, F.lit(False)).alias("_train"), code_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")), "tokens")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 8 * TOKENS):
            for _, number, tf, texts in _grams(part, most):
                df, total = np.bincount(number, minlength=len(texts)), np.bincount(number, tf, len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([texts.cast(pa.string()), pa.array(df), pa.array(total)], names=["term", "df", "total"])

    learned = tokens.where("_train")
    sums = learned.select("tokens").mapInArrow(frequencies, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    known = sums.where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_features).select("term", "df").toArrow()
    order = sorted(range(known.num_rows), key=[t.encode() for t in known.column("term").to_pylist()].__getitem__)
    known = known.take(pa.array(order, pa.int64())).combine_chunks()
    idf = np.log((1 + learned.count()) / (1 + known.column("df").to_numpy().astype(float))) + 1
    sent = spark.sparkContext.broadcast((known.column("term").to_pylist(), idf))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = sent.value
        terms = pa.array(names, pa.string())
        for part in _parts(batches, 2 * TOKENS):
            owners, ids, weights = [], [], []
            for row, number, tf, texts in _grams(part, most):
                place = pc.fill_null(pc.index_in(texts.cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)
                at = place[number] if len(texts) else number
                held = at >= 0
                owners.append(row[held])
                ids.append(at[held])
                weights.append((1 + np.log(tf[held])) * idf[at[held]])
            owner, at, w = np.concatenate(owners), np.concatenate(ids), np.concatenate(weights)
            order = np.argsort(owner * max(len(names), 1) + at)
            owner, at, w = owner[order], at[order], w[order]
            norm = np.sqrt(np.bincount(owner, w * w, part.num_rows))
            off = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=part.num_rows))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(off, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(w / norm[owner]))], names=[*keep, "ids", "values"])

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
    return tokens.select(*keep, "tokens").mapInArrow(weigh, schema), known.num_rows


def term_ids(weights: DataFrame) -> DataFrame:
    """(term, id) of the terms in use, in term order; at most max_features rows."""
    return weights.select("term").distinct().withColumn("id", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def length_features(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Adds log_chars and log_lines, standardised by train's mean and population deviation (one row, joined by broadcast)."""
    logs = [F.log1p("n_chars").alias("a"), F.log1p("n_lines").alias("b")]
    stats = train.select(*logs).agg(F.avg("a").alias("ma"), F.stddev_pop("a").alias("sa"), F.avg("b").alias("mb"), F.stddev_pop("b").alias("sb"))
    scale = lambda x, m, s: (F.log1p(x) - F.col(m)) / (F.col(s) + F.lit(1e-9))
    return rows.crossJoin(F.broadcast(stats)).withColumn("log_chars", scale("n_chars", "ma", "sa")).withColumn("log_lines", scale("n_lines", "mb", "sb")).drop("ma", "sa", "mb", "sb")
