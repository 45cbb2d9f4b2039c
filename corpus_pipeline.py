"""Corpus pipeline: quality rules, near copies, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each to
Parquet in the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.bpe import encode_tokens
from strataweave.llm.jaccard_join import one_of_each
from strataweave.llm.mixing import mix_sources, training_order
from strataweave.llm.quality import quality_rules, train_quality
from strataweave.llm.queries import pretoken_pattern, ranks_path
from strataweave.llm.substring import substring_dedup
from strataweave.session import materialize, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near copies: words in a shingle and similarity in percent
SHINGLE, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the trees, which are grown on labelled ones. Null and empty texts fail; repeated rows fare alike; an empty table stays one."""
    ship(spark)
    trees = train_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, trees, keep=COLUMNS).where("kept").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id (null: largest). Texts without a word are near copies of nothing and stay; of rows that repeat doc_id and text one stays; an empty table stays one."""
    ship(spark)
    return one_of_each(docs.select(COLUMNS), k=SHINGLE, percent=SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 20 words that begin earlier in the corpus; documents left without a word go. Others, with null and empty ones, keep their text as it is; repeated rows fare alike; an empty table stays one."""
    ship(spark)
    done = substring_dedup(docs, keep=["lang", "source", "n_chars"], rewrite=True)
    kept = done.where("n_removed = 0 or n_removed < n_words")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in training order; where it takes a part, that part's words. Texts without a word have size 0 and are not taken; repeated rows are documents of their own; a null source is a source; an empty table stays one."""
    ship(spark)
    rows = training_order(mix_sources(docs, keep=COLUMNS))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([^\x09-\x0D ]+)"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("words") < F.col("size"), F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: none for null and empty texts. An empty table stays one."""
    ship(spark)
    return encode_tokens(docs, ranks_path(), pretoken_pattern(), keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: SQL can't express the trees, the encoder or the hash orders; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
