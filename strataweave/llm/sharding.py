"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into (shard, bucket) by seeded hashes; a bucket
is sized to fit in memory, and copies that would overfill one are dealt over as many as
they need. Pass two reads one bucket at a time, puts its rows in
a fixed order, Fisher-Yates shuffles them with a seed of its own and writes them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.session import TASK_BYTES, materialize

BUCKET_BYTES = 16 << 20
#: buckets whose offsets, 16 bytes each, are broadcast at most; beyond it they are joined by a shuffle
MOST_BROADCAST = 500_000


def _draw(key: Column, shard: int, seed: int) -> Column:
    return F.struct(F.xxhash64(key, F.lit(shard), F.lit(seed)).alias("h"), F.lit(shard).alias("s"))


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard with the highest hash of (key, shard). One more shard takes rows only into itself."""
    draws = [_draw(key, s, seed) for s in range(n_shards)]
    return (F.greatest(*draws) if n_shards > 1 else draws[0])["s"].cast("int")


def external_shuffle(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all records in shuffled order; read back with size, text_crc32, shard, grown_shard and slot.

    Law ``key``: key and shard count alone decide the shard, grown_shard is the one
    with one shard more. slot numbers a shard's rows from 0 without gaps. size is
    the text's UTF-8 bytes plus 8. Null texts count as empty; null keys share a
    shard; rows that agree in key and text are interchangeable, and each gets its
    own slot. An empty table gives no rows. Columns of docs named like an output
    are replaced. Buckets spread by key and text, so equal texts or one hot source
    don't meet in one bucket.
    """
    own = {"size", "text_crc32", "shard", "grown_shard", "slot", "_bucket", "_pos", "_before", "_turn"}
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select([c for c in docs.columns if c not in own])
    sized = docs.withColumn("size", F.octet_length(body).cast("long") + 8).withColumn("text_crc32", F.crc32(body.cast("binary")))
    total = sized.agg(F.sum("size")).first()[0] or 0
    width = -(-total // TASK_BYTES)
    buckets = max(1, -(-total // (n_shards * bucket_bytes)))
    # rows that agree in key and text would all meet in one bucket: of those, each bucketful gets a number that enters the hash
    same = [F.col(key), F.col("text_crc32"), F.col("size")]
    copies = materialize(sized.groupBy(*same).agg(F.sum("size").alias("_all")).where(F.col("_all") > bucket_bytes), "copies", width)
    turned = sized.withColumn("_turn", F.lit(0).cast("long"))
    if copies.limit(1).count():
        alike = reduce(lambda a, b: a & b, (sized[c].eqNullSafe(copies[c]) for c in (key, "text_crc32", "size")))
        many = sized.join(copies, alike, "left_semi")
        turn = F.floor(F.row_number().over(Window.partitionBy(*same).orderBy("size")) * F.col("size") / bucket_bytes)
        turned = sized.join(copies, alike, "left_anti").withColumn("_turn", F.lit(0).cast("long")).unionByName(many.withColumn("_turn", turn))
    scattered = (
        turned.withColumn("shard", shard_of(F.col(key), n_shards, seed))
        .withColumn("grown_shard", shard_of(F.col(key), n_shards + 1, seed))
        .withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("text_crc32"), F.col("_turn")), F.lit(buckets)).cast("int"))
        .drop("_turn")
    )
    order = [(c, "ascending") for c in (key, "text_crc32", "size")]
    schema = T.StructType([*scattered.schema.fields, T.StructField("_pos", T.LongType())])

    def permute(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        rng = np.random.default_rng([seed, t["shard"][0].as_py(), t["_bucket"][0].as_py()])
        t = t.take(pa.array(rng.permutation(t.num_rows)))
        return t.append_column("_pos", pa.array(np.arange(t.num_rows)))

    written = materialize(scattered.groupBy("shard", "_bucket").applyInArrow(permute, schema), "shards", width)
    counts = written.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    # a row for each bucket, and their number is known
    before = F.broadcast(before) if n_shards * buckets <= MOST_BROADCAST else before
    return written.join(before, ["shard", "_bucket"]).withColumn("slot", F.col("_before") + F.col("_pos")).drop("_bucket", "_pos", "_before")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, its rows sorted by slot within files of at most 100,000. Nothing is written for an empty table but its schema's folder."""
    shuffled.repartition("shard", F.expr("cast(slot / 100000 as int)")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
