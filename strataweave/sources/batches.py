"""Training batches as Arrow IPC files: ``format("token_batches")``.

A batch is one record batch: rows of token ids padded to a common width, with masks, labels and lengths. The writer takes rows
in order of (part, batch), puts a file for each run of batches of a part beside its place, and the driver moves the files of the attempts that count and writes
a manifest of them. The reader has a partition for each file of the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strataweave.operators.numbering import running_sums
from strataweave.operators.sampling import length_sorted
from strataweave.operators.windows import PAD
from strataweave.session import ship
from strataweave.sources.npz import _system

SCHEMA = "part int, batch long, row_id long, length int, ids array<int>, mask array<int>, labels array<int>"
MANIFEST = "manifest.json"
_IPC = pa.schema([("row_id", pa.int64()), ("length", pa.int32()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32()))])


def token_batches(rows: DataFrame, budget: int, parts: int, length: str = "length", key: str = "row_id") -> DataFrame:
    """Adds part and batch to rows (row_id, ids, labels, ...): rows of like length, at most ``budget`` tokens a batch with padding to a multiple of 8.

    Rows are put in order of length over ``parts`` parts by one range shuffle. A part's batches have as many rows as the budget holds of its
    widest one, which the order keeps near the others; a row wider than the budget is a batch by itself.
    Rows are counted over ranges, so no task holds a part. Keys must be unique.
    """
    wide = (F.ceil(F.greatest(F.col(length), F.lit(1)) / 8) * 8).cast("long")
    placed = length_sorted(rows.withColumn("_wide", wide), length, key, parts)
    counted = running_sums(placed.withColumn("_one", F.lit(1)).select("part", length, key, "_wide", "_one"), ["part"], [F.col(length), F.col(key)], ["_one"])
    most = counted.groupBy("part").agg(F.max("_wide").alias("_most"))
    room = F.greatest(F.floor(F.lit(budget) / F.col("_most")), F.lit(1))
    numbered = counted.join(most, "part").select(key, "part", F.floor((F.col("_one_sum") - 1) / room).cast("long").alias("batch"))
    return placed.drop("_wide", "part").join(numbered, key)


@dataclass
class Files(WriterCommitMessage):
    """Files of a task: where they are, what they hold."""

    moves: list[tuple[str, dict]] = field(default_factory=list)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.root = options["path"].rstrip("/")
        self.per_file = int(options.get("batchesPerFile", 256))
        self.overwrite = overwrite
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        system, staging = _system(self.staging)
        system.create_dir(staging, recursive=True)
        done, held, last, out = Files(), [], None, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out[0].close()
                out[1].close()
                done.moves.append((out[2], out[3]))
                out = None

        def put() -> None:
            """The rows held as one padded record batch."""
            nonlocal out
            part, batch = last
            if out is not None and (out[3]["part"] != part or len(out[3]["batches"]) >= self.per_file):
                close()
            if out is None:
                at = f"{staging}/{uuid.uuid4().hex}.arrow"
                stream = system.open_output_stream(at, compression=None)
                out = (pa.ipc.new_file(stream, _IPC), stream, at, {"part": part, "batches": [], "rows": 0, "tokens": 0})
            t = pa.Table.from_batches(held).combine_chunks()
            lists = pa.concat_arrays(t["ids"].chunks) if t["ids"].num_chunks != 1 else t["ids"].chunk(0)
            length = np.diff(np.asarray(lists.offsets, np.int64))
            width = -(-max(int(length.max()), 1) // 8) * 8
            inside = np.arange(width) < length[:, None]
            ids = np.full(inside.shape, PAD, np.int32)
            ids[inside] = np.asarray(lists.flatten())
            cut = pa.array(np.arange(len(length) + 1) * width, pa.int32())
            column = lambda x: pa.ListArray.from_arrays(cut, pa.array(x.ravel().astype(np.int32)))
            labels = t["labels"].combine_chunks()
            out[0].write_batch(pa.RecordBatch.from_arrays([t["row_id"].combine_chunks(), pa.array(length.astype(np.int32)), column(ids), column(inside), labels.chunk(0) if isinstance(labels, pa.ChunkedArray) else labels], schema=_IPC))
            note = out[3]
            note["batches"].append(batch)
            note["rows"] += len(length)
            note["tokens"] += int(inside.size)

        for whole in iterator:
            keys = list(zip(whole.column("part").to_pylist(), whole.column("batch").to_pylist(), strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != last and held:
                    put()
                    held = []
                if last is not None and keys[a] < last:
                    raise ValueError("rows must come in order of part and batch")
                last = keys[a]
                held.append(whole.slice(a, b - a).select(["row_id", "ids", "labels"]))
        if held:
            put()
        close()
        return done

    def commit(self, messages: list[Files | None]) -> None:
        system, root = _system(self.root)
        notes = []
        for i, (at, note) in enumerate(sorted((m for message in messages if message is not None for m in message.moves), key=lambda m: (m[1]["part"], m[1]["batches"][0]))):
            name = f"part-{note['part']:05d}-{i:06d}-{uuid.uuid4().hex[:8]}.arrow"
            system.move(at, f"{root}/{name}")
            notes.append({"file": name, **note})
        old = []
        if system.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                old = json.loads(f.read())["files"]
        # the manifest decides which files count: it is put in place last, in one step
        kept = [] if self.overwrite else old
        with system.open_output_stream(f"{self._inner()}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps({"files": kept + notes, "rows": sum(n["rows"] for n in kept + notes), "tokens": sum(n["tokens"] for n in kept + notes)}, indent=1).encode())
        system.move(f"{self._inner()}/{MANIFEST}", f"{root}/{MANIFEST}")
        for n in old if self.overwrite else []:
            system.delete_file(f"{root}/{n['file']}")
        self.abort(messages)

    def _inner(self) -> str:
        system, staging = _system(self.staging)
        system.create_dir(staging, recursive=True)
        return staging

    def abort(self, messages: list[Files | None]) -> None:
        """Delete what attempts have left."""
        system, staging = _system(self.staging)
        if system.get_file_info(staging).type == pafs.FileType.Directory:
            system.delete_dir(staging)


class BatchFile(InputPartition):
    def __init__(self, file: str, part: int, batches: list[int]):
        self.file, self.part, self.batches = file, part, batches


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")

    def partitions(self) -> list[BatchFile]:
        system, root = _system(self.root)
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        return [BatchFile(n["file"], n["part"], n["batches"]) for n in files] or [BatchFile("", 0, [])]

    def read(self, partition: BatchFile) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, root = _system(self.root)
        with system.open_input_file(f"{root}/{partition.file}") as f:
            held = pa.ipc.open_file(f)
            for i, batch in enumerate(partition.batches):
                rows = held.get_batch(i)
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.part, np.int32)), pa.array(np.full(n, batch, np.int64)), *rows.columns], names=["part", "batch", *rows.schema.names])


class BatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_batches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> BatchReader:
        return BatchReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, overwrite)


def write_batches(rows: DataFrame, path: str, per_file: int = 256) -> None:
    """Rows (part, batch, row_id, ids, labels) as padded batches below path, replacing what is there. A part is written by one task, which holds one batch."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(BatchSource)
    key = ["part", "batch"]
    typed = rows.select(F.col("part").cast("int").alias("part"), F.col("batch").cast("long").alias("batch"), F.col("row_id").cast("long").alias("row_id"), F.col("ids").cast("array<int>").alias("ids"), F.col("labels").cast("array<int>").alias("labels"))
    typed.repartition("part").sortWithinPartitions(*key, "row_id").write.format("token_batches").mode("overwrite").option("batchesPerFile", per_file).save(path)


def read_batches(spark, path: str) -> DataFrame:
    """(part, batch, row_id, length, ids, mask, labels) of the files that the manifest names."""
    ship(spark)
    spark.dataSource.register(BatchSource)
    return spark.read.format("token_batches").load(path)
