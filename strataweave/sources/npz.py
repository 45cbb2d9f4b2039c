"""Logits archives as a data source: ``format("npz")`` over ``<run>/logits_<split>.npz``.

An archive is a zip of .npy members: logits (rows, classes), labels (rows, classes), row_id, exposed and classes. The reader
plans from the members' headers alone. Members that are stored are cut into row ranges, and a task seeks to its own; a deflated
member can only be read from its start, so such an archive is one partition, in blocks of bounded size. The writer puts each archive beside its
place under a name of the attempt, and the driver moves those of the attempts that count.
"""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strataweave.session import ship

SCHEMA = "run string, split string, row_id long, cls int, class_name string, logit float, y int, exposed boolean"
WRITTEN = "run string, split string, shard int, row_id long, logits array<float>, labels array<int>, exposed boolean"
#: bytes of logits and labels that a partition reads, and rows of an archive, about
PARTITION_BYTES, ROWS_PER_FILE = 32 << 20, 5_000_000
#: cells in an Arrow batch
CELLS = 1 << 16
_NAME = re.compile(r"(?:^|/)([^/]+)/logits_(\w+?)(?:\.(\d{5}))?\.npz$")
_PARTS = ("logits", "labels", "row_id", "exposed")


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; plain paths are local."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def _header(f) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of a .npy member from its first bytes; the stream stands at the values then."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    if fortran and len(shape) > 1 or kind.hasobject:
        raise ValueError("only arrays of numbers or text in row order can be read by ranges")
    return shape, kind


@dataclass
class Archive:
    """What the headers of an archive say: shapes and types of its members, and where the values of stored ones begin."""

    shapes: dict[str, tuple[int, ...]]
    kinds: dict[str, np.dtype]
    begins: dict[str, int]
    classes: list[str]

    @property
    def rows(self) -> int:
        return self.shapes["logits"][0]

    @property
    def seekable(self) -> bool:
        return all(p in self.begins for p in _PARTS if p in self.shapes)


def describe(f) -> Archive:
    """The headers of an archive that an open file holds, checked against each other."""
    out = Archive({}, {}, {}, [])
    with zipfile.ZipFile(f) as z:
        for info in z.infolist():
            name = info.filename.removesuffix(".npy")
            if name not in (*_PARTS, "classes"):
                continue
            with z.open(info) as member:
                shape, kind = _header(member)
                if name == "classes":
                    out.classes = np.frombuffer(member.read(), kind).astype(str).tolist()
                    continue
                after = member.tell()
            out.shapes[name], out.kinds[name] = shape, kind
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset + 26)
                names, extra = struct.unpack("<HH", f.read(4))
                out.begins[name] = info.header_offset + 30 + names + extra + after
    n, k = out.shapes.get("logits", (None, None))
    if n is None or out.shapes.get("labels") != (n, k):
        raise ValueError("an archive of logits needs logits and labels of one shape")
    for name in ("row_id", "exposed"):  # may be missing or empty
        if (shape := out.shapes.get(name, (0,))) not in ((n,), (0,)):
            raise ValueError(f"{name} has shape {shape} beside {n} rows")
        if not shape[0]:
            out.shapes.pop(name, None)
    if out.classes and len(out.classes) != k:
        raise ValueError(f"{len(out.classes)} class names for {k} columns")
    return out


def _blocks(f, archive: Archive, low: int, high: int, rows: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(first row, values by member) of rows ``low`` to ``high``: stored members by seeking, deflated ones in a stream from their start."""
    width = {p: archive.kinds[p].itemsize * int(np.prod(archive.shapes[p][1:], dtype=np.int64)) for p in _PARTS if p in archive.shapes}
    with ExitStack() as stack:
        streams = {}
        if not archive.seekable:
            z = stack.enter_context(zipfile.ZipFile(f))
            for p in width:
                streams[p] = stack.enter_context(z.open(f"{p}.npy"))
                _header(streams[p])

        def take(p: str, a: int, b: int) -> np.ndarray:
            if p in streams:
                data = streams[p].read((b - a) * width[p])
            else:
                f.seek(archive.begins[p] + a * width[p])
                data = f.read((b - a) * width[p])
            if len(data) != (b - a) * width[p]:
                raise ValueError(f"{p} ends before row {b}")
            return np.frombuffer(data, archive.kinds[p]).reshape(b - a, *archive.shapes[p][1:])

        for a in range(low, high, rows):
            yield a, {p: take(p, a, min(high, a + rows)) for p in width}


@dataclass
class Range(InputPartition):
    """Rows ``low`` to ``high`` of an archive."""

    path: str
    run: str
    split: str
    low: int
    high: int

    def __init__(self, path: str, run: str, split: str, low: int, high: int):
        self.path, self.run, self.split, self.low, self.high = path, run, split, low, high


class NpzReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Range]:
        system, root = _system(self.root)
        found = []
        for info in system.get_file_info(pafs.FileSelector(root, recursive=True)):
            name = _NAME.search(info.path)
            if info.type != pafs.FileType.File or not name or "/_staging-" in info.path:
                continue
            with system.open_input_file(info.path) as f:
                archive = describe(f)
            n, k = archive.shapes["logits"]
            step = max(1, self.partition_bytes // max(1, k * 5)) if archive.seekable else max(1, n)
            found += [Range(info.path, name[1], name[2], a, min(n, a + step)) for a in range(0, n, step)]
        return sorted(found, key=lambda r: (r.path, r.low)) or [Range("", "", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _system(self.root)
        with system.open_input_file(partition.path) as f:
            archive = describe(f)
            k = archive.shapes["logits"][1]
            names = pa.array(archive.classes or [None] * k, pa.string())
            for first, held in _blocks(f, archive, partition.low, partition.high, max(1, CELLS // max(1, k))):
                n = len(held["logits"])
                ids = held["row_id"].astype(np.int64) if "row_id" in held else np.arange(first, first + n)
                cls = np.tile(np.arange(k, dtype=np.int32), n)
                exposed = pa.array(np.repeat(held["exposed"] != 0, k)) if "exposed" in held else pa.nulls(n * k, pa.bool_())
                columns = [
                    pa.array([partition.run]).take(pa.array(np.zeros(n * k, np.int32))), pa.array([partition.split]).take(pa.array(np.zeros(n * k, np.int32))), pa.array(np.repeat(ids, k)), pa.array(cls), names.take(pa.array(cls)),
                    pa.array(held["logits"].astype(np.float32).ravel()), pa.array(held["labels"].astype(np.int32).ravel()), exposed,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "split", "row_id", "cls", "class_name", "logit", "y", "exposed"])


@dataclass
class Written(WriterCommitMessage):
    """Archives of a task: where they are, and where they belong."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class _Spool:
    """One archive's members on their way: values go to files of the task, as a .npy header needs the number of rows."""

    def __init__(self, classes: list[str]):
        self.classes, self.n = classes, 0
        self.files = {p: tempfile.TemporaryFile() for p in _PARTS}

    def add(self, row_id: np.ndarray, logits: np.ndarray, labels: np.ndarray, exposed: np.ndarray | None) -> None:
        self.n += len(row_id)
        for p, values in (("row_id", row_id.astype("<i8")), ("logits", logits.astype("<f4")), ("labels", labels.astype(np.uint8)), ("exposed", exposed)):
            if values is not None:
                self.files[p].write(np.ascontiguousarray(values).tobytes())

    def write(self, out, compression: int) -> None:
        k = len(self.classes)
        shapes = {"logits": ("<f4", (self.n, k)), "labels": ("|u1", (self.n, k)), "row_id": ("<i8", (self.n,)), "exposed": ("|u1", (self.n if self.files["exposed"].tell() else 0,))}
        with zipfile.ZipFile(out, "w", compression) as z:
            for p, (kind, shape) in shapes.items():
                with z.open(f"{p}.npy", "w", force_zip64=True) as member:
                    np.lib.format.write_array_header_1_0(member, {"descr": kind, "fortran_order": False, "shape": shape})
                    self.files[p].seek(0)
                    while data := self.files[p].read(1 << 20):
                        member.write(data)
                    self.files[p].close()
            with z.open("classes.npy", "w") as member:
                np.lib.format.write_array(member, np.array(self.classes, dtype=str), allow_pickle=False)


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.root = options["path"].rstrip("/")
        self.classes = options["classes"].split("\n")
        self.compression = {"stored": zipfile.ZIP_STORED, "deflated": zipfile.ZIP_DEFLATED}[options.get("compression", "stored")]
        self.overwrite = overwrite
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, staging = _system(self.staging)
        system.create_dir(staging, recursive=True)
        done, seen, key, spool = Written(), set(), None, None

        def close() -> None:
            at = f"{staging}/{uuid.uuid4().hex}.npz"
            with system.open_output_stream(at, compression=None) as out:
                spool.write(out, self.compression)
            run, split, shard = key
            done.moves.append((at, f"{run}/logits_{split}{'' if shard < 0 else f'.{shard:05d}'}.npz"))

        k = len(self.classes)
        for batch in iterator:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("run", "split", "shard")), strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != key:
                    if spool is not None:
                        close()
                    key, spool = keys[a], _Spool(self.classes)
                    if key in seen or not re.fullmatch(r"[^/]+", key[0]) or not re.fullmatch(r"\w+", key[1]):
                        raise ValueError(f"rows of {key} are apart, or it can't be a file's name")
                    seen.add(key)
                part = batch.slice(a, b - a)
                if (np.diff(np.asarray(part.column("logits").offsets)) != k).any() or (np.diff(np.asarray(part.column("labels").offsets)) != k).any():
                    raise ValueError(f"a row of {key} has not {k} classes")
                flags = part.column("exposed")
                values = [np.asarray(part.column(c).flatten()).reshape(-1, k) for c in ("logits", "labels")]
                spool.add(np.asarray(part.column("row_id")), *values, None if flags.null_count else np.asarray(flags.cast(pa.uint8())))
        if spool is not None:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.root)
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(root, recursive=True)):
                if info.type == pafs.FileType.File and _NAME.search(info.path) and "/_staging-" not in info.path:
                    system.delete_file(info.path)
        for at, name in (move for m in messages if m is not None for move in m.moves):
            system.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
            system.move(at, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what attempts have left."""
        system, staging = _system(self.staging)
        if system.get_file_info(staging).type == pafs.FileType.Directory:
            system.delete_dir(staging)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options, overwrite)


def read_npz(spark, root: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(run, split, row_id, cls, class_name, logit, y, exposed) of all archives below root.

    Archives without row_id number their rows; exposed is null where none is kept; no archives give no rows.
    """
    ship(spark)
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("partitionBytes", partition_bytes).load(root)


def write_npz(logits: DataFrame, root: str, classes: list[str], compression: str = "stored", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Logits (run, split, row_id, cls, logit, y, and exposed if there) as archives ``<run>/logits_<split>.npz``, rows by row_id; archives below root are replaced.

    Every row must have each of the classes 0 to K-1 once. A split of more than ``rows_per_file`` rows is dealt into numbered archives, so that no task
    writes more; rows meet by (run, split, row_id) with at most K of a row.
    """
    spark = logits.sparkSession
    ship(spark)
    spark.dataSource.register(NpzSource)
    exposed = F.col("exposed") if "exposed" in logits.columns else F.lit(None).cast("boolean")
    cells = F.array_sort(F.collect_list(F.struct(F.col("cls").cast("int").alias("cls"), F.col("logit").cast("float").alias("logit"), F.col("y").cast("int").alias("y"))))
    rows = logits.select("run", "split", "row_id", "cls", "logit", "y", exposed.alias("exposed")).groupBy("run", "split", F.col("row_id").cast("long").alias("row_id")).agg(cells.alias("c"), F.bool_or("exposed").alias("exposed"))
    whole = F.transform("c", lambda x: x["cls"]) == F.sequence(F.lit(0), F.lit(len(classes) - 1))
    checked = F.when(whole, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("not every class once in row "), F.col("row_id").cast("string"))).cast(T.ArrayType(T.StructType([T.StructField("cls", T.IntegerType()), T.StructField("logit", T.FloatType()), T.StructField("y", T.IntegerType())]))))
    files = logits.groupBy("run", "split").agg(F.ceil(F.count_distinct("row_id") / rows_per_file).alias("files"))
    shard = F.when(F.col("files") > 1, F.pmod(F.xxhash64("row_id"), F.col("files"))).otherwise(-1).cast("int")
    out = rows.withColumn("c", checked).join(files, ["run", "split"]).select("run", "split", shard.alias("shard"), "row_id", F.transform("c", lambda x: x["logit"]).alias("logits"), F.transform("c", lambda x: x["y"]).alias("labels"), "exposed")
    key = ["run", "split", "shard"]
    out.repartition(*key).sortWithinPartitions(*key, "row_id").write.format("npz").mode("overwrite").option("classes", "\n".join(classes)).option("compression", compression).save(root)
