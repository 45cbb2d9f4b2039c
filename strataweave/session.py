"""Session factory, table loading and the shared folder for intermediate tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE on and UTC as its time zone; further settings by keyword (dots as ``__``)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("strataweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes in an Arrow batch at most: with long texts the usual 10,000 rows are far more
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ship(spark: SparkSession) -> None:
    """Ready a session for Python operators: small Arrow batches unless set otherwise, and this package on the executors, once per application."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH[0], None) is None:
        spark.conf.set(*_BATCH)
    if getattr(sc, "_strataweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="strataweave"), "strataweave_pkg.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._strataweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local one is set up, but only for a local master: executors elsewhere would not see it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strataweave-shared")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return f"{at.rstrip('/')}/strataweave-{sc.applicationId}"


_WIDTH = "spark.sql.shuffle.partitions"
#: bytes of text for each shuffle partition, about
TASK_BYTES = 64 << 20


@contextmanager
def _settings(spark: SparkSession, **values: str | None):
    """Within it these settings hold (dots as ``__``; None: as before)."""
    values = {k.replace("__", "."): v for k, v in values.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, width: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing before it.

    Shuffles before it have ``width`` partitions, or the session's number if that is more; their files go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    wider = str(width) if width > int(spark.conf.get(_WIDTH)) else None
    with _settings(spark, **{_CLEANUP: "true", _WIDTH: wider}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _located(spark: SparkSession, path: str):
    """A path and its file system, through Hadoop's API: wherever Spark can read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    p, system = _located(spark, path)
    system.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p, system = _located(spark, path)
    return system.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    p, system = _located(spark, path)
    stream = system.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file; folders on the way are made."""
    p, system = _located(spark, path)
    stream = system.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def forget(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``materialize`` gave."""
    drop_path(df.sparkSession, df._stored_at)


def shuffle_width(docs: DataFrame, text: str = "text", bytes_per_task: int = TASK_BYTES) -> int:
    """Shuffle partitions for a text column, by its bytes: as many as keep a task at ``bytes_per_task``."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return -(-total // bytes_per_task)


def dealt(df: DataFrame, width: int, *columns) -> DataFrame:
    """``df`` repartitioned by columns, over ``width`` partitions if the session has fewer; else AQE may join small ones."""
    if width > int(df.sparkSession.conf.get(_WIDTH)):
        return df.repartition(width, *columns)
    return df.repartition(*columns)
