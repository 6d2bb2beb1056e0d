"""Session helpers: settings for tests and bench, code shipping, shared folders, saved tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="groveline_"), "groveline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("groveline", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt to all of them by ``key``: for work that is dear a row on a table
    that comes as one file. A table of more parts than cores, as large ones are, stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and
    all run on one machine. Elsewhere an unset folder is an error, as executors would write where nobody reads."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="groveline_shared_")
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._groveline_path = path
    return out


def open_fs(uri: str):
    """pyarrow's file system and path for a URI of the shared folder (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def saved_rows(uri: str, rows: int, columns: list[str] | None = None, piece: int = 0, pieces: int = 1):
    """Tables of at most ``rows`` rows of what :func:`save` wrote, read on an executor from the shared folder, so that a task
    meets a whole table without a shuffle. Of ``pieces`` tasks each gets other files or, where there are too few, other tables."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, path = open_fs(uri)
    names = sorted(f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(".parquet"))
    by_file, at = len(names) >= pieces, 0
    for name in names[piece::pieces] if by_file else names:
        with fs.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches(rows, columns=columns):
                if b.num_rows and (by_file or at % pieces == piece):
                    yield pa.Table.from_batches([b])
                at += b.num_rows > 0


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`save`."""
    path = getattr(df, "_groveline_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
