"""Intermediate tables in the folder that the cluster shares.

A written table cuts the lineage: after the loss of an executor only the tasks of the current job run again.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where that is unset, a temporary folder serves a local master, whose executors are this process; on a cluster there
    is no folder that all executors share, and a RuntimeError says so.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="panelwright-")
    return _own[app]


def make_dir(spark: SparkSession, path: str) -> None:
    """Create a folder through Spark's own file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, on an executor."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return fs.FileSystem.from_uri(uri if mark or not uri.startswith("file:") else "file://" + uri[5:])


@contextlib.contextmanager
def new_file(fs, temporary: str) -> Iterator:
    """A file under a temporary name, which is deleted when its writing fails."""
    stream = fs.open_output_stream(temporary, compression=None, buffer_size=1 << 20)
    try:
        yield stream
    except BaseException:
        with contextlib.suppress(OSError):
            stream.close()
        with contextlib.suppress(OSError):
            fs.delete_file(temporary)
        raise
    stream.close()


def commit(fs, temporary: str, name: str) -> None:
    """Give a whole file its name.  Where an attempt that died has left the same file, that one is replaced or stays."""
    try:
        fs.move(temporary, name)
    except OSError:
        # some file systems don't rename onto a file that exists
        if fs.get_file_info(name).size != fs.get_file_info(temporary).size:
            raise
        fs.delete_file(temporary)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and return the written table."""
    spark = frame.sparkSession
    path = new_dir(spark, name)
    frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table._kept_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        hadoop = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._kept_at)
        hadoop.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
