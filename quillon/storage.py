"""Where tables' files lie: Parquet segments in a folder that all executors reach.

Paths are kept decoded, as they are given to Spark, which hands out encoded URIs. Whatever is
made is deleted when it isn't needed any more, at the latest when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from quillon.errors import EngineProblem

_made: set[str] = set()
_own: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a local session that has none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise EngineProblem("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        named = tempfile.mkdtemp(prefix="quillon-")
        _own.add(named)
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the process ends, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    keep_track(path)
    return path


def keep_track(path: str) -> str:
    """Has path deleted when the process ends, if it isn't before."""
    _made.add(path)
    return path


def remove(path: str) -> None:
    context = SparkContext._active_spark_context
    jvm = SparkContext._jvm
    conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)
    _made.discard(path)


@atexit.register
def _clear() -> None:
    for path in sorted(_made):
        try:
            remove(path)
        except Exception:  # the session may be gone, and its folder with it
            pass
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)


def write_segment(df: DataFrame, by: str | None = None) -> str:
    """Writes df's rows as Parquet and returns the folder; by: a column to part them by."""
    path = fresh_path(df.sparkSession, "segment")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    except Exception:
        remove(path)
        raise
    return path


def decoded(uri: str) -> str:
    """The path that a URI of Spark's stands for."""
    return unquote(uri)


def files_of(spark: SparkSession, path: str) -> list[str]:
    return sorted(map(decoded, spark.read.parquet(path).inputFiles()))


def files_by(spark: SparkSession, path: str, by: str) -> dict[str, list[str]]:
    """The files of a segment that was written by a column, for each value of it."""
    found: dict[str, list[str]] = {}
    for f in files_of(spark, path):
        value = f.split(f"/{by}=", 1)[1].split("/", 1)[0]
        found.setdefault(value, []).append(f)
    return found
