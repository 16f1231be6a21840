"""What several corpus operators share: tables, the shared folder, checked broadcasts."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.storage import fresh_path, keep_track, remove, shared_folder

#: ASCII white space ends a word here; every other character belongs to one.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of each scratch() that is open, what has been made within it.
_open: list[list[str]] = []


@contextmanager
def scratch():
    """Deletes, at its end, the checkpoints and folders that operators make within it.

    What they return must have been written or collected by then. Without it these stay until
    the process ends, as a DataFrame that was returned may still read them.
    """
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            remove(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    made = df.checkpoint(eager=True)
    written = made._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if written.isDefined():
        keep_track(written.get())
        if _open:
            _open[-1].append(written.get())
    return made


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which scratch() deletes."""
    path = fresh_path(spark, name)
    if _open:
        _open[-1].append(path)
    return path


#: Bytes of rows that go to Python at once.
BATCH = 4 << 20


def for_python(df: DataFrame) -> DataFrame:
    """df, about to be sent to Python: lowers the session's limit on the bytes of a batch.

    Spark's default lets ten thousand rows or 64 MB go at once, which long texts turn into
    several copies of that in an executor and its worker.
    """
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, f"{BATCH}b")
    return df


#: Bytes that a side which is broadcast holds at most, as weighed().
BROADCAST_BYTES = 128 << 20


def weighed(df: DataFrame) -> Column:
    """About the bytes of a row: texts and arrays by what they hold, other columns by 16 each."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c) + 16
        elif isinstance(f.dataType, T.ArrayType):
            own = F.octet_length(F.array_join(c, "")) if isinstance(f.dataType.elementType, T.StringType) else F.lit(0)
            size = own + 16 * (1 + F.greatest(F.size(c), F.lit(0)))
        else:
            size = F.lit(16)
        total = total + F.coalesce(size, F.lit(16))
    return total


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df, marked for broadcast only when weighed and found within max_rows and BROADCAST_BYTES.

    Beyond the bounds the frame is returned unmarked and the join shuffles. Pass a frame
    that is cheap to read, such as one that cut() returned.
    """
    some = df.limit(max_rows + 1)
    rows, weight = some.agg(F.count(F.lit(1)), F.sum(weighed(df))).first()
    return F.broadcast(df) if rows <= max_rows and (weight or 0) <= BROADCAST_BYTES else df


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else; lower() alone would also change other scripts."""
    plain = ~column.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(column)).otherwise(
        F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())
    )
