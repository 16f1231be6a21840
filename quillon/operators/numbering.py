"""Dense numbers for the rows of a DataFrame, without sorting them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import storage


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """df with column, 0 to the number of rows - 1 in partition order, and that number.

    The rows are written first, so that numbers stay with their rows whatever is recomputed.
    Only the partitions' row counts come to the driver.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    path = storage.write_segment(df.withColumn("__place", place))
    rows = spark.read.parquet(path)
    part = F.shiftright("__place", 33)
    counts = rows.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["part"], total))
        total += r["count"]
    if not offsets:
        return rows.withColumn(column, F.lit(0).cast("long")).drop("__place"), 0
    # one row per partition that wrote the segment
    starts = spark.createDataFrame(offsets, "__part bigint, __start bigint")
    within = F.col("__place").bitwiseAND((1 << 33) - 1)
    found = rows.withColumn("__of", part).join(F.broadcast(starts), F.col("__of") == F.col("__part"))
    return found.withColumn(column, F.col("__start") + within).drop("__place", "__of", "__part", "__start"), total
