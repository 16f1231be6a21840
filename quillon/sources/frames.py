"""DataFrames as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillon import storage
from quillon.catalog import Column, Table
from quillon.errors import EngineProblem


@dataclass
class FrameTable(Table):
    """A table over a DataFrame. A static one is written to files when it is first changed."""

    df: DataFrame | None = None

    @classmethod
    def of(cls, name: str, df: DataFrame) -> FrameTable:
        return cls(name, [Column(f.name, f.dataType) for f in df.schema], df=df)

    def frame(self, spark: SparkSession, files=None) -> DataFrame:
        return self.df if files is None and self.df is not None else super().frame(spark, files)

    def listed(self, spark: SparkSession) -> list[str]:
        if self.df is not None:
            if self.df.isStreaming:
                raise EngineProblem(f"{self.name} is a stream and can't be changed")
            self.files, self.df = storage.files_of(spark, storage.write_segment(self.df)), None
        return self.files
