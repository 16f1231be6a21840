"""Tables, sequences, constraints and indexes by name."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import storage
from quillon.errors import EngineProblem, NameProblem


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    nullable: bool = True
    default: Any = None  # an expression of the syntax tree


@dataclass(frozen=True)
class Index:
    name: str
    method: str
    keys: tuple
    unique: bool = False
    where: Any = None


@dataclass
class Table:
    """A table's rows are the rows of its files, none of which is ever changed.

    A change writes new files and swaps the list; files without changed rows stay. A table
    that was loaded keeps its path until it is first changed.
    """

    name: str
    columns: list[Column]
    path: str | None = None
    files: list[str] = field(default_factory=list)
    constraints: list = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type) for c in self.columns])

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise NameProblem(f"table {self.name} has no column {name}")

    def frame(self, spark: SparkSession, files: list[str] | None = None) -> DataFrame:
        """All rows, or those of some files."""
        if files is None and self.path:
            return spark.read.schema(self.schema).parquet(self.path)
        some = self.files if files is None else files
        if not some:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*some)

    def placed(self, spark: SparkSession, files: list[str] | None = None) -> DataFrame:
        """Rows with __file and __row, which identify them for good."""
        self.listed(spark)
        some = self.files if files is None else files
        if not some:
            empty = self.schema.add("__file", T.StringType()).add("__row", T.LongType())
            return spark.createDataFrame([], empty)
        return self.frame(spark, some).select(
            "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
        )

    def listed(self, spark: SparkSession) -> list[str]:
        if self.path:
            self.files, self.path = storage.files_of(spark, self.path), None
        return self.files


class Sequence:
    """A counter on the driver; statements take blocks of it."""

    def __init__(self, name: str, kind: str = "bigint"):
        self.name, self.kind = name, kind
        self.value, self.called, self.lock = 0, False, threading.Lock()

    def block(self, size: int) -> int:
        """The first of size new values."""
        with self.lock:
            first = self.value + 1
            top = {"smallint": 2**15 - 1, "integer": 2**31 - 1}.get(self.kind, 2**63 - 1)
            if self.value + size > top:
                raise EngineProblem(f"sequence {self.name} is exhausted")
            self.value += size
            self.called = self.called or size > 0
            return first

    def current(self) -> int:
        if not self.called:
            raise EngineProblem(f"sequence {self.name} has no current value yet")
        return self.value

    def set(self, value: int):
        with self.lock:
            self.value, self.called = value, True


class Catalog:
    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.sequences: dict[str, Sequence] = {}

    def table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise NameProblem(f"unknown table {name}")
        return self.tables[name.lower()]

    def add(self, table: Table):
        seen = set()
        for c in table.columns:
            if c.name.lower() in seen:
                raise NameProblem(f"column {c.name} is defined twice")
            seen.add(c.name.lower())
        self.tables[table.name.lower()] = table

    def load(self, spark: SparkSession, name: str, path: str):
        schema = spark.read.parquet(path).schema
        self.add(Table(name, [Column(f.name, f.dataType) for f in schema], path))

    def sequence(self, name: str) -> Sequence:
        if name.lower() not in self.sequences:
            raise NameProblem(f"unknown sequence {name}")
        return self.sequences[name.lower()]

    def add_sequence(self, name: str, kind: str):
        self.sequences[name.lower()] = Sequence(name, kind)
