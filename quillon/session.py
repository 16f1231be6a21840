"""The engine: statements in, DataFrames out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon import storage
from quillon.catalog import Catalog
from quillon.dialect import syntax as s
from quillon.dialect.lexer import statements, tokens
from quillon.dialect.parser import parse
from quillon.errors import NameProblem
from quillon.functions import registry
from quillon.operators.constraints import Constraints
from quillon.operators.definition import Definitions
from quillon.operators.mutation import Mutations
from quillon.plans.select import Planner
from quillon.sources.frames import FrameTable


class _Catalog(Catalog):
    """Finds tables that were not defined in a folder of Parquet tables, if there is one."""

    def __init__(self, spark: SparkSession, folder: str | None):
        super().__init__()
        self.spark, self.folder = spark, folder

    def table(self, name: str):
        if name.lower() not in self.tables and self.folder:
            try:
                self.load(self.spark, name.lower(), f"{self.folder}/{name.lower()}.parquet")
            except AnalysisException as problem:
                raise NameProblem(f"unknown table {name}") from problem
        return super().table(name)


class Engine:
    """A catalog of its own on a Spark session.

    folder: where <table>.parquet of names that no statement has defined may lie.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.catalog = _Catalog(spark, folder)
        self.functions, self.aggregates = registry.scalars(), registry.aggregates()
        self.planner = Planner(self)
        self.constraints = Constraints(self, self.planner)
        self.mutations = Mutations(self, self.planner, self.constraints)
        self.definitions = Definitions(self, self.planner, self.constraints)
        self.segments: list[str] = []  # folders that statements have written

    def drop_segments(self, start: int = 0):
        """Deletes what statements have written, from a place on."""
        for path in self.segments[start:]:
            storage.remove(path)
        del self.segments[start:]

    def close(self):
        """Deletes all that its statements have written; its tables can't be read any more."""
        self.drop_segments()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def sequence(self, name: str):
        return self.catalog.sequence(name)

    def nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([]))

    def register(self, name: str, df: DataFrame):
        """A DataFrame, also a streaming one, as a table."""
        self.catalog.add(FrameTable.of(name, df))

    def sql(self, text: str) -> DataFrame:
        """Runs one statement. Queries are lazy; changes happen before this returns."""
        return self.execute(parse(text))

    def execute(self, statement) -> DataFrame:
        match statement:
            case s.Select() | s.SetOperation():
                return self.planner.query(statement).named()
            case s.Insert() | s.Update() | s.Delete():
                return self.mutations.run(statement)
            case s.Explain(inner):
                return self.spark.createDataFrame([(self.explained(inner),)], "`query plan` string")
        return self.definitions.run(statement)

    def explained(self, statement, mode: str = "formatted") -> str:
        """The plan of a query, or of the rows that a change would work on; nothing is run."""
        if isinstance(statement, str):
            statement = parse(statement)
        if isinstance(statement, (s.Select, s.SetOperation)):
            df = self.planner.query(statement).named()
        else:
            df = self.mutations.plan(statement)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def script(self, text: str) -> list[DataFrame]:
        """Runs every statement of a script."""
        found, rest = statements(text)
        if tokens(rest)[0].kind != "end":
            found.append(rest)
        return [self.sql(one) for one in found]
