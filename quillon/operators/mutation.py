"""INSERT, UPDATE and DELETE as new files.

Files that hold no changed row are kept as they are. The changed rows and the rest of their
files are written anew, constraints are checked on what is new, and only then is the table's
list of files exchanged, so a statement takes effect wholly or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import storage, types
from quillon.catalog import Table
from quillon.dialect import syntax as s
from quillon.errors import TypeProblem
from quillon.plans.binder import Field, Scope
from quillon.plans.bound import Col, Const
from quillon.plans.select import Planner, Relation

PLACE = ("__file", "__row")
CHANGED = "__changed"


class Mutations:
    def __init__(self, engine, planner: Planner, constraints):
        self.engine, self.planner, self.constraints = engine, planner, constraints

    def run(self, statement) -> DataFrame:
        made = len(self.engine.segments)
        try:
            match statement:
                case s.Insert():
                    rows = self.insert(statement)
                case s.Update():
                    rows = self.update(statement)
                case s.Delete():
                    rows = self.delete(statement)
        except Exception:
            self.engine.drop_segments(made)
            raise
        if not statement.returning:
            return self.engine.nothing()
        return self.returned(self.engine.catalog.table(statement.table), statement, rows)

    def returned(self, table: Table, statement, rows: DataFrame) -> DataFrame:
        rows = rows.select(*[F.col(f"`{c.name}`") for c in table.columns])
        fields = [Field(c.name, self.planner.uid(), c.type, statement.alias or table.name) for c in table.columns]
        df = rows.toDF(*[f.uid for f in fields])
        items = self.planner.items(statement.returning, Scope(fields), False)
        return self.planner.projected(*self.planner.numbered(df, items)).named()

    def stored(self, expr, column):
        if not types.assignable(column.type, expr.type):
            raise TypeProblem(f"{types.name_of(expr.type)} doesn't fit {column.name}, {types.name_of(column.type)}")
        return expr

    def default(self, column):
        return Const(None, types.NULL) if column.default is None else self.planner.binder.bind(column.default, Scope([]))

    def segment(self, df: DataFrame, by: str | None = None) -> str:
        path = storage.write_segment(df, by)
        self.engine.segments.append(path)
        return path

    def written(self, df: DataFrame) -> list[str]:
        return storage.files_of(self.engine.spark, self.segment(df))

    # INSERT

    def insert(self, statement: s.Insert) -> DataFrame:
        spark, table = self.engine.spark, self.engine.catalog.table(statement.table)
        relation = self.planner.query(statement.source)
        names = [table.column(c).name for c in statement.columns] or [c.name for c in table.columns[: len(relation.fields)]]
        if len(names) != len(relation.fields) or len(set(names)) != len(names):
            raise TypeProblem(f"{len(relation.fields)} values for {len(names)} columns of {table.name}")
        given = {n: f for n, f in zip(names, relation.fields)}
        items = []
        for c in table.columns:
            expr = Col(given[c.name].uid, given[c.name].type) if c.name in given else self.default(c)
            items.append((c.name, self.stored(expr, c)))
        df, items = self.planner.numbered(relation.df, items)
        df = df.select(*[self.planner.columns.make(e).cast(c.type).alias(c.name) for (_, e), c in zip(items, table.columns)])
        files = self.written(df)
        new = table.frame(spark, files)
        table.listed(spark)
        self.constraints.validate(table, new, table.frame(spark))
        table.files = table.files + files
        return new

    # UPDATE and DELETE

    def target(self, table: Table, statement, files=None) -> Relation:
        df = table.placed(self.engine.spark, files)
        fields = [Field(c.name, self.planner.uid(), c.type, statement.alias or table.name) for c in table.columns]
        return Relation(df.toDF(*[f.uid for f in fields], *PLACE), fields)

    def matched(self, table: Table, statement, values=()) -> tuple[DataFrame, Scope]:
        """Target rows joined to the sources, where the condition holds: at least PLACE."""
        relation = self.target(table, statement)
        fields, df = relation.fields, relation.df
        if statement.sources:
            sources = self.planner.sources(statement.sources)
            self.planner.check_tables(fields, sources.fields)
            df, fields = df.crossJoin(sources.df), fields + sources.fields
        return self.planner.filtered(Relation(df, fields), statement.where).df, Scope(fields)

    def split(self, table: Table, statement, changes=()):
        """Files with matches, and their rows: by CHANGED, those that match, with new values, and the others.

        changes: (column, expression) for UPDATE. Several matches of a row count once, with
        the least of the new values.
        """
        hits, scope = self.matched(table, statement)
        made = []
        for name, expr in changes:
            column = table.column(name)
            made.append((column, self.stored(self.planner.binder.bind(expr, scope), column)))
        make = self.planner.columns.make
        names = [c.name for c in table.columns]
        if not statement.sources:
            files = self.hit(hits)
            uids = [f.uid for f in scope.fields]
            inside = self.target(table, statement, files).df.toDF(*uids, *PLACE)
            where = F.lit(True)
            if statement.where is not None:
                bound = self.planner.binder.boolean(self.planner.binder.bind(statement.where, scope))
                where = F.coalesce(make(bound), F.lit(False))
            new = {c.name: e for c, e in made}
            items = [(n, new.get(n, Col(f.uid, f.type))) for n, f in zip(names, scope.fields)]
            old = [F.col(u).alias(n) for n, u in zip(names, uids)]
            if self.planner.advances(items):  # only rows that match are numbered
                rows, items = self.planner.numbered(inside.filter(where), items)
                changed = rows.select(*[make(e).cast(c.type).alias(n) for (n, e), c in zip(items, table.columns)], F.lit(True).alias(CHANGED))
                return files, changed.unionByName(inside.filter(~where).select(*old, F.lit(False).alias(CHANGED)))
            flagged = inside.withColumn(CHANGED, where)
            values = [
                F.when(F.col(CHANGED), make(e).cast(c.type)).otherwise(F.col(f.uid)).alias(n) if n in new else F.col(f.uid).alias(n)
                for (n, e), c, f in zip(items, table.columns, scope.fields)
            ]
            return files, flagged.select(*values, CHANGED)
        values = F.struct(*[make(e).cast(c.type).alias(f"v{i}") for i, (c, e) in enumerate(made)], F.lit(0).alias("none"))
        once = hits.select(*PLACE, values.alias("__new")).groupBy(*PLACE).agg(F.min("__new").alias("__new"))
        once = self.engine.spark.read.parquet(self.segment(once))
        files = self.hit(once)
        order = {c.name: i for i, (c, _) in enumerate(made)}
        joined = table.placed(self.engine.spark, files).join(once, list(PLACE), "left")
        seen = F.col("__new").isNotNull()
        values = [F.when(seen, F.col(f"__new.v{order[n]}")).otherwise(F.col(f"`{n}`")).alias(n) if n in order else F.col(f"`{n}`") for n in names]
        return files, joined.select(*values, seen.alias(CHANGED))

    @staticmethod
    def hit(rows: DataFrame) -> list[str]:
        """The files that rows (with PLACE) come from: names of files, never rows."""
        return [storage.decoded(r[0]) for r in rows.select("__file").distinct().collect()]

    def update(self, statement: s.Update) -> DataFrame:
        spark, table = self.engine.spark, self.engine.catalog.table(statement.table)
        hit, rows = self.split(table, statement, statement.changes)
        if not hit:
            return table.frame(spark, [])
        kept = self.kept(table, hit)
        parts = storage.files_by(spark, self.segment(rows, CHANGED), CHANGED)
        new, other = parts.get("true", []), parts.get("false", [])
        changed = {name.lower() for name, _ in statement.changes}
        self.constraints.validate(table, table.frame(spark, new), table.frame(spark, kept + other), changed)
        table.files = kept + other + new
        return table.frame(spark, new)

    def delete(self, statement: s.Delete) -> DataFrame:
        spark, table = self.engine.spark, self.engine.catalog.table(statement.table)
        hit, rows = self.split(table, statement)
        if not hit:
            return table.frame(spark, [])
        table.files = self.kept(table, hit) + self.written(rows.filter(~F.col(CHANGED)).drop(CHANGED))
        return rows.filter(CHANGED).drop(CHANGED)

    @staticmethod
    def kept(table: Table, hit: list[str]) -> list[str]:
        """The files without matches. Spark writes their URIs in more than one way."""
        path = lambda f: f.split("://", 1)[-1].removeprefix("file:").lstrip("/")
        gone = {path(f) for f in hit}
        return [f for f in table.files if path(f) not in gone]

    def plan(self, statement) -> DataFrame:
        """The rows that a statement would work on, for EXPLAIN."""
        if isinstance(statement, s.Insert):
            return self.planner.query(statement.source).named()
        return self.matched(self.engine.catalog.table(statement.table), statement)[0]
