"""Constraints as queries for violating rows; a change is kept only if all find none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Index, Table
from quillon.dialect import syntax as s
from quillon.errors import ConstraintProblem, NameProblem
from quillon.plans.binder import Field, Scope


def table_scope(table: Table) -> Scope:
    return Scope([Field(c.name, c.name, c.type, table.name) for c in table.columns])


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


class Constraints:
    def __init__(self, engine, planner):
        self.engine, self.planner = engine, planner

    def column(self, table: Table, expr):
        return self.planner.columns.make(self.planner.binder.bind(expr, table_scope(table)))

    def validate(self, table: Table, new: DataFrame, others: DataFrame, changed: set[str] | None = None):
        """new: rows to be added; others: the rows that stay beside them.

        changed: lower-cased columns that new rows may differ in from rows that were valid;
        constraints on none of them hold still. All of a row's own conditions are one job.
        """
        touched = lambda names: changed is None or bool(changed & {n.lower() for n in names})
        broken = []
        for c in table.columns:
            if not c.nullable and touched([c.name]):
                broken.append((F.col(f"`{c.name}`").isNull(), f"null in column {c.name} of {table.name}, which is NOT NULL"))
        for c in table.constraints:
            if isinstance(c, s.Check) and touched(s.names(c.condition)):
                # a null result passes
                broken.append((F.coalesce(~self.column(table, c.condition), F.lit(False)), f"check {c.name or ''} of {table.name} fails"))
        if broken:
            found = new.agg(*[F.max(condition).alias(f"x{i}") for i, (condition, _) in enumerate(broken)]).first()
            for seen, (_, problem) in zip(found, broken):
                if seen:
                    raise ConstraintProblem(problem)
        for c in table.constraints:
            if not isinstance(c, s.Check) and touched(c.columns):
                self.one(table, c, new, others)
        for index in table.indexes:
            names = [n for e in (*index.keys, index.where) for n in s.names(e)]
            if index.unique and (touched(names) or not names):
                self.unique(table, index.name, index.keys, index.where, new, others)

    def one(self, table: Table, constraint, new: DataFrame, others: DataFrame):
        match constraint:
            case s.Check(condition, name):
                if _any(new.filter(~self.column(table, condition))):
                    raise ConstraintProblem(f"check {name or ''} of {table.name} fails")
            case s.PrimaryKey(columns, name):
                self.unique(table, name or f"{table.name}_pkey", [s.Name(c) for c in columns], None, new, others)
            case s.ForeignKey():
                self.foreign(table, constraint, new, others)

    def unique(self, table: Table, name: str, keys, where, new: DataFrame, others: DataFrame):
        """Rows with a null key are distinct from all."""
        def keyed(df):
            if where is not None:
                df = df.filter(self.column(table, where))
            named = [self.column(table, k).alias(f"k{i}") for i, k in enumerate(keys)]
            return df.select(*named).dropna()

        fresh, names = keyed(new), [f"k{i}" for i in range(len(keys))]
        twice = fresh.groupBy(*names).count().filter("count > 1")
        if _any(twice) or _any(fresh.join(keyed(others), names, "left_semi")):
            raise ConstraintProblem(f"duplicate key in {name} of {table.name}")

    def foreign(self, table: Table, key: s.ForeignKey, new: DataFrame, others: DataFrame):
        parent = self.engine.catalog.table(key.table)
        rows = new.unionByName(others) if parent is table else parent.frame(self.engine.spark)
        names = [f"k{i}" for i in range(len(key.columns))]
        child = new.select(*[F.col(f"`{table.column(c).name}`").alias(n) for c, n in zip(key.columns, names)])
        targets = rows.select(*[F.col(f"`{parent.column(c).name}`").alias(n) for c, n in zip(key.targets, names)])
        # a key with any null part passes
        if _any(child.dropna().distinct().join(targets, names, "left_anti")):
            raise ConstraintProblem(f"{key.name or 'foreign key'} of {table.name}: no such row in {parent.name}")

    def add(self, table: Table, constraint):
        """Checks the rows that are there, then keeps the constraint."""
        spark = self.engine.spark
        rows = table.frame(spark)
        nothing = rows.limit(0)
        match constraint:
            case s.PrimaryKey(columns, name):
                if any(isinstance(c, s.PrimaryKey) for c in table.constraints):
                    raise ConstraintProblem(f"{table.name} has a primary key already")
                names = [table.column(c).name for c in columns]
                if any(table.column(c).nullable for c in names):
                    raise ConstraintProblem(f"primary key columns of {table.name} must be NOT NULL")
            case s.ForeignKey(columns, target, targets, _):
                for c in columns:
                    table.column(c)
                self.referable(self.engine.catalog.table(target), targets)
                if len(columns) != len(targets):
                    raise NameProblem("a foreign key needs as many columns as it references")
        self.one(table, constraint, rows, nothing)
        table.constraints.append(constraint)

    @staticmethod
    def referable(parent: Table, targets):
        wanted = {parent.column(t).name.lower() for t in targets}
        for c in parent.constraints:
            if isinstance(c, s.PrimaryKey) and {x.lower() for x in c.columns} == wanted:
                return
        for i in parent.indexes:
            names = {k.name.lower() for k in i.keys if isinstance(k, s.Name)}
            if i.unique and i.where is None and len(names) == len(i.keys) and names == wanted:
                return
        raise ConstraintProblem(f"no unique key of {parent.name} on {', '.join(targets)}")

    def add_index(self, statement: s.CreateIndex):
        table = self.engine.catalog.table(statement.table)
        if statement.method not in ("btree", "hash"):
            raise NameProblem(f"unknown index method {statement.method}")
        if statement.method == "hash" and (len(statement.keys) != 1 or statement.unique or statement.keys[0].descending):
            raise ConstraintProblem("a hash index has one key, without order, and is not unique")
        keys = tuple(o.expr for o in statement.keys)
        for k in keys:
            self.column(table, k)
        if statement.where is not None:
            self.column(table, statement.where)
        if any(i.name.lower() == statement.name.lower() for t in self.engine.catalog.tables.values() for i in t.indexes):
            raise NameProblem(f"index {statement.name} exists already")
        index = Index(statement.name, statement.method, keys, statement.unique, statement.where)
        if index.unique:
            rows = table.frame(self.engine.spark)
            self.unique(table, index.name, keys, index.where, rows, rows.limit(0))
        table.indexes.append(index)
