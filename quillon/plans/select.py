"""Queries to DataFrames. Catalyst does all optimisation; this only says what is wanted."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon import types
from quillon.dialect import syntax as s
from quillon.errors import NameProblem, TypeProblem
from quillon.operators import numbering
from quillon.plans.binder import Binder, Field, Scope
from quillon.plans.bound import Agg, Col, Const, Op, aggregates, columns, parts, replaced, windows
from quillon.plans.columns import Columns, ordering


@dataclass
class Relation:
    """A DataFrame whose columns are called by the fields' uids, and the fields."""

    df: DataFrame
    fields: list[Field]
    loose: bool = False  # types were inferred, as for VALUES

    def named(self) -> DataFrame:
        """With the fields' names, which may repeat."""
        return self.df.select(*[F.col(f.uid).alias(f.name) for f in self.fields])


class Planner:
    def __init__(self, engine):
        self.engine = engine
        self.binder = Binder(engine.functions, engine.aggregates, engine.sequence, self.subquery)
        self.columns = Columns(engine.functions, engine.aggregates)
        self.counter = itertools.count()
        self.common: list[dict] = []  # WITH queries, innermost last

    def uid(self) -> str:
        return f"c{next(self.counter)}"

    # queries

    def subquery(self, query, scope: Scope) -> Relation:
        """A query within an expression, which may use the columns of the scope around it."""
        self.binder.around.append(Scope(scope.fields))
        try:
            return self.query(query)
        finally:
            self.binder.around.pop()

    def query(self, query) -> Relation:
        match query:
            case s.Values():
                return self.values(query)
            case s.Select() | s.SetOperation():
                self.common.append({n.lower(): (columns_, q) for n, columns_, q in query.with_})
                try:
                    return self.select(query) if isinstance(query, s.Select) else self.set_operation(query)
                finally:
                    self.common.pop()
        raise TypeProblem(f"not a query: {query}")

    def values(self, values: s.Values) -> Relation:
        widths = {len(r) for r in values.rows}
        if len(widths) != 1:
            raise TypeProblem("VALUES rows differ in length")
        rows = [[self.binder.bind(e, Scope([])) for e in r] for r in values.rows]
        kinds = []
        for column in zip(*rows):
            kind = types.NULL
            for x in column:
                kind = types.common(kind, x.type, "mix")
            kinds.append(kind)
        fields = [Field(f"column{i + 1}", self.uid(), k) for i, k in enumerate(kinds)]
        spark = self.engine.spark
        if all(isinstance(x, Const) for r in rows for x in r) and not any(isinstance(k, T.DecimalType) for k in kinds):
            # a local relation, which Catalyst folds
            arrays = []
            for column, kind in zip(zip(*rows), kinds):
                cast = float if isinstance(kind, (T.DoubleType, T.FloatType)) else lambda v: v
                arrays.append(pa.array([None if x.value is None else cast(x.value) for x in column], to_arrow_type(kind)))
            schema = T.StructType([T.StructField(f.uid, f.type) for f in fields])
            return Relation(spark.createDataFrame(pa.table(arrays, names=[f.uid for f in fields]), schema), fields, True)
        structs = [
            F.struct(*[self.columns.make(x).cast(f.type).alias(f.uid) for x, f in zip(r, fields)]) for r in rows
        ]
        one = spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))
        return Relation(one, fields, True)

    # sources

    def source(self, source) -> Relation:
        match source:
            case s.TableName(name):
                return self.table(name)
            case s.Aliased(inner, alias, names):
                return self.aliased(self.source(inner), inner, alias, names)
            case s.Join():
                return self.join(source)
        return self.query(source)

    def table(self, name: str) -> Relation:
        for level in range(len(self.common) - 1, -1, -1):
            if name.lower() in self.common[level]:
                names, query = self.common[level][name.lower()]
                inner, self.common = self.common, self.common[:level] or [{}]
                # a query may use the ones before it in its own list
                before = dict(itertools.takewhile(lambda x: x[0] != name.lower(), inner[level].items()))
                self.common = [*inner[:level], before]
                try:
                    found = self.query(query)
                finally:
                    self.common = inner
                return self.aliased(found, query, name, names)
        table = self.engine.catalog.table(name)
        df = table.frame(self.engine.spark)
        fields = [Field(c.name, self.uid(), df.schema[i].dataType, name) for i, c in enumerate(table.columns)]
        return Relation(df.toDF(*[f.uid for f in fields]), fields)

    def aliased(self, relation: Relation, inner, alias, names) -> Relation:
        # what USING has merged can't be named any more once the whole has a name
        seen = relation.fields if alias is None else [f for f in relation.fields if not f.hidden]
        if len(names) > len(seen):
            raise NameProblem(f"{len(names)} column aliases for {len(seen)} columns")
        if alias is None:
            return relation
        fields = [replace(f, table=alias, name=names[i] if i < len(names) else f.name) for i, f in enumerate(seen)]
        return replace(relation, fields=fields, loose=False)

    def join(self, join: s.Join) -> Relation:
        left, right = self.source(join.left), self.source(join.right)
        fields = left.fields + right.fields
        self.check_tables(left.fields, right.fields)
        if join.using is not None:
            return self.joined_using(left, right, join)
        if join.on is None:
            if join.kind not in ("inner", "cross"):
                raise TypeProblem(f"{join.kind} joins need a condition")
            return Relation(left.df.crossJoin(right.df), fields)
        condition = self.columns.make(self.binder.boolean(self.binder.bind(join.on, Scope(fields))))
        return Relation(left.df.join(right.df, condition, join.kind), fields)

    def joined_using(self, left: Relation, right: Relation, join: s.Join) -> Relation:
        """USING and NATURAL: columns of one name are equal and stand once, before all others."""
        names = join.using
        if not names:
            theirs = {f.name.lower() for f in right.fields if not f.hidden}
            names = [f.name for f in left.fields if not f.hidden and f.name.lower() in theirs]
            if not names:
                return Relation(left.df.crossJoin(right.df), left.fields + right.fields)
        pairs = [(Scope(left.fields).find(s.Name(n)), Scope(right.fields).find(s.Name(n))) for n in names]
        equal = [self.columns.make(self.binder.binary("=", a, b)) for a, b in pairs]
        condition = equal[0]
        for one in equal[1:]:
            condition = condition & one
        df, merged = left.df.join(right.df, condition, join.kind), []
        for n, (a, b) in zip(names, pairs):
            kind = types.common(a.type, b.type, "mix")
            value = {"right": F.col(b.uid), "full": F.coalesce(a.uid, b.uid)}.get(join.kind, F.col(a.uid))
            field_ = Field(n, self.uid(), kind)
            df = df.withColumn(field_.uid, value.cast(kind))
            merged.append(field_)
        gone = {x.uid for pair in pairs for x in pair}
        others = [replace(f, hidden=True) if f.uid in gone else f for f in left.fields + right.fields]
        return Relation(df, merged + others)

    @staticmethod
    def check_tables(left, right):
        names = lambda fields: {f.table.lower() for f in fields if f.table}
        if twice := names(left) & names(right):
            raise NameProblem(f"table name {sorted(twice)[0]} is used twice")

    def sources(self, sources) -> Relation:
        """The comma list: a product, which WHERE conditions turn into joins."""
        found = self.source(sources[0])
        for one in sources[1:]:
            right = self.source(one)
            self.check_tables(found.fields, right.fields)
            found = Relation(found.df.crossJoin(right.df), found.fields + right.fields)
        return found

    # SELECT

    def filtered(self, relation: Relation, where) -> Relation:
        if where is None:
            return relation
        condition = self.binder.boolean(self.binder.bind(where, Scope(relation.fields)))
        return replace(relation, df=relation.df.filter(self.columns.make(condition)))

    def items(self, items, scope: Scope, aggregates_: bool) -> list[tuple[str, object]]:
        """Name and bound expression of each output column."""
        found = []
        for item in items:
            match item:
                case s.Star(None):
                    found += [(f.name, Col(f.uid, f.type)) for f in scope.fields if not f.hidden]
                case s.Star(table):
                    found += [(f.name, Col(f.uid, f.type)) for f in scope.table_fields(table)]
                case s.Item(expr, alias):
                    bound = self.binder.bind(expr, scope, aggregates_)
                    found.append((alias or default_name(expr), bound))
        return found

    def select(self, select: s.Select) -> Relation:
        relation = self.filtered(self.sources(select.sources), select.where)
        scope = Scope(relation.fields)
        items = self.items(select.items, scope, True)
        own = {i.alias.lower(): self.binder.bind(i.expr, scope, True) for i in select.items if isinstance(i, s.Item) and i.alias}
        # select items come before input columns of the same name
        aliased = Scope(relation.fields, own)
        group = [self.binder.bind(e, aliased, False) for e in select.group]
        if aggregates(*group):
            raise TypeProblem("aggregates are not allowed in GROUP BY")
        order = [(o, self.binder.bind(o.expr, self.ordering_scope(relation, items, own), True)) for o in select.order]
        having = select.having and self.binder.boolean(self.binder.bind(select.having, aliased, True))
        if having is not None and windows(having):
            raise TypeProblem("functions over windows stand in select lists and ORDER BY only")
        wanted = [e for _, e in items] + [e for _, e in order] + ([having] if having else [])
        df = relation.df
        if group or aggregates(*wanted):
            df, known = self.grouped(df, group, aggregates(*wanted))
            items = [(n, self.regrouped(e, known)) for n, e in items]
            order = [(o, self.regrouped(e, known)) for o, e in order]
            if having is not None:
                df = df.filter(self.columns.make(self.regrouped(having, known)))
        elif having is not None:
            raise TypeProblem("HAVING needs aggregates or GROUP BY")
        df, items, order = self.over_windows(df, items, order)
        if select.distinct_on:
            df = self.first_of_each(df, select, aliased, items, order)
        df, items = self.numbered(df, items)
        if select.distinct:
            return self.distinct(df, items, order, select)
        df = self.sliced(self.ordered(df, order), select)
        return self.projected(df, items)

    def over_windows(self, df, items, order):
        """Functions over windows become columns, which items and order then use."""
        found = windows(*[e for _, e in items], *[e for _, e in order])
        if not found:
            return df, items, order
        known = {w: Col(self.uid(), w.type) for w in found}
        df = df.withColumns({c.uid: self.columns.make(w) for w, c in known.items()})
        return df, [(n, replaced(e, known)) for n, e in items], [(o, replaced(e, known)) for o, e in order]

    def first_of_each(self, df, select, scope, items, order) -> DataFrame:
        """DISTINCT ON: of rows that agree on its expressions the first in order; ties go by the items."""
        if select.group or any(isinstance(p, Agg) for _, e in items for p in parts(e)):
            raise TypeProblem("DISTINCT ON doesn't go with grouping")
        keys = [self.columns.make(self.binder.bind(e, scope, False)) for e in select.distinct_on]
        sorted_ = [k for k in (self.ordered_key(o, e) for o, e in order) if k is not None]
        ties = [self.columns.make(e).asc_nulls_last() for _, e in items]
        place = self.uid()
        ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*sorted_, *ties)))
        return ranked.filter(F.col(place) == 1).drop(place)

    @staticmethod
    def ordering_scope(relation, items, own) -> Scope:
        known = {n.lower(): e for n, e in items if not isinstance(e, Col)}
        return Scope(relation.fields, {**{k: v for k, v in known.items() if k not in {f.name.lower() for f in relation.fields}}, **own})

    def grouped(self, df, group, aggs):
        """Grouped rows, and what became of group keys and aggregates."""
        keys = {e: Col(self.uid(), e.type) for e in dict.fromkeys(group)}
        sums = {a: Col(self.uid(), a.type) for a in aggs}
        # DISTINCT goes over columns
        own = {x: Col(self.uid(), x.type) for a in aggs if a.distinct for x in a.args if not isinstance(x, (Col, Agg))}
        df = df.withColumns({c.uid: self.columns.make(x) for x, c in own.items()}) if own else df
        ready = {a: replace(a, args=tuple(own.get(x, x) for x in a.args)) if a.distinct else a for a in aggs}
        made = [self.columns.make(ready[a]).alias(c.uid) for a, c in sums.items()]
        named = [self.columns.make(e).alias(c.uid) for e, c in keys.items()]
        if not keys:
            df = df.select(*made)  # a query that names columns around it can't be analysed before them
        elif made:
            df = df.groupBy(*named).agg(*made)
        else:
            df = df.select(*named).distinct()
        return df, {**keys, **sums}

    def regrouped(self, expr, known):
        found = replaced(expr, known)
        made = set(known.values())
        for c in columns(found):
            if c not in made:
                raise TypeProblem("a column must be grouped or aggregated")
        return found

    def ordered_key(self, o, e):
        if isinstance(e, Const):
            return None  # a constant orders nothing
        # nulls stand after everything, so first when descending
        return ordering(self.columns.make(e), o.descending, o.descending if o.nulls_first is None else o.nulls_first)

    def ordered(self, df, order) -> DataFrame:
        keys = [k for k in (self.ordered_key(o, e) for o, e in order) if k is not None]
        return df.orderBy(*keys) if keys else df

    @staticmethod
    def sliced(df, query) -> DataFrame:
        if query.offset:
            df = df.offset(query.offset)
        return df if query.limit is None else df.limit(query.limit)

    def projected(self, df, items) -> Relation:
        fields = [Field(n, self.uid(), e.type) for n, e in items]
        return Relation(df.select(*[self.columns.make(e).alias(f.uid) for (_, e), f in zip(items, fields)]), fields)

    def distinct(self, df, items, order, select) -> Relation:
        relation = self.projected(df, items)
        known = {e: Col(f.uid, f.type) for (_, e), f in zip(items, relation.fields)}
        order = [(o, replaced(e, known)) for o, e in order]
        outputs = set(known.values())
        if any(c not in outputs for _, e in order for c in columns(e)):
            raise TypeProblem("with DISTINCT, rows are ordered by selected expressions")
        return replace(relation, df=self.sliced(self.ordered(relation.df.distinct(), order), select))

    @staticmethod
    def advances(items) -> set[str]:
        """The operators of the sequences that items advance."""
        return {p.op for _, e in items for p in parts(e) if isinstance(p, Op) and p.op.startswith("nextval:")}

    def numbered(self, df, items):
        """Takes a block of each sequence that items advance: a value for each row."""
        named = self.advances(items)
        if not named:
            return df, items
        place = self.uid()
        df, rows = numbering.numbered(df, place)
        for op in named:
            first = self.engine.sequence(op[8:]).block(rows)
            value = Op("+", (Col(place, types.BIGINT), Const(first, types.BIGINT)), types.BIGINT)
            old = Op(op, (), types.BIGINT)
            items = [(n, replaced(e, {old: value})) for n, e in items]
        return df, items

    # set operations

    def set_operation(self, query: s.SetOperation) -> Relation:
        left, right = self.query(query.left), self.query(query.right)
        if len(left.fields) != len(right.fields):
            raise TypeProblem(f"{query.op.upper()} of {len(left.fields)} and {len(right.fields)} columns")
        kinds = [self.same_type(a, b, left.loose or right.loose, query.op) for a, b in zip(left.fields, right.fields)]
        a, b = (
            r.df.select(*[F.col(f.uid).cast(k) if type(f.type) is not type(k) else F.col(f.uid) for f, k in zip(r.fields, kinds)])
            for r in (left, right)
        )
        match query.op, query.all:
            case "union", all_:
                df = a.union(b) if all_ else a.union(b).distinct()
            case "intersect", all_:
                df = a.intersectAll(b) if all_ else a.intersect(b)
            case "except", all_:
                df = a.exceptAll(b) if all_ else a.subtract(b)
        fields = [Field(f.name, self.uid(), k) for f, k in zip(left.fields, kinds)]
        df = df.toDF(*[f.uid for f in fields])
        order = [(o, self.binder.bind(o.expr, Scope(fields))) for o in query.order]
        df = self.sliced(self.ordered(df, order), query)
        return Relation(df, fields, left.loose and right.loose)

    @staticmethod
    def same_type(a: Field, b: Field, loose: bool, op: str):
        if type(a.type) is type(b.type) or types.is_null(a.type) or types.is_null(b.type) or loose:
            return types.common(a.type, b.type, "mix")
        raise TypeProblem(f"{op.upper()} types differ: {types.name_of(a.type)} and {types.name_of(b.type)}")


def default_name(expr) -> str:
    match expr:
        case s.Name(name, _):
            return name
        case s.Call(name):
            return name
    return "?column?"
