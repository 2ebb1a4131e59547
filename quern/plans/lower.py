"""SELECT and DELETE conditions as DataFrames: names, types, error rules, then one declarative plan for Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QuernError
from quern.functions import numbers, spatial, vector
from quern.operators.knn import top_k
from quern.plans.parser import ColumnDef, Condition, Item, PointValue, Statement, VectorValue
from quern.sources.catalog import Table

SCORE, DIST = "__score", "__distance"
#: The k best (id, score) of a MATCH are broadcast up to this k.
MOST_BROADCAST = 100_000


@dataclass
class Side:
    """A table of the query: its columns stand in the frame under `prefix` + name."""

    table: Table
    names: tuple[str, ...]
    frame: DataFrame
    prefix: str = ""


def _kind(df: DataFrame, name: str) -> ColumnDef:
    """The dialect's type of a native Parquet column."""
    t = df.schema[name].dataType
    if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return ColumnDef(name, "INT")
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return ColumnDef(name, "FLOAT")
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        return ColumnDef(name, "VECTOR")
    if isinstance(t, T.StructType) and t.names == ["lat_e6", "lon_e6"]:
        return ColumnDef(name, "POINT")
    return ColumnDef(name, "VARCHAR")


def native_table(name: str, df: DataFrame, path: str) -> Table:
    columns = [_kind(df, c) for c in df.columns]
    key = next((c for c in columns if c.kind == "INT"), columns[0])
    key.key = True
    return Table(name, columns, native=path)


class Lowering:
    """One statement over its sides. text_scores(table, column, query, scheme) gives (id, score) of a MATCH; ann(table,
    index kind, column, vector, k) the rows of an approximate search."""

    def __init__(self, s: Statement, sides: list[Side], text_scores: Callable | None = None, ann: Callable | None = None):
        self.s, self.sides, self.text_scores, self.ann = s, sides, text_scores, ann
        self.shown: DataFrame | None = None
        self.watched: dict[str, Observation] | None = None  # rows that pass each part of the plan, if they are asked for

    def watch(self, part: str, df: DataFrame) -> DataFrame:
        if self.watched is None:
            return df
        self.watched[part] = Observation()
        return df.observe(self.watched[part], F.count(F.lit(1)).alias("n"))

    # --- names
    def find(self, name: str) -> tuple[ColumnDef, Column]:
        owner, dot, bare = name.rpartition(".")
        hits = []
        for side in self.sides:
            if dot and owner.upper() not in side.names:
                continue
            for c in side.table.columns:
                if c.name.upper() == bare.upper():
                    hits.append((c, F.col(f"`{side.prefix}{c.name}`")))
        if not hits:
            raise QuernError(f"column {name} does not exist in {' or '.join(x.table.name for x in self.sides)}")
        if len(hits) > 1:
            raise QuernError(f"column {bare} is ambiguous")
        return hits[0]

    def owner(self, name: str) -> Side:
        _, dot, bare = name.rpartition(".")
        self.find(name)
        return next(x for x in self.sides if (not dot or name.rpartition(".")[0].upper() in x.names) and any(c.name.upper() == bare.upper() for c in x.table.columns))

    # --- conditions
    def check_centre(self, c: ColumnDef, centre) -> None:
        if isinstance(centre, PointValue) and c.kind != "POINT":
            raise QuernError(f"column {c.name} is not POINT")
        if isinstance(centre, VectorValue):
            if c.kind != "VECTOR":
                raise QuernError(f"column {c.name} is not VECTOR")
            if c.size and len(centre.items) != c.size:
                raise QuernError(f"column {c.name} has {c.size} components, the vector {len(centre.items)}")

    def distance(self, name: str, centre, metric: str) -> Column:
        c, col = self.find(name)
        self.check_centre(c, centre)
        if isinstance(centre, PointValue):
            return spatial.distance_m(col, centre.lat_e6, centre.lon_e6, metric)
        return vector.distance(col, list(centre.items), metric)

    def condition(self, c: Condition) -> Column:
        column, col = self.find(c.column)
        if c.op == "INSIDE":
            if column.kind != "POINT":
                raise QuernError(f"dentro needs a POINT column and {column.name} is none")
            return spatial.inside(col, c.polygon)
        if c.centre is not None:
            if isinstance(c.centre, PointValue):
                self.check_centre(column, c.centre)
                return spatial.within(col, c.centre.lat_e6, c.centre.lon_e6, c.op, c.value, c.metric)
            d = self.distance(c.column, c.centre, c.metric)
            return {"<": d < c.value, "<=": d <= c.value, ">": d > c.value, ">=": d >= c.value}[c.op]
        for v in (c.value, c.upper) if c.op == "BETWEEN" else (c.value,):
            if column.kind in ("POINT", "VECTOR"):
                raise QuernError(f"column {column.name} is {column.kind}; compare it with distancia(...)")
            good = {"INT": isinstance(v, int), "FLOAT": isinstance(v, (int, float)), "VARCHAR": isinstance(v, str)}[column.kind]
            if not good:
                raise QuernError(f"column {column.name} is {column.kind}")
        # A whole number meets a FLOAT column as a double; a decimal is a float32 already.
        lit = (lambda v: F.lit(float(v))) if column.kind == "FLOAT" else F.lit
        if c.op == "BETWEEN":
            return col.between(lit(c.value), lit(c.upper))
        v = lit(c.value)
        return {"=": col == v, "!=": col != v, "<": col < v, "<=": col <= v, ">": col > v, ">=": col >= v}[c.op]

    def filtered(self, df: DataFrame, conditions: list[Condition]) -> DataFrame:
        for c in conditions:
            df = df.where(self.condition(c))
        return df

    # --- sources
    def similar_column(self) -> ColumnDef:
        if self.s.similar_column:
            c, _ = self.find(self.s.similar_column)
            if c.kind != "VECTOR":
                raise QuernError(f"column {c.name} is not VECTOR")
            return c
        vectors = [c for c in self.sides[0].table.columns if c.kind == "VECTOR"]
        if len(vectors) != 1:
            raise QuernError("SIMILAR_TO needs its column: the table has " + ("no" if not vectors else "more than one") + " VECTOR column")
        return vectors[0]

    def source(self) -> DataFrame:
        s, one = self.s, self.sides[0]
        if s.join:
            return self.watch("join", self.joined())
        df = self.watch("scan", one.frame)
        if s.match:
            column, _ = self.find(s.match[0])
            scores = self.text_scores(one.table, column.name, s.match[1], s.ranking)
            if s.limit is not None and not s.where and self.by_score():  # the k best are chosen before the table is joined
                scores = F.broadcast(scores.orderBy(F.desc("score"), "id").limit(s.limit)) if s.limit <= MOST_BROADCAST else scores.orderBy(F.desc("score"), "id").limit(s.limit)
            df = df.join(scores.select(F.col("id").alias("__id"), F.col("score").alias(SCORE)), F.col(one.table.key.name) == F.col("__id")).drop("__id")
            return self.watch("filter", self.filtered(self.watch("text", df), s.where))
        if s.similar:
            c = self.similar_column()
            if isinstance(s.similar_to, str):
                raise QuernError("SIMILAR_TO('file') needs a vector: register the file's vector first")
            self.check_centre(c, s.similar_to)
            q = list(s.similar_to.items)
            score = vector.similarity(F.col(DIST), s.similar_metric)
            nearest = lambda d: top_k(d.withColumn(DIST, vector.distance(F.col(c.name), q, s.similar_metric)), F.col(DIST), one.table.key.name, s.similar_k)
            if not s.similar_index:  # the conditions choose first
                return nearest(self.filtered(df, s.where)).withColumn(SCORE, score)
            index = one.table.index(c.name, s.similar_index)
            if index is None:
                raise QuernError(f"there is no {s.similar_index} index on {one.table.name}.{c.name}")
            if index.options["metrica"] != s.similar_metric:
                raise QuernError(f"index {index.name} uses the metric {index.options['metrica'].lower()}; use WITH METRIC")
            found = df.where(F.col(one.table.key.name).isin(*s.candidates)) if s.candidates else df.limit(0) if s.candidates is not None else self.ann(one.table, index, q, s.similar_k)
            # The index chooses first; the conditions come after it and may leave fewer than k.
            return self.filtered(nearest(found.select(*df.columns)), s.where).withColumn(SCORE, score)
        return self.watch("filter", self.filtered(df, s.where))

    def by_score(self) -> bool:
        """Whether rows come by falling score and are not aggregated."""
        s = self.s
        if s.group_by or any(i.aggregate for i in s.items) or s.order_centre is not None:
            return False
        own = not s.order_by or any(i.score and i.label.upper() == s.order_by.upper() for i in s.items) or s.order_by.upper() == "SCORE"
        return own and (s.descending or not s.order_by)

    def joined(self) -> DataFrame:
        s, (a, b) = self.s, self.sides
        if a.names[-1] == b.names[-1]:
            raise QuernError("the tables of a JOIN need different names")
        (left, lc), (right, rc) = self.find(s.on[0]), self.find(s.on[1])
        if self.owner(s.on[0]) is self.owner(s.on[1]):
            raise QuernError("ON takes a column of each table")
        for c in (left, right):
            if c.kind in ("POINT", "VECTOR"):
                raise QuernError(f"column {c.name} is {c.kind} and cannot be joined on")
        if (left.kind == "VARCHAR") != (right.kind == "VARCHAR"):
            raise QuernError("ON compares text with a number")
        frames = []
        for k, side in enumerate(self.sides):
            own = self.watch(f"scan{k}", side.frame).select(*(F.col(c.name).alias(side.prefix + c.name) for c in side.table.columns))
            frames.append(self.watch(f"filter{k}", self.filtered(own, [c for c in s.where if self.owner(c.column) is side])))
        return frames[0].join(frames[1], lc == rc)

    # --- items
    def items(self) -> list[Item]:
        stars = [Item(column=(f"{x.names[-1]}.{c.name}" if self.s.join else c.name)) for x in self.sides for c in x.table.columns] if self.s.star else []
        return stars + self.s.items

    def aggregate(self, item: Item) -> Column:
        if not item.column:
            return F.count(F.lit(1))
        c, col = self.find(item.column)
        if c.kind not in ("INT", "FLOAT"):
            raise QuernError(f"{item.aggregate} needs a number and {c.name} is {c.kind}")
        single = isinstance(self.sides[0].frame.schema[c.name].dataType, T.FloatType) if not self.s.join else c.kind == "FLOAT" and not self.sides[0].table.native
        match item.aggregate:
            case "COUNT":
                return F.count(col)
            case "SUM":
                return F.sum(col.cast("double")).cast("float") if single else F.sum(col)
            case "AVG":
                return F.avg(col.cast("double"))
            case "MIN":
                return F.min(col)
        return F.max(col)

    def select(self) -> DataFrame:
        s, df = self.s, self.source()
        items = self.items()
        if s.group_by or any(i.aggregate for i in items):
            return self.grouped(df, items)
        names = [f"__c{k}" for k in range(len(items))]
        shown = [(F.col(SCORE).cast("float") if i.score else self.find(i.column)[1]).alias(n) for i, n in zip(items, names, strict=True)]
        order = self.order(items)
        ties = [F.col(f"`{x.prefix}{x.table.key.name}`").asc() for x in self.sides]
        if s.match and not order:
            order = [F.desc(SCORE)]
        elif s.similar and not order:
            order = [F.asc(DIST)]
        if order:
            df = df.orderBy(*order, *ties)
        elif not s.join and self.sides[0].table.organization != "HEAP" and not s.similar:
            df = df.orderBy(*ties)
        if s.limit is not None:
            df = df.limit(s.limit)
        return self.labelled(df.select(*shown), items)

    @staticmethod
    def labelled(df: DataFrame, items: list[Item]) -> DataFrame:
        return df.toDF(*(i.label for i in items))

    def order(self, items: list[Item]) -> list[Column]:
        s = self.s
        if not s.order_by:
            return []
        if s.order_centre is not None:
            d = self.distance(s.order_by, s.order_centre, s.order_metric)
            # Places are told apart by millimetres, vectors by float32.
            key = F.rint(d * 1000) if isinstance(s.order_centre, PointValue) else d.cast("float")
        elif any(i.score and i.label.upper() == s.order_by.upper() for i in items) or (s.order_by.upper() == "SCORE" and (s.match or s.similar)):
            key = F.col(SCORE)
        else:
            c, key = self.find(s.order_by)
            if c.kind in ("POINT", "VECTOR"):
                raise QuernError(f"ORDER BY needs distancia(...) for the {c.kind} column {c.name}")
        return [key.desc() if s.descending else key.asc()]

    def grouped(self, df: DataFrame, items: list[Item]) -> DataFrame:
        s = self.s
        if s.match and s.group_by:
            raise QuernError("MATCH does not go with GROUP BY")
        if s.order_centre is not None:
            raise QuernError("ORDER BY distancia does not go with aggregates")
        key = self.find(s.group_by)[1] if s.group_by else None
        names = [f"__c{k}" for k in range(len(items))]
        aggregates, shown = [], []
        for item, n in zip(items, names, strict=True):
            if item.aggregate:
                aggregates.append(self.aggregate(item).alias(n))
                shown.append((numbers.fixed2(F.col(n)) if item.aggregate == "AVG" else F.col(n)).alias(n))
            else:
                if item.score or key is None or self.find(item.column) [0] is not self.find(s.group_by)[0]:
                    raise QuernError(f"{item.label} is neither grouped nor aggregated")
                shown.append(F.col("__key").alias(n))
        groups = df.groupBy(key.alias("__key")) if key is not None else df.groupBy()
        out = self.watch("group", groups.agg(*aggregates) if aggregates else df.select(key.alias("__key")).distinct())
        out = out.select(*shown, *(["__key"] if key is not None else []))
        if s.order_by:
            n = next((n for i, n in zip(items, names, strict=True) if i.label.upper() == s.order_by.upper()), None)
            if n is None and key is not None and self.find(s.order_by)[0] is self.find(s.group_by)[0]:
                n = "__key"
            if n is None:
                raise QuernError(f"ORDER BY {s.order_by} is neither grouped nor aggregated")
            ties = [F.col("__key").cast("string")] if key is not None else []
            out = out.orderBy(F.col(n).desc() if s.descending else F.col(n).asc(), *ties)
        elif key is not None:  # groups are shown in the order of their text; without LIMIT only what is shown is sorted
            ordered = out.orderBy(F.col("__key").cast("string"))
            if s.limit is None:
                self.shown = self.labelled(ordered.drop("__key"), items)
            else:
                out = ordered
        if s.limit is not None:
            out = out.limit(s.limit)
        return self.labelled(out.drop("__key"), items)
