"""A session: statements of the dialect over a database folder or over Parquet tables, with transactions."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.functions.numbers import text_of
from quern.functions.vector import metric_of
from quern.operators import ann
from quern.operators.text_rank import TextIndex, bm25
from quern.plans import explain
from quern.plans.lower import Lowering, Side, native_table
from quern.plans.parser import ColumnDef, PointValue, Statement, VectorValue, parse, split_statements
from quern.sources import csv_files
from quern.sources.catalog import Catalog, Index, Locks, Table
from quern.sources.work import materialize

#: Folders of a snapshot before it is written anew as one.
MOST_FOLDERS = 16
ALLOWED = {"BPLUS": ("INT", "VARCHAR"), "HASH": ("INT", "VARCHAR"), "RTREE": ("POINT",), "SPIMI": ("VARCHAR",), "IVF": ("VECTOR",), "HNSW": ("VECTOR",)}
ORDINARY = ("BPLUS", "HASH", "RTREE")


@dataclass
class Result:
    kind: str
    df: DataFrame | None = None
    message: str = ""
    affected: int = 0
    plan: list[explain.Node] = field(default_factory=list)
    seconds: float = 0.0
    error: str = ""
    shown: DataFrame | None = None  # df in the order in which it is shown, where that costs a sort

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def rows(self) -> list[list]:
        """Values as the dialect shows them: numbers stay numbers, NULL (an aggregate of nothing) is an empty text."""
        if self.df is None:
            return []
        show = lambda v: v if isinstance(v, int) else ("" if v is None else float(text_of(v)) if isinstance(v, float) else text_of(v))
        df = self.df if self.shown is None else self.shown
        return [[show(v) for v in r] for r in df.toDF(*(f"c{i}" for i in range(len(df.columns)))).collect()]

    def to_json(self) -> str:
        if self.error:
            return json.dumps({"ok": False, "error": self.error}, ensure_ascii=False)
        rows = self.rows()
        plan = [{"nodo": n.name, "cond": n.detail, "nivel": n.level, "filas_estimadas": n.rows, "filas_reales": n.actual, "costo": n.cost} for n in self.plan]
        return json.dumps({"ok": True, "tipo": self.kind, "mensaje": self.message, "afectadas": self.affected or len(rows), "tiempo_ms": round(self.seconds * 1000, 3), "columnas": self.columns, "filas": rows, "plan": plan}, ensure_ascii=False)


class Database:
    """A catalog, its locks and its indexes' data; sessions share it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog, self.locks = spark, Catalog(spark, root), Locks()
        self.built: dict[tuple, object] = {}  # index data by (table, index, version)

    def vacuum(self, older_than: float = 3600.0) -> list[str]:
        """Delete folders that no table's snapshot and no index uses and that are older than so many seconds."""
        tables = self.catalog.tables.values()
        used = {f for t in tables for f in t.folders} | {f for t in tables for i in t.indexes for f in i.data.get("folders", [])}
        return self.catalog.vacuum(used, older_than)


class Session:
    def __init__(self, database: Database | SparkSession, parquet_dir: str | None = None):
        self.db = database if isinstance(database, Database) else None
        self.spark = self.db.spark if self.db else database
        self.native: dict[str, tuple[Table, DataFrame]] = {}
        self.parquet_dir = parquet_dir
        self.vectors: dict[str, list[float]] = {}
        self.transaction = 0
        self.staged: dict[str, Table | None] = {}

    # --- tables
    def register_vector(self, file: str, items: list[float]) -> Session:
        """The vector that SIMILAR_TO('file') stands for; extraction from images or audio is the caller's."""
        self.vectors[file] = [float(x) for x in items]
        return self

    def attach(self, name: str, df: DataFrame, key: str | None = None, **indexes: tuple[str, str]) -> Session:
        """Query a DataFrame as a read-only table; indexes: name=(column, kind), for the rules that ask for one."""
        table = native_table(name, df, name)
        if key:
            for c in table.columns:
                c.key = c.name == key
        table.indexes = [Index(n, c, k) for n, (c, k) in indexes.items()]
        self.native[name.upper()] = table, df
        return self

    def table(self, name: str) -> Table:
        if name.upper() in self.staged:
            if (t := self.staged[name.upper()]) is None:
                raise QuernError(f"table {name} does not exist")
            return t
        if name.upper() in self.native:
            return self.native[name.upper()][0]
        if self.parquet_dir and not self.db:
            self.attach(name, self.spark.read.parquet(f"{self.parquet_dir}/{name.lower()}.parquet"))
            return self.native[name.upper()][0]
        if not self.db:
            raise QuernError(f"table {name} does not exist")
        return self.db.catalog.get(name)

    def frame(self, t: Table) -> DataFrame:
        if t.native:
            return self.native[t.name.upper()][1]
        if not t.folders:
            return self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(t.schema).parquet(*t.folders)

    def rows_of(self, t: Table) -> int:
        return t.rows if t.rows >= 0 else self.frame(t).count()

    def size_of(self, t: Table) -> tuple[int, int]:
        """Rows and pages of 4 KiB as the catalog has them; of an attached table as its files' sizes and types suggest."""
        if t.native or t.rows < 0:
            plan = self.frame(t)._jdf
            size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
            return max(1, size // plan.schema().defaultSize()), -(-size // 4096)
        return t.rows, -(-sum(self.db.catalog.files.size(f) for f in t.folders) // 4096)

    def lock(self, name: str, mode: str) -> None:
        if self.db and name.upper() not in self.native:
            try:
                self.db.locks.acquire(self.transaction or self.single, name, mode)
            except QuernError:
                self.rollback()
                raise

    # --- running
    def run(self, script: str) -> list[Result]:
        """All statements of a batch; an error ends it. A transaction left open is rolled back."""
        out = []
        for sql in split_statements(script):
            try:
                out.append(self.execute(sql))
            except QuernError as e:
                out.append(Result("error", error=str(e)))
                break
        if self.transaction:
            self.rollback()
            out.append(Result("rollback", message="the batch ended inside a transaction: rolled back"))
        return out

    def sql(self, sql: str) -> DataFrame:
        """The DataFrame of one query, not yet run."""
        return self.execute(sql).df

    def execute(self, sql: str) -> Result:
        began, s = time.time(), parse(sql)
        if self.transaction and s.kind in ("create_table", "create_from_file", "copy", "create_index", "drop_table"):
            raise QuernError("DDL and COPY are not allowed in a transaction")
        if not self.db and s.kind in ("create_table", "create_from_file", "copy", "create_index", "drop_table", "insert", "delete"):
            raise QuernError("this session reads Parquet tables only: open it on a Database to change one")
        self.single = self.db.locks.begin() if self.db and not self.transaction else 0
        try:
            result = getattr(self, f"do_{s.kind}")(s)
        finally:
            if self.single and self.db:
                self.db.locks.release(self.single)
            self.single = 0
        result.seconds = time.time() - began
        return result

    single = 0

    def publish(self, t: Table, gone: bool = False) -> None:
        """Make a changed table visible: at once, or at COMMIT."""
        t.version += 1
        t.rows = t.rows if t.folders else 0
        if self.transaction:
            self.staged[t.name.upper()] = None if gone else t
        else:
            self.db.catalog.put({t.name.upper(): None if gone else t})

    # --- queries
    def lowering(self, s: Statement) -> Lowering:
        names = [(s.table, s.alias)] + ([(s.join, s.join_alias)] if s.join else [])
        sides = []
        for i, (name, alias) in enumerate(names):
            self.lock(name, "S")
            t = self.table(name)
            if isinstance(s.similar_to, str) and s.similar_to in self.vectors:
                s.similar_to = VectorValue(tuple(self.vectors[s.similar_to]))
            sides.append(Side(t, tuple(x.upper() for x in ((alias,) if alias and s.join else (name, alias)) if x), self.frame(t), f"__{i}_" if s.join else ""))
        return Lowering(s, sides, self.text_scores, self.ann_search)

    def do_select(self, s: Statement) -> Result:
        low = self.lowering(s)
        df = low.select()
        return Result("select", df, shown=low.shown)

    def text_scores(self, t: Table, column: str, query: str, scheme: str) -> DataFrame:
        index = t.index(column, "SPIMI")
        if index is None:
            raise QuernError(f"MATCH needs a SPIMI index on {t.name}.{column}")
        if t.native and scheme == "BM25":
            return bm25(self.frame(t), t.key.name, column, query)
        if not self.db:
            return TextIndex.build(self.frame(t), t.key.name, column).scores(query, scheme)
        return self.built(t, index).scores(query, scheme)

    def built(self, t: Table, index: Index):
        """An index's data for this snapshot of the table: as it was left, brought up to date, or built.

        What is built is noted in the catalog, so another session loads it. A vector index takes over rows that have come
        and masks those that have gone; it is built anew when their share passes `umbral`.
        """
        at = (t.name.upper(), index.name.upper(), tuple(t.folders))
        if at in self.db.built:
            return self.db.built[at]
        data, folder = index.data, self.db.catalog.index_folder(t.name, index.name)
        known = data.get("snapshot") if data else None
        if known != t.folders:
            data = (self.changed(t, index, folder) if known else None) or self.made(t, index, folder)
            data["snapshot"] = list(t.folders)
            self.db.catalog.note(t.name, index.name, data)
        for old in [k for k in self.db.built if k[:2] == at[:2]]:
            del self.db.built[old]
        self.db.built[at] = self.opened(t, index, data)
        return self.db.built[at]

    def made(self, t: Table, index: Index, folder: str) -> dict:
        """Build an index; what the catalog notes of it."""
        df, key, column, o = self.frame(t), t.key.name, t.column(index.column).name, index.options
        if index.kind == "SPIMI":
            TextIndex.build(df, key, column, folder=folder)
            return {"folders": [folder]}
        if index.kind == "IVF":
            ann.Ivf.build(df, key, column, o["metrica"], int(o["nlist"]), folder)
            return {"folders": [folder], "rows": self.rows_of(t), "gone": 0}
        parts = ann.Hnsw.build(df, key, column, o["metrica"], int(o["M"]), int(o["ef_construccion"]), folder).parts
        return {"folders": [folder], "rows": self.rows_of(t), "gone": 0, "parts": parts}

    def opened(self, t: Table, index: Index, data: dict):
        df, key, o = self.frame(t), t.key.name, index.options
        if index.kind == "SPIMI":
            return TextIndex.load(self.spark, data["folders"][0])
        column = t.column(index.column).name
        if index.kind == "IVF":
            found = ann.Ivf.load(df, key, column, o["metrica"], data["folders"][0])
            return found if data["gone"] else replace(found, current=None)
        return ann.Hnsw.load(df, key, column, o["metrica"], data["folders"], data["parts"])

    def changed(self, t: Table, index: Index, folder: str) -> dict | None:
        """Bring a vector index up to date with the table; None if it is to be built anew."""
        if index.kind == "SPIMI":  # lengths and norms of the whole collection change
            return None
        data, key, column = dict(index.data), t.key.name, t.column(index.column).name
        row = lambda folders: self.spark.read.schema(t.schema).parquet(*folders).select(key, column) if folders else self.spark.createDataFrame([], t.schema).select(key, column)
        try:
            before, now = row([f for f in data["snapshot"] if f not in t.folders]), row([f for f in t.folders if f not in data["snapshot"]])
            gone, came = materialize(before.join(now, [key, column], "left_anti").select(key), "gone"), materialize(now.join(before, [key, column], "left_anti").select(key), "came")
        except AnalysisException:  # the old snapshot has been vacuumed
            return None
        n_gone, n_came, limit = gone.count(), came.count(), float(index.options.get("umbral", ann.HNSW_DEFAULTS["umbral"]))
        data["gone"] += n_gone
        # The lists of IVF know a key once: one that comes again means a rebuild. So does growth to more than twice the rows.
        again = index.kind == "IVF" and not came.join(gone, key, "left_semi").isEmpty()
        if again or (index.kind == "IVF" and data["gone"] > limit * data["rows"]) or self.rows_of(t) > 2 * max(1, data["rows"]):
            return None
        new = self.frame(t).join(came, key, "left_semi")
        if index.kind == "IVF":
            if n_came:
                ann.Ivf.load(self.frame(t), key, column, index.options["metrica"], data["folders"][0]).insert(new, data["folders"][0])
            return data
        if n_gone or n_came:
            self.opened(t, index, data).change(new, gone, folder, limit)
            data["folders"] = [*data["folders"], folder]
            if len(data["folders"]) > MOST_FOLDERS:
                return None
        return data

    def ann_search(self, t: Table, index: Index, q: list[float], k: int) -> DataFrame:
        if not t.native and t.name.upper() in self.staged:  # an index knows committed rows only
            t = self.db.catalog.get(t.name)
            index = next(i for i in t.indexes if i.name == index.name)
        key, column, metric, o = t.key.name, t.column(index.column).name, index.options["metrica"], index.options
        if index.kind == "IVF":
            found = self.built(t, index) if self.db and not t.native else ann.Ivf.build(self.frame(t), key, column, metric, int(o["nlist"]))
            return found.search(q, k, int(o["nprobe"]))
        found = self.built(t, index) if self.db and not t.native else ann.Hnsw.build(self.frame(t), key, column, metric, int(o["M"]), int(o["ef_construccion"]))
        return found.search(q, k, int(o["ef_busqueda"]))

    def do_explain(self, s: Statement) -> Result:
        inner = s.inner
        if not s.analyze and inner.kind not in ("select", "delete"):
            raise QuernError("EXPLAIN describes SELECT and DELETE; use EXPLAIN ANALYZE for the rest")
        began = time.time()
        nodes: list[explain.Node] = []
        lines: list[str] = []
        if inner.kind in ("select", "delete"):
            low = self.lowering(inner)
            # The plan comes from the catalog alone: names and types are checked, no index is built, no data is read.
            low.text_scores = lambda *_: self.spark.createDataFrame([], "id long, score double")
            low.ann = lambda t, *_: self.frame(t).limit(0)
            low.select() if inner.kind == "select" else low.filtered(low.sides[0].frame, inner.where)
            tables = [x.table for x in low.sides]
            sizes = [self.size_of(t) for t in tables]
            nodes = explain.plan(inner, tables, [n for n, _ in sizes], [p for _, p in sizes])
        planning = time.time() - began
        done = None
        if s.analyze:
            began = time.time()
            if inner.kind == "select":
                low = self.lowering(inner)
                low.watched = {}
                done = Result("select", low.watch("root", low.select()))
                done.df.write.format("noop").mode("overwrite").save()  # nothing comes to the driver but the counts
                counts = {k: o.get["n"] for k, o in low.watched.items()}
                for n in nodes:
                    n.actual = counts.get(n.part, -1)
                actual = nodes[0].actual = counts["root"]
            else:
                done = getattr(self, f"do_{inner.kind}")(inner)
                actual = done.affected
                if nodes:
                    nodes[0].actual = actual
            lines = [f"Rows: {actual}"]
        text = [x for n in nodes for x in n.lines().split("\n")] + lines + [f"Planning Time: {planning * 1000:.3f} ms"]
        if s.analyze:
            text.append(f"Execution Time: {(time.time() - began) * 1000:.3f} ms")
        if done is not None and done.df is not None:
            text += ["Catalyst:", *done.df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1].strip().split("\n")]
        return Result("explain", self.spark.createDataFrame([(x,) for x in text], "plan string"), plan=nodes)

    # --- catalog
    def do_show_tables(self, s: Statement) -> Result:
        rows = []
        for t in sorted((self.db.catalog.tables if self.db else {}).values(), key=lambda t: t.name.upper()):
            size = sum(self.db.catalog.files.size(f) for f in t.folders)
            names = ([f"PRIMARY({t.key.name})"] if t.organization == "BPLUS" else []) + [f"{i.name}({i.column})" for i in t.indexes]
            rows.append((t.name, t.organization, t.key.name, len(t.columns), self.rows_of(t), -(-size // 4096), size, ", ".join(names), f"{len(t.folders)} folders"))
        df = self.spark.createDataFrame(rows, "tabla string, organizacion string, clave string, columnas int, registros long, paginas long, bytes long, indices string, detalle string")
        return Result("show_tables", df, f"{len(rows)} tables", len(rows))

    def do_describe(self, s: Statement) -> Result:
        t = self.table(s.table)
        rows = []
        for c in t.columns:
            own = ", ".join(f"{i.name} ({i.kind})" for i in t.indexes if i.column.upper() == c.name.upper())
            rows.append((c.name, c.type_text, "PK" if c.key else "", own or ("PRIMARY (BPLUS)" if c.key and t.organization == "BPLUS" else "")))
        return Result("describe", self.spark.createDataFrame(rows, "columna string, tipo string, clave string, indice string"), t.organization, len(rows))

    def new_table(self, name: str, columns: list[ColumnDef], organization: str, key: str) -> Table:
        if name.upper() in self.db.catalog.tables:
            raise QuernError(f"table {name} exists already")
        if len({c.name.upper() for c in columns}) < len(columns):
            raise QuernError("a column name is repeated")
        keys = [c for c in columns if c.key] + [c for c in columns if key and c.name.upper() == key.upper() and not c.key]
        if key and not any(c.name.upper() == key.upper() for c in columns):
            raise QuernError(f"column {key} does not exist in {name}")
        if len(keys) > 1:
            raise QuernError("a table has one primary key")
        if not keys:
            keys = [c for c in columns if c.kind == "INT"][:1]
        if not keys or keys[0].kind != "INT":
            raise QuernError("the primary key must be an INT column")
        keys[0].key = True
        return Table(name, columns, organization)

    def do_create_table(self, s: Statement) -> Result:
        self.lock(s.table, "X")
        self.publish(self.new_table(s.table, s.columns, s.organization, s.key))
        return Result("create_table", message=f"table {s.table} created")

    def add_rows(self, t: Table, df: DataFrame) -> None:
        """Write a new folder of the snapshot, laid out as the table's order and indexes ask for.

        Tables ordered by key are range-partitioned and sorted by it; a heap is sorted by its first BPLUS index, or along a
        space-filling curve over its RTREE column, so that row groups outside a range or a box are skipped. HASH and BPLUS
        columns get Bloom filters, which skip row groups for equality. Beyond MOST_FOLDERS the smaller half becomes one.
        """
        if len(t.folders) >= MOST_FOLDERS:
            small = sorted(t.folders, key=self.db.catalog.files.size)[: MOST_FOLDERS // 2]
            merged = self.spark.read.schema(t.schema).parquet(*small)
            n = merged.count()
            df, t.rows, t.folders = merged.unionByName(df), self.rows_of(t) - n, [f for f in t.folders if f not in small]
        before = self.rows_of(t) if t.folders else 0
        order = None
        if t.organization != "HEAP":
            order = F.col(t.key.name)
        elif index := next((i for i in t.indexes if i.kind in ("BPLUS", "RTREE")), None):
            order = F.col(t.column(index.column).name)
            order = curve(order) if index.kind == "RTREE" else order
        if order is not None:
            df = df.withColumn("__order", order).repartitionByRange("__order").sortWithinPartitions("__order").drop("__order")
        folder = self.db.catalog.folder(t.name)
        hashed = {t.column(i.column).name for i in t.indexes if i.kind in ("HASH", "BPLUS")}
        df.write.options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in hashed}).parquet(folder)
        t.rows = before + self.spark.read.schema(t.schema).parquet(folder).count()
        t.folders = [*t.folders, folder]

    def remove_keys(self, t: Table, gone: DataFrame) -> None:
        """Take rows out by key: only folders that hold one of the keys are written again."""
        key = t.key.name
        gone = gone.select(key)
        held = self.frame(t).select(key, F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1).alias("__folder")).join(gone, key, "left_semi")
        names = {r["__folder"].rsplit("/", 1)[1] for r in held.select("__folder").distinct().collect()}  # at most as many as folders
        touched = [f for f in t.folders if f.rsplit("/", 1)[1] in names]
        if not touched:
            return
        rows = self.spark.read.schema(t.schema).parquet(*touched)
        n = rows.count()
        keep = rows.join(gone, key, "left_anti").select(*(c.name for c in t.columns))
        folders, total = t.folders, self.rows_of(t)
        t.folders, t.rows = [f for f in folders if f not in touched], total - n
        try:
            self.add_rows(t, keep)
        except Exception:
            t.folders, t.rows = folders, total
            raise

    def load(self, t: Table, path: str, names: list[str], whole: bool) -> int:
        """Load a file into t. whole: all or nothing; else the lines before the first bad one stay."""
        lines = csv_files.check(csv_files.rows(self.spark, path, names))
        rows = csv_files.typed(lines, t.columns).persist()
        try:
            if first := rows.where("__bad is not null").orderBy(csv_files.LINE).limit(1).collect():
                raise QuernError(f"column {first[0]['__bad']} has a value that does not fit its type")
            key = t.key.name
            # The first line whose key is taken, by an earlier line or by a stored row.
            first = rows.groupBy(key).agg(F.min(csv_files.LINE).alias("__first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(key, "__first")
            again = rows.join(first, key).where(F.col(csv_files.LINE) > F.col("__first")).agg(F.min(csv_files.LINE)).first()[0]
            taken = rows.join(self.frame(t).select(key), key, "left_semi").agg(F.min(csv_files.LINE)).first()[0]
            bad = min((x for x in (again, taken) if x is not None), default=None)
            good = (rows if bad is None else rows.where(F.col(csv_files.LINE) < bad)).select(*(c.name for c in t.columns))
            if bad is not None and whole:
                raise QuernError(f"the key {key} repeats a value")
            n = good.count()
            if n:
                self.add_rows(t, good)
                self.publish(t)
            if bad is not None:
                raise QuernError(f"the key {key} repeats a value; {n} rows were loaded before it")
            return n
        finally:
            rows.unpersist()
            lines.unpersist()

    def do_create_from_file(self, s: Statement) -> Result:
        self.lock(s.table, "X")
        names = csv_files.identifiers(csv_files.header(self.spark, s.file))
        lines = csv_files.check(csv_files.rows(self.spark, s.file, names))
        columns = csv_files.inferred(lines, names)
        lines.unpersist()
        t = self.new_table(s.table, columns, s.organization, s.key)
        n = self.load(t, s.file, [c.name for c in columns], True)
        for c in s.indexed:
            self.create_index(t, Index(f"{t.name}_{c}".lower(), t.column(c).name, "BPLUS"))
        if not n or s.indexed:
            self.publish(t)
        return Result("create_table", message=f"table {t.name} created with {n} rows", affected=n)

    def do_copy(self, s: Statement) -> Result:
        self.lock(s.table, "X")
        t = self.table(s.table)
        if t.native:
            raise QuernError(f"table {t.name} is read-only")
        names = csv_files.identifiers(csv_files.header(self.spark, s.file))
        if [n.upper() for n in names] != [c.name.upper() for c in t.columns]:
            raise QuernError("the file's header does not match the table's columns")
        whole = not t.folders and not [i for i in t.indexes if i.kind not in ("IVF", "HNSW")]
        n = self.load(t, s.file, [c.name for c in t.columns], whole)
        return Result("copy", message=f"{n} rows loaded", affected=n)

    def do_drop_table(self, s: Statement) -> Result:
        self.lock(s.table, "X")
        t = self.table(s.table)
        if t.native:
            raise QuernError(f"table {t.name} is read-only")
        self.publish(t, gone=True)  # its files wait for Database.vacuum: a DataFrame may still read them
        return Result("drop_table", message=f"table {s.table} dropped")

    def create_index(self, t: Table, index: Index) -> None:
        column = t.column(index.column)
        if column.kind not in ALLOWED[index.kind]:
            raise QuernError(f"a {index.kind} index does not fit the {column.kind} column {column.name}")
        if any(i.name.upper() == index.name.upper() for i in t.indexes):
            raise QuernError(f"index {index.name} exists already")
        own = [i.kind for i in t.indexes if i.column.upper() == column.name.upper()]
        if index.kind in own or (index.kind in ORDINARY and any(k in ORDINARY for k in own)):
            raise QuernError(f"column {column.name} has such an index already")
        t.indexes.append(index)

    def do_create_index(self, s: Statement) -> Result:
        self.lock(s.table, "X")
        t = self.table(s.table)
        options = index_options(s.index_kind, s.options)
        if s.index_kind == "IVF" and self.rows_of(t) < int(options["nlist"]):
            raise QuernError(f"IVF needs at least nlist = {options['nlist']} rows")
        self.create_index(t, Index(s.index, t.column(s.column).name, s.index_kind, options))
        if s.index_kind in ORDINARY and t.folders:  # the rows are laid out anew
            rows, t.folders = self.frame(t), []
            self.add_rows(t, rows)
        self.publish(t)
        return Result("create_index", message=f"index {s.index} created")

    # --- rows
    def value(self, c: ColumnDef, v):
        if c.kind == "INT" and isinstance(v, int) and -(2**31) <= v < 2**31:
            return v
        if c.kind == "FLOAT" and isinstance(v, (int, float)):
            return float(v)
        if c.kind == "VARCHAR" and isinstance(v, str):
            if len(v.encode()) > c.size:
                raise QuernError(f"{c.name} takes {c.size} bytes at most")
            return v
        if c.kind == "POINT" and isinstance(v, PointValue):
            return v.lat_e6, v.lon_e6
        if c.kind == "VECTOR" and isinstance(v, VectorValue):
            if len(v.items) != c.size:
                raise QuernError(f"{c.name} has {c.size} components")
            return list(v.items)
        raise QuernError(f"the value of {c.name} is not {c.type_text}")

    def do_insert(self, s: Statement) -> Result:
        self.lock(s.table, "X")
        t = self.table(s.table)
        if t.native:
            raise QuernError(f"table {t.name} is read-only")
        if len(s.values) != len(t.columns):
            raise QuernError(f"{t.name} has {len(t.columns)} columns, {len(s.values)} values were given")
        row = tuple(self.value(c, v) for c, v in zip(t.columns, s.values, strict=True))
        key = row[t.columns.index(t.key)]
        if not self.frame(t).where(F.col(t.key.name) == key).isEmpty():
            raise QuernError(f"the key {key} exists already in {t.name}")
        self.add_rows(t, self.spark.createDataFrame([row], t.schema).coalesce(1))
        self.publish(t)
        return Result("insert", message="1 row inserted", affected=1)

    def do_delete(self, s: Statement) -> Result:
        self.lock(s.table, "X")
        t = self.table(s.table)
        if t.native:
            raise QuernError(f"table {t.name} is read-only")
        low = Lowering(s, [Side(t, (t.name.upper(),), self.frame(t))])
        gone = low.filtered(low.sides[0].frame, s.where)
        n = gone.count()
        if n:
            self.remove_keys(t, gone)
            self.publish(t)
        return Result("delete", message=f"{n} rows deleted", affected=n)

    # --- transactions
    def do_begin(self, s: Statement) -> Result:
        if self.transaction:
            raise QuernError("a transaction is open already")
        if not self.db:
            raise QuernError("transactions need a database")
        self.transaction = self.db.locks.begin()
        return Result("begin", message=f"transaction {self.transaction}")

    def do_commit(self, s: Statement) -> Result:
        if not self.transaction:
            raise QuernError("no transaction is open")
        if self.staged:
            self.db.catalog.put(self.staged)
        self._close()
        return Result("commit")

    def do_rollback(self, s: Statement) -> Result:
        if not self.transaction:
            raise QuernError("no transaction is open")
        self.rollback()
        return Result("rollback")

    def rollback(self) -> None:
        """Staged snapshots are forgotten; the committed ones were never touched."""
        self._close()

    def _close(self) -> None:
        if self.transaction:
            self.db.locks.release(self.transaction)
        self.transaction, self.staged = 0, {}


def curve(point: Column) -> Column:
    """A place on a space-filling curve: the bits of latitude and longitude in turn, 16 of each."""
    lat, lon = ((point["lat_e6"] + 90_000_000) / 180_000_001 * 65_536).cast("long"), ((point["lon_e6"] + 180_000_000) / 360_000_001 * 65_536).cast("long")

    def spread(x: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF), (8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(mask)
        return x

    return F.shiftleft(spread(lat), 1).bitwiseOR(spread(lon))


def index_options(kind: str, given: list[tuple[str, str]]) -> dict[str, str]:
    """Checked WITH options of an IVF or HNSW index, over their defaults."""
    if kind not in ("IVF", "HNSW"):
        return {}
    out = {k: str(v) for k, v in (ann.IVF_DEFAULTS if kind == "IVF" else ann.HNSW_DEFAULTS).items()} | {"metrica": "COSENO"}
    names, seen = {k.upper(): k for k in out}, set()
    for name, value in given:
        key = names.get(name.upper())
        if key is None:
            raise QuernError(f"unknown option {name}")
        if key in seen:
            raise QuernError(f"option {name} is repeated")
        seen.add(key)
        if key == "metrica":
            out[key] = metric_of(value)
        elif key == "umbral":
            if not re.fullmatch(r"\d+(\.\d+)?", value) or not 0 < float(value) <= 1:
                raise QuernError("umbral is a share above 0")
            out[key] = value
        else:
            if not re.fullmatch(r"\d+", value) or int(value) < 1:
                raise QuernError(f"{name} must be a positive whole number")
            out[key] = value
    return out
