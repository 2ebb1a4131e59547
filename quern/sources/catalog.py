"""Catalog of tables as versioned snapshots of Parquet folders, with an atomically replaced manifest; table locks."""

from __future__ import annotations

import copy
import json
import threading
import time
import uuid
from collections import deque
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quern.errors import QuernError
from quern.plans.parser import ColumnDef

POINT = T.StructType([T.StructField("lat_e6", T.IntegerType(), False), T.StructField("lon_e6", T.IntegerType(), False)])
KINDS = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "VARCHAR": T.StringType(), "POINT": POINT, "VECTOR": T.ArrayType(T.FloatType(), False)}


@dataclass
class Index:
    name: str
    column: str
    kind: str
    options: dict[str, str] = field(default_factory=dict)
    #: What is built: the table's folders that it knows, its own folders, and what its kind needs to be loaded again.
    data: dict = field(default_factory=dict)


@dataclass
class Table:
    name: str
    columns: list[ColumnDef]
    organization: str = "HEAP"
    indexes: list[Index] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)  # Parquet folders that make up the current snapshot
    version: int = 0
    native: str = ""  # a read-only Parquet table outside the catalog's folder
    rows: int = -1  # of the current snapshot

    @property
    def key(self) -> ColumnDef | None:
        return next((c for c in self.columns if c.key), None)

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name.upper() == name.upper():
                return c
        raise QuernError(f"column {name} does not exist in {self.name}")

    def index(self, column: str, *kinds: str) -> Index | None:
        return next((i for i in self.indexes if i.column.upper() == column.upper() and i.kind in kinds), None)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, KINDS[c.kind], False, {"dim": c.size} if c.kind == "VECTOR" else None) for c in self.columns])


class Files:
    """Small files in any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.root).toUri(), self.conf)
        self.fs = self.path(self.root).getFileSystem(self.conf)

    def read(self, name: str) -> str | None:
        p = self.path(f"{self.root}/{name}")
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the file, then rename over it."""
        part = self.path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        many = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        many[0] = options.OVERWRITE
        self.context.rename(part, self.path(f"{self.root}/{name}"), many)

    def make(self) -> None:
        self.fs.mkdirs(self.path(self.root))

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength()

    def list(self, folder: str) -> list[tuple[str, float]]:
        """Folders in a folder, with the seconds since they were changed."""
        if not self.fs.exists(self.path(folder)):
            return []
        return [(f.getPath().getName(), time.time() - f.getModificationTime() / 1000) for f in self.fs.listStatus(self.path(folder)) if f.isDirectory()]

    def delete(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


class Catalog:
    """Tables by upper-case name; save() makes a state durable."""

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.root, self.lock = Files(spark, root), root.rstrip("/"), threading.RLock()
        self.text = self.files.read("catalog.json")  # as this process has last seen it
        self.tables = self.parsed(self.text)

    @staticmethod
    def parsed(text: str | None) -> dict[str, Table]:
        out = {}
        for t in json.loads(text) if text else []:
            t["columns"] = [ColumnDef(**c) for c in t["columns"]]
            t["indexes"] = [Index(**i) for i in t["indexes"]]
            out[t["name"].upper()] = Table(**t)
        return out

    def to_json(self) -> str:
        return json.dumps([asdict(t) for t in self.tables.values() if not t.native], indent=1)

    def save(self) -> None:
        self.text = self.to_json()
        self.files.replace("catalog.json", self.text)

    def put(self, staged: dict[str, Table | None]) -> None:
        """Publish changed tables. Locks end at the process: what another one has published meanwhile is taken over, and a
        change of the same table there is an error here."""
        with self.lock:
            text = self.files.read("catalog.json")
            if text != self.text:
                theirs = self.parsed(text)
                state = lambda tables, k: (tables[k].version, tables[k].folders) if k in tables else None
                if clash := [k for k in staged if state(theirs, k) != state(self.tables, k)]:
                    self.text, self.tables = text, theirs
                    raise QuernError(f"{', '.join(clash)} was changed by another process: run the statement again")
                self.tables = theirs
            for k, t in staged.items():
                if t is None:
                    self.tables.pop(k, None)
                else:
                    self.tables[k] = t
            self.save()

    def note(self, table: str, index: str, data: dict) -> None:
        """Remember what has been built of an index; the table itself does not change."""
        with self.lock:
            if (text := self.files.read("catalog.json")) != self.text:
                self.text, self.tables = text, self.parsed(text)
            t = self.tables.get(table.upper())
            if t is not None and (own := next((i for i in t.indexes if i.name.upper() == index.upper()), None)) is not None:
                own.data = data
                self.save()

    def get(self, name: str) -> Table:
        t = self.tables.get(name.upper())
        if t is None:
            raise QuernError(f"table {name} does not exist")
        return copy.deepcopy(t)

    def folder(self, table: str) -> str:
        return f"{self.root}/{table.lower()}/{uuid.uuid4().hex}"

    def index_folder(self, table: str, index: str) -> str:
        """Apart from the tables, so that no table's name can be part of another's index."""
        return f"{self.root}/_indexes/{table.lower()}/{index.lower()}/{uuid.uuid4().hex}"

    def vacuum(self, used: set[str], older_than: float) -> list[str]:
        """Delete folders of snapshots and indexes that are not in use and older than so many seconds."""
        gone = []
        tables = [f"{self.root}/{name}" for name, _ in self.files.list(self.root) if not name.startswith(("_", "."))]
        indexes = [f"{self.root}/_indexes/{t}/{i}" for t, _ in self.files.list(f"{self.root}/_indexes") for i, _ in self.files.list(f"{self.root}/_indexes/{t}")]
        for parent in tables + indexes:
            for name, seconds in self.files.list(parent):
                if f"{parent}/{name}" not in used and seconds >= older_than:
                    self.files.delete(f"{parent}/{name}")
                    gone.append(f"{parent}/{name}")
        return gone


#: Lock events that are remembered.
MOST_EVENTS = 10_000


class Locks:
    """Strict two-phase locks on tables: shared to read, exclusive to write. In a cycle the youngest transaction loses."""

    def __init__(self):
        self.condition, self.held, self.waits, self.lost = threading.Condition(), {}, {}, set()
        self.events: deque[dict] = deque(maxlen=MOST_EVENTS)
        self.last = 0

    def begin(self) -> int:
        with self.condition:
            self.last += 1
            return self.last

    def _log(self, event: str, who: int, table: str = "", mode: str = "") -> None:
        self.events.append({"event": event, "transaction": who, "table": table, "mode": mode})

    def _blockers(self, who: int, table: str, mode: str) -> set[int]:
        return {t for t, m in self.held.get(table, {}).items() if t != who and (mode == "X" or m == "X")}

    def _cycle(self, who: int) -> set[int]:
        """Transactions on a waiting cycle through `who`."""

        def walk(t: int, path: list[int]) -> list[int]:
            for b in self._blockers(t, *self.waits[t]) if t in self.waits else ():
                if b == who:
                    return path
                if b not in path and (found := walk(b, [*path, b])):
                    return found
            return []

        return set(walk(who, [who]))

    def acquire(self, who: int, table: str, mode: str) -> None:
        table = table.upper()
        with self.condition:
            if self.held.get(table, {}).get(who) in ("X", mode):
                return
            while self._blockers(who, table, mode):
                if (table, mode) != self.waits.get(who):
                    self._log("wait", who, table, mode)
                self.waits[who] = table, mode
                if cycle := self._cycle(who):
                    self.lost.add(max(cycle))
                    self._log("deadlock", max(cycle), table, mode)
                    self.condition.notify_all()
                if who in self.lost:
                    self.lost.discard(who)
                    self.waits.pop(who, None)
                    raise QuernError(f"deadlock: transaction {who} is undone")
                self.condition.wait(1.0)
            self.waits.pop(who, None)
            self.held.setdefault(table, {})[who] = mode
            self._log("grant", who, table, mode)

    def release(self, who: int) -> None:
        with self.condition:
            for table in [t for t, h in self.held.items() if who in h]:
                del self.held[table][who]
                self._log("release", who, table)
            self.lost.discard(who)
            self.condition.notify_all()
