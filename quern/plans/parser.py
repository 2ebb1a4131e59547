"""Statements of the dialect: a token pattern, a table of statement forms and the rules that they name, into dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from quern.errors import QuernError
from quern.functions.vector import metric_of

TOKEN = re.compile(
    r"""\s*(?:(?P<word>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<symbol><=|>=|!=|<>|[()*,=<>;]))""",
    re.X | re.A,
)
# The dialect's words. Aggregates, names of file organizations, of types and of indexes; longest vector.
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
ORGANIZATIONS = {"HEAP": "HEAP", "SEQUENTIAL": "SEQUENTIAL", "SECUENCIAL": "SEQUENTIAL", "BPLUS": "BPLUS", "BPLUS_AGRUPADO": "BPLUS", "AGRUPADO": "BPLUS", "CLUSTERED": "BPLUS"}
TYPES = {"INT": "INT", "INTEGER": "INT", "FLOAT": "FLOAT", "REAL": "FLOAT", "VARCHAR": "VARCHAR", "CHAR": "VARCHAR", "VECTOR": "VECTOR", "POINT": "POINT"}
INDEX_KINDS = {"BPLUS": "BPLUS", "BTREE": "BPLUS", "HASH": "HASH", "RTREE": "RTREE", "SPIMI": "SPIMI", "IVF": "IVF", "HNSW": "HNSW"}
MAX_VECTOR = 512
#: Forms of statements. Words in capitals stand for themselves (| between alternatives, [] around what may be left out);
#: x= is a name and x~ a text for the field x; @x is the rule x of the parser; signs stand for themselves.
FORMS = {
    "select": "SELECT @selection",
    "insert": "INSERT INTO table= VALUES ( @row )",
    "delete": "DELETE FROM table= @deletion",
    "create_table": "CREATE TABLE table= ( @columns ) @layout",
    "create_from_file": "CREATE TABLE table= FROM FILE file~ @layout",
    "create_index": "CREATE INDEX index= ON table= ( column= ) @index_kind",
    "copy": "COPY table= FROM FILE file~",
    "drop_table": "DROP TABLE table=",
    "show_tables": "SHOW TABLES",
    "describe": "DESCRIBE|DESC table=",
    "begin": "BEGIN|START [TRANSACTION]",
    "commit": "COMMIT|END [TRANSACTION]",
    "rollback": "ROLLBACK [TRANSACTION]",
    "explain": "EXPLAIN @explained",
}


@dataclass(frozen=True)
class PointValue:
    lat_e6: int
    lon_e6: int


@dataclass(frozen=True)
class VectorValue:
    items: tuple[float, ...]


@dataclass
class Condition:
    column: str
    op: str  # = != < <= > >= BETWEEN, or INSIDE
    value: Any = None
    upper: Any = None
    centre: PointValue | VectorValue | None = None  # of a distance
    metric: str = ""
    polygon: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Item:
    column: str = ""
    aggregate: str = ""
    score: str = ""  # SCORE or SIMILARITY_SCORE
    alias: str = ""

    @property
    def label(self) -> str:
        if self.alias or self.score:
            return self.alias or "score"
        return f"{self.aggregate}({self.column or '*'})" if self.aggregate else self.column.rpartition(".")[2]


@dataclass
class ColumnDef:
    name: str
    kind: str
    size: int = 0
    key: bool = False

    @property
    def type_text(self) -> str:
        return f"{self.kind}({self.size})" if self.size and self.kind in ("VARCHAR", "VECTOR") else self.kind


@dataclass
class Statement:
    kind: str
    table: str = ""
    alias: str = ""
    columns: list[ColumnDef] = field(default_factory=list)
    organization: str = "HEAP"
    file: str = ""
    key: str = ""
    indexed: list[str] = field(default_factory=list)
    index: str = ""
    index_kind: str = ""
    column: str = ""
    options: list[tuple[str, str]] = field(default_factory=list)
    values: list[Any] = field(default_factory=list)
    star: bool = False
    items: list[Item] = field(default_factory=list)
    join: str = ""
    join_alias: str = ""
    on: tuple[str, str] = ("", "")
    where: list[Condition] = field(default_factory=list)
    match: tuple[str, str] | None = None
    ranking: str = ""
    similar: bool = False
    similar_column: str = ""
    similar_to: VectorValue | str | None = None
    similar_k: int = 10
    similar_metric: str = "COSENO"
    similar_index: str = ""
    candidates: list[int] | None = None
    group_by: str = ""
    order_by: str = ""
    order_centre: PointValue | VectorValue | None = None
    order_metric: str = ""
    descending: bool = False
    limit: int | None = None
    analyze: bool = False
    inner: Statement | None = None
    text: str = ""


def split_statements(script: str) -> list[str]:
    """Statements of a batch: comments (-- to the end of the line) out, cut at ; outside quotes."""
    parts, now = [], ""
    for piece in re.findall(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|;|[^'\";-]+|.", script, re.S):
        if piece == ";":
            parts.append(now)
            now = ""
        elif not piece.startswith("--"):
            now += piece
    return [p.strip() for p in [*parts, now] if p.strip()]


def tokenize(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    sql = sql.rstrip()
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m or m.end() == at:
            rest = sql[at:].lstrip()
            raise QuernError("unclosed text" if rest[:1] in "'\"" else f"unexpected character '{rest[:1]}'")
        kind = m.lastgroup
        value = m[kind]
        if kind == "text":
            value = value[1:-1].replace(value[0] * 2, value[0])
        elif kind == "number" and sql[m.end() : m.end() + 1] == ".":
            raise QuernError(f"malformed number '{value}.'")
        elif value == "<>":
            value = "!="
        out.append((kind, value))
        at = m.end()
    return out


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.at = sql, tokenize(sql), 0

    # --- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def fail(self, what: str):
        raise QuernError(f"{what}, near '{self.peek()[1] or 'the end'}'")

    def is_word(self, *words: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1].upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(f"{word} was expected")

    def symbol(self, s: str) -> bool:
        if self.peek() == ("symbol", s):
            self.at += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not self.symbol(s):
            self.fail(f"'{s}' was expected")

    def name(self, qualified: bool = True) -> str:
        kind, value = self.peek()
        if kind != "word" or ("." in value and not qualified):
            self.fail("a name was expected")
        self.at += 1
        return value

    def take(self, kind: str, what: str) -> str:
        if self.peek()[0] != kind:
            self.fail(f"{what} was expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def integer(self) -> int:
        value = self.take("number", "a whole number")
        if not re.fullmatch(r"-?\d+", value):
            self.fail("a whole number was expected")
        return int(value)

    def calls(self, *names: str) -> bool:
        return self.is_word(*names) and self.peek(1) == ("symbol", "(")

    # --- values
    def degrees(self, most: int) -> int:
        value = self.take("number", "a coordinate")
        m = re.fullmatch(r"(-?)(\d+)(?:\.(\d{1,6}))?", value)
        if not m:
            raise QuernError(f"coordinates have up to 6 decimals and no exponent: {value}")
        e6 = (-1 if m[1] else 1) * (int(m[2]) * 10**6 + int((m[3] or "").ljust(6, "0")))
        if abs(e6) > most * 10**6:
            raise QuernError(f"coordinate out of range: {value}")
        return e6

    def point(self) -> PointValue:
        self.need("(")
        lat = self.degrees(90)
        self.need(",")
        lon = self.degrees(180)
        self.need(")")
        return PointValue(lat, lon)

    def vector(self) -> VectorValue:
        self.need("(")
        items = [self.decimal("a component")]
        while self.symbol(","):
            items.append(self.decimal("a component"))
        self.need(")")
        return VectorValue(tuple(items))

    def decimal(self, what: str) -> float:
        """A number as a float32; one beyond its range is an error."""
        text = self.take("number", what)
        with np.errstate(over="ignore"):
            x = float(np.float32(text))
        if not np.isfinite(x):
            raise QuernError(f"{text} does not fit FLOAT")
        return x

    def value(self):
        kind, value = self.peek()
        if kind == "word":
            if self.calls("POINT"):
                self.at += 1
                return self.point()
            if self.calls("VECTOR"):
                self.at += 1
                return self.vector()
            self.fail("a value was expected")
        if kind not in ("number", "text"):
            self.fail("a value was expected")
        if kind == "number" and not re.fullmatch(r"-?\d+", value):
            return self.decimal("a number")
        self.at += 1
        return value if kind == "text" else int(value)

    def distance(self) -> tuple[str, PointValue | VectorValue, str]:
        self.at += 1
        self.need("(")
        column = self.name()
        self.need(",")
        centre = self.value()
        if not isinstance(centre, (PointValue, VectorValue)):
            self.fail("distancia needs a POINT or a VECTOR")
        metric = "HAVERSINE" if isinstance(centre, PointValue) else "EUCLIDIANA"
        if self.symbol(","):
            given = self.take("text", "a metric")
            if isinstance(centre, PointValue):
                metric = {"HAVERSINE": "HAVERSINE", "GEODESICA": "HAVERSINE", "EUCLIDIANA": "EUCLIDIANA", "EUCLIDEAN": "EUCLIDIANA"}.get(given.upper(), "")
                if not metric:
                    raise QuernError(f"unknown metric '{given}' for points")
            else:
                metric = metric_of(given)
        self.need(")")
        return column, centre, metric

    # --- statements
    def statement(self) -> Statement:
        s = self.one()
        self.symbol(";")
        if self.at < len(self.tokens):
            self.fail("the statement should have ended")
        s.text = self.sql
        return s

    def one(self) -> Statement:
        """A statement by the form that goes furthest with the next tokens; where it ends, its error is the one to tell."""
        reach = {kind: self.reach(form.split()) for kind, form in FORMS.items()}
        kind = max(FORMS, key=lambda k: reach[k])
        if not reach[kind]:
            self.fail("unknown statement")
        s = Statement(kind)
        for part in FORMS[kind].split():
            if part.startswith("@"):
                getattr(self, part[1:])(s)
            elif part.startswith("["):
                self.word(part[1:-1])
            elif part[-1] in "=~" and len(part) > 1:
                setattr(s, part[:-1], self.name(False) if part[-1] == "=" else self.take("text", "a file name"))
            elif part.isalpha() or "|" in part:
                if not self.word(*part.split("|")):
                    self.fail(f"{part} was expected")
            else:
                self.need(part)
        return s

    def reach(self, parts: list[str]) -> int:
        """How many parts of a form the next tokens fit, up to its first rule."""
        for k, part in enumerate(parts):
            kind, value = self.peek(k)
            name = part[-1] in "=~" and len(part) > 1
            fits = (kind == ("word" if part[-1] == "=" else "text")) if name else value.upper() in part.split("|") and kind in ("word", "symbol")
            if part[0] in "@[" or not fits:
                return k
        return len(parts)

    # --- rules of the forms
    def explained(self, s: Statement) -> None:
        s.analyze = self.word("ANALYZE", "ANALYSE")
        s.inner = self.one()
        if s.inner.kind == "explain":
            raise QuernError("EXPLAIN does not explain an EXPLAIN")

    def row(self, s: Statement) -> None:
        s.values = [self.value()]
        while self.symbol(","):
            s.values.append(self.value())

    def deletion(self, s: Statement) -> None:
        if self.word("WHERE"):
            self.where(s)
        if s.match or s.similar:
            raise QuernError("DELETE takes neither MATCH nor SIMILAR_TO")
        self.unqualified(s)

    def organization(self) -> str:
        given = self.name(False).upper()
        if given not in ORGANIZATIONS:
            raise QuernError(f"unknown organization {given}")
        return ORGANIZATIONS[given]

    def layout(self, s: Statement) -> None:
        """USING organization, PRIMARY KEY column and, for a table made from a file, INDEX (columns), in any order."""
        while True:
            if self.word("USING"):
                s.organization = self.organization()
            elif self.word("PRIMARY"):
                self.need_word("KEY")
                s.key = self.name(False)
            elif s.kind == "create_from_file" and self.word("INDEX"):
                self.need("(")
                s.indexed.append(self.name(False))
                while self.symbol(","):
                    s.indexed.append(self.name(False))
                self.need(")")
            else:
                return

    def columns(self, s: Statement) -> None:
        while True:
            column, given = ColumnDef(self.name(False), ""), self.name(False).upper()
            column.kind = TYPES.get(given, "")
            if not column.kind:
                raise QuernError(f"unknown type {given}")
            if column.kind in ("VARCHAR", "VECTOR"):
                self.need("(")
                column.size = self.integer()
                self.need(")")
                if column.size < 1 or (column.kind == "VECTOR" and column.size > MAX_VECTOR):
                    raise QuernError(f"bad size for {given}")
            if self.word("PRIMARY"):
                self.need_word("KEY")
                column.key = True
            s.columns.append(column)
            if not self.symbol(","):
                return

    def index_kind(self, s: Statement) -> None:
        s.index_kind = "BPLUS"
        if self.word("USING"):
            given = self.name(False).upper()
            if given not in INDEX_KINDS:
                raise QuernError(f"unknown index type {given}")
            s.index_kind = INDEX_KINDS[given]
        if self.word("WITH"):
            if s.index_kind not in ("IVF", "HNSW"):
                raise QuernError("WITH is for IVF and HNSW indexes")
            self.need("(")
            while True:
                option = self.name(False)
                self.need("=")
                kind, value = self.peek()
                if kind not in ("word", "number", "text"):
                    self.fail("a value was expected")
                self.at += 1
                s.options.append((option, value))
                if not self.symbol(","):
                    break
            self.need(")")

    def where(self, s: Statement) -> None:
        while True:
            if self.calls("MATCH"):
                self.at += 2
                if s.match:
                    raise QuernError("one MATCH a query")
                column = self.name()
                self.need(",")
                s.match = column, self.take("text", "a text query")
                self.need(")")
            elif self.calls("SIMILAR_TO"):
                self.similar(s)
            elif self.calls("DENTRO"):
                self.at += 2
                column = self.name()
                self.need(",")
                self.need_word("POLYGON")
                self.need("("), self.need("(")
                ring = [(self.degrees(90), self.degrees(180))]
                while self.symbol(","):
                    ring.append((self.degrees(90), self.degrees(180)))
                self.need(")"), self.need(")"), self.need(")")
                if len(ring) < 3:
                    raise QuernError("a polygon has at least 3 corners")
                s.where.append(Condition(column, "INSIDE", polygon=ring))
            elif self.calls("DISTANCIA"):
                column, centre, metric = self.distance()
                op = self.take("symbol", "a comparison")
                if op not in ("<", "<=", ">", ">="):
                    raise QuernError("distancia compares with < <= > >=")
                value = self.integer() if isinstance(centre, PointValue) else self.decimal("a number")
                s.where.append(Condition(column, op, value, centre=centre, metric=metric))
            else:
                column = self.name()
                if self.word("BETWEEN"):
                    low = self.value()
                    self.need_word("AND")
                    s.where.append(Condition(column, "BETWEEN", low, self.value()))
                else:
                    op = self.take("symbol", "a comparison")
                    if op not in ("=", "!=", "<", "<=", ">", ">="):
                        self.fail("a comparison was expected")
                    s.where.append(Condition(column, op, self.value()))
            if not self.word("AND"):
                return

    def similar(self, s: Statement) -> None:
        self.at += 2
        if s.similar:
            raise QuernError("one SIMILAR_TO a query")
        s.similar = True
        if self.peek()[0] == "word" and not self.calls("VECTOR"):
            s.similar_column = self.name()
            self.need(",")
        if self.calls("VECTOR"):
            self.at += 1
            s.similar_to = self.vector()
        else:
            s.similar_to = self.take("text", "a VECTOR or a file name")
            if not s.similar_to:
                raise QuernError("SIMILAR_TO needs a file name")
        if self.symbol(","):
            self.need_word("K")
            self.need("=")
            s.similar_k = self.integer()
            if s.similar_k < 1:
                raise QuernError("k must be positive")
        self.need(")")

    def table_alias(self) -> str:
        if self.word("AS"):
            return self.name(False)
        if self.peek()[0] != "word" or self.is_word("WHERE", "INNER", "JOIN", "ON", "USING", "WITH", "GROUP", "ORDER", "LIMIT"):
            return ""
        return self.name(False)

    def item(self) -> Item:
        if self.calls("SCORE", "SIMILARITY_SCORE"):
            item = Item(score=self.name().upper())
            self.need("("), self.need(")")
        elif self.calls(*AGGREGATES):
            item = Item(aggregate=self.name().upper())
            self.need("(")
            if self.symbol("*"):
                if item.aggregate != "COUNT":
                    raise QuernError("only COUNT takes *")
            else:
                item.column = self.name()
            self.need(")")
        else:
            item = Item(column=self.name())
        if self.word("AS"):
            if not (item.aggregate or item.score):
                raise QuernError("AS is for aggregates and scores")
            item.alias = self.name(False)
        return item

    def selection(self, s: Statement) -> None:
        if self.symbol("*"):
            s.star = True
        else:
            s.items.append(self.item())
        while self.symbol(","):
            s.items.append(self.item())
        self.need_word("FROM")
        s.table, s.alias = self.name(False), self.table_alias()
        if self.is_word("INNER", "JOIN"):
            self.word("INNER")
            self.need_word("JOIN")
            s.join, s.join_alias = self.name(False), self.table_alias()
            self.need_word("ON")
            left = self.name()
            self.need("=")
            s.on = left, self.name()
        if self.word("WHERE"):
            self.where(s)
        if s.match and s.similar:
            raise QuernError("MATCH and SIMILAR_TO do not go together")
        if s.join and (s.match or s.similar):
            raise QuernError("MATCH and SIMILAR_TO do not go with JOIN")
        if self.word("USING"):
            given = self.name(False).upper()
            if given in ("IVF", "HNSW"):
                if not s.similar:
                    raise QuernError(f"USING {given} needs SIMILAR_TO")
                s.similar_index = given
                if self.word("CANDIDATES"):
                    self.need("(")
                    s.candidates = []
                    if not self.symbol(")"):
                        s.candidates.append(self.integer())
                        while self.symbol(","):
                            s.candidates.append(self.integer())
                        self.need(")")
            elif given in ("TF_IDF", "BM25"):
                s.ranking = given
            else:
                raise QuernError("USING takes TF_IDF, BM25, IVF or HNSW")
        if self.word("WITH"):
            self.need_word("METRIC")
            self.need("=")
            if not s.similar:
                raise QuernError("WITH METRIC needs SIMILAR_TO")
            if self.peek()[0] not in ("word", "text"):
                self.fail("a metric was expected")
            s.similar_metric = metric_of(self.peek()[1])
            self.at += 1
        if bool(s.match) != bool(s.ranking):
            raise QuernError("MATCH and USING TF_IDF or BM25 go together")
        for item in s.items:
            if item.score == "SCORE" and not s.match:
                raise QuernError("SCORE() needs MATCH")
            if item.score == "SIMILARITY_SCORE" and not s.similar:
                raise QuernError("SIMILARITY_SCORE() needs SIMILAR_TO")
        if self.word("GROUP"):
            self.need_word("BY")
            s.group_by = self.name()
        if self.word("ORDER"):
            self.need_word("BY")
            if self.calls("DISTANCIA"):
                s.order_by, s.order_centre, s.order_metric = self.distance()
            else:
                s.order_by = self.name()
            s.descending = not self.word("ASC") and self.word("DESC")
        if self.word("LIMIT"):
            s.limit = self.integer()
            if s.limit < 0:
                raise QuernError("LIMIT must not be negative")
        if not s.join:
            self.unqualified(s)

    @staticmethod
    def unqualified(s: Statement) -> None:
        """With one table, t.column and alias.column are its column."""

        def bare(name: str) -> str:
            owner, dot, column = name.partition(".")
            if dot and owner.upper() not in (s.table.upper(), s.alias.upper()):
                raise QuernError(f"table {owner} is not in FROM")
            return column if dot else name

        for x in (*s.items, *s.where):
            x.column = bare(x.column)
        s.group_by, s.order_by, s.similar_column = bare(s.group_by), bare(s.order_by), bare(s.similar_column)
        if s.match:
            s.match = bare(s.match[0]), s.match[1]


def parse(sql: str) -> Statement:
    return Parser(sql).statement()
