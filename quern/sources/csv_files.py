"""CSV files: quoted fields without line breaks in them, blank lines skipped; the header gives the names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QuernError
from quern.plans.parser import ColumnDef

INTEGER = r"^-?[0-9]{1,10}$"
LINE, RAGGED = "__line", "__ragged"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("wholetext", False).text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    if not first:
        raise QuernError(f"{path} is empty")
    schema = "value string"
    row = spark.createDataFrame([(first[0]["value"].rstrip("\r"),)], schema)
    n = len(re.findall(r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", first[0]["value"])) + 1
    cells = row.select(F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(n))), {"quote": '"', "escape": '"'}).alias("r")).first()["r"]
    return [c or "" for c in cells]


def identifiers(names: list[str]) -> list[str]:
    """Names as identifiers; a repeated one gets _ appended."""
    out: list[str] = []
    for name in names:
        x = re.sub(r"\W", "_", name.strip(), flags=re.A) or "_"
        x = f"_{x}" if x[0].isdigit() else x
        while x.upper() in (y.upper() for y in out):
            x += "_"
        out.append(x)
    return out


def rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """All columns as text, the line's rank in file order, and the line itself where its number of fields is another."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RAGGED]])
    lines = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=False, mode="PERMISSIVE", columnNameOfCorruptRecord=RAGGED, emptyValue="", nullValue="\0", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return lines.na.fill("", names).withColumn(LINE, F.monotonically_increasing_id())


def check(df: DataFrame) -> DataFrame:
    """df, read once to see that there are lines and that all have the header's number of fields."""
    df = df.persist()
    first = df.agg(F.count(F.lit(1)).alias("n"), F.min_by(RAGGED, F.when(F.col(RAGGED).isNotNull(), F.col(LINE))).alias("line")).first()
    if not first["n"] or first["line"] is not None:
        df.unpersist()
        raise QuernError("the file has no data rows" if not first["n"] else f"a line has another number of fields than the header: {first['line'][:80]}")
    return df


def is_integer(c: Column) -> Column:
    return c.rlike(INTEGER) & F.coalesce(c.try_cast("long").between(-(2**31), 2**31 - 1), F.lit(False))


def inferred(df: DataFrame, names: list[str]) -> list[ColumnDef]:
    """INT where every value is a whole 32-bit number, else VARCHAR of the largest byte length: one pass over the file."""
    stats = df.agg(*(F.min(is_integer(F.col(n)).cast("int")).alias(f"i{k}") for k, n in enumerate(names)), *(F.max(F.octet_length(n)).alias(f"w{k}") for k, n in enumerate(names))).first()
    return [ColumnDef(n, "INT") if stats[f"i{k}"] == 1 else ColumnDef(n, "VARCHAR", max(1, stats[f"w{k}"] or 0)) for k, n in enumerate(names)]


def micro_degrees(c: Column) -> Column:
    """Whole microdegrees from the digits of a decimal text, never by way of a double."""
    whole, part = F.regexp_extract(c, r"^-?([0-9]+)", 1), F.regexp_extract(c, r"\.([0-9]+)$", 1)
    value = whole.try_cast("long") * 1_000_000 + F.rpad(part, 6, "0").try_cast("long")
    ok = c.rlike(r"^-?[0-9]{1,3}(\.[0-9]{1,6})?$")
    return F.when(ok, F.when(c.startswith("-"), -value).otherwise(value)).cast("int")


def parsed(c: Column, column: ColumnDef) -> tuple[Column, Column]:
    """The typed value of a text, and whether the text is good."""
    if column.kind == "INT":
        return c.try_cast("int"), is_integer(c)
    if column.kind == "FLOAT":
        return c.try_cast("float"), c.rlike(f"^{NUMBER}$") & c.try_cast("float").isNotNull()
    if column.kind == "VARCHAR":
        return c, F.octet_length(c) <= column.size
    if column.kind == "POINT":
        inner = F.trim(F.regexp_replace(c, r"(?i)^\s*POINT\s*\(|\)\s*$", ""))
        parts = F.split(inner, r"\s*,\s*|\s+", -1)
        lat, lon = micro_degrees(F.get(parts, 0)), micro_degrees(F.get(parts, 1))
        good = (F.size(parts) == 2) & lat.between(-90_000_000, 90_000_000) & lon.between(-180_000_000, 180_000_000)
        return F.struct(lat.alias("lat_e6"), lon.alias("lon_e6")), F.coalesce(good, F.lit(False))
    inner = F.trim(F.regexp_replace(c, r"(?i)^\s*(VECTOR\s*\(|\[)|[)\]]\s*$", ""))
    parts = F.split(inner, r"\s*,\s*|\s+", -1)
    value = F.transform(parts, lambda x: x.try_cast("float"))
    good = (F.size(parts) == column.size) & F.forall(parts, lambda x: x.rlike(f"^{NUMBER}$")) & F.forall(value, lambda x: x.isNotNull())
    return value, F.coalesce(good, F.lit(False))


def typed(df: DataFrame, columns: list[ColumnDef]) -> DataFrame:
    """Typed columns, the line and `__bad`: the first column that does not fit, or null."""
    pairs = [parsed(F.col(c.name), c) for c in columns]
    bad = reduce(lambda later, p: F.when(~p[1], F.lit(p[0])).otherwise(later), reversed([(c.name, ok) for c, (_, ok) in zip(columns, pairs, strict=True)]), F.lit(None).cast("string"))
    return df.select(*(v.alias(c.name) for c, (v, _) in zip(columns, pairs, strict=True)), LINE, bad.alias("__bad"))


def preview(spark: SparkSession, path: str, limit: int = 2_000) -> list[dict]:
    """Type, width and uniqueness of each column over the first rows."""
    names = identifiers(header(spark, path))
    df = rows(spark, path, names).limit(limit)  # a preview does not refuse a line
    kinds = inferred(df, names)
    stats = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(n).alias(f"d{k}") for k, n in enumerate(names))).first()
    return [{"name": c.name, "type": c.type_text, "unique": stats[f"d{k}"] == stats["n"]} for k, c in enumerate(kinds)]
