"""Change logs as streams: each micro-batch becomes one new snapshot of a table.

A change is a row with the table's columns, `op` ('insert' or 'delete') and `seq`, its place in the log. Within a batch
the last change of a key counts. Changed keys are taken out (only folders that hold one are written again) and inserted
rows put in as a folder, so a batch that is applied twice leaves the same table; indexes follow at their next use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.errors import QuernError
from quern.session import Database, Session


def last_changes(changes: DataFrame, key: str) -> DataFrame:
    """The last change of each key: an aggregate, so a key with many changes is reduced before the shuffle."""
    row = F.struct("seq", *(c for c in changes.columns if c != "seq"))
    return changes.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, "seq").alias("r")).select("r.*")


def apply_batch(db: Database, table: str, changes: DataFrame) -> int:
    """Apply a batch; the number of keys that it touches."""
    session = Session(db)
    who = db.locks.begin()
    db.locks.acquire(who, table, "X")
    try:
        t = db.catalog.get(table)
        key, names = t.key.name, [c.name for c in t.columns]
        if missing := {*names, "op", "seq"} - set(changes.columns):
            raise QuernError(f"a change lacks {', '.join(sorted(missing))}")
        last = last_changes(changes, key).persist()
        try:
            if n := last.count():
                fitted = lambda c: F.col(c) if t.column(c).kind in ("VECTOR", "POINT") else F.col(c).cast(t.schema[c].dataType).alias(c)
                rows = last.where("op = 'insert'").select(*map(fitted, names))
                if t.folders:
                    session.remove_keys(t, last.select(F.col(key).cast(t.schema[key].dataType).alias(key)))
                session.add_rows(t, rows)
                session.publish(t)
            return n
        finally:
            last.unpersist()
    finally:
        db.locks.release(who)


def follow(db: Database, table: str, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Start applying a stream of changes; all that is there now, then the query ends."""
    writer = changes.writeStream.foreachBatch(lambda df, _: apply_batch(db, table, df)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
