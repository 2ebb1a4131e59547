import json

from quern.session import Database, Session
from quern.streaming.changes import apply_batch, follow


def test_change_log_is_applied_once_for_each_key(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    s = Session(db)
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, nombre VARCHAR(10), v VECTOR(2))")
    s.execute("INSERT INTO t VALUES (1, 'a', VECTOR(1, 0))"), s.execute("INSERT INTO t VALUES (2, 'b', VECTOR(0, 1))")
    log = tmp_path / "log"
    log.mkdir()
    changes = [(1, "insert", 3, "c"), (2, "delete", 1, None), (3, "insert", 3, "d"), (4, "insert", 4, "e"), (5, "delete", 4, None)]
    (log / "one.json").write_text("\n".join(json.dumps({"seq": q, "op": op, "id": i, "nombre": n, "v": [0.5, 0.5]}) for q, op, i, n in changes))
    schema = "seq long, op string, id int, nombre string, v array<float>"
    for _ in range(2):  # the second run finds nothing new
        follow(db, "t", spark.readStream.schema(schema).json(f"file://{log}"), f"file://{tmp_path}/checkpoint").awaitTermination()
    want = [[2, "b"], [3, "d"]]
    assert s.execute("SELECT id, nombre FROM t ORDER BY id").rows() == want
    assert apply_batch(db, "t", spark.read.schema(schema).json(f"file://{log}")) == 3
    assert s.execute("SELECT id, nombre FROM t ORDER BY id").rows() == want
