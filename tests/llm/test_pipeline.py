"""Each stage on its own input, and the whole run."""

import corpus_pipeline
from quern.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(docs.columns) < set(out.columns) and 0 < out.count() <= 3 * docs.count()
    assert out.select("shard", "slot").distinct().count() == out.count()


def test_stages_take_odd_rows(spark, table, edges, prose):
    rows = edges + [(100 + i, prose(30 + i, i), "en", f"s{i % 2}") for i in range(12)] + [(200, prose(30, 0), "en", "s0")]
    for docs in (table(rows), table([])):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name in ("language_id", "near_dedup", "decontamination"):
                assert out.columns == docs.columns and len(got) <= n
                clean = {100 + i for i in range(1, 12)} if n else set()
                assert clean <= {r["doc_id"] for r in got}
            if name == "near_dedup" and n:
                assert 200 not in {r["doc_id"] for r in got} and 5 not in {r["doc_id"] for r in got}
            if name == "language_id" and n:
                assert not {1, 2, 3} & {r["doc_id"] for r in got}
            if name == "mixing":
                assert out.columns == docs.columns
            if name == "sharding":
                assert len(got) == n and len({(r["shard"], r["slot"]) for r in got}) == n
