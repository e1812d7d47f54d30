"""The pipeline's stages, each on its own input, and the registered queries against DuckDB."""

import re

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen.append((name, before.count(), docs.count()))
        assert docs.columns == columns + ["epoch"] * (name == "mixing")
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert [s[0] for s in seen] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert seen[0][1] == 200 and seen[1][2] < seen[1][1] and seen[3][1] == seen[3][2]
    assert not any(re.search(r"@[a-z0-9]+\.example\.com", r.text) for r in docs.collect())
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries(spark, name):
    df = registry.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark", "conversations"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(registry.ORACLES[name])
        at = [want.columns.index(c) for c in order]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
