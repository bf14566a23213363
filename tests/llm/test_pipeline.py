import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from hornbeam.llm.common import materialise

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, sample):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"] and P.ORACLE_SQL is None
    docs, seen = sample, []
    for name, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DIR), "test")
        assert docs.columns == COLUMNS
        rows = docs.collect()
        assert all(r.n_chars == len(r.text) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        seen.append({r.doc_id: r.text for r in rows})
    whole = {r.doc_id: r.text for r in sample.collect()}
    assert set(whole) >= set(seen[0]) >= set(seen[1]) >= set(seen[2]) == set(seen[3])
    assert all(seen[0][d] == whole[d] for d in seen[0]) and len(set(seen[2].values())) == len(seen[2])
    assert not any("24be6443" in t for t in seen[3].values())
    packed = P.run(spark, DIR).collect()
    assert {r.doc_id for r in packed} == set(seen[3])


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "a text without an id that is long enough to stay here")]])
def test_little_tables(spark, docs, rows):
    table = docs(rows)
    for _, stage in P.STAGES:
        table = materialise(stage(spark, table, DIR), "test")
    assert table.count() <= len(rows)


def test_last_plans_get_small_batches(spark, docs):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    try:
        for _, stage in P.STAGES:
            spark.conf.set(name, 64 << 20)
            stage(spark, docs([(1, "a text of one line")]), DIR)
            rows = spark.range(64, numPartitions=1).select(F.expr("repeat('a', 1048576)").alias("text"))
            assert rows.select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 16
    finally:
        spark.conf.set(name, before)
