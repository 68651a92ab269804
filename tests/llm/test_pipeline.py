"""The pipeline's stages, one after another, and the registered queries."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from terrasift.llm.common import written
from terrasift.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if re.match(r"op\d+_", n)) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    extra = docs.unionByName(docs.limit(1).selectExpr("9001L AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")).unionByName(docs.filter("doc_id < 5").withColumn("doc_id", docs["doc_id"] + 9100))
    now, ids = extra, {r.doc_id for r in extra.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        found = written(stage(spark, now, str(DATA)))
        left = {r.doc_id for r in found.select("doc_id").collect()}
        assert left <= ids and found.count() == len(left), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns
        if name == "language id":
            assert ids - left == {9001}
        if name == "exact dedup":
            texts = [r.text for r in found.select("text").collect()]
            assert len(texts) == len(set(texts)) and not any(i > 9099 for i in left)
        now, ids = found, left
    assert "ids" in now.columns and now.count() == corpus_pipeline.run(spark, str(DATA)).count()


def test_stages_decide_by_row(spark, tmp_path):
    """Rows with null or repeated ids go one by one, and nothing goes for want of languages."""
    item = " ".join(f"item{i}" for i in range(20))
    texts = {t: " ".join(f"{t}{i}" for i in range(40)) for t in "abcdef"}
    near = texts["a"] + " end"
    rows = [(1, texts["a"]), (None, texts["a"]), (None, texts["b"]), (None, near), (7, texts["c"]), (7, texts["d"]), (6, texts["d"]), (None, item), (None, texts["e"]), (7, item + " x"), (7, texts["f"])]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = lambda stage: sorted(((r.doc_id or 0, r.text) for r in stage(spark, docs, str(tmp_path)).collect()))
    but = lambda *gone: sorted((i or 0, t) for at, (i, t) in enumerate(rows) if at not in gone)
    assert found(corpus_pipeline.language_stage) == but()
    assert found(corpus_pipeline.exact_stage) == but(1, 5)
    assert {(0, texts["b"]), (0, texts["e"]), (7, texts["c"]), (7, texts["f"])} <= set(found(corpus_pipeline.near_stage))
    assert (0, near) not in found(corpus_pipeline.near_stage)
    assert found(corpus_pipeline.leak_stage) == but(7, 9)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    wanted = con.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    names = wanted.columns
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in wanted.fetchall())
