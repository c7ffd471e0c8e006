"""The registered queries on whole tables, and the pipeline stage by stage against brute force."""

import os

import duckdb
import pytest
import test_decontaminate
import test_line_dedup
import test_near_duplicates
import test_packing
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from kdframe.llm import registry

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{ROOT}/{name}.parquet')")
    return con


def test_all_operators_are_registered():
    names = set(entry.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))
    assert set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    cursor = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = registry.QUERIES[name](spark, ROOT)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op4_packing", "op11_spelling_variants", "op13_prefix_trie"}))
def test_one_row_per_document(spark, name):
    ids = sorted(r[0] for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in registry.QUERIES[name](spark, ROOT).collect()) == ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").withColumn(
        "text", F.when(F.col("doc_id") == 3, F.lit("12 34")).when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.col("text"))
    )
    items = [tuple(r) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text").collect()]
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    columns = docs.columns
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT).cache()
        if len(out) < 4:
            assert sorted(docs.columns) == sorted(columns)
            rows = docs.collect()
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
            out.append([(r["doc_id"], r["text"]) for r in rows])
    language, lines, near, clean = out
    assert {d for d, _ in given} - {d for d, _ in language} == {3, 4}
    assert sorted(lines) == [(d, t) for d, t, _ in test_line_dedup.brute(language, blocks=False) if t]
    assert sorted(d for d, _ in near) == [d for d, _, c in test_near_duplicates.brute(lines, 5) if d == c]
    judged = {r[0]: r[5] for r in test_decontaminate.brute(near, items)}
    assert sorted(d for d, _ in clean) == sorted(d for d in judged if not judged[d])
    assert not any(r[2] for r in test_decontaminate.brute(clean, items))
    test_packing.check(clean, [r.asDict() for r in docs.collect()])


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, ROOT).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_the_rest_does_not_need_the_corpus_operators():
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('kdframe.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()) and len(e.queries()) > 100\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
