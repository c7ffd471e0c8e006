"""The pipeline's stages on clashing columns, nulls, repeated rows, long texts and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
KEPT = [name for name, _ in corpus_pipeline.STAGES[:-1]]
CLASH = [
    "_found", "_key", "_gone", "key", "gone", "spans", "_spans", "items", "_items", "hits", "_hits", "place", "node",
    "unit", "hash", "group", "start", "length", "ids", "serial", "offset", "sequence_id", "words", "value", "kept",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ENGLISH = "the quick brown fox jumps over the lazy dog and then runs away from the other animals of the forest number "
GERMAN = "der schnelle braune Fuchs springt über den faulen Hund und läuft dann vor den anderen Tieren des Waldes weg "
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def rows():
    """Documents whose lines share few words, an exact copy, a contaminated one and a long one."""
    found = []
    for i in range(24):
        own = " ".join(word(7919 * i + 104729 * j) for j in range(12))
        found.append((i, f"{(ENGLISH, GERMAN)[i % 2]}{own}", ("en", "de")[i % 2]))
    found.append((30, found[3][1], "de"))
    found.append((31, f"{ITEM} {word(5)}", "en"))
    found.append((32, "\n".join(ENGLISH + " ".join(word(31 * k + 7 * j) for j in range(20)) for k in range(400)), "en"))
    return [(d, t, lang, "web", len(t)) for d, t, lang in found]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([("b1", ITEM)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def clashing(df):
    return df.withColumns({name: F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string")) for name in CLASH})


@pytest.mark.parametrize("name", KEPT)
def test_other_columns_do_not_matter(spark, sf_dir, name):
    plain = spark.createDataFrame(rows(), SCHEMA)
    want = {tuple(r) for r in STAGES[name](spark, plain, sf_dir).select(plain.columns).collect()}
    given = clashing(plain)
    found = STAGES[name](spark, given, sf_dir)
    assert sorted(found.columns) == sorted(given.columns)
    found = found.collect()
    assert {tuple(r[c] for c in plain.columns) for r in found} == want and want
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in found for c in CLASH)


def test_packing_reads_only_id_and_text(spark, sf_dir):
    given = clashing(spark.createDataFrame(rows(), SCHEMA))
    found = STAGES["packing"](spark, given, sf_dir).collect()
    assert {r["doc_id"] for r in found} == {r[0] for r in rows()}
    assert all(r["length"] == len(r["ids"]) for r in found)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, sf_dir, name):
    given = spark.createDataFrame([], SCHEMA)
    found = STAGES[name](spark, given, sf_dir)
    assert found.count() == 0
    assert name == "packing" or sorted(found.columns) == sorted(given.columns)


@pytest.mark.parametrize("name", KEPT)
def test_nulls_and_repeated_rows(spark, sf_dir, name):
    odd = [(40, None, None, None, None), (41, "", "en", None, 0), (42, "12 34", None, "web", 5), (None, ENGLISH + "xyzzy", "en", None, None)]
    again = [rows()[0]] * 3
    found = STAGES[name](spark, spark.createDataFrame([*rows(), *odd, *again], SCHEMA), sf_dir).collect()
    ids = [r["doc_id"] for r in found]
    if name == "language ID":
        assert not {40, 41, 42} & set(ids) and ids.count(0) == 4
    elif name == "line dedup":
        assert not {40, 41} & set(ids) and 42 in ids and 3 in ids and 30 not in ids and ids.count(0) == 4
    elif name == "MinHash near-dedup":
        assert {40, 41, 42} <= set(ids) and 3 in ids and 30 not in ids and ids.count(0) == 4
    else:
        assert {40, 41, 42} <= set(ids) and 31 not in ids and ids.count(0) == 4
