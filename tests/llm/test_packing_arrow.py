"""Groups of remainders are packed on Arrow tables, so that workers hold no pandas frames and no lists of ids."""

from pyspark.sql import functions as F

from kdframe.llm import packing


def test_groups_are_arrow_tables(spark, capsys):
    rows = [(f"d{i}", 0, 700 - i, list(range(i, 700)), 0, 700 - i, i) for i in range(40)] + [(None, 5, 3, [7, 8, 9], 0, 8, 40)]
    kinds = "doc_id string, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, serial long"
    packed = packing.pack(spark.createDataFrame(rows, kinds).repartition(3))
    packed.explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroupsInArrow" in plan and "InPandas" not in plan
    pieces = packed.orderBy("doc_id", "start").collect()
    ids = {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) and p["ids_crc32"] == packing.crc(packing.np.array(p["ids"]))
        ids.setdefault(p["doc_id"], []).extend(p["ids"])
    assert ids == {r[0]: r[3] for r in rows}
    assert min(p["start"] for p in pieces if p["doc_id"] is None) == 5
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 1024 or n != end").isEmpty()


def test_the_slower_library_is_loaded_for_texts_that_need_it(monkeypatch):
    import tokenizers
    from kdframe.llm.registry import tokenizer_files

    definition, ranks = (open(f, "rb").read() for f in tokenizer_files())
    exact, loaded = tokenizers.Tokenizer.from_str(definition.decode()), []

    class Counted:
        @staticmethod
        def from_str(text):
            loaded.append(len(text))
            return exact

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    encode = packing.encoder.__wrapped__(definition, ranks)
    for text in ("", "usual text, 12 words", *special, f"a{special[0]} b" if special else "a"):
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert loaded == []
    for text in ("日本 語", "usual", "한국"):
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert len(loaded) == 1
