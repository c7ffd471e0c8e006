"""Word counts of all rows, for the order of the rare-word net."""

import numpy as np

from kdframe.llm import line_dedup as ld


def test_words_of_all_rows_are_counted(spark):
    from pyspark.sql import functions as F

    rows = [(i, "alpha beta" if i % 4 else "alpha") for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    keyed = df.select(F.struct("id", F.xxhash64("id", "text").alias("key")).alias("row"), "text")
    got = ld.rarities(keyed)
    slots = [int(h >> np.uint64(32)) % ld.COUNT_SLOTS for h in ld.hashed_words(["alpha beta"])[0]]
    want = np.zeros(ld.COUNT_SLOTS)
    want[slots] = 40, 30
    assert (got == (128 * np.log2(1 + want)).astype(np.uint64)).all()
