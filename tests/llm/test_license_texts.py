"""Complete licence files, with title and copyright line."""

import pytest

from kdframe.llm import licenses as lc

FULL = sorted(name for name in lc.TEMPLATES if name.endswith("-full"))


def test_complete_files_reach_the_threshold(spark):
    assert {"apache-2.0-full", "bsd-2-clause-full", "bsd-3-clause-full", "gpl-3.0-full", "isc-full", "mit-full", "mpl-2.0-full"} <= set(FULL)
    rows = [(name, f"The {name} License\n\nCopyright (c) 2015 Some Author\n\n{lc.TEMPLATES[name]}") for name in FULL]
    df = spark.createDataFrame(rows, "name string, text string")
    found = {r["name"]: [m for m in r["licenses"] if m["unit"] == 0] for r in lc.find_licenses(df).collect()}
    for name, matches in found.items():
        assert [m["license"] for m in matches] == [name] and matches[0]["dice"] > 0.9


@pytest.mark.parametrize("name, phrase", [("mit-full", "NONINFRINGEMENT"), ("bsd-3-clause-full", "Neither the name"), ("isc-full", "TORTIOUS")])
def test_texts_are_whole(name, phrase):
    assert phrase in lc.TEMPLATES[name]
