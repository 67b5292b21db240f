"""Search by postings finds what a scan of the catalog finds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ondine.operators import catalog, postings


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    words = ["Peak", "peaks", "LUFS", "Übergang", "dB/oct", "a", "", "𝄞 clef", "true peak", "  ", "per", "100%", "aaa", "aaaa"]
    made = [(i, draw.choice(words) + " " + draw.choice(words), draw.choice([*words, None])) for i in range(400)] + [(3, "Peak", None)] * 2 + [(900, None, None)]
    return spark.createDataFrame(made, "id int, name string, unit string").repartition(3)


@pytest.mark.parametrize("text", ["peak", "PEAK", "übe", "𝄞 cl", "k t", "aaa", "aaaa", "aaaaa", " lufs", "ea", "a", "", "   ", "nowhere", "0% l", "%", "_"])
def test_postings_find_what_a_scan_finds(rows, text):
    index = postings.indexed(rows, "name", "unit")
    plain = sorted(map(tuple, catalog.matching(rows, text, "name", "unit").collect()), key=repr)
    assert sorted(map(tuple, postings.found(index, text).collect()), key=repr) == plain


def test_hits_are_scored_and_ordered_as_by_a_scan(rows):
    index = postings.indexed(rows, "name", "unit")
    score = catalog.relevance("peak", F.coalesce("name", F.lit("")), unit=F.col("unit"))
    wanted = [(r.score, r.id) for r in catalog.ranked(rows, score, "id").collect()]
    assert [(r.score, r.id) for r in postings.search(index, "peak", score, "id").collect()] == wanted and len(wanted) > 100


def test_a_search_reads_postings_only(rows):
    index = postings.indexed(rows, "name", "unit")
    plan = postings.found(index, "true peak")._jdf.queryExecution().toString()
    assert "EqualTo(run," in plan and "ExistingRDD" not in plan
    assert all("postings" in f for f in postings.found(index, "true peak").inputFiles())


def test_postings_of_nothing(spark, rows):
    index = postings.indexed(rows.limit(0), "name", "unit")
    assert postings.found(index, "peak").count() == 0 and postings.found(index, "").count() == 0
