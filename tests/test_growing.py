"""Counts that loads are added to, and the search index."""

import random

import pytest
from pyspark.sql import functions as F

from bizlake.operators import bitmaps, search


def _rows(spark, seed, n, members):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([None, *(f"m{k}" for k in members)])) for _ in range(n)
    ]
    return spark.createDataFrame(rows, "g string, h string, m string")


def test_counts_of_two_loads_are_those_of_all_rows(spark):
    first, second = _rows(spark, 1, 300, range(40)), _rows(spark, 2, 200, range(30, 70))
    one = bitmaps.add_load(first, ["g", "h"], "m")
    both = bitmaps.add_load(second, ["g", "h"], "m", one)
    for groups in (["g", "h"], ["g"], []):
        for state, rows in ((one, first), (both, first.unionByName(second))):
            want = rows.groupBy(*groups).agg(F.count_distinct("m").alias("n")).filter("n > 0")
            got = bitmaps.distinct_counts(state, groups, "n")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    numbers = [r.number for r in both.members.collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))
    kept = {r.m: r.number for r in one.members.collect()}
    assert kept.items() <= {r.m: r.number for r in both.members.collect()}.items()


def test_numbers_beyond_one_bitmap_and_empty_loads(spark):
    many = spark.range(70_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("m"))
    state = bitmaps.add_load(many, ["g"], "m")
    assert state.bitmaps.select("bucket").distinct().count() == 3
    again = bitmaps.add_load(many.limit(0), ["g"], "m", state)
    assert [tuple(r) for r in bitmaps.distinct_counts(again, ["g"], "n").orderBy("g").collect()] == [
        (0, 23_334), (1, 23_333), (2, 23_333),
    ]
    assert bitmaps.distinct_counts(bitmaps.add_load(many.limit(0), ["g"], "m"), ["g"], "n").count() == 0


@pytest.fixture(scope="module")
def index(spark):
    names = ["Alfa SRL", "alfa", "BETA srl", None, "", "ab", "a%b_c", "ÀÉÎ Öko", "srl", "s r l", "abcabc"]
    rows = [(k, names[k % len(names)], names[(k * 7) % len(names)], "kept") for k in range(400)]
    df = spark.createDataFrame(rows, "id int, name string, town string, gram string")
    return df, search.build_index(df, ["name", "town"])


@pytest.mark.parametrize("word", ["srl", "ALFA", "b", "", "%b_", "éî ö", "nothing", "abca", "bcabca"])
def test_search_finds_what_a_scan_finds(index, word):
    df, built = index
    low = word.lower()
    want = [tuple(r) for r in df.collect() if any(x is not None and low in x.lower() for x in (r.name, r.town))]
    assert sorted(map(str, map(tuple, search.search(built, word).collect()))) == sorted(map(str, want))


def test_search_reads_less_than_the_scan(spark):
    df = spark.range(5000).select(F.format_string("company %05d", "id").alias("name"))
    built = search.build_index(df, ["name"])
    found = search.search(built, "ANY 0123")
    assert found.count() == 10
    picked = search.candidates(built, "ANY 0123")
    assert picked.count() == 10 and "In(gram" in picked._jdf.queryExecution().executedPlan().toString()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan


def test_postings_list_the_rows_of_a_batch(spark):
    df = spark.range(5000).select(F.format_string("company %05d", "id").alias("name"))
    postings = search.build_index(df, ["name"]).postings()
    # 13 grams a row, 9 of which most rows share
    assert postings.count() < 5000 * 13 / 4
    rows = postings.filter("gram = 'com'").select(F.explode("rows").alias("r"))
    assert rows.count() == rows.distinct().count() == 5000
