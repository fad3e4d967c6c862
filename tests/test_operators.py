"""Operators on small tables, with the paths for big groups forced."""

import random

from pyspark.sql import functions as F

from bizlake.operators import aggregates, dedup, joins, names, order, shares
from bizlake.plans import participation


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_numbering_matches_a_sort(spark):
    values = random.Random(7).sample(range(100_000), 5_000)
    df = spark.createDataFrame([(v % 3, v) for v in values], "k int, v int")
    numbered = order.number_rows(df.repartition(6), ["k", "v"], "n")
    expected = [(k, v, i) for i, (k, v) in enumerate(sorted((v % 3, v) for v in values), 1)]
    assert rows(numbered, "k", "v", "n") == sorted(expected)


def test_group_numbers_are_the_same_for_large_groups(spark):
    pairs = [(0, i) for i in range(700)] + [(1, i) for i in range(5)] + [(2, 9)]
    df = spark.createDataFrame(pairs, "k int, v int").repartition(5)
    by_window = order.number_in_group(df, ["k"], [F.desc("v")], "n")
    by_range = order.number_in_group(df, ["k"], [F.desc("v")], "n", per_task=4)
    assert rows(by_window, "k", "v", "n") == rows(by_range, "k", "v", "n")
    assert (0, 699, 1) in rows(by_range, "k", "v", "n")


def test_sizes_told_beforehand_change_no_number(spark):
    df = spark.createDataFrame([(0, i) for i in range(40)] + [(1, i) for i in range(5)], "k int, v int").repartition(5)
    told = spark.createDataFrame([(0,)] * 3 + [(1,)] * 9 + [(7,)] * 9 + [(None,)] * 9, "k int")
    want = rows(order.number_in_group(df, ["k"], ["v"], "n"), "k", "v", "n")
    assert rows(order.number_in_group(df, ["k"], ["v"], "n", per_task=4, sizes=told), "k", "v", "n") == want


def test_joined_names_keep_order_and_skip_nulls(spark):
    df = spark.createDataFrame(
        [("p", "b", 2), ("p", "a", 1), ("p", None, 3), ("q", "z", 1)], "k string, v string, n int"
    )
    assert rows(names.join_names(df, "k", {"l": F.col("v")}, ["n"]), "k", "part", "l") == [
        ("p", 0, "a;b"), ("q", 0, "z"),
    ]


def test_long_name_lists_continue_and_lose_nothing(spark):
    df = spark.createDataFrame(
        [("big", f"n{i:04d}", i) for i in range(1_000)] + [("small", "s", 1)],
        "k string, v string, n int",
    ).repartition(5)
    values = {"l": F.col("v"), "odd": F.when(F.col("n") % 2 == 1, F.col("v"))}
    joined = names.join_names(df, "k", values, ["n"], per_cell=64)
    listed = rows(joined, "k", "part", "l")
    odd = sorted((r.part, r.odd) for r in joined.filter("k = 'big'").collect())
    assert ";".join(text for _, text in odd) == ";".join(f"n{i:04d}" for i in range(1, 1_000, 2))
    big = [(part, text) for key, part, text in listed if key == "big"]
    assert max(text.count(";") + 1 for _, text in big) <= 2 * 64
    assert ";".join(text for _, text in sorted(big)) == ";".join(f"n{i:04d}" for i in range(1_000))
    assert ("small", 0, "s") in listed


def test_projects_hold_all_names_of_long_lists(spark):
    people = [("big", f"n{i:04d}", "participant" if i % 2 else "coordinator", i) for i in range(1_000)]
    df = spark.createDataFrame([*people, ("small", "s", "participant", 1)], "k string, v string, role string, n int")
    values = {into: F.when(F.col("role") == role, F.col("v")) for role, into in participation.LISTED_ROLES.items()}
    lists = names.join_names(df.withColumnRenamed("k", "projectID"), "projectID", values, ["n"], per_cell=64)
    project = spark.createDataFrame([("big",), ("small",), ("none",)], "id string")
    cells = {r.id: (r.coordinator, r.participants) for r in participation.add_names(project, lists).collect()}
    listed = lambda start: ";".join(f"n{i:04d}" for i in range(start, 1_000, 2))
    assert cells == {"big": (listed(0), listed(1)), "small": (None, "s"), "none": (None, None)}


def test_first_row_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 5)], "k int, v int")
    first = dedup.keep_first(df, ["k"], ["v"])
    assert rows(first, "k", "v") == [(1, 2), (2, 5)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    below_shuffle = plan.split("Exchange", 1)[1]
    assert "WindowGroupLimit" in below_shuffle and "Partial" in below_shuffle


def test_repeated_keys_see_null_as_a_value(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x")], "k string, v string")
    assert rows(dedup.mark_repeated(df, ["k", "v"], "r"), "r") == [(False,), (True,), (True,)]


def test_conditional_removal_may_drop_a_whole_group(spark):
    df = spark.createDataFrame(
        [("a", 1, True), ("a", 2, True), ("b", 1, True), ("c", 1, False), ("c", 2, True)],
        "k string, n int, away boolean",
    )
    kept = dedup.drop_repeated_when(df, ["k"], F.col("away"))
    assert rows(kept, "k", "n") == [("b", 1), ("c", 1)]


def test_matching_and_parents(spark):
    child = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    parent = spark.createDataFrame([("1",), ("1",)], "k string")
    assert rows(joins.keep_matching(child, parent, "k"), "k") == [("1",)]
    assert joins.drop_matching(child, parent, "k").count() == 2
    flagged = joins.split_by_parent(child, parent, "k")
    assert flagged.count() == 3 and flagged.filter("has_parent").count() == 1


def test_flag_counts_have_margins_and_absent_flags(spark):
    df = spark.createDataFrame([("a", "u"), ("a", "u"), ("b", "u")], "k string, f string")
    assert rows(aggregates.count_by_flag(df, "k", "f", ["s", "u"], "All"), "k", "s", "u", "All") == [
        ("All", 0, 3, 3), ("a", 0, 2, 2), ("b", 0, 1, 1),
    ]


def test_first_nonblank_value(spark):
    df = spark.createDataFrame([("a", "", 1), ("a", "x", 2), ("a", "y", 3), ("b", "", 1)],
                               "k string, v string, n int")
    assert rows(aggregates.first_nonblank(df, "k", {"v": "first"}, ["n"]), "k", "first") == [
        ("a", "x"), ("b", None),
    ]


def test_distinct_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None)], "k string, v int")
    assert rows(aggregates.distinct_per_group(df, ["k"], "v", "n"), "k", "n") == [("a", 2)]


def test_widths_and_shares(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n long")
    assert rows(shares.add_widths(df, {"n": "w"}), "k", "w") == [("a", 100.0), ("b", 33.3)]
    zero = spark.createDataFrame([("a", 0)], "k string, n long")
    assert rows(shares.add_widths(zero, {"n": "w"}), "w") == [(0.0,)]
    shown = shares.top_rows(df, [F.desc("n")], 1)
    assert rows(shares.shares_of_shown(shown, "n"), "k", "pct_of_shown", "slice_start", "slice_end") == [
        ("a", 100.0, 0.0, 100.0)
    ]
