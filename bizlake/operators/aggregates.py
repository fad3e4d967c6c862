"""Aggregates that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def distinct_per_group(df: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Exact number of distinct values per group, nulls not counted.

    Duplicates collapse on (keys, value) first, so a hot group is spread over
    its values.
    """
    return (
        df.filter(F.col(value).isNotNull())
        .select(*keys, value).distinct()
        .groupBy(*keys).agg(F.count(value).alias(into))
    )


def distinct_by_case(
    df: DataFrame, keys: list[str], value: str, cases: dict[str, Column]
) -> DataFrame:
    """Distinct values per group, once for every named condition, in one pass.

    Per (keys, value) it is enough to know whether each condition ever held.
    """
    seen = df.groupBy(*keys, value).agg(
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in cases.items()]
    )
    return seen.groupBy(*keys).agg(*[F.count_if(name).alias(name) for name in cases])


def count_by_flag(df: DataFrame, key: str, flag: str, flags: list[str], total: str) -> DataFrame:
    """Rows per key and flag as columns, with row and column totals.

    Flags are given, so a flag that never occurs is a column of zeros.
    """
    counted = df.groupBy(key).agg(*[F.count_if(F.col(flag) == f).alias(f) for f in flags])
    margin = counted.agg(*[F.sum(f).alias(f) for f in flags]).select(F.lit(total).alias(key), *flags)
    both = counted.unionByName(margin)
    row_total = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return both.withColumn(total, row_total)


def frequencies(df: DataFrame, column: str, into: str = "n") -> DataFrame:
    """How often each non-null value occurs."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(into))


def first_nonblank(
    df: DataFrame, key: str, columns: dict[str, str], order: list[str]
) -> DataFrame:
    """Per key the first value of each column that is not blank: {column: name}.

    Rows are compared by ``order`` inside the aggregate; blank cells do not
    take part, and a key with blank cells only gets null.
    """
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(key).agg(
        *[
            F.min_by(F.col(c), F.when(F.col(c) != "", place)).alias(into)
            for c, into in columns.items()
        ]
    )


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows left after each step, every step also applying the earlier ones.

    One scan: step, position, n_rows.
    """
    passed = F.lit(True)
    counts = []
    for at, (name, condition) in enumerate(steps.items(), 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.struct(
            F.lit(name).alias("step"), F.lit(at).cast("bigint").alias("position"),
            F.count_if(passed).alias("n_rows"),
        ))
    return df.agg(F.array(*counts).alias("steps")).select(F.inline("steps"))
