"""Running sums and maxima over ranges of an order, so that no task holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.sources.scratch import written


def running(rows: DataFrame, values: dict[str, tuple[Callable, str]], order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds a column for each name: the aggregate (such as F.sum or F.max) of a column over the rows before, within `by` if given; null for the first.

    Rows are dealt by ranges of the order and written once; what a range aggregates to is carried to those after it, as one row for each
    range and group. Groups may be of any size: a group that fills many ranges is scanned by as many tasks.
    """
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.unboundedPreceding, -1
    whole = dealt.groupBy("_part", *by).agg(*[f(c).alias(f"_{n}") for n, (f, c) in values.items()])
    across = Window.partitionBy(*by).orderBy("_part").rowsBetween(*earlier)
    base = whole.select("_part", *by, *[f(f"_{n}").over(across).alias(f"_{n}") for n, (f, _) in values.items()])
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(*earlier)
    own = dealt.withColumns({n: f(c).over(within) for n, (f, c) in values.items()})
    keys = [F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_part", *by)]
    joined = own.alias("o").join(base.alias("b"), keys)
    both = [_merged(f, F.col(f"b._{n}"), F.col(f"o.{n}")).alias(n) for n, (f, _) in values.items()]
    return joined.select(*[F.col(f"o.{c}") for c in rows.columns], *both)


def _merged(f: Callable, a: Column, b: Column) -> Column:
    """The aggregate of two aggregates, either of which may be null."""
    if f is F.sum:
        return F.coalesce(a + b, a, b)
    return {F.max: F.greatest, F.min: F.least}[f](a, b)
