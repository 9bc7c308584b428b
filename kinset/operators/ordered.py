"""Running totals and values at ranks over orders of any size.

An order is cut into ranges at approximate quantiles, which become literals. A range is
summed in its own task; what lies before it is a sum over at most one row a range and group.
So neither a group nor the whole order meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinset.sources.workspace import stored

#: Ranges of an order, and the rows up to which one range holds them all.
RANGES, FEW = 256, 10_000


def attach(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the columns of right's row of the same group; null is a group like others.

    right has one row a group, or one row where there is nothing to group by.
    """
    if not by:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({c: f"__by_{i}" for i, c in enumerate(by)})
    same = [left[c].eqNullSafe(renamed[f"__by_{i}"]) for i, c in enumerate(by)]
    return left.join(renamed, same, "left").drop(*[f"__by_{i}" for i in range(len(by))])


def cuts(df: DataFrame, order: str, ranges: int = RANGES, few: int = FEW) -> list:
    """Ascending bounds that part the values into ranges of like size; none for few rows."""
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.count(order).alias("n"), F.percentile_approx(order, shares, 10_000).alias("at")).first()
    return sorted(set(found["at"])) if found["n"] > few else []


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, str], below: str | None = None, ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """df with, for each column and name in sums, name: its sum up to and with the row.

    name + "_all" is the sum of the group, and below, where named, the value before the
    row's. Values of order are distinct in a group; rows without one are left out.
    """
    rows = df.where(F.col(order).isNotNull())
    at = cuts(rows, order, ranges, few)
    if not at:
        group = Window.partitionBy(*by)
        upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        new = {name: F.sum(c).over(upto) for c, name in sums.items()} | {f"{name}_all": F.sum(c).over(group) for c, name in sums.items()}
        return rows.withColumns(new | ({below: F.lag(order).over(group.orderBy(order))} if below else {}))
    rows = rows.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c <= F.col(order))))
    keys = [*by, "__range"]
    within = Window.partitionBy(*keys).orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    new = {name: F.sum(c).over(upto) for c, name in sums.items()}
    if below:
        new[below] = F.lag(order).over(within)
    group = Window.partitionBy(*by)
    ahead = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(F.max(order).alias("__max"), *[F.sum(c).alias(f"__sum_{name}") for c, name in sums.items()])
    befores = [F.coalesce(F.sum(f"__sum_{n}").over(ahead), F.lit(0)).alias(f"__before_{n}") for n in sums.values()]
    wholes = [F.sum(f"__sum_{n}").over(group).alias(f"{n}_all") for n in sums.values()]
    totals = totals.select(*keys, F.lag("__max").over(group.orderBy("__range")).alias("__below"), *befores, *wholes)
    out = attach(rows.withColumns(new) if new else rows, totals, keys)
    out = out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums.values()}) if sums else out
    if below:
        out = out.withColumn(below, F.coalesce(below, "__below"))
    return out.drop("__range", "__below", *[f"__before_{n}" for n in sums.values()])


def ranks(df: DataFrame, by: list[str], value: str, between: dict[str, float], nearest: dict[str, int] | None = None) -> DataFrame:
    """One row a group: values at shares of n - 1 (between, interpolated) and of n (nearest).

    Shares of nearest are percentages, whose rank ceil(share * n / 100) is counted with
    integers. Equal values are counted first, so those of a large group move once. Without
    by there is one row, of nulls where no row has a value.
    """
    return ranks_of_counts(counted(df, by, value), by, between, nearest)


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., __value, __n): how often a group has each value, stored; nulls are left out.

    What reads it more than once, as cuts and the ranks do, does not make df again.
    """
    return stored(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__value")).agg(F.count("*").alias("__n")), "counted")


def ranks_of_counts(counts: DataFrame, by: list[str], between: dict[str, float], nearest: dict[str, int] | None = None) -> DataFrame:
    """`ranks` from what `counted` gives."""
    nearest = nearest or {}
    rows = running(counts, by, "__value", {"__n": "__to"})
    n = F.col("__to_all")

    def at(index: Column) -> Column:
        return F.max(F.when((index >= F.col("__to") - F.col("__n")) & (index < F.col("__to")), F.col("__value")))

    found = [F.max("__to_all").alias("__size")]
    for name, share in between.items():
        place = F.lit(float(share)) * (n - 1)
        found += [at(F.floor(place)).cast("double").alias(f"__low_{name}"), at(F.ceil(place)).cast("double").alias(f"__high_{name}")]
    found += [at(F.ceil(n * percent / 100) - 1).alias(name) for name, percent in nearest.items()]

    def mixed(name: str, share: float) -> Column:
        place = F.lit(float(share)) * (F.col("__size") - 1)
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return rows.groupBy(*by).agg(*found).select(*by, *[mixed(name, s) for name, s in between.items()], *nearest)
