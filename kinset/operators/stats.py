"""Summaries: errors, scaffolds, intervals, percentiles, confusion counts, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.operators import ordered

#: Two-sided 97.5 % points of Student's t for 1 to 30 degrees of freedom (fixed values).
STUDENT_T = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.068657610, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
)

#: The 97.5 % point of the normal distribution.
NORMAL_Z = 1.959963984540054
#: Numerators over 1/n, .., 1/n^4 of the expansion of Student's t by degrees of freedom n.
_z = NORMAL_Z
STUDENT_SERIES = (
    (_z**3 + _z) / 4,
    (5 * _z**5 + 16 * _z**3 + 3 * _z) / 96,
    (3 * _z**7 + 19 * _z**5 + 17 * _z**3 - 15 * _z) / 384,
    (79 * _z**9 + 776 * _z**7 + 1482 * _z**5 - 1920 * _z**3 - 945 * _z) / 92160,
)


def nearest_rank(df: DataFrame, by: list[str], value: str, share_percent: int, name: str) -> DataFrame:
    """The value at rank ceil(share * n) of each group, counted with integers."""
    return ordered.ranks(df, by, value, {}, {name: share_percent})


def error_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation, median, nearest-rank p95, max and 95 % interval of the mean.

    One row gives null for deviation and interval. The interval is not clipped. df is made
    once, as counts of equal values, which everything else reads; groups whose values are all
    null have no row.
    """
    counts = ordered.counted(df, by, value)
    v, n = F.col("__value").cast("double"), F.col("__n")
    first = counts.groupBy(*by).agg(F.sum("__n").alias("n"), (F.sum(v * n) / F.sum("__n")).alias("mae"), F.max("__value").alias("max"))
    # deviations from the mean, which are summed without cancelling
    spread = ordered.attach(counts, first.select(*by, F.col("mae").alias("__mean")), by)
    spread = spread.groupBy(*by).agg(F.sum(n * (v - F.col("__mean")) * (v - F.col("__mean"))).alias("__square"))
    out = ordered.attach(ordered.attach(first, spread, by), ordered.ranks_of_counts(counts, by, {"median": 0.5}, {"p95": 95}), by)
    out = out.withColumn("sample_sd", F.when(F.col("n") > 1, F.sqrt(F.col("__square") / (F.col("n") - 1))))
    margin = 1.96 * F.col("sample_sd") / F.sqrt("n")
    return out.select(*by, "n", "mae", "sample_sd", "median", "max", "p95", (F.col("mae") - margin).alias("ci95_low"), (F.col("mae") + margin).alias("ci95_high"))


def scaffold(summary: DataFrame, groups: DataFrame, category: str, values: tuple[str, ...]) -> DataFrame:
    """Every group with every value of category; what the summary lacks has n = 0."""
    every = groups.distinct().withColumn(category, F.explode(F.array(*map(F.lit, values))))
    return every.join(summary, [*groups.columns, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def binomial_interval(successes: Column, n: Column) -> tuple[Column, Column, Column]:
    """(rate, low, high) clipped to 0..1; null without trials."""
    rate = successes / n
    margin = 1.96 * F.sqrt(rate * (1 - rate) / n)
    some = lambda c: F.when(n > 0, c)
    return some(rate), some(F.greatest(F.lit(0.0), rate - margin)), some(F.least(F.lit(1.0), rate + margin))


def t_interval(df: DataFrame, by: list[str], value: str, beyond: bool = False) -> DataFrame:
    """n, mean, sd and the Student-t interval of groups of 2 to 31 rows.

    Larger groups are an error, or with beyond get t by its expansion in degrees of freedom.
    """
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    point = F.element_at(F.array(*map(F.lit, STUDENT_T)), F.least(F.greatest(F.col("n") - 1, F.lit(1)), F.lit(len(STUDENT_T))).cast("int"))
    v = (F.col("n") - 1).cast("double")
    series = sum((F.lit(c) / v**k for k, c in enumerate(STUDENT_SERIES, 1)), F.lit(NORMAL_Z))
    more = series if beyond else F.raise_error(F.lit("more rows than the table has degrees of freedom")).cast("double")
    t = F.when(F.col("n") > len(STUDENT_T) + 1, more).otherwise(point)
    margin = t * F.col("sd") / F.sqrt("n")
    return out.withColumn("low", F.when(F.col("n") > 1, F.col("mean") - margin)).withColumn("high", F.when(F.col("n") > 1, F.col("mean") + margin))


def outcome(decided: Column, truth: Column) -> Column:
    return F.when(decided & truth, "TP").when(~decided & truth, "FN").when(decided, "FP").otherwise("TN")


def linear_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def residual_gate(df: DataFrame, by: list[str], x: str, y: str, held: float, limit: float = 0.10) -> DataFrame:
    """A line through the medians of y at each x but held, and its relative error there.

    (by.., slope, intercept, r2, points, measured, predicted, residual, gate). The gate is
    PASS where the residual is below limit. A median at held that is missing or not above
    zero, and fewer than two values of x, have residual 1 or no fit and FAIL.
    """
    medians = ordered.ranks(df.where(F.col(x).isNotNull()), [*by, x], y, {"__y": 0.5})
    train = F.col(x) != held
    fit = medians.groupBy(*by).agg(
        F.regr_slope(F.when(train, F.col("__y")), x).alias("slope"),
        F.regr_intercept(F.when(train, F.col("__y")), x).alias("intercept"),
        F.regr_r2(F.when(train, F.col("__y")), x).alias("r2"),
        F.count_if(train).alias("points"),
        F.max(F.when(~train, F.col("__y"))).alias("measured"),
    )
    fit = fit.withColumn("predicted", F.col("slope") * held + F.col("intercept"))
    fit = fit.withColumn("residual", F.when(F.col("measured") > 0, F.abs(F.col("measured") - F.col("predicted")) / F.col("measured")).otherwise(1.0))
    return fit.withColumn("gate", F.when(F.col("residual") < limit, "PASS").otherwise("FAIL"))


def extrapolated(fit: DataFrame, at: float) -> DataFrame:
    """fit with the line's value at a point as extrapolated; null where the gate is not PASS."""
    return fit.withColumn("extrapolated", F.when(F.col("gate") == "PASS", F.col("slope") * at + F.col("intercept")))


def cheapest(df: DataFrame, by: list[str], cost: list[str]) -> DataFrame:
    """The row of least cost of each group, the numbers in cost compared in order.

    Equal rows of the least cost are one; unlike ones are a conflict, and reading it is an
    error. Both ends of the rows at the least cost, the least and the greatest row, are kept
    in one aggregate that sums up before rows move. Rows with a null cost are not candidates;
    null is a value of the other columns like any.
    """
    rest = [c for c in df.columns if c not in cost and c not in by]
    row = F.struct(*[F.col(c) for c in rest])
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cost))
    low = F.min(F.struct(F.struct(*cost).alias("cost"), row.alias("row"))).alias("__low")
    high = F.max(F.struct(F.struct(*[(-F.col(c)).alias(c) for c in cost]).alias("cost"), row.alias("row"))).alias("__high")
    both = rows.groupBy(*by).agg(low, high)
    clash = ~F.col("__low.row").eqNullSafe(F.col("__high.row"))
    name = F.concat(F.lit("unlike rows of least cost in group "), F.to_json(F.struct(*by)))
    one = F.when(clash, F.raise_error(name).cast(both.schema["__low"].dataType)).otherwise(F.col("__low"))
    checked = both.select(*by, one.alias("__one"))
    at = {c: F.col(f"__one.cost.`{c}`") for c in cost} | {c: F.col(f"__one.row.`{c}`") for c in rest}
    return checked.select(*[F.col(c) if c in by else at[c].alias(c) for c in df.columns])


def ordered_digest(df: DataFrame, by: list[str], order: list[str], row: Column) -> DataFrame:
    """SHA-256 over the rows' texts in order, for groups of a bounded size."""
    rows = F.array_sort(F.collect_list(F.struct(*order, row.alias("__row"))))
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["__row"]), "\n"), 256).alias("digest"))
