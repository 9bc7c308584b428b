"""Assertions as queries: each gives the rows or keys that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strictly_increasing(array: Column) -> Column:
    """Whether every element is greater than the one before it."""
    return F.forall(F.zip_with(F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0))), F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), lambda a, b: a < b), lambda x: x)


def size_matches(array: Column, count: Column, universe: int | None = None) -> Column:
    """Whether count is the array's size and, where a universe is given, all elements lie in it."""
    ok = F.size(array) == count
    return ok if universe is None else ok & F.forall(array, lambda x: (x >= 0) & (x < universe))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def dangling(df: DataFrame, known: DataFrame, *key: str) -> DataFrame:
    return df.join(known, list(key), "left_anti")


def outside(df: DataFrame, column: str, values: tuple) -> DataFrame:
    return df.where(~F.col(column).isin(*values))


def one_to_many(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def incomplete(df: DataFrame, key: str, sequence: str, first: int = 0) -> DataFrame:
    """Groups whose sequence is not first, first + 1, .. without gap or repetition."""
    g = df.groupBy(key).agg(F.count(sequence).alias("n"), F.countDistinct(sequence).alias("d"), F.min(sequence).alias("lo"), F.max(sequence).alias("hi"))
    return g.where((F.col("n") != F.col("d")) | (F.col("lo") != first) | (F.col("hi") != F.col("lo") + F.col("n") - 1))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one frame has more often than the other."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def recomputed(stated: DataFrame, again: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys.., field, stated, again): where stated rows and recomputed ones differ.

    Rows that only one frame has differ in the field ``row``. Numbers may differ by tolerance,
    NaN equals NaN, null equals null; all else is compared as text. A repeated key is an error.
    """
    for df in (stated, again):
        demand(repeated(df, *keys), "a key stands twice")
    kinds = dict(stated.dtypes)
    fields = [c for c in stated.columns if c not in keys]
    a, b = (df.select(*keys, F.struct(*fields).alias(name)) for df, name in ((stated, "__stated"), (again, "__again")))
    both = a.join(b, keys, "full")

    def entry(name: str, x: Column, y: Column, wrong: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), x.cast("string").alias("stated"), y.cast("string").alias("again"), wrong.alias("wrong"))

    alone = F.col("__stated").isNull() != F.col("__again").isNull()
    entries = [entry("row", F.col("__stated").isNotNull(), F.col("__again").isNotNull(), alone)]
    for name in fields:
        x, y = F.col("__stated")[name], F.col("__again")[name]
        number = kinds[name] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[name].startswith("decimal")
        far = ~x.eqNullSafe(y) & ~F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= tolerance, F.lit(False)) if number else ~x.cast("string").eqNullSafe(y.cast("string"))
        entries.append(entry(name, x, y, ~alone & far))
    found = both.select(*keys, F.explode(F.filter(F.array(*entries), lambda e: e["wrong"])).alias("e"))
    return found.select(*keys, "e.field", "e.stated", "e.again")


def inconsistent_decisions(rows: DataFrame, score: str, threshold: str, decision: str, margin: float = 1e-12) -> DataFrame:
    """Rows whose decision is not (score >= threshold); within margin of it either will do."""
    s, t, d = F.col(score), F.col(threshold), F.col(decision).cast("boolean")
    bad = s.isNull() | t.isNull() | d.isNull() | F.isnan(s) | F.isnan(t) | (t < 0) | (t > 1)
    return rows.where(bad | ((F.abs(s - t) > margin) & (d != (s >= t))))


def report(**rules: DataFrame) -> DataFrame:
    """(rule, offending): how many rows break each rule."""
    return reduce(DataFrame.unionAll, [rows.agg(F.count("*").alias("offending")).select(F.lit(name).alias("rule"), "offending") for name, rows in rules.items()])


def demand(rows: DataFrame, message: str) -> None:
    """Raise with the first offending rows, if there are any."""
    some = rows.limit(3).collect()
    if some:
        raise ValueError(f"{message}: {some}")
