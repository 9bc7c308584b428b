"""Source manifests: what a folder of source data says of itself, held against what is expected.

A manifest is a small table of keys and values. It is joined in full with the table of
expected keys, each of which carries the rule for its value, and with the digests of the
inputs that it names; every fault is a row, and all are reported together.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.sources import readers

# Keys whose values are given, keys that must say something, and what says nothing.
STATED = ("schema_version", "dataset", "parsing_schema", "preprocessing_profile")
DESCRIBED = ("dataset_version", "source_url", "citation", "license_or_terms_url", "acquisition_note")
PLACEHOLDERS = ("todo", "tbd", "unknown", "replace-me")

EQUAL, TEXT, PLACE, DIGEST = "equal", "text", "place", "digest"


def expected_keys(spark: SparkSession, stated: dict[str, str], roles: list[tuple[str, str]]) -> DataFrame:
    """(key, rule, want): the keys that a manifest has, and what holds for each value."""
    rows = [(k, EQUAL, stated[k]) for k in STATED] + [(k, TEXT, None) for k in DESCRIBED]
    for i, (role, _) in enumerate(roles):
        rows += [(f"input.{i}.role", EQUAL, role), (f"input.{i}.path", PLACE, None), (f"input.{i}.sha256", DIGEST, None)]
    return spark.createDataFrame(rows, "key string, rule string, want string")


def key_faults(values: DataFrame, expected: DataFrame) -> DataFrame:
    """(key, fault) of (key, value) rows against `expected_keys`."""
    both = values.join(expected, "key", "full")
    value, rule = F.col("value"), F.col("rule")
    empty = F.lower(F.trim(value)).isin("", *PLACEHOLDERS)
    fault = (
        F.when(rule.isNull(), "is not asked for")
        .when(value.isNull(), "is missing")
        .when((rule == EQUAL) & (value != F.col("want")), F.concat(F.lit("should be "), F.col("want")))
        .when((rule == TEXT) & empty, "says nothing")
        .when((rule == DIGEST) & ~value.rlike("^[0-9a-f]{64}$"), "is no SHA-256")
    )
    return both.select("key", fault.alias("fault")).where("fault IS NOT NULL")


def place(folder: Path, path: str) -> Path | None:
    """What a path names below folder; None unless it is the plain spelling of where that really is.

    So there is one rule for links, dots, double and leading slashes: the resolved path must
    be the folder's with the given text behind it.
    """
    root = folder.resolve(strict=True)
    found = (root / path).resolve()
    return found if "\\" not in path and str(found) == f"{root}/{path}" else None


def input_digests(spark: SparkSession, inputs: list[tuple[str, Path, str]]) -> DataFrame:
    """(key, value) with the digest of each (key, path, kind); a folder's is that of its inventory."""
    files = {f"file:{at}": key for key, at, kind in inputs if kind == "file"}
    folders = [(key, readers.tree_digest(readers.inventory(spark, str(at)))) for key, at, kind in inputs if kind != "file"]
    out = spark.createDataFrame(folders, "key string, value string")
    if not files:
        return out
    names = spark.createDataFrame([(path.removeprefix("file:"), key) for path, key in files.items()], "at string, key string")
    read = spark.read.format("binaryFile").load([p.removeprefix("file:") for p in files]).select(F.regexp_replace("path", "^file:/*", "/").alias("at"), F.sha2("content", 256).alias("value"))
    return out.unionByName(read.join(F.broadcast(names), "at").select("key", "value"))


def _demand_none(path: str, faults: DataFrame) -> None:
    found = sorted(f"{r.key} {r.fault}" for r in faults.collect())
    if found:
        raise ValueError(f"{path}: {'; '.join(found)}")


def source_manifest(spark: SparkSession, path: str, stated: dict[str, str], roles: list[tuple[str, str]]) -> tuple[dict[str, str], list[tuple[str, Path]]]:
    """(values, inputs) of a manifest in a local folder, with inputs as (role, path).

    stated gives the values of the keys in STATED, roles the inputs in order as (role, "file"
    or "folder"). All faults of keys are one error, then all of places, then all of digests.
    """
    values = readers.key_values(spark, path)
    table = spark.createDataFrame(list(values.items()), "key string, value string")
    _demand_none(path, key_faults(table, expected_keys(spark, stated, roles)))
    found = [(f"input.{i}.sha256", place(Path(path).parent, values[f"input.{i}.path"]), kind) for i, (_, kind) in enumerate(roles)]
    lost = [values[key.replace("sha256", "path")] for key, at, _ in found if at is not None and not at.exists()]
    if lost:
        raise FileNotFoundError(f"{path}: no {lost}")
    odd = [key for key, at, kind in found if at is None or (at.is_file() if kind == "file" else at.is_dir()) is False]
    if odd:
        raise ValueError(f"{path}: not a plain path below the folder to what the role says: {odd}")
    differ = input_digests(spark, found).join(table.withColumnRenamed("value", "want"), "key").where("value <> want")
    _demand_none(path, differ.select("key", F.concat(F.lit("differs from what is there: "), "value").alias("fault")))
    return values, [(role, at) for (role, _), (_, at, _) in zip(roles, found)]
