"""Timing sidecars: one tab-separated file for each cell, read and written as a Spark data source.

A sidecar says whose timings it holds, then gives the samples and, by phase, what sums them up.
Each file is a partition of its own, parsed line by line. Writing is all or nothing: tasks
write below a pending folder, the driver moves the files to their names when all tasks are
done, and a job that fails removes them. Files are never replaced.
"""

from __future__ import annotations

import io
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from kinset.operators import stats
from kinset.operators import validate as V
from kinset.sources.workspace import ship

# Sections, their headers, and the names of kinds and policies.
ABOUT = ("producer_id", "profile_id", "cell_id", "warmup_policy", "expected_measured")
SAMPLE = ("sample", "producer_id", "profile_id", "cell_id", "phase", "sample_kind", "trial_index", "seed", "raw_ms")
AGGREGATE = ("aggregate", "producer_id", "profile_id", "cell_id", "phase", "measured_count", "mean_ms", "sample_sd_ms", "median_ms", "ci95_low_ms", "ci95_high_ms", "format_version")
MEASURED, WARMUP = "measured", "discarded_warmup"
POLICIES = {"none": 0, "discard_one": 1}
NONE, DIGITS = "N/A", "17-digit"
#: The version is ours; another one is an option of the source.
VERSION = "kinset-raw-timing-v1"

SCHEMA = "producer_id string, profile_id string, cell_id string, warmup_policy string, expected_measured bigint, section string, phase string, sample_kind string, trial_index bigint, seed string, raw_ms double, measured_count bigint, mean_ms double, sample_sd_ms double, median_ms double, ci95_low_ms double, ci95_high_ms double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
CELL = ["producer_id", "profile_id", "cell_id"]
SUMMARY = ("mean_ms", "sample_sd_ms", "median_ms", "ci95_low_ms", "ci95_high_ms")


def number(text: str) -> float:
    """A finite number in its 17-digit spelling."""
    value = float(text)
    if not math.isfinite(value) or spelled(value) != text:
        raise ValueError(f"not a number as it is written here: {text!r}")
    return value


def spelled(value: float) -> str:
    return format(value + 0.0, ".17g")


def whole(text: str) -> int:
    if not re.fullmatch("0|[1-9][0-9]{0,19}", text):
        raise ValueError(f"not a whole number: {text!r}")
    return int(text)


def parsed(lines: Iterator[str], version: str) -> Iterator[tuple]:
    """The rows of one sidecar, samples then aggregates; any line out of place is an error."""

    def line(*want: str) -> list[str]:
        got = next(lines, None)
        if got is None or not got.endswith("\n"):
            raise ValueError("the file ends early")
        fields = got[:-1].split("\t")
        if want and fields != list(want):
            raise ValueError(f"{fields} where {list(want)} should be")
        return fields

    line("schema_version", version)
    line("artifact_type", "raw_timing_v1")
    about = []
    for key in ABOUT:
        fields = line()
        if len(fields) != 2 or fields[0] != key or not fields[1]:
            raise ValueError(f"{fields} where {key} should be")
        about.append(fields[1])
    cell, head = about[:3], (*about[:4], whole(about[4]))
    line("samples")
    line(*SAMPLE)
    while (fields := line()) != ["aggregates"]:
        if len(fields) != len(SAMPLE) or fields[0] != "sample" or fields[1:4] != cell:
            raise ValueError(f"not a sample of this cell: {fields}")
        yield (*head, "sample", fields[4], fields[5], whole(fields[6]), str(whole(fields[7])), number(fields[8]), *[None] * 6)
    line(*AGGREGATE)
    for text in lines:
        fields = text.removesuffix("\n").split("\t")
        if not text.endswith("\n") or len(fields) != len(AGGREGATE) or fields[0] != "aggregate" or fields[1:4] != cell or fields[-1] != DIGITS:
            raise ValueError(f"not an aggregate of this cell: {fields}")
        yield (*head, "aggregate", fields[4], *[None] * 4, whole(fields[5]), *[None if x == NONE else number(x) for x in fields[6:11]])


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list


def _where(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class SidecarReader(DataSourceReader):
    def __init__(self, path: str, version: str):
        self.path, self.version = path, version

    def partitions(self) -> list[File]:
        fs, root = _where(self.path)
        found = fs.get_file_info(pafs.FileSelector(root))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".tsv") and f.base_name[0] not in "._"]

    def read(self, partition: File) -> Iterator[tuple]:
        fs, _ = _where(self.path)
        with fs.open_input_file(partition.path) as raw:
            try:
                yield from parsed((line.decode() for line in io.BufferedReader(raw)), self.version)
            except (ValueError, UnicodeDecodeError) as e:
                raise ValueError(f"{partition.path}: {e}") from e


class SidecarWriter(DataSourceWriter):
    """Rows come sorted by cell, samples before aggregates."""

    def __init__(self, path: str, version: str):
        self.path, self.version, self.pending = path, version, f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, root = _where(self.path)
        # each attempt of a task has a folder of its own
        folder, files, out, last = f"{root}/{self.pending}/{uuid.uuid4().hex}", [], None, (None, None)
        fs.create_dir(folder, recursive=True)
        for row in rows:
            r = dict(zip(COLUMNS, row))
            cell = [r[c] for c in CELL]
            if cell != last[0]:
                if out:
                    out.close()
                name = "__".join(re.sub("[^A-Za-z0-9_.-]", "_", c) for c in cell) + ".tsv"
                files.append((f"{folder}/{name}", f"{root}/{name}"))
                out = fs.open_output_stream(files[-1][0])
                self._line(out, "schema_version", self.version)
                self._line(out, "artifact_type", "raw_timing_v1")
                for key in ABOUT:
                    self._line(out, key, str(r[key]))
                last = (cell, None)
            if r["section"] != last[1]:
                self._line(out, r["section"] + "s")
                self._line(out, *(SAMPLE if r["section"] == "sample" else AGGREGATE))
                last = (cell, r["section"])
            if r["section"] == "sample":
                self._line(out, "sample", *cell, r["phase"], r["sample_kind"], str(r["trial_index"]), r["seed"], spelled(r["raw_ms"]))
            else:
                self._line(out, "aggregate", *cell, r["phase"], str(r["measured_count"]), *[NONE if r[c] is None else spelled(r[c]) for c in SUMMARY], DIGITS)
        if out:
            out.close()
        return Written(files)

    @staticmethod
    def _line(out, *fields: str) -> None:
        if any("\t" in f or "\n" in f or not f for f in fields):
            raise ValueError(f"empty, or holds a tab or a line break: {fields}")
        out.write(("\t".join(fields) + "\n").encode())

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _where(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [to for _, to in files]
        there = [i.path for i in fs.get_file_info(names) if i.type != pafs.FileType.NotFound] if names else []
        if there or len(set(names)) < len(names):
            raise ValueError(f"sidecars that are there or would share a name: {there or sorted(n for n in names if names.count(n) > 1)}")
        for made, to in files:
            fs.move(made, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _where(self.path)
        if fs.get_file_info(f"{root}/{self.pending}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.pending}")


class TimingSidecars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timing_sidecars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SidecarReader:
        return SidecarReader(self.options["path"], self.options.get("version", VERSION))

    def writer(self, schema, overwrite: bool) -> SidecarWriter:
        if overwrite:
            raise ValueError("sidecars are not replaced")
        return SidecarWriter(self.options["path"], self.options.get("version", VERSION))


def aggregates(samples: DataFrame) -> DataFrame:
    """(cell.., phase, measured_count, mean_ms, ..): what sums up the measured samples of a phase."""
    by = [*CELL, "phase"]
    measured = samples.where(F.col("sample_kind") == MEASURED)
    t = stats.t_interval(measured, by, "raw_ms", beyond=True).select(*by, F.col("n").alias("measured_count"), F.col("mean").alias("mean_ms"), F.col("sd").alias("sample_sd_ms"), F.col("low").alias("ci95_low_ms"), F.col("high").alias("ci95_high_ms"))
    return t.join(measured.groupBy(*by).agg(F.median("raw_ms").alias("median_ms")), by).select(*by, "measured_count", *SUMMARY)


def write_sidecars(samples: DataFrame, path: str, version: str = VERSION) -> None:
    """Write (cell.., warmup_policy, phase, sample_kind, trial_index, seed, raw_ms) as sidecars.

    Every phase of a cell must have as many measured samples as the others.
    """
    spark = samples.sparkSession
    ship(spark)
    spark.dataSource.register(TimingSidecars)
    summed = aggregates(samples)
    about = summed.groupBy(*CELL).agg(F.max("measured_count").alias("expected_measured")).join(samples.groupBy(*CELL).agg(F.max("warmup_policy").alias("warmup_policy")), CELL)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    rows = samples.drop("warmup_policy").withColumn("section", F.lit("sample")).withColumn("seed", F.col("seed").cast("string"))
    rows = rows.unionByName(summed.withColumn("section", F.lit("aggregate")), allowMissingColumns=True).join(about, CELL)
    rows = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    ordered = rows.repartition(*CELL).sortWithinPartitions(*CELL, F.desc("section"), "phase", "sample_kind", "trial_index")
    ordered.write.format("timing_sidecars").mode("append").option("version", version).save(path)


def read_sidecars(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """All rows of the sidecars in a folder, after `check_sidecars`."""
    ship(spark)
    spark.dataSource.register(TimingSidecars)
    rows = spark.read.format("timing_sidecars").option("version", version).load(path)
    check_sidecars(rows, path)
    return rows


def check_sidecars(rows: DataFrame, path: str) -> None:
    """Raise unless samples are as many as stated, indexed 0, 1, .., finite, and summed up as stated."""
    samples, stated = rows.where("section = 'sample'"), rows.where("section = 'aggregate'")
    by = [*CELL, "phase"]
    kind, index = F.col("sample_kind"), F.col("trial_index")
    measured = kind == MEASURED
    count = samples.groupBy(*by).agg(F.count_if(measured).alias("n"), F.countDistinct(F.when(measured, index)).alias("different"), F.max(F.when(measured, index)).alias("last"), F.count_if((kind == WARMUP) & (index == 0)).alias("warm"), F.count_if(~((measured | (kind == WARMUP)) & (F.col("raw_ms") >= 0) & (~measured | index.isNotNull()))).alias("odd"), F.max("expected_measured").alias("expected"), F.max("warmup_policy").alias("policy"), F.count("*").alias("all"))
    warm: Column = F.create_map(*[F.lit(x) for p in POLICIES.items() for x in p])[F.col("policy")]
    right = (F.col("n") == F.col("expected")) & (F.col("different") == F.col("n")) & (F.col("last") == F.col("n") - 1) & (F.col("warm") == warm) & (F.col("all") == F.col("n") + F.col("warm")) & (F.col("odd") == 0)
    V.demand(count.where(~F.coalesce(right, F.lit(False))), f"{path}: samples are not as stated")
    again = aggregates(samples).select(*by, F.struct("measured_count", *SUMMARY).alias("made"))
    both = stated.select(*by, F.struct("measured_count", *SUMMARY).alias("said")).join(again, by, "full")
    # sums of doubles differ in their last digits by the order of rows
    near = lambda c: F.col(f"said.{c}").eqNullSafe(F.col(f"made.{c}")) | (F.abs(F.col(f"said.{c}") - F.col(f"made.{c}")) <= 1e-9 * (1 + F.abs(F.col(f"made.{c}"))))
    same = F.col("said.measured_count") == F.col("made.measured_count")
    for c in SUMMARY:
        same = same & near(c)
    V.demand(both.where(~F.coalesce(same, F.lit(False))), f"{path}: aggregates are not those of the samples")
