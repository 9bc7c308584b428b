"""Strict readers: exact headers, explicit schemas, no inference; a violation is an error."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kinset.functions import hashing as H
from kinset.functions import text as T
from kinset.operators import validate as V

RECORD_HEADER = ("record_id", "raw_feature_count", "raw_features_csv", "bucketed_feature_count", "bucketed_features_csv")
PAIR_HEADER = ("pair_id", "record_a", "record_b", "pair_kind", "label")
#: Kinds of pairs and the label that each has (fixed values).
LABELS = {"known_match": 1, "sampled_nonmatch": 0, "thread_related": -1, "cross_thread": -1}


def _check_bytes(spark: SparkSession, path: str, header: str) -> None:
    """UTF-8 without BOM, CR or empty lines, a line feed at the end, the exact header."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.decode("content", "UTF-8")
    bad = raw.select(
        "path",
        F.when(F.startswith(F.hex("content"), F.lit("EFBBBF")), "byte order mark")
        .when(F.contains(text, F.lit("\r")), "carriage return")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
        .when(F.contains(text, F.lit("\n\n")) | F.startswith(text, F.lit("\n")), "empty line")
        .when(~F.endswith(text, F.lit("\n")), "no line feed at the end")
        .when(F.substring_index(text, "\n", 1) != header, "other header")
        .alias("fault"),
    ).where("fault IS NOT NULL")
    V.demand(bad, f"{path} breaks the format")


def key_values(spark: SparkSession, path: str) -> dict[str, str]:
    """A two-column manifest: header key and value, exactly one tab a line, unique keys."""
    _check_bytes(spark, path, "key\tvalue")
    lines = [r.value for r in spark.read.text(path).where("value <> 'key\tvalue'").collect()]
    out: dict[str, str] = {}
    for line in lines:
        if line.count("\t") != 1:
            raise ValueError(f"{path}: not one tab: {line!r}")
        key, value = line.split("\t")
        if not key or key in out:
            raise ValueError(f"{path}: empty or repeated key {key!r}")
        out[key] = value
    return out


def delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """A quoted CSV or TSV with an exact header; another header, width or type is an error.

    An empty cell is an empty text, quoted or not.
    """
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST", "enforceSchema": False, "multiLine": sep == ",", "emptyValue": "", "nullValue": "\x00"}
    return spark.read.schema(schema).options(**options).csv(path).na.fill("")


def text_schema(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def bibliographic(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Records id,title,authors,venue,year with record_id = prefix and hexadecimal id."""
    rows = delimited(spark, path, text_schema("id", "title", "authors", "venue", "year"))
    V.demand(rows.where("id IS NULL OR id = ''"), f"{path}: empty id")
    V.demand(V.repeated(rows, "id"), f"{path}: repeated id")
    return rows.withColumn("record_id", H.hex_record_id(F.col("id"), prefix))


def mapping(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Known matches (left, right), one to one, no row twice."""
    rows = delimited(spark, path, text_schema(left, right))
    V.demand(V.repeated(rows, left, right), f"{path}: repeated row")
    V.demand(V.one_to_many(rows, left, right), f"{path}: {left} with several {right}")
    V.demand(V.one_to_many(rows, right, left), f"{path}: {right} with several {left}")
    return rows


def processed_records(spark: SparkSession, path: str, universe: int) -> DataFrame:
    """records.tsv as (record_id, raw_features array<string>, bucketed_features array<bigint>).

    Raw features are unsigned 64-bit, carried as 20-digit texts, which keep their order.
    Counts, order and range are checked.
    """
    _check_bytes(spark, path, "\t".join(RECORD_HEADER))
    rows = delimited(spark, path, text_schema(*RECORD_HEADER), sep="\t")
    raw = F.transform(F.filter(F.split("raw_features_csv", ","), lambda x: x != ""), lambda x: F.lpad(x, 20, "0"))
    bucketed = F.transform(F.filter(F.split("bucketed_features_csv", ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    rows = rows.select("record_id", raw.alias("raw_features"), bucketed.alias("bucketed_features"), F.col("raw_feature_count").cast("int").alias("n_raw"), F.col("bucketed_feature_count").cast("int").alias("n_bucketed"))
    numbers = F.forall("raw_features", lambda x: T.strict_unsigned(F.regexp_replace(x, "^0+(?=.)", "")).isNotNull())
    good = numbers & V.strictly_increasing(F.col("raw_features")) & V.strictly_increasing(F.col("bucketed_features")) & V.size_matches(F.col("raw_features"), F.col("n_raw")) & V.size_matches(F.col("bucketed_features"), F.col("n_bucketed"), universe)
    V.demand(rows.where(~F.coalesce(good, F.lit(False))), f"{path}: unordered, miscounted or out of range")
    V.demand(V.repeated(rows, "record_id"), f"{path}: repeated record")
    return rows.drop("n_raw", "n_bucketed")


def processed_pairs(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """pairs.tsv with labels that fit their kinds and endpoints that exist."""
    _check_bytes(spark, path, "\t".join(PAIR_HEADER))
    rows = delimited(spark, path, text_schema(*PAIR_HEADER), sep="\t").withColumn("label", F.col("label").cast("int"))
    fits = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("pair_kind")) == F.col("label")
    V.demand(V.outside(rows, "pair_kind", tuple(LABELS)), f"{path}: unknown kind")
    V.demand(rows.where(~F.coalesce(fits, F.lit(False))), f"{path}: label against kind")
    V.demand(V.repeated(rows, "pair_id"), f"{path}: repeated pair")
    for side in ("record_a", "record_b"):
        V.demand(V.dangling(rows, records.select(F.col("record_id").alias(side)), side), f"{path}: unknown {side}")
    return rows


def processed(spark: SparkSession, folder: str) -> tuple[dict[str, str], DataFrame, DataFrame]:
    """(manifest, records, pairs) of a folder, with row counts and digests as the manifest says."""
    manifest = key_values(spark, f"{folder}/dataset.manifest.tsv")
    records = processed_records(spark, f"{folder}/records.tsv", int(manifest["universe"]))
    pairs = processed_pairs(spark, f"{folder}/pairs.tsv", records)
    for name, rows in (("records", records), ("pairs", pairs)):
        digest = spark.read.format("binaryFile").load(f"{folder}/{name}.tsv").select(F.sha2("content", 256)).first()[0]
        if digest != manifest[f"{name}_sha256"] or rows.count() != int(manifest[f"{name}_count"]):
            raise ValueError(f"{folder}/{name}.tsv is not what the manifest says")
    return manifest, records, pairs


def all_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all files below a folder; paths are relative.

    Spark's own listing leaves out names that begin with a dot or an underscore. The folder
    is listed once more, by name only, and files that Spark left out are read by name; a
    link or anything else that is no regular file is an error.
    """
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    root = fs.makeQualified(root)
    skip = len(root.toString()) + 1
    listing, left_out = fs.listFiles(root, True), []
    while listing.hasNext():
        status = listing.next()
        if not status.isFile() or status.isSymlink():
            raise ValueError(f"{status.getPath()} is no regular file")
        path = status.getPath().toString()
        if any(part[:1] in "._" for part in path[skip:].split("/")):
            left_out.append(path)
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")
    if left_out:

        def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    source, name = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                    with source.open_input_stream(name, compression=None) as f:
                        raw = f.read()
                    yield pa.record_batch([pa.array([path]), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], names=["path", "length", "content"])

        named = spark.createDataFrame([(p,) for p in left_out], "path string").mapInArrow(contents, "path string, length long, content binary")
        seen = seen.join(named, "path", "left_anti").unionByName(named)
    return seen.withColumn("path", F.substr("path", F.lit(skip + 1)))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder; paths are relative."""
    return all_files(spark, folder).select("path", F.col("length").cast(LongType()).alias("size"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame) -> str:
    """One digest of an inventory, over its lines in order of path."""
    import hashlib

    h = hashlib.sha256()
    for r in files.orderBy("path").toLocalIterator():
        h.update(f"{r.path}\t{r.size}\t{r.sha256}\n".encode())
    return h.hexdigest()


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
