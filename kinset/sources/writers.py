"""Canonical writers: ordered rows, exact text, never over an existing target."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinset.functions import hashing as H
from kinset.operators import validate as V
from kinset.sources import readers

SEAL, SEAL_SUM = "seal.json", "seal.sha256"


def number_text(x: float | None) -> str | None:
    """A double with 17 significant digits; minus zero is zero, non-finite values are errors."""
    if x is None:
        return None
    if not math.isfinite(x):
        raise ValueError("a non-finite number cannot be written")
    return format(x + 0.0 if x else 0.0, ".17g")


@F.pandas_udf(StringType())
def number_column(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else number_text(v))


def table_folder(df: DataFrame, path: str, order: list[str], sep: str = "\t") -> None:
    """Rows in total order as a folder of delimited files; part names keep the order.

    Range partitions are sorted in parallel and never meet in one task.
    """
    V.demand(V.repeated(df, *order), f"{path}: repeated key")
    df.orderBy(*order).write.mode("errorifexists").options(header=True, sep=sep, quote='"', escape='"', nullValue="", emptyValue="").csv(path)


def single_file(df: DataFrame, path: str, order: list[str], sep: str = "\t") -> str:
    """A small, ordered table as one local file, published whole; its SHA-256.

    Written beside the target, flushed, linked under the name (which must be free), and
    read again. For driver-side artefacts; rows stream through one at a time.
    """
    V.demand(V.repeated(df, *order), f"{path}: repeated key")
    h = hashlib.sha256()
    handle, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as out:
            for row in _lines(df.orderBy(*order), sep):
                h.update(row)
                out.write(row)
            out.flush()
            os.fsync(out.fileno())
        with open(part, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != h.hexdigest():
                raise OSError(f"{part} is not what was written")
        os.link(part, path)
    finally:
        os.unlink(part)
    return h.hexdigest()


def _lines(df: DataFrame, sep: str):
    def cell(v: object) -> str:
        s = "" if v is None else number_text(v) if isinstance(v, float) else ",".join(map(str, v)) if isinstance(v, list) else str(v)
        if sep in s or "\n" in s or "\r" in s:
            raise ValueError(f"a cell holds a separator: {s!r}")
        return s

    yield (sep.join(df.columns) + "\n").encode()
    for r in df.toLocalIterator():
        yield (sep.join(map(cell, r)) + "\n").encode()


def manifest(values: dict[str, str], path: str) -> None:
    """A key/value file in the given order of keys, published whole."""
    if os.path.exists(path):
        raise FileExistsError(path)
    body = "key\tvalue\n" + "".join(f"{k}\t{v}\n" for k, v in values.items())
    part = f"{path}.part"
    with open(part, "x", encoding="utf-8", newline="") as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    os.link(part, path)
    os.unlink(part)


def published(spark: SparkSession, path: str, write: Callable[[str], dict[str, str] | None], overwrite: bool = False) -> None:
    """A folder that appears whole or not at all, on any file system that Spark writes to.

    write fills a sibling folder whose name it is given, and may return the SHA-256 of files
    by relative path, which are compared with what was stored. Then the folder is renamed. An
    existing target is an error, or with overwrite is set aside until the new one stands and
    comes back if that fails.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path.rstrip("/"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged, aside = (hadoop.Path(f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    try:
        expected = write(staged.toString()) or {}
        if expected:
            stored = {r.path: r.sha256 for r in readers.inventory(spark, staged.toString()).where(F.col("path").isin(*expected)).collect()}
            wrong = sorted(name for name, digest in expected.items() if stored.get(name) != digest)
            if wrong:
                raise OSError(f"{path}: not what was written: {wrong}")
        replaced = fs.exists(target)
        if replaced and not overwrite:
            raise FileExistsError(path)
        if replaced and not fs.rename(target, aside):
            raise OSError(f"{path} cannot be set aside")
        try:
            # a rename onto a folder that came in between would go into it
            if fs.exists(target) or not fs.rename(staged, target):
                raise OSError(f"{path} cannot be published")
        except BaseException:
            if replaced and not fs.exists(target):
                fs.rename(aside, target)
            raise
        if replaced:
            fs.delete(aside, True)
    finally:
        fs.delete(staged, True)


def sealed(spark: SparkSession, folder: str, facts: dict[str, str] | None = None) -> dict:
    """Seal a local folder: number, bytes and digest of its files, and facts, in two new files.

    A sealed folder is not sealed again.
    """
    for name in (SEAL, SEAL_SUM):
        if os.path.lexists(f"{folder}/{name}"):
            raise FileExistsError(f"{folder}/{name}")
    seal = {"facts": facts or {}} | _state(spark, folder)
    body = json.dumps(seal, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    for name, raw in ((SEAL, body), (SEAL_SUM, f"{H.json_digest(seal)}  {SEAL}\n".encode())):
        with open(f"{folder}/{name}", "xb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
    return seal


def verified(spark: SparkSession, folder: str) -> dict:
    """The seal of a folder whose files, and the seal itself, are as they were sealed."""
    with open(f"{folder}/{SEAL}", "rb") as f:
        body = f.read()
    with open(f"{folder}/{SEAL_SUM}", encoding="ascii") as f:
        if f.read() != f"{hashlib.sha256(body).hexdigest()}  {SEAL}\n":
            raise ValueError(f"{folder}: the seal was changed")
    seal = json.loads(body)
    now = _state(spark, folder)
    changed = [k for k, v in now.items() if seal.get(k) != v]
    if changed:
        raise ValueError(f"{folder}: {', '.join(changed)} changed since it was sealed")
    return seal


def _state(spark: SparkSession, folder: str) -> dict:
    files = readers.inventory(spark, folder).where(~F.col("path").isin(SEAL, SEAL_SUM))
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return {"files": n, "bytes": size, "tree_sha256": readers.tree_digest(files)}


def archived(folder: str, path: str, level: int = 19) -> dict[str, str]:
    """A local folder as one tar file in zstd whose bytes depend on names and contents only.

    The SHA-256 of each file by relative path, as read again from the archive and compared
    with the folder. Links and special files are errors, as is a path that exists.
    """
    import tarfile

    import zstandard

    root = Path(folder)
    found = sorted(root.rglob("*"), key=lambda p: p.relative_to(root).as_posix())
    odd = [str(p) for p in found if p.is_symlink() or not (p.is_file() or p.is_dir())]
    if odd:
        raise ValueError(f"no regular files: {odd}")
    files = {p.relative_to(root).as_posix(): p for p in found if p.is_file()}
    part = f"{path}.part"
    with open(part, "xb") as raw:
        try:
            with zstandard.ZstdCompressor(level=level).stream_writer(raw, closefd=False) as packed, tarfile.open(fileobj=packed, mode="w|", format=tarfile.PAX_FORMAT) as tar:
                for name, source in files.items():
                    entry = tarfile.TarInfo(name)
                    entry.size, entry.mode = source.stat().st_size, 0o644
                    with source.open("rb") as f:
                        tar.addfile(entry, f)
            raw.flush()
            os.fsync(raw.fileno())
            stored = unpacked_digests(part)
            for name, source in files.items():
                with source.open("rb") as f:
                    if stored.get(name) != hashlib.file_digest(f, "sha256").hexdigest():
                        raise OSError(f"{name} is not what was archived")
            os.link(part, path)
        finally:
            os.unlink(part)
    return stored


def unpacked_digests(path: str) -> dict[str, str]:
    """The SHA-256 of each file of a tar file in zstd, read as a stream."""
    import tarfile

    import zstandard

    with open(path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
        return {e.name: hashlib.file_digest(tar.extractfile(e), "sha256").hexdigest() for e in tar if e.isfile()}
