"""WARC archives with a two-level capture index.

Archives. Records are gzip members of their own, one for each page, in files of about
``FILE_BYTES`` each; files are written through the file system of the shared folder, named
by the attempt that writes them and renamed when whole. The rows that name a file are stored
by Spark, which keeps those of one attempt: a task that is repeated on another executor, in
another order of rows, leaves a file that nothing names. Of records with equal payloads of at least ``MIN_PAYLOAD``
bytes the one with the least page_id is the response; the others are revisit records that
carry the response's HTTP header (with its length), its digest and its record id.

Index. Captures are sorted by their key, the URL with its host reversed, across files; the
sorted lines are cut into blocks, each a gzip member; a sparse directory holds each block's
first key, file, offset and length. A lookup finds the index files whose keys enclose the
wanted one (a row for each million of captures), searches the directory of such a file by
bisection, reads one block by its range, bisects its lines, and reads the records by their
ranges. Many lookups run alike: wanted keys are dealt out by index file and searched in
order, so a block is read once however many of its keys are wanted.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.llm.common import partitions_for, shared_dir, ship, stored, uri

MIN_PAYLOAD = 100
FILE_BYTES = 64 << 20
#: Lines of an index block.
BLOCK_LINES = 256
#: Bytes between two records that are still read in one range.
READ_GAP = 1 << 16
READ_BYTES = 8 << 20
LEVEL = 1
#: Records that a task reads back, on average.
RECORDS_A_TASK = 16_384
#: Rows (of some 100 bytes) that are broadcast at most.
BROADCAST_ROWS = 100_000

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def host_key(url: str | None) -> str:
    """The URL with its host reversed, lower-cased, without scheme, www and fragment.

    No URL gives the empty key; what is no URL is kept as it is, lower-cased.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host.lower())
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + rest


def _record_id(page_id: object, payload_digest: str) -> str:
    """A name-based id: the same page gives the same id in every attempt."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def _escaped(page_id: object) -> str:
    return quote(str(page_id), safe="!\"#$&'()*+,/:;<=>?@[\\]^`{|}")


def _id(head: dict[str, str], name: str) -> str | None:
    return None if name not in head else unquote(head[name])


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, has_first: bool) -> bytes:
    """One WARC record; has_first says that the payload stands in the record of refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if has_first else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if has_first else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {safe}"] if safe else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    # an id may hold anything; its bytes outside visible ASCII are escaped, so it stays one header's value
    head += [] if page_id is None else [f"WARC-Page-ID: {_escaped(page_id)}"]
    if has_first:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        head += [] if refers_to is None else [f"WARC-Refers-To-Page-ID: {_escaped(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one record; lengths are checked."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not lines[0].startswith("WARC/") or len(rest) != int(head["content-length"]) + 4:
        raise ValueError("not a whole WARC record")
    block = rest[:-4]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Writer:
    """A file of the shared folder that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.name, self.path, self.part = name, f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.out, self.at = self.fs.open_output_stream(self.part, compression=None), 0

    def add(self, data: bytes) -> int:
        """Append; the offset at which data begins."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


_INDEX = "key string, page_id string, file string, offset long, length long, digest string, kind string"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row of pages as a record; the captures' index rows (key, page_id, file, ..).

    A null html is an empty payload, a null url has no target; a null id has none in its
    record and comes last in the choice of a response. Of equal ids and payloads one is the
    response. The result is stored, so the archives are written once.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("long", F.octet_length("payload") >= MIN_PAYLOAD)
    same = rows.where("long").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n").withColumnRenamed("digest", "of")
    size = pages.agg(F.coalesce(F.sum(F.octet_length(html_col)), F.lit(0)), F.count("*")).first()
    files = partitions_for(spark, size[0], FILE_BYTES)
    same = stored(same, "same")
    # payloads that occur twice are sent to all tasks while they are few; else payloads are
    # dealt out by digest, where the planner splits one that a third of the pages share
    few = same.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(same) if few else same, (F.col("digest") == F.col("of")) & F.col("long"), "left")
    run = uuid.uuid4().hex[:8]
    base = uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{run}-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        w, seen = None, set()
        for b in batches:
            out = []
            for r in b.to_pylist():
                w = w or _Writer(base, name)
                again = r["of"] is not None and (r["id"] != r["first"] or (r["id"], r["digest"]) in seen)
                seen |= {(r["id"], r["digest"])} if r["of"] is not None and not again else set()
                data = _gzip(record(r["id"], r["url"], r["payload"], r["digest"], r["first"], again))
                out.append({"key": host_key(r["url"]), "page_id": None if r["id"] is None else str(r["id"]), "file": name, "offset": w.add(data), "length": len(data), "digest": r["digest"], "kind": "revisit" if again else "response"})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in ("key", "page_id", "file", "offset", "length", "digest", "kind")]))
        if w:
            w.close()

    # rows of one id and digest meet in one task, which tells the first of equal ones
    return stored(rows.repartition(files, "id", "digest").mapInArrow(write, _INDEX), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by key into compressed blocks; the sparse directory, one row a block.

    Ranges of keys go to one file each. A key that very many captures share is dealt out
    by page and offset too, so it may span files.
    """
    spark = captures.sparkSession
    base = uri(folder)
    run = uuid.uuid4().hex[:8]
    files = partitions_for(spark, captures.count(), 1_000_000)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{run}-{task.partitionId():06d}-{task.taskAttemptId()}.idx.gz"
        w, part, out = None, [], []

        def flush() -> None:
            data = _gzip("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in part).encode())
            out.append({"first_key": part[0]["key"], "last_key": part[-1]["key"], "file": name, "offset": w.add(data), "length": len(data), "lines": len(part)})
            part.clear()

        for b in batches:
            for r in b.to_pylist():
                w = w or _Writer(base, name)
                part.append(r)
                if len(part) == BLOCK_LINES:
                    flush()
        if part:
            flush()
        if w:
            w.close()
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())]))

    order = ["key", "page_id", "file", "offset"]
    rows = captures.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(write, "first_key string, last_key string, file string, offset long, length long, lines long"), "directory")


class _Sparse:
    """Spans (first key, last key, what they span) in order; neighbours share a key at most."""

    def __init__(self, spans: list[tuple[str, str, object]]):
        self.first, self.last, self.what = ([s[i] for s in spans] for i in range(3))

    def enclosing(self, key: str) -> Iterator[object]:
        """What may hold the key, found by bisection: one span, more where they share the key."""
        at = bisect.bisect_left(self.last, key)
        while at < len(self.first) and self.first[at] <= key:
            yield self.what[at]
            at += 1


class _Blocks:
    """The blocks of one index file, searched by key."""

    def __init__(self, fs: pafs.FileSystem, path: str, rows: list[tuple[str, str, int, int]]):
        """rows: (first key, last key, offset, length) of the file's blocks."""
        self.fs, self.path = fs, path
        rows = sorted(rows, key=lambda r: r[2])
        self.sparse = _Sparse([(first, last, (offset, length)) for first, last, offset, length in rows])
        self.at: object = None
        self.lines: list[dict] = []

    def captures(self, key: str) -> Iterator[dict]:
        """The lines with the key, in order; the last block that was read is kept."""
        for where in self.sparse.enclosing(key):
            if where != self.at:
                text = zlib.decompress(_range(self.fs, self.path, *where), 31).decode()
                self.at, self.lines = where, [json.loads(x) for x in text.splitlines()]
            lo = bisect.bisect_left(self.lines, key, key=lambda r: r["key"])
            while lo < len(self.lines) and self.lines[lo]["key"] == key:
                yield self.lines[lo]
                lo += 1


def _range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def index_files(directory: DataFrame) -> _Sparse:
    """The index files by the keys they span: a row for about a million of captures."""
    rows = directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect()
    return _Sparse(sorted((r["first"], r["last"], r["file"]) for r in rows))


class CaptureIndex:
    """Lookups by URL, one at a time, on the driver; a directory is read file by file."""

    def __init__(self, directory: DataFrame, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri(folder))
        self.directory, self.files = directory, index_files(directory)
        self.open: dict[str, _Blocks] = {}

    def captures(self, url: str) -> list[dict]:
        """Index lines of a URL's captures, in order."""
        key, out = host_key(url), []
        for file in self.files.enclosing(key):
            if file not in self.open:
                rows = self.directory.where(F.col("file") == file).select("first_key", "last_key", "offset", "length").collect()
                self.open = {file: _Blocks(self.fs, f"{self.root}/{file}", [tuple(r) for r in rows])}
            out += self.open[file].captures(key)
        return out

    def payload(self, capture: dict) -> bytes:
        """A response's payload, by one range read."""
        return parse(zlib.decompress(_range(self.fs, f"{self.root}/{capture['file']}", capture["offset"], capture["length"]), 31))[2]


def wanted_keys(urls: DataFrame) -> DataFrame:
    """(key): the distinct keys of a column of URLs; null URLs have the empty key."""
    ship(urls.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(sorted({host_key(u) for u in b.column(0).to_pylist()}), pa.string())], names=["key"])

    return urls.select(F.col(urls.columns[0]).cast("string")).mapInArrow(keys, "key string").distinct()


def find(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """(file, offset, length) of all captures whose key is among the distinct keys."""
    files, base = index_files(directory), uri(folder)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(file, key) for key in b.column(0).to_pylist() for file in files.enclosing(key)]
            yield pa.record_batch([pa.array([g[i] for g in got], pa.string()) for i in range(2)], names=["file", "key"])

    def search(keys: pa.Table, blocks: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(base)
        where: list[list] = [[], [], []]
        if keys.num_rows:
            index = _Blocks(fs, f"{root}/{keys['file'][0].as_py()}", list(zip(*(blocks[c].to_pylist() for c in ("first_key", "last_key", "offset", "length")))))
            for key in sorted(keys["key"].to_pylist()):
                for c in index.captures(key):
                    for column, name in zip(where, ("file", "offset", "length")):
                        column.append(c[name])
        return pa.table([pa.array(where[0], pa.string()), pa.array(where[1], pa.int64()), pa.array(where[2], pa.int64())], names=["file", "offset", "length"])

    # stated numbers of tasks: keys and blocks are few bytes, what is read for them is not
    parts = max(1, len(files.what))
    placed = keys.mapInArrow(place, "file string, key string").repartition(parts, "file").groupBy("file")
    return placed.cogroup(directory.repartition(parts, "file").groupBy("file")).applyInArrow(search, "file string, offset long, length long")


def read_back(keys: DataFrame, directory: DataFrame, folder: str, id_type: str) -> DataFrame:
    """All captures of the distinct keys, looked up and read; the digest of op4, a row each.

    Records are dealt out by archive and read by ranges, those that lie close together in one
    read. Length and digest are computed from payloads that were read: a response's own, for
    a revisit that of the response it refers to, which must be among the keys' captures.
    """
    spark = directory.sparkSession
    base = uri(folder)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        todo: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if todo and (r["file"] != todo[0]["file"] or r["offset"] > todo[-1]["offset"] + todo[-1]["length"] + READ_GAP or r["offset"] + r["length"] > todo[0]["offset"] + READ_BYTES):
                    yield _read(fs, root, todo)
                    todo = []
                todo.append(r)
        if todo:
            yield _read(fs, root, todo)

    where = stored(find(keys, directory, folder), "found")
    parts = partitions_for(spark, where.count(), RECORDS_A_TASK)
    span = F.floor(F.col("offset") / READ_BYTES)
    out = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, stated string"
    got = stored(where.repartition(parts, "file", span).sortWithinPartitions("file", "offset").mapInArrow(records, out), "read")
    # one row for each payload that a revisit can stand for, narrow, and the planner splits
    # a payload that very many pages revisit
    first = got.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("of_bytes"))
    again = got.where("record_type = 'revisit'").join(first, F.col("stated") == F.col("of"), "left")
    wrong = F.col("of_bytes").isNull() | (F.col("of_bytes") != F.col("payload_bytes"))
    told = F.when(wrong, F.raise_error(F.concat(F.lit("no payload like that of the revisit of page "), "page_id"))).otherwise(F.col("of_bytes")).cast("long")
    again = again.select("page_id", told.alias("payload_bytes"), F.col("of").alias("payload_digest"), "record_type", "refers_to")
    rows = got.where("record_type <> 'revisit'").drop("stated").unionByName(again)
    return rows.select(F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type))


def _read(fs: pafs.FileSystem, root: str, todo: list[dict]) -> pa.RecordBatch:
    begin = todo[0]["offset"]
    data = _range(fs, f"{root}/{todo[0]['file']}", begin, todo[-1]["offset"] + todo[-1]["length"] - begin)
    out: list[list] = [[] for _ in range(6)]
    for r in todo:
        at = r["offset"] - begin
        head, http, payload = parse(zlib.decompress(data[at : at + r["length"]], 31))
        stated, size, own = head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), None
        if head["warc-type"] == "response":
            own = hashlib.sha256(payload).hexdigest()
            if own != stated or len(payload) != size:
                raise ValueError(f"record at {r['file']}:{r['offset']} differs from what was written")
        for column, value in zip(out, (_id(head, "warc-page-id"), size, own, head["warc-type"], _id(head, "warc-refers-to-page-id"), stated)):
            column.append(value)
    return pa.record_batch([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(out)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stated"])


def archive(pages: DataFrame, folder: str | None = None, **columns: str) -> tuple[DataFrame, str]:
    """Write pages and their index to a folder of the shared one; (directory, folder)."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return write_index(write_archives(pages, folder, **columns), folder), folder


def query(pages: DataFrame) -> DataFrame:
    """The digest of op4: every page's URL is looked up in the index and its records read."""
    directory, folder = archive(pages.select("page_id", "url", "html"))
    return read_back(wanted_keys(pages.select("url")), directory, folder, pages.schema["page_id"].dataType.simpleString())


#: The same result in SQL.
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= {MIN_PAYLOAD} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_PAYLOAD} AND page_id > first THEN first END AS refers_to FROM f
"""
