import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from kinset.llm import warc


def rows():
    rng = random.Random(1)
    out = []
    for k in range(300):
        html = rng.choice([None, "", "short", "é" * 49, "é" * 50, "<p>same</p>" * 40, "x" * 99, "x" * 100, f"<p>{k}</p>" * rng.randrange(1, 400)])
        out.append((k * 7 % 300, rng.choice([f"https://www.ex{k % 9}.example.org/p/{k % 20}?q=ü {k}#top", "http://a.example.com", None, "not a url", "http://[bad"]), html, "clash"))
    return out + [(900, "http://a.example.com/long", "long \r\n\r\n text" * 90000, "c")]


def frame(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, file string")


@pytest.mark.parametrize("few", [100_000, 0])
def test_round_trip_against_sql(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    data = rows()
    got = [tuple(r) for r in warc.query(frame(spark, data)).collect()]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(data, columns=["page_id", "url", "html", "file"]))
    assert sorted(got) == sorted(con.execute(warc.ORACLE).fetchall())


def test_null_and_repeated_rows(spark):
    data = [(None, None, "y" * 200, "c"), (3, None, "y" * 200, "c"), (3, None, "y" * 200, "c"), (4, "u", "y" * 200, "c"), (None, None, None, None)]
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.query(frame(spark, data)).collect())
    assert got == [("3", 200, "response", None), ("3", 200, "revisit", 3), ("4", 200, "revisit", 3), ("None", 0, "response", None), ("None", 200, "revisit", 3)]
    assert warc.query(frame(spark, [])).collect() == []


def test_lookups_by_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    data = rows()
    directory, folder = warc.archive(frame(spark, data))
    index = warc.CaptureIndex(directory, folder)
    for url in {r[1] for r in data if r[1]} | {"http://absent.example.com/"}:
        want = sorted(str(r[0]) for r in data if r[1] and warc.host_key(r[1]) == warc.host_key(url))
        found = index.captures(url)
        assert sorted(c["page_id"] for c in found) == want
    html = {str(r[0]): r[2] or "" for r in data}
    for c in index.captures("https://ex1.example.org/p/1?q=ü 1"):
        if c["kind"] == "response":
            assert index.payload(c).decode() == html[c["page_id"]]


def test_record_is_a_warc_record():
    digest = hashlib.sha256(b"abc").hexdigest()
    raw = warc.record(5, "http://x/ y\r\nEvil: 1", b"abc", digest, None, False)
    head, http, payload = warc.parse(zlib.decompress(warc._gzip(raw), 31))
    assert payload == b"abc" and http["content-length"] == "3" and "evil" not in head
    assert warc.host_key("HTTPS://WWW.Example.com:443/A?b#c") == "com,example)/A?b"


def test_only_wanted_keys_are_found(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    data = [(k, f"http://h{k % 40}.example.org/", f"<p>{k}</p>" * 30, "c") for k in range(200)]
    directory, folder = warc.archive(frame(spark, data))
    urls = spark.createDataFrame([("http://h7.example.org",), ("http://H31.example.org/",), ("http://none.example.org",)], "url string")
    got = warc.read_back(warc.wanted_keys(urls), directory, folder, "bigint").collect()
    assert sorted(r.page_id for r in got) == [k for k in range(200) if k % 40 in (7, 31)]


def test_ids_may_hold_anything(spark):
    ids = [" a ", "c\r\nEvil: 1", "", "%41", "é\u0000", "plain", None, "tab\t", "a:b"]
    pages = spark.createDataFrame([(i, f"http://h.org/{k}", "same payload " * 20 if k % 2 else f"own {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.query(pages).collect()}
    assert set(got) == set(ids)
    first = min(i for k, i in enumerate(ids) if k % 2)
    for k, i in enumerate(ids):
        assert got[i].refers_to == (first if k % 2 and i != first else None)
