import hashlib
import os

import pytest

from kinset.plans import campaign
from kinset.sources import mail, manifests, readers, results, writers


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_key_values(spark, tmp_path):
    assert readers.key_values(spark, write(tmp_path / "a", "key\tvalue\na\t1\nb\tx y\n")) == {"a": "1", "b": "x y"}
    for i, bad in enumerate([b"\xef\xbb\xbfkey\tvalue\na\t1\n", b"key\tvalue\r\na\t1\r\n", b"key\tvalue\n\na\t1\n", b"key\tvalue\na\t1", b"k\tv\na\t1\n", b"key\tvalue\na\t1\t2\n", b"key\tvalue\na\t1\na\t2\n"]):
        with pytest.raises(ValueError):
            readers.key_values(spark, write(tmp_path / f"bad{i}", bad))


def test_bibliographic(spark, tmp_path):
    head = "id,title,authors,venue,year\n"
    rows = readers.bibliographic(spark, write(tmp_path / "r.csv", head + 'a1,"A ""quoted"", title","X, Y",V,1999\nb,,,,\n'), "acm:").collect()
    assert [(r.record_id, r.title, r.authors) for r in rows] == [("acm:6131", 'A "quoted", title', "X, Y"), ("acm:62", "", "")]
    with pytest.raises(ValueError, match="repeated id"):
        readers.bibliographic(spark, write(tmp_path / "d.csv", head + "a,,,,\na,,,,\n"), "x:")
    with pytest.raises(Exception):
        readers.bibliographic(spark, write(tmp_path / "h.csv", "id,name,authors,venue,year\na,,,,\n"), "x:").collect()


def test_mapping(spark, tmp_path):
    assert readers.mapping(spark, write(tmp_path / "m.csv", "l,r\na,1\nb,2\n"), "l", "r").count() == 2
    for i, bad in enumerate(["a,1\na,1\n", "a,1\na,2\n", "a,1\nb,1\n"]):
        with pytest.raises(ValueError):
            readers.mapping(spark, write(tmp_path / f"m{i}.csv", "l,r\n" + bad), "l", "r")


def folder(tmp_path, records, pairs, **over):
    for name, text in (("records", records), ("pairs", pairs)):
        write(tmp_path / f"{name}.tsv", text)
    values = {"universe": "16", "records_count": "2", "pairs_count": "1", "records_sha256": hashlib.sha256(records.encode()).hexdigest(), "pairs_sha256": hashlib.sha256(pairs.encode()).hexdigest()} | over
    writers.manifest(values, str(tmp_path / "dataset.manifest.tsv"))
    return str(tmp_path)


RECORDS = "\t".join(readers.RECORD_HEADER) + "\nr1\t2\t5,18446744073709551615\t2\t5,15\nr2\t1\t7\t1\t7\n"
PAIRS = "\t".join(readers.PAIR_HEADER) + "\np1\tr1\tr2\tknown_match\t1\n"


def test_processed(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    manifest, records, pairs = readers.processed(spark, folder(tmp_path / "ok", RECORDS, PAIRS))
    assert manifest["universe"] == "16" and pairs.count() == 1
    first = records.orderBy("record_id").first()
    assert first.raw_features == ["5".zfill(20), "18446744073709551615"] and first.bucketed_features == [5, 15]
    faults = [
        (RECORDS.replace("\t5,15", "\t15,5"), PAIRS, {}),
        (RECORDS.replace("5,18446744073709551615", "5,18446744073709551616"), PAIRS, {}),
        (RECORDS.replace("\t2\t5,15", "\t3\t5,15"), PAIRS, {}),
        (RECORDS.replace("5,15", "5,16"), PAIRS, {}),
        (RECORDS, PAIRS.replace("\t1\n", "\t0\n"), {}),
        (RECORDS, PAIRS.replace("\tr2\t", "\tr3\t"), {}),
        (RECORDS, PAIRS, {"records_count": "3"}),
        (RECORDS, PAIRS, {"pairs_sha256": "0" * 64}),
    ]
    for i, (records, pairs, over) in enumerate(faults):
        (tmp_path / str(i)).mkdir()
        with pytest.raises(ValueError):
            readers.processed(spark, folder(tmp_path / str(i), records, pairs, **over))


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "b", b"two")
    write(tmp_path / "a", b"one")
    files = readers.inventory(spark, str(tmp_path))
    assert sorted(map(tuple, files.collect())) == [("a", 3, hashlib.sha256(b"one").hexdigest()), ("sub/b", 3, hashlib.sha256(b"two").hexdigest())]
    assert readers.tree_digest(files) == readers.tree_digest(files.repartition(3))


def test_writers(spark, tmp_path):
    assert [writers.number_text(x) for x in (0.1, -0.0, 1e300, None, 2.0)] == ["0.10000000000000001", "0", "1.0000000000000001e+300", None, "2"]
    with pytest.raises(ValueError):
        writers.number_text(float("nan"))
    df = spark.createDataFrame([("b", 0.5, [1, 2]), ("a", None, [])], "id string, x double, f array<int>")
    path = str(tmp_path / "out.tsv")
    digest = writers.single_file(df, path, ["id"])
    assert open(path).read() == "id\tx\tf\na\t\t\nb\t0.5\t1,2\n" and digest == hashlib.sha256(open(path, "rb").read()).hexdigest()
    with pytest.raises(FileExistsError):
        writers.single_file(df, path, ["id"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out.tsv"]
    with pytest.raises(ValueError, match="repeated"):
        writers.single_file(df.union(df), str(tmp_path / "two"), ["id"])
    writers.table_folder(df.select("id", "x"), str(tmp_path / "folder"), ["id"])
    with pytest.raises(Exception, match="already exists"):
        writers.table_folder(df.select("id", "x"), str(tmp_path / "folder"), ["id"])


PLAIN = b"From: a@x\nTo: b@x\nSubject: Re: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nMessage-ID: <1@x>\n\none two three four five six\n> quoted\n"


def test_mail(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    two = b"Subject: s\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain; charset=ANSI_X3.4-1968\nContent-Transfer-Encoding: quoted-printable\n\nfirst=20part\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=x.txt\n\nattached\n--B\nContent-Type: text/html\n\n<p>html</p>\n--B--\n"
    files = {"plain": PLAIN, "sub/two": two, "charset": b"Subject: s\nContent-Type: text/plain; charset=none-such\n\nx\n", "base64": b"Subject: s\nContent-Transfer-Encoding: base64\n\n!!!\n", "word": b"Subject: =?utf-8?q?broken\n\nx\n", "empty": b"Subject: s\n\n"}
    for name, raw in files.items():
        write(tmp_path / "in" / name, raw)
    rows = {r.path: r for r in mail.messages(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == set(files)
    assert rows["plain"].subject == "Re: Grüße" and rows["plain"].error is None
    assert rows["sub/two"].body.strip() == "first part"
    assert {p for p, r in rows.items() if r.error} == {"charset", "base64", "word"}
    got = {r.path: r for r in mail.candidates(mail.messages(spark, str(tmp_path / "in"))).collect()}
    assert got["plain"].n_tokens == 6 and len(got["plain"].features) == 2 and got["plain"].message_id == "1@x"
    assert got["plain"].subject == "gr sse" and got["empty"].n_tokens == 0
    assert got["plain"].record_id == "mail:" + hashlib.sha256(b"plain").hexdigest()


def test_hidden_names_are_read(spark, tmp_path):
    for name in ("1.", "_2", ".3", "sub/_deep/4"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    got = {r.path: bytes(r.content) for r in readers.all_files(spark, str(tmp_path)).collect()}
    assert got == {n: n.encode() for n in ("1.", "_2", ".3", "sub/_deep/4")}
    assert readers.inventory(spark, str(tmp_path)).count() == 4


def test_published_folders(spark, tmp_path):
    target = str(tmp_path / "out")

    def fill(text, digest=None):
        def write_to(path):
            spark.createDataFrame([(text,)], "t string").write.parquet(f"{path}/rows")
            (tmp_path / path.rpartition("/")[2] / "note").write_text(text)
            return {"note": digest or hashlib.sha256(text.encode()).hexdigest()}

        return write_to

    def held():
        return spark.read.parquet(f"{target}/rows").first().t

    writers.published(spark, target, fill("one"))
    assert held() == "one" and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(FileExistsError):
        writers.published(spark, target, fill("two"))
    with pytest.raises(OSError, match="note"):
        writers.published(spark, target, fill("two", "0" * 64), overwrite=True)

    def fails(path):
        fill("two")(path)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        writers.published(spark, target, fails, overwrite=True)
    assert held() == "one" and [p.name for p in tmp_path.iterdir()] == ["out"]
    writers.published(spark, target, fill("two"), overwrite=True)
    assert held() == "two" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_seals(spark, tmp_path):
    write(tmp_path / "a", "x")
    write(tmp_path / "_b", "y")
    seal = writers.sealed(spark, str(tmp_path), {"run": "1"})
    assert (seal["files"], seal["bytes"]) == (2, 2) and writers.verified(spark, str(tmp_path)) == seal
    with pytest.raises(FileExistsError):
        writers.sealed(spark, str(tmp_path))
    write(tmp_path / "a", "z")
    with pytest.raises(ValueError, match="tree_sha256"):
        writers.verified(spark, str(tmp_path))
    write(tmp_path / "a", "x")
    write(tmp_path / "seal.json", (tmp_path / "seal.json").read_text().replace('"1"', '"2"'))
    with pytest.raises(ValueError, match="seal was changed"):
        writers.verified(spark, str(tmp_path))


def test_source_manifests(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    write(tmp_path / "tree" / "f", "1")
    write(tmp_path / "file", "2")
    (tmp_path / "link").symlink_to(tmp_path / "file")
    stated = {"schema_version": "v1", "dataset": "d", "parsing_schema": "p", "preprocessing_profile": "q"}
    roles = [("one", "file"), ("all", "folder")]
    tree = readers.tree_digest(readers.inventory(spark, str(tmp_path / "tree")))
    good = stated | {k: "said" for k in manifests.DESCRIBED} | {"input.0.role": "one", "input.0.path": "file", "input.0.sha256": hashlib.sha256(b"2").hexdigest(), "input.1.role": "all", "input.1.path": "tree", "input.1.sha256": tree}

    def read(**over):
        values = {k: v for k, v in (good | {k.replace("__", "."): v for k, v in over.items()}).items() if v is not None}
        path = write(tmp_path / "m.tsv", "key\tvalue\n" + "".join(f"{k}\t{v}\n" for k, v in values.items()))
        return manifests.source_manifest(spark, path, stated, roles)

    values, inputs = read()
    assert values == good and inputs == [("one", tmp_path / "file"), ("all", tmp_path / "tree")]
    faults = [{"dataset": "other"}, {"citation": "TBD"}, {"citation": " "}, {"citation": None}, {"more": "x"}, {"input__2__role": "x"}, {"input__0__role": "all"}, {"input__0__sha256": "unknown"}, {"input__0__sha256": "0" * 64}, {"input__0__path": "tree"}]
    faults += [{"input__0__path": p} for p in ("/file", "../file", "./file", "tree//f", "a\\b", "link")]
    for over in faults:
        with pytest.raises(ValueError):
            read(**over)
    with pytest.raises(FileNotFoundError):
        read(input__0__path="none")


def csv_of(path, header, rows):
    return write(path, "\n".join(",".join(r.get(h, "") for h in header) for r in [dict(zip(header, header)), *rows]) + "\n")


def test_accuracy_rows(spark, tmp_path):
    assert len(results.ACCURACY_HEADER) == 73
    sizes = dict(zip(results.SIZES, "1234"))
    plain = {"dataset": "d", "variant": "v", "exact_jaccard_bucketed": "0.5", "abs_error": "1e-3"}
    full = plain | {"dataset": "enron", "record_a": "x", "record_b": "y"} | sizes
    rows = results.accuracy_rows(spark, csv_of(tmp_path / "a.csv", results.ACCURACY_HEADER, [plain, full])).orderBy("dataset").collect()
    assert rows[0].set_size_a_raw is None and rows[0].abs_error == 0.001 and rows[1].set_size_b_bucketed == 4
    bad = [plain | {"abs_error": "nan"}, plain | {"abs_error": ""}, full | {"record_a": ""}, full | {"set_size_a_raw": "-1"}, full | {"set_size_b_raw": "x"}]
    for i, row in enumerate(bad):
        with pytest.raises(ValueError):
            results.accuracy_rows(spark, csv_of(tmp_path / f"b{i}.csv", results.ACCURACY_HEADER, [plain, row]))
    with pytest.raises(Exception):
        results.accuracy_rows(spark, csv_of(tmp_path / "h.csv", results.ACCURACY_HEADER[:-1], [plain]))


def test_threshold_rows(spark, tmp_path):
    # tau of 0.5 at k = 128, m = 64 is 128 * (1 / 64 + 63 / 64 * 0.5) = 65
    row = {"dataset": "d", "variant": "v", "pair_id": "p", "pair_kind": "known_match", "label": "1", "record_a": "a", "record_b": "b", "k": "128", "m": "64", "root_seed": "18446744073709551615", "hash_seed": "3", "split": "evaluation", "rank_position": "0", "threshold_trial_index": "0"}
    row |= {"match_count": "70", "decision": "1", "label_truth": "1", "label_outcome": "TP", "exact_j_truth": "1", "exact_j_outcome": "TP", "exact_jaccard_bucketed": "0.75", "requested_j_threshold": "0.5", "tau_count": "65", "realized_j_tau": repr((65 / 128 - 1 / 64) / (1 - 1 / 64))}
    second = row | {"threshold_trial_index": "1", "match_count": "3", "decision": "0", "label_outcome": "FN", "exact_j_outcome": "FN"}

    def read(*rows):
        return results.threshold_rows(spark, csv_of(tmp_path / "t.csv", results.THRESHOLD_HEADER, rows))

    assert read(row, second).count() == 2
    faults = {"decision": "1", "label": "2", "label_truth": "0", "label_outcome": "FP", "exact_j_truth": "0", "exact_j_outcome": "TN", "tau_count": "64", "realized_j_tau": "0.500001", "k": "64", "m": "8", "match_count": "129", "threshold_trial_index": "0", "exact_jaccard_bucketed": "1.5", "split": "calibration", "root_seed": "-1", "dataset": "other", "record_a": "z"}
    for field, value in faults.items():
        with pytest.raises(ValueError):
            read(row, second | {field: value})
    with pytest.raises(ValueError, match="trials"):
        read(row, second, row | {"pair_id": "q"})
    with pytest.raises(ValueError, match="no evaluation rows"):
        read()


def test_archives_do_not_depend_on_time(spark, tmp_path):
    digests = []
    for k in (1, 2):
        root = tmp_path / f"in{k}"
        (root / "sub").mkdir(parents=True)
        for name in ("b", "sub/a") if k == 1 else ("sub/a", "b"):
            write(root / name, name * 1000)
            os.utime(root / name, (k, k))
        stored = writers.archived(str(root), str(tmp_path / f"{k}.tar.zst"))
        assert stored == {n: hashlib.sha256((n * 1000).encode()).hexdigest() for n in ("b", "sub/a")} == writers.unpacked_digests(str(tmp_path / f"{k}.tar.zst"))
        digests.append((tmp_path / f"{k}.tar.zst").read_bytes())
    assert digests[0] == digests[1]
    with pytest.raises(FileExistsError):
        writers.archived(str(tmp_path / "in1"), str(tmp_path / "1.tar.zst"))
    (tmp_path / "in1" / "link").symlink_to(tmp_path / "in1" / "b")
    with pytest.raises(ValueError):
        writers.archived(str(tmp_path / "in1"), str(tmp_path / "3.tar.zst"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.tar.zst", "2.tar.zst", "in1", "in2"]


def test_campaigns_go_on(spark, tmp_path):
    runs, broken = [], [True]

    def cell(n):
        def rows(s):
            runs.append(n)
            if n == 2 and broken:
                raise RuntimeError("stopped")
            return s.range(n)

        return rows

    cells = {f"c{n}": cell(n) for n in (1, 2, 3)}
    with pytest.raises(RuntimeError):
        campaign.run(spark, str(tmp_path), cells, "b1")
    broken.clear()
    with pytest.raises(ValueError, match="build"):
        campaign.run(spark, str(tmp_path), cells, "b2")
    assert campaign.run(spark, str(tmp_path), cells, "b1") == ["c2", "c3"] and runs == [1, 2, 2, 3]
    assert campaign.run(spark, str(tmp_path), cells, "b1") == []
    assert [spark.read.parquet(f"{tmp_path}/cells/c{n}").count() for n in (1, 2, 3)] == [1, 2, 3]
    log = [(r.event, r.cell) for r in campaign.events(spark, str(tmp_path)).orderBy("seq").collect()]
    assert log[:5] == [("begun", ""), ("started", "c1"), ("completed", "c1"), ("started", "c2"), ("failed", "c2")]
    assert log[5:] == [("resumed", ""), ("started", "c2"), ("completed", "c2"), ("started", "c3"), ("completed", "c3"), ("ended", ""), ("resumed", ""), ("ended", "")]
