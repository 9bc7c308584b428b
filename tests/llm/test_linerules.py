import random
import re
from collections import Counter

import duckdb
import pandas as pd

from kinset.llm import linerules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    hit = {q for i, g in enumerate(grams) if many[g] > 1 for q in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def texts():
    rng = random.Random(4)
    lines = ["Home | About | Contact", "A plain line of several words stands here.", "one two three four five six seven", "Été » là", "It ends… ", "Too short", "Fine.", "WOW!! SO!! LOUD!! NOW!!", "a### b$$$ c&&&", "", " \t", "We use Cookies on this page.", "Licensed under the MIT License, and so on.", "x · y · z", "\x0b wide space kept", "“Quoted”"]
    out = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(14))), "n", 1) for k in range(120)]
    out += [(200, None, None, None), (201, "", "n", 2), (202, "\n\n", "n", 2), (203, "word " * 30000, "n", 2), (204, " ".join(f"w{i}" for i in range(30000)), "n", 2), (None, "one line only without an end but with ten words here", "n", 2), (201, "", "n", 2)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long")


def test_counts_against_brute_force_and_verdicts_against_sql(spark):
    rows = texts()
    got = [tuple(r) for r in linerules.judged(frame(spark, rows)).collect()]
    assert [g[:7] for g in got] == [(r[0], *brute(r[1])) for r in rows]
    documents = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(linerules.ORACLE).fetchall(), key=str) == sorted(got, key=str)


def test_clean_lines(spark):
    good = "A plain line of several words stands here, and it goes on for a while.\nAnother one follows and says something else."
    rows = [(1, good, "a", 1), (2, good + "\nHome | About | Contact\n", "a", 1), (3, "Home | About | Contact\n" * 3 + "A line with ten words that would be kept alone.", "a", 1), (4, None, "a", 1)]
    out = {r.doc_id: r.text for r in linerules.clean_lines(frame(spark, rows)).collect()}
    assert out == {1: good, 2: good + "\n"}


def test_empty_table(spark):
    assert linerules.judged(frame(spark, [])).collect() == []


def twins(n=2048):
    """Two different words of which every polynomial hash modulo a power of two is equal."""
    s = "a"
    while len(s) < n:
        s = "".join({"a": "ab", "b": "ba"}[c] for c in s)
    return s, s.translate(str.maketrans("ab", "ba"))


def test_lines_with_like_hashes_are_different(spark, monkeypatch):
    a, b = twins()
    rows = [(1, f"{a}\n{b}", "n", 1), (2, f"{a}\n{b}\n{a}", "n", 1)]
    assert [r.n_dup_lines for r in linerules.judged(frame(spark, rows)).collect()] == [0, 1]


def test_hashes_that_meet_are_told_apart(monkeypatch):
    import numpy as np

    from kinset.llm import bytetext as bt

    mix = bt.mix
    buf = np.frombuffer(b"aa bb aa cc dd bb", np.uint8)
    start = np.array([0, 3, 6, 9, 12, 15])
    # as long as the seed is small, all ranges meet in one hash
    monkeypatch.setattr(bt.Hasher, "__call__", lambda self, s, e: np.zeros(len(s), np.uint64) if self.seed < 2 else mix(self.bytes.at(s, e - s)))
    got = bt.Hasher(buf).exact(start, start + 2)
    assert len(set(got.tolist())) == 4 and got[0] == got[2] and got[1] == got[5]


def test_licence_lines_go_and_the_text_stays(spark):
    text = "Licensed under the Apache License, version 2 and so on and on here.\nGood text."
    row = linerules.judged(frame(spark, [(1, text, "n", 1)])).first()
    assert row.kept and row.lost_words == 13
    assert linerules.clean_lines(frame(spark, [(1, text, "n", 1)])).first().text == "Good text."
