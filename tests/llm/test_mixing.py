import random

import duckdb
import pandas as pd
import pytest

from kinset.llm import mixing


def rows():
    rng = random.Random(9)
    out = [(k, " ".join(["w"] * int(rng.paretovariate(0.8) * 5)), rng.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"])) for k in range(800)]
    return out + [(None, None, "none"), (901, "", "none"), (902, None, None), (5, "x y", "b"), (5, "x y", "b"), (903, "w " * 60000, "b")]


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", "k", "a.b", 1.0) for r in data], "doc_id long, text string, source string, size string, __at string, `a.b` string, __mix double")


def test_against_sql_and_targets(spark):
    data = [(i, t[:200000] if t else t, s) for i, t, s in rows()]
    got = [tuple(r) for r in mixing.query(frame(spark, data)).collect()]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64", "text": object}))
    want = con.execute(mixing.ORACLE.replace("'t')", "'t')")).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    names = {i: s for i, _, s in data}
    taken, target, longest = {}, {}, {}
    for i, size, _, goal, took, copies in got:
        s = names[i]
        assert copies <= 2 and took == copies * size
        taken[s] = taken.get(s, 0) + took
        target[s] = goal
        longest[s] = max(longest.get(s, 0), size)
    total = sum(g[1] for g in got)
    assert sum(target.values()) == pytest.approx(1.5 * total)
    for s in taken:
        assert abs(taken[s] - target[s]) <= 2 * longest[s] + 1


def test_mixed_rows(spark):
    d = frame(spark, rows())
    out = mixing.mixed(d)
    assert out.columns == d.columns
    want = mixing.query(d).collect()
    assert out.count() == sum(r.copies for r in want)


def test_empty_table(spark):
    assert mixing.query(frame(spark, [])).collect() == []
