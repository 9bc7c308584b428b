import math
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinset.sources import sidecars


def samples(spark, cells=("c 1", "c/2"), n=4, warm=True):
    rows = [("p", "paper", c, "discard_one" if warm else "none", phase, "measured", i, (1 << 64) - 1 - i, 0.1 * (i + 1) * (k + 1)) for k, c in enumerate(cells) for phase in ("a", "b") for i in range(n)]
    rows += [("p", "paper", c, "discard_one", phase, "discarded_warmup", 0, 7, 99.5) for c in cells for phase in ("a", "b")] * warm
    return spark.createDataFrame([(*r[:7], str(r[7]), r[8]) for r in rows], "producer_id string, profile_id string, cell_id string, warmup_policy string, phase string, sample_kind string, trial_index long, seed string, raw_ms double")


def test_round_trip(spark, tmp_path):
    made = samples(spark)
    sidecars.write_sidecars(made, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["p__paper__c_1.tsv", "p__paper__c_2.tsv"]
    back = sidecars.read_sidecars(spark, str(tmp_path))
    assert back.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, back.where("section = 'sample'").select(*made.columns).collect())) == sorted(map(tuple, made.collect()))
    for r in back.where("section = 'aggregate'").collect():
        values = [x.raw_ms for x in made.where((F.col("cell_id") == r.cell_id) & (F.col("phase") == r.phase) & (F.col("sample_kind") == "measured")).collect()]
        assert (r.measured_count, r.mean_ms, r.median_ms) == (4, pytest.approx(statistics.mean(values)), pytest.approx(statistics.median(values)))
        assert r.ci95_high_ms - r.mean_ms == pytest.approx(3.182446305 * statistics.stdev(values) / math.sqrt(4))


def test_one_sample_has_no_interval(spark, tmp_path):
    sidecars.write_sidecars(samples(spark, n=1, warm=False), str(tmp_path))
    r = sidecars.read_sidecars(spark, str(tmp_path)).where("section = 'aggregate'").first()
    assert r.sample_sd_ms is None and r.ci95_low_ms is None and "N/A" in next(tmp_path.iterdir()).read_text()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = samples(spark).withColumn("phase", F.when(F.col("cell_id") == "c/2", F.concat("phase", F.lit("\t"))).otherwise(F.col("phase")))
    with pytest.raises(Exception, match="tab or a line break"):
        sidecars.write_sidecars(bad, str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    sidecars.write_sidecars(samples(spark, cells=("one",)), str(tmp_path))
    first = (tmp_path / "p__paper__one.tsv").read_bytes()
    with pytest.raises(Exception, match="that are there"):
        sidecars.write_sidecars(samples(spark, cells=("one", "two"), n=2), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["p__paper__one.tsv"] and (tmp_path / "p__paper__one.tsv").read_bytes() == first


def test_pending_files_are_not_read(spark, tmp_path):
    sidecars.write_sidecars(samples(spark, cells=("one",)), str(tmp_path))
    (tmp_path / "_pending-x").mkdir()
    (tmp_path / "_half.tsv").write_text("schema")
    assert sidecars.read_sidecars(spark, str(tmp_path)).select("cell_id").distinct().count() == 1


@pytest.mark.parametrize("old,new", [("schema_version\tkinset", "schema_version\tother"), ("\t0.10000000000000001\n", "\t0.1\n"), ("\t0.10000000000000001\n", "\t0.25\n"), ("\tmeasured\t1\t", "\tmeasured\t2\t"), ("\tmeasured\t3\t", "\tmeasured\t03\t"), ("expected_measured\t4", "expected_measured\t5"), ("discard_one", "none"), ("aggregates\n", ""), ("\tdiscarded_warmup\t0\t", "\tmeasured\t0\t"), ("sample\tp\tpaper\tone\ta\tmeasured\t0", "sample\tp\tpaper\ttwo\ta\tmeasured\t0"), ("17-digit\n", "17-digit")])
def test_faults(spark, tmp_path, old, new):
    sidecars.write_sidecars(samples(spark, cells=("one",)), str(tmp_path))
    path: Path = tmp_path / "p__paper__one.tsv"
    text = path.read_text()
    assert old in text
    at = text.rindex(old) if old == "17-digit\n" else text.index(old)
    path.write_text(text[:at] + new + text[at + len(old) :])
    with pytest.raises(Exception):
        sidecars.read_sidecars(spark, str(tmp_path)).collect()
