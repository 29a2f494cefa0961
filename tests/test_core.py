import json

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from compare import connect, differences
from tidepool.operators import consolidate, ledger, quality, sampling, signal
from tidepool.plans import catalog
from tidepool.sources import int16, manifest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_query_guards(spark):
    df = spark.createDataFrame([(0, 1, 2.0, 3.0)], "row_id long, sample_index long, amplitude_uv double, snr double").selectExpr("*", "0L as channel_index")
    with pytest.raises(ValueError):
        ledger.query(df, 1.5, saved_floor=2.0)
    with pytest.raises(ValueError):
        ledger.query(df, 2.0, time=(5, 4))
    with pytest.raises(ValueError):
        ledger.query(df, 2.0, channels=[7], known={0})
    assert ledger.query(df, 2.0, channels=[]).count() == 0
    assert ledger.query(df, 3.0).count() == 0


def test_quotas():
    q = sampling.allocate_quotas([0, 3, 100, 9, 1], 20, 2)
    assert sum(q) == 20 and all(a <= b for a, b in zip(q, [0, 3, 100, 9, 1], strict=True))


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for n, m in ((3, 3), (2, 4), (4, 2)):
        w = rng.random((n, m))
        best = max(sum(w[i, p[i]] for i in range(n)) for p in permutations(range(m), n)) if n <= m else max(sum(w[p[j], j] for j in range(m)) for p in permutations(range(n), m))
        assert sum(w[i, j] for i, j in quality.assignment(w)) == pytest.approx(best)


def test_two_pointer():
    a, b = quality.two_pointer(np.array([0, 5, 10]), np.array([1, 9, 30]), 2)
    assert a.tolist() == [0, 2] and b.tolist() == [0, 1]


def test_groups_of_an_island():
    rows = pd.DataFrame({"row_id": [0, 1, 2], "sample_index": [10, 11, 12], "channel_index": [0, 1, 0], "amplitude_uv": [-5.0, -9.0, 4.0], "snr": [5.0, 9.0, 4.0]})
    g = consolidate.group_island(rows, 2, {0: {0, 1}, 1: {0, 1}})
    assert [(x["anchor"], x["channel"], x["members"]) for x in g] == [(11, 1, [0, 1]), (12, 0, [2])]


def test_filters():
    taps = signal.kaiser_taps(30000, 1250, 300)
    assert len(taps) % 2 == 1 and taps.sum() == pytest.approx(1)
    t = np.arange(6000) / 20000
    x = np.stack([np.sin(2 * np.pi * 1500 * t), np.sin(2 * np.pi * 30 * t)], axis=1)
    y = signal.zero_phase(signal.butterworth_band(20000, 300, 6000), x)
    middle = slice(2000, 4000)
    assert np.abs(y[middle, 0] - x[middle, 0]).max() < 0.1 and np.abs(y[middle, 1]).max() < 0.05


def test_int16_source(spark, tmp_path):
    data = np.arange(60, dtype="<i2").reshape(20, 3)
    path = tmp_path / "a.dat"
    data.tofile(path)
    spark.dataSource.register(int16.Int16Source)
    df = spark.read.format("int16").options(path=str(path), channels=3, core=8, halo=2, gain=0.5).load()
    owned = sorted(df.where("owned").collect(), key=lambda r: r.t)
    assert [r.t for r in owned] == list(range(20)) and owned[7].uv == [10.5, 11.0, 11.5]
    assert df.count() == 20 + 2 + 4 + 2


def test_manifest(tmp_path):
    np.zeros((10, 2), "<i2").tofile(tmp_path / "a.dat")
    probe = {"probe_id": "p", "sample_rate_hz": 20000, "gain_uv_per_count": 0.2, "geometry": {"x_um": [0, 1], "y_um": [0, 1], "shank": [0, 0]}, "segments": [{"path": "a.dat", "start_sample": 0, "n_samples": 10}], "gaps": []}
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": 1, "session_id": "s", "probes": [probe]}))
    assert manifest.load_session(str(tmp_path / "s.json"))["session_id"] == "s"
    probe["gaps"] = [{"start_sample": 10, "stop_sample": 12, "reason": "x"}]
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": 1, "session_id": "s", "probes": [probe]}))
    with pytest.raises(ValueError, match="gaps"):
        manifest.load_session(str(tmp_path / "s.json"))


def test_rolling_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidepool.plans.views import Views
    from tidepool.streaming import rolling

    events = Views(spark, SF).ledger().select(F.col("user_id").alias("label"), F.col("sample_index").alias("t"), F.abs("amplitude_uv").alias("v"))
    events.orderBy("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = rolling.rolling_templates(rolling.event_stream(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "out"), 43200)
    q.awaitTermination(120)
    a, b = rolling.snapshot(spark, str(tmp_path / "out"), 6).collect(), consolidate.rolling_bins(events, 43200, 6).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_int16_session_with_a_gap(spark, tmp_path):
    a, b = (np.random.default_rng(i).integers(-99, 99, (n, 2)).astype("<i2") for i, n in ((1, 4000), (2, 2000)))
    a.tofile(tmp_path / "a.dat")
    b.tofile(tmp_path / "b.dat")
    probe = {"probe_id": "p", "sample_rate_hz": 1000, "gain_uv_per_count": 0.5, "geometry": {"x_um": [0, 1], "y_um": [0, 1], "shank": [0, 0]}, "segments": [{"path": "a.dat", "start_sample": 0, "n_samples": 4000, "day_id": "d1"}, {"path": "b.dat", "start_sample": 5000, "n_samples": 2000, "day_id": "d2"}], "gaps": [{"start_sample": 4000, "stop_sample": 5000, "reason": "x"}]}
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": 1, "session_id": "s", "probes": [probe]}))
    spark.dataSource.register(int16.Int16Source)
    for grouped in (1, 5):
        df = spark.read.format("int16").options(manifest=str(tmp_path / "s.json"), probe="p", core=2000, halo=100, grouped=grouped).load()
        spans = {(r.core, r.a, r.b, r.day) for r in df.groupBy("core", "day").agg({"t": "min"}).withColumnRenamed("min(t)", "a").join(df.groupBy("core").agg({"t": "max"}).withColumnRenamed("max(t)", "b"), "core").collect()}
        assert spans == {(0, 0, 2099, "d1"), (2000, 1900, 3999, "d1"), (5000, 5000, 6999, "d2")}
        owned = sorted(df.where("owned").select("t", "uv").collect())
        assert [r.t for r in owned] == [*range(4000), *range(5000, 7000)]
        assert np.allclose([r.uv for r in owned], np.concatenate([a, b]) * 0.5)
    assert [(c.start, c.stop) for c in int16.plan([("x", 0, 4000, None), ("y", 5000, 7000, None)], 2000, 10, 1000, 6000)] == [(1000, 3000), (3000, 4000), (5000, 6000)]
    with pytest.raises(OSError):
        int16.read_frames(str(tmp_path / "b.dat"), 2, 1990, 20)
