import os

import numpy as np
import pytest

from tidepool.operators import learning
from tidepool.operators.signal import kaiser_taps
from tidepool.sources import lfp


def test_planted_clusters(spark):
    rng = np.random.default_rng(3)
    shapes = rng.normal(size=(2, 64))
    rows = [(i, 5, (shapes[i % 2] * (1 + i / 100) + rng.normal(scale=0.05, size=64)).tolist()) for i in range(60)] + [(100 + i, 6, [1.0] * 64) for i in range(19)]
    got = learning.calibrate(spark.createDataFrame(rows, "row_id long, anchor long, w array<double>")).collect()
    assert {r.anchor for r in got} == {5} and all(r.n >= 10 for r in got)
    cosines = np.array([[np.dot(r.w, s) / np.linalg.norm(r.w) / np.linalg.norm(s) for s in shapes] for r in got])
    assert (cosines.max(axis=1) > 0.99).all() and set(cosines.argmax(axis=1)) == {0, 1}


def test_silent_and_few():
    assert learning.spherical_means(np.zeros((30, 16, 4)), slice(4, 12)) == []
    assert learning.spherical_means(np.ones((19, 16, 4)), slice(4, 12)) == []


def test_links_of_a_chain(spark):
    units = spark.range(6).withColumnRenamed("id", "unit")
    pairs = spark.createDataFrame([(1, 4), (2, 4), (2, 5)], "left long, right long")
    assert sorted(map(tuple, learning.linked_identities(units, pairs).collect())) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 1), (5, 1)]
    assert learning.linked_identities(units, pairs.limit(0)).select("identity").distinct().count() == 6


def test_refinement_promotes(spark):
    rng = np.random.default_rng(5)
    true = rng.normal(size=64)
    snippet = lambda: (true + rng.normal(scale=0.01, size=64)).tolist()
    models = spark.createDataFrame([(1, (true * 1.2).tolist()), (2, true.tolist()), (3, true.tolist())], "unit long, w array<double>")
    training = spark.createDataFrame([(u, i % 3, snippet()) for u in (1, 2) for i in range(12)], "unit long, core long, w array<double>")
    held = spark.createDataFrame([(u, snippet()) for u in (1, 2) for _ in range(6)], "unit long, w array<double>")
    got = {r.unit: r.reason for r in learning.heldout_refinement(models, training, held).collect()}
    assert got == {1: "heldout_waveform_improvement", 2: "validation_rejected", 3: "insufficient_evidence"}
    with pytest.raises(ValueError):
        learning.heldout_refinement(models, training, held, 0.0)


def test_export(spark, tmp_path):
    data = np.random.default_rng(2).integers(-32768, 32767, (5003, 3)).astype("<i2")
    source, out = str(tmp_path / "a.dat"), str(tmp_path / "out")
    data.tofile(source)
    done = lfp.export_lfp(spark, source, out, 3, 10000, 2500, 900.0, part=300)
    names = sorted(x for x in os.listdir(out) if x.endswith(".i16"))
    got = np.concatenate([np.fromfile(f"{out}/{x}", "<i2").reshape(-1, 3) for x in names])
    taps = kaiser_taps(10000, 2500, 900.0)
    half = len(taps) // 2
    padded = np.pad(data.astype(float), ((half, half), (0, 0)), mode="constant")
    want = np.stack([np.convolve(padded[:, c], taps[::-1], "valid")[::4] for c in range(3)], axis=1)
    assert np.array_equal(got, np.rint(want).clip(-32768, 32767)) and done["outputs"] == 1251 and done["parts"] == len(names) == 5
    with pytest.raises(FileExistsError):
        lfp.export_lfp(spark, source, out, 3, 10000, 2500, 900.0, part=300)
    os.remove(f"{out}/{names[2][:-4]}.json")
    assert lfp.export_lfp(spark, source, out, 3, 10000, 2500, 900.0, part=300, resume=True) == done


def test_rational_export(spark, tmp_path):
    data = np.random.default_rng(3).integers(-9000, 9000, (2000, 2)).astype("<i2")
    source, out = str(tmp_path / "a.dat"), str(tmp_path / "out")
    data.tofile(source)
    done = lfp.export_lfp(spark, source, out, 2, 32000, 1250, 450.0, part=16)
    names = sorted(x for x in os.listdir(out) if x.endswith(".i16"))
    got = np.concatenate([np.fromfile(f"{out}/{x}", "<i2").reshape(-1, 2) for x in names])
    taps = kaiser_taps(32000 * 5, 1250, 450.0)
    whole = np.zeros((2000 * 5, 2))
    whole[::5] = data
    half = len(taps) // 2
    want = np.stack([5 * np.convolve(np.pad(whole[:, c], half), taps[::-1], "valid")[::128] for c in range(2)], axis=1)
    assert done["outputs"] == 79 == len(got) and np.abs(got - want).max() <= 0.5 + 1e-6
