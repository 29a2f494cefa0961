import numpy as np
import pytest

from tidepool.operators import adaptation as A

W = "w array<double>"
PEAK = np.exp(-0.5 * (np.arange(16) - 8) ** 2 / 4)[:, None] * [1.0, 0.6, 0.4, 0.2]


def test_recent_evidence(spark):
    rows = [(1, s, s // 100, [0.0]) for s in range(0, 1000, 10)] + [(1, 990, 0, [5.0])]
    got = A.recent_evidence(spark.createDataFrame(rows, "unit long, sample long, core long, " + W), 1000, 700, 1).collect()
    assert sorted(r.sample for r in got) == list(range(360, 1000, 10)) and sum(r.core == 0 for r in got) == 1


def test_promotion(spark):
    rng = np.random.default_rng(1)
    true = PEAK.ravel() * 10
    models = spark.createDataFrame([(1, (true * 1.3).tolist()), (2, true.tolist()), (3, true.tolist()), (4, true.tolist())], "unit long, " + W)
    snippet = lambda: (true + rng.normal(scale=0.01, size=64)).tolist()
    rows = [(u, i * 10, i // 6, snippet()) for u in (1, 2) for i in range(24)] + [(3, i, 0, snippet()) for i in range(24)] + [(4, i, int(i == 17), snippet()) for i in range(18)]
    evidence = spark.createDataFrame(rows, "unit long, sample long, core long, " + W)
    last = lambda at: spark.createDataFrame([(1, at)], "unit long, promoted_at long")
    got = {r.unit: r.reason for r in A.promote(models, evidence, last(100)).collect()}
    assert got == {1: "heldout_waveform_improvement", 2: "validation_rejected", 3: "insufficient_independent_evidence", 4: "insufficient_temporal_holdout"}
    assert {r.unit: r.reason for r in A.promote(models, evidence, last(200)).collect()}[1] == "insufficient_independent_evidence"


def test_splits(spark):
    rng = np.random.default_rng(2)
    shapes = [PEAK * 10, PEAK * 10 * [1.0, -0.6, -0.4, -0.2]]
    mean = (shapes[0] * 0.6 + shapes[1] * 0.4).ravel().tolist()
    row = lambda u, i, s: (u, i, i % 10, i % 10 > 6, (shapes[s] + rng.normal(scale=0.05, size=(16, 4))).ravel().tolist())
    rows = [row(u, i, i // 10 % 2) for u in (1, 2) for i in range(120)] + [row(3, i, 0) for i in range(120)] + [row(4, i, 0) for i in range(20)]
    rows += [(5, i, i % 10, i % 10 > 6, mean) for i in range(120)]
    snippets = spark.createDataFrame(rows, "unit long, row long, core long, held boolean, " + W)
    models = spark.createDataFrame([(u, mean) for u in range(1, 6)], "unit long, " + W)
    got = {r.unit: r for r in A.pca_splits(models, snippets, 16, (4, 13), most_new=1).collect()}
    assert got[1].reason == "validated_pca_split" and got[2].reason == "model_budget" and got[2].child is None
    assert got[4].reason == "insufficient_support" and got[5].reason == "no_shape_variation" and got[3].child is None
    assert np.allclose(got[1].parent, shapes[0].ravel(), atol=0.1) and np.allclose(got[1].child, shapes[1].ravel(), atol=0.1)


def test_a_core_on_both_sides_is_an_error(spark):
    rows = spark.createDataFrame([(1, i, 0, i == 0, [0.0] * 64) for i in range(2)], "unit long, row long, core long, held boolean, " + W)
    models = spark.createDataFrame([(1, [0.0] * 64)], "unit long, " + W)
    with pytest.raises(Exception, match="both sides"):
        A.pca_splits(models, rows, 16, (4, 13)).collect()


def test_proposals_and_enrolment(spark):
    rng = np.random.default_rng(3)
    a, b = PEAK.ravel() * 10, rng.normal(size=64)
    near = lambda x: (x + rng.normal(scale=0.02, size=64)).tolist()
    rows = [(7, 100 * i, i // 6, near(a)) for i in range(30)] + [(7, 100 * i + 50, i // 6, near(b)) for i in range(10)] + [(7, 1, 0, near(a)), (7, 60, 0, [0.0] * 64)]
    rows += [(8, 100 * i, i // 6, near(a)) for i in range(30)]
    found = A.proposals(spark.createDataFrame(rows, "anchor long, sample long, core long, " + W), 100_000, 10)
    models = spark.createDataFrame([(8, a.tolist())], "anchor long, " + W)
    got = {(r.anchor, r.proposal): (r.support, r.reason) for r in A.enrolment(found, models, 5).collect()}
    assert got == {(7, 0): (30, "enrolled"), (7, 1): (10, "insufficient_temporal_support"), (8, 0): (30, "consistency_duplicate_or_refractory_rejected")}
    assert {r.reason for r in A.enrolment(found, models.limit(0), 5, most=1).collect()} == {"enrolled", "active_model_budget", "insufficient_temporal_support"}


def test_enrolment_knows_models_of_other_anchors(spark):
    rng = np.random.default_rng(7)
    shape = rng.normal(size=(16, 4))
    members = spark.createDataFrame([(1, 0, 1000 * i, i % 6, (shape + rng.normal(scale=0.01, size=(16, 4))).ravel().tolist()) for i in range(36)], "anchor long, proposal long, sample long, core long, " + W)
    moved = np.zeros((16, 4))
    moved[1:, :3] = shape[:-1, 1:]  # the same shape one sample later, seen from the next anchor
    moved[:, 3] = 0.0
    models = spark.createDataFrame([(2, moved.ravel().tolist())], "anchor long, " + W)
    contacts = spark.createDataFrame([(a, [a, a + 1, a + 2, a + 3]) for a in range(4)], "anchor long, contacts array<long>")
    alone, near = (A.enrolment(members, models, 10, contacts=c).first() for c in (None, contacts))
    assert alone.reason == "enrolled" and alone.likeness == 0.0
    lost = np.sqrt((shape[:15, 1:] ** 2).sum() / (shape**2).sum())
    assert abs(near.likeness - lost) < 0.02 and near.reason == ("consistency_duplicate_or_refractory_rejected" if near.likeness >= 0.85 else "enrolled")
