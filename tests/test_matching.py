import numpy as np

from tidepool.operators import matching
from tidepool.operators.matching import Bank, Couplings, Fit, Residual, Rules


def bank(units=3, times=61, slots=4, seed=1):
    rng = np.random.default_rng(seed)
    shape = np.exp(-0.5 * (np.arange(times) - times // 2) ** 2 / 9.0)
    waves = np.stack([np.outer(shape * np.cos(np.arange(times) * (0.3 + 0.25 * u)), rng.uniform(0.3, 1, slots) * [1, 0.8, 0.6, 0.4]) for u in range(units)]) * 40
    return Bank(waves, np.array([[2 * u + s if 2 * u + s < 8 else -1 for s in range(slots)] for u in range(units)]), np.arange(units))


def planted(b, spikes, n=900, channels=8, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, channels))
    for t, u, a in spikes:
        good = b.contacts[u] >= 0
        x[t - 30 : t + 31, b.contacts[u][good]] += a * b.waves[u][:, good]
    return x


SPIKES = [(100, 0, 1.0), (300, 1, 1.2), (312, 0, 0.9), (500, 2, 1.0), (700, 1, 0.8)]


def test_planted_spikes_are_found_both_ways():
    b = bank()
    x = planted(b, SPIKES)
    for together in (True, False):
        fits, left = matching.match(x, np.ones(8), b, Rules(refit_rounds=2), together)
        assert sorted((f.t, f.unit) for f in fits) == [s[:2] for s in SPIKES]
        assert all(abs(f.amplitude - dict((s[:2], s[2]) for s in SPIKES)[f.t, f.unit]) < 0.1 for f in fits)
        assert left.x.std() < 1.1 and not left.x[:, -1].any()


def test_score_is_that_of_plain_sums():
    b = bank()
    x, noise = planted(b, SPIKES), np.linspace(0.5, 2, 8)
    r = Residual(x, noise, b)
    s, a, g = (v[0] for v in r.score(np.array([1]), np.array([301]), 8))
    w = 1 / noise[b.contacts[1]] ** 2
    seen, model = x[271:332, b.contacts[1]], b.waves[1]
    whole, own = (seen * model * w).sum(), (model**2 * w).sum()
    c = slice(22, 39)
    assert np.isclose(a, whole / own) and np.isclose(g, 2 * a * whole - a * a * own)
    assert np.isclose(s, (seen[c] * model[c] * w).sum() / np.sqrt((model[c] ** 2 * w).sum() * (seen[c] ** 2 * w).sum()))


def test_couplings():
    b = bank()
    fit = lambda t, u, score=0.95, margin=0.5: Fit(t, 0, u, score, -1.0, 1.0, 100.0, margin, 0)
    c = Couplings(Residual(np.zeros((900, 8)), np.ones(8), b), Rules())
    assert c.admit(fit(100, 0)) and c.admit(fit(400, 0))
    assert not c.admit(fit(102, 0)), "overlapping copies of one template disturb each other"
    assert c.admit(fit(100, 2)), "no common contact"
    assert c.admit(fit(159, 0)), "hardly any overlap"
    assert not c.admit(fit(459, 0, margin=0.05)), "unsure fits keep away from others"
    assert c.colour == [0, 0, 0, 1]


def test_short_and_silent_cores():
    b = bank()
    for n in (0, 10, 61):
        assert matching.match(np.zeros((n, 8)), np.ones(8), b)[0] == []


def test_one_identity_has_no_rival():
    b = bank(1)
    twins = Bank(np.concatenate([b.waves, b.waves]), np.concatenate([b.contacts, b.contacts]), np.array([0, 0]))
    x = planted(b, [(200, 0, 1.0)], 400)
    assert [f.t for f in matching.match(x, np.ones(8), twins)[0]] == [200]
    assert matching.match(x, np.ones(8), Bank(twins.waves, twins.contacts, np.array([0, 1])))[0] == []


def test_cores_give_what_the_whole_gives(spark):
    b = bank()
    x = planted(b, SPIKES + [(398, 2, 1.0), (601, 0, 1.0)])
    frames = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "t long, uv array<double>")
    got = matching.match_cores(matching.cut_cores(frames, 200, 120), [1.0] * 8, b).collect()
    assert sorted((r.t, r.unit) for r in got) == sorted([s[:2] for s in SPIKES] + [(398, 2), (601, 0)])
    assert all(r.core == r.t // 200 * 200 for r in got)
