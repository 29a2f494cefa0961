"""What has no SQL against brute force, and stores, journals and streams on small fixtures."""

import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import evidence, preprocess, quality, report, sampling, waveforms
from tidepool.operators.signal import butterworth_band, zero_phase
from tidepool.plans import catalog, recordings
from tidepool.plans.views import Views
from tidepool.sources import files, journal, ledger_store, neuroscope
from tidepool.streaming import assignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


# ---- ledger store ----------------------------------------------------------------------------------


def events_of(spark, rows):
    return spark.createDataFrame([(t, c, a, abs(a) / 2.0) for t, c, a in rows], "sample_index long, channel_index long, amplitude_uv double, snr double")


def noise_of(spark, n=4):
    return spark.createDataFrame([(c, 2.0) for c in range(n)], "channel_index long, noise_uv double")


ROWS = [(5, 0, -20.0), (5, 1, 30.0), (99, 3, 12.0), (100, 0, -14.0), (350, 2, 40.0)]


def test_ledger_round_trip_and_faults(spark, tmp_path):
    path, noise = f"file://{tmp_path}/a", noise_of(spark)
    led = ledger_store.write_ledger(events_of(spark, ROWS), noise, path, 3.0, 0, 400, 100)
    led.verify()
    assert [tuple(r)[:4] for r in led.events().select("row_id", "sample_index", "channel_index", "amplitude_uv").orderBy("row_id").collect()] == [(i, *r) for i, r in enumerate(ROWS)]
    assert [b[3:] for b in led.manifest["blocks"]] == [[0, 3], [3, 4], [4, 4], [4, 5]]
    assert [r.row_id for r in led.query(3.0, start=90, stop=350, channels=[0, 3]).orderBy("row_id").collect()] == [2, 3]
    assert [[r.row_id for r in b] for b in led.batches(6.5, rows=2)] == [[0, 1], [3], [4]]
    assert not ledger_store.files.exists(spark, path + ".partial")
    pruned = led.query(3.0, start=100, stop=200)
    assert len(pruned.inputFiles()) <= 4 and "block_id" in pruned._jdf.queryExecution().toString() and [r.row_id for r in pruned.collect()] == [3]
    for fault in (lambda: led.query(2.0), lambda: led.query(3.0, start=5, stop=4), lambda: led.query(3.0, channels=[9]), led.waveforms):
        with pytest.raises(ValueError):
            fault()
    with pytest.raises(FileExistsError):
        ledger_store.write_ledger(events_of(spark, ROWS), noise, path, 3.0, 0, 400, 100)
    bad = {"outside": [(400, 0, 20.0)], "channel": [(1, 7, 20.0)], "finite": [(1, 0, float("nan"))], "floor": [(1, 0, 6.0)], "unique": [(1, 0, 20.0), (1, 0, 22.0)]}
    for i, (word, rows) in enumerate(bad.items()):
        with pytest.raises(ValueError, match=word):
            ledger_store.write_ledger(events_of(spark, rows), noise, f"file://{tmp_path}/bad{i}", 3.0, 0, 400, 100)
    with pytest.raises(ValueError, match="SNR"):
        ledger_store.write_ledger(events_of(spark, ROWS).withColumn("snr", F.col("snr") * 1.01), noise, f"file://{tmp_path}/b", 3.0, 0, 400, 100)
    text = json.loads(files.read_text(spark, f"{path}/manifest.json"))
    for change in ({"complete": False}, {"version": "9"}, {"rows": 6}, {"waveforms": {}}):
        files.write_text(spark, f"{path}/manifest.json", json.dumps(text | change))
        with pytest.raises(ValueError):
            ledger_store.Ledger(spark, path)
    empty = ledger_store.write_ledger(events_of(spark, ROWS).limit(0), noise, f"file://{tmp_path}/none", 3.0, 0, 400, 100)
    empty.verify()
    assert empty.query(3.0).count() == 0


def test_waveforms_extend_a_ledger(spark, tmp_path):
    rng = np.random.default_rng(2)
    signal = np.round(rng.normal(0, 20, (400, 4)), 2)
    rows = [(t, c, float(signal[t, c])) for t, c in ((0, 1), (1, 3), (57, 0), (200, 2), (398, 1), (399, 0)) if abs(signal[t, c]) > 7]
    led = ledger_store.write_ledger(events_of(spark, rows), noise_of(spark), f"file://{tmp_path}/a", 3.0, 0, 400, 100)
    spec = waveforms.WaveformSpec(((0, 1, -1), (1, 0, 2), (2, 1, 3), (3, 2, -1)), 2, 3, 0.01)
    frames = spark.createDataFrame([(t, signal[t].tolist()) for t in range(400)], "t long, uv array<double>")
    cut = waveforms.extracted(led.events(), frames, spec, 0, 400, 100)
    assert waveforms.anchored(cut, spec).isEmpty()
    stored = cut.select("row_id", "valid_start", "valid_stop", waveforms.encoded(F.col("values"), spec.scale_uv).alias("counts"))
    cores = spark.createDataFrame([(a, a + 100) for a in range(0, 400, 100)], "start long, stop long")
    with pytest.raises(ValueError, match="every block"):
        ledger_store.extend(led, f"file://{tmp_path}/c", spec, stored, cores.limit(3), {})
    more = ledger_store.extend(led, f"file://{tmp_path}/b", spec, stored, cores, {"by": "test"})
    assert more.manifest["provenance"]["parent"] == led.path and len(more.manifest["provenance"]["parent_sha256"]) == 64
    for r in more.fetch(3.0).collect():
        want = [float(signal[t, c]) if 0 <= t < 400 and c >= 0 else None for t in range(r.sample_index - 2, r.sample_index + 4) for c in spec.channel_index[r.channel_index]]
        assert [x is None for x in r.uv] == [x is None for x in want]
        assert [x for x in r.uv if x is not None] == pytest.approx([x for x in want if x is not None], abs=0.006)
    with pytest.raises(Exception, match="frames are missing"):
        waveforms.extracted(led.events(), frames.where("t <> 58"), spec, 0, 400, 100).collect()
    for bad in ((((1, 0), (1, 0)), 1, 1), (((0, 0), (1, 0)), 1, 1), (((0, -1), (1, 5)), 1, 1), (((0,),), -1, 1)):
        with pytest.raises(ValueError):
            waveforms.WaveformSpec(*bad)


# ---- signal -----------------------------------------------------------------------------------------


def test_band_pass_by_core_equals_the_whole(spark):
    x = np.random.default_rng(1).normal(0, 10, (3000, 2))
    grid = spark.createDataFrame([(t, c, float(x[t, c])) for t in range(3000) for c in range(2)], "t long, channel long, v double")
    got = np.zeros_like(x)
    for r in preprocess.band_passed(grid, 20_000.0, 500, 400).collect():
        got[r.t, r.channel] = r.v
    want = zero_phase(butterworth_band(20_000.0, 300.0, 6000.0), x)
    assert np.abs(got - want)[500:2500].max() < 1e-3 and np.abs(got - want).max() < 0.5
    with pytest.raises(ValueError):
        preprocess.band_passed(grid, 700.0, 500, 400)
    for bad in ((0, 1.0, 0, 5, 5), (1, 0.0, 0, 5, 5), (1, 1.0, 3, 3, 5), (1, 1.0, 0, 6, 5)):
        with pytest.raises(ValueError):
            preprocess.check_detector(*bad)


# ---- evidence ---------------------------------------------------------------------------------------


def cosine(a, ac, b, bc, share=0.7):
    common = sorted({c for c in ac if c >= 0} & {c for c in bc if c >= 0})
    a, b = np.array(a).reshape(16, 4), np.array(b).reshape(16, 4)
    x, y = a[:, [ac.index(c) for c in common]], b[:, [bc.index(c) for c in common]]
    if not common or (x**2).sum() < share * (a**2).sum() or (y**2).sum() < share * (b**2).sum():
        return -1.0
    best = -1.0
    for s in range(-2, 3):
        p, q = (x[: 16 - s], y[s:]) if s >= 0 else (x[-s:], y[: 16 + s])
        best = max(best, float((p * q).sum() / np.sqrt((p**2).sum() * (q**2).sum())))
    return best


def test_cross_day_links_by_brute_force(views, spark):
    models = [r for r in recordings._day_models(views).collect()]
    at = {r.channel_index: (r.x, r.y, r.shank) for r in views.channels().collect()}
    want = {}
    for a in models:
        for b in models:
            if b.day_index != a.day_index + 1 or not a.assigned or not b.assigned or at[a.anchor][2] != at[b.anchor][2]:
                continue
            d = np.hypot(at[a.anchor][0] - at[b.anchor][0], at[a.anchor][1] - at[b.anchor][1])
            if d <= 20 and (s := cosine(a.w, a.contacts, b.w, b.contacts)) > 0:
                want[f"p/{a.day}/{a.unit}", f"p/{b.day}/{b.unit}"] = round(s, 6)
    got = {(r.left_id, r.right_id): r.cosine for r in catalog.QUERIES["cross_day_links"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    with pytest.raises(Exception, match="over 2 neighbours"):
        channels = views.channels().select(F.col("channel_index").alias("channel"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "shank")
        evidence.cross_day_links(recordings._day_models(views), channels, 20.0, 2).collect()


def test_template_transforms_by_brute_force(views):
    models = recordings._day_models(views).select("unit", "contacts", "w")
    rows = {r.unit: r for r in models.collect()}
    for r in evidence.canonical(models).collect():
        w = np.array(rows[r.unit].w).reshape(16, 4)
        peak, slot = np.unravel_index(np.abs(w).argmax(), w.shape)
        order = [slot, *[s for s in range(4) if s != slot]]
        want = np.zeros((16, 4))
        for t in range(16):
            if 0 <= t - (8 - peak) < 16:
                want[t] = w[t - (8 - peak), order]
        assert np.allclose(np.array(r.w).reshape(16, 4), want) and r.contacts == [rows[r.unit].contacts[s] for s in order]
    for r in evidence.low_rank(models, 2).collect():
        u, s, v = np.linalg.svd(np.array(rows[r.unit].w).reshape(16, 4), full_matrices=False)
        assert np.allclose(r.w, ((u[:, :2] * s[:2]) @ v[:2]).ravel())
    for r in evidence.energy_masked(models, 0.8).collect():
        e = (np.array(rows[r.unit].w).reshape(16, 4) ** 2).sum(axis=0)
        order = np.argsort(-e, kind="stable")
        keep = set(order[: np.searchsorted(np.cumsum(e[order]), 0.8 * e.sum()) + 1].tolist()) | {0}
        assert r.contacts == [c if i in keep else -1 for i, c in enumerate(rows[r.unit].contacts)]


def test_refractory_by_brute_force(views, spark):
    led = views.ledger().collect()
    taken, kept = defaultdict(list), set()
    for r in sorted(led, key=lambda r: (-abs(r.amplitude_uv), r.sample_index, r.row_id)):
        if all(abs(r.sample_index - t) > 3600 for t in taken[r.user_id]):
            taken[r.user_id].append(r.sample_index)
            kept.add(r.row_id)
    assert {r.id for r in catalog.QUERIES["refractory_kept"](spark, SF).collect()} == kept


def test_labels_need_consistent_links(spark):
    spikes = spark.createDataFrame([(1, "d", 0, 5)], "t long, day string, shard long, unit long")
    links = lambda *x: spark.createDataFrame(x, "day string, shard long, unit long, linked long")
    assert evidence.resolved_labels(spikes, links(("d", 0, 5, 2), ("d", 1, 5, 2)), "p").first().label == "p/d/2"
    with pytest.raises(ValueError):
        evidence.resolved_labels(spikes, links(("d", 0, 5, 2), ("d", 1, 5, 3)), "p")
    with pytest.raises(Exception, match="no link"):
        evidence.resolved_labels(spikes, links(("d", 0, 6, 2)), "p").collect()


# ---- reports ----------------------------------------------------------------------------------------


def test_sorting_scores_by_brute_force(spark):
    rng = np.random.default_rng(4)
    truth = sorted((int(t), int(u)) for u in range(6) for t in rng.choice(9000, 40 + 10 * u, replace=False))
    found = sorted((t + int(rng.integers(-3, 4)), u if u < 4 else 4) for t, u in truth if rng.random() < (0.95 if u < 3 else 0.6))
    frame = lambda x: spark.createDataFrame(x, "t long, label long")
    got = report.score_sorting(frame(truth), frame(found), 2, 4).first()
    a, b = defaultdict(list), defaultdict(list)
    for t, u in truth:
        a[u].append(t)
    for t, u in found:
        b[u].append(t)
    match = {(u, w): quality.two_pointer(np.array(a[u]), np.array(b[w]), 2)[0] for u in a for w in b}
    iou = np.array([[len(match[u, w]) / (len(a[u]) + len(b[w]) - len(match[u, w])) for w in sorted(b)] for u in sorted(a)])
    links = [(i, sorted(b)[j]) for i, j in quality.assignment(iou) if iou[i, j] > 0]
    good = {u for u, w in links if iou[u, sorted(b).index(w)] >= 0.8}
    hit = {(t, u) for (t0, u0), (t1, u1) in zip(truth, truth[1:], strict=False) if t1 - t0 <= 4 and u0 != u1 for t, u in ((t0, u0), (t1, u1))}
    caught = sum((a[u][i], u) in hit for u, w in links for i in match[u, w])
    tp, middle = sum(len(match[x]) for x in links), (truth[0][0] + truth[-1][0]) / 2
    assert (got.units, got.found_units, got.true_positives, got.recovered_units) == (6, len(b), tp, len(good))
    assert got.precision == pytest.approx(tp / len(found)) and got.recall == pytest.approx(tp / len(truth))
    assert (got.rare_units, got.rare_recovered) == (sum(len(x) <= 50 for x in a.values()), sum(len(a[u]) <= 50 for u in good))
    assert (got.late_units, got.collision_spikes, got.collision_recovered) == (sum(x[0] > middle for x in a.values()), len(hit), caught)
    assert got.split_units == sum(sum(len(match[u, w]) >= 0.2 * len(a[u]) for w in b) >= 2 for u in a)
    assert got.merged_units == sum(sum(len(match[u, w]) >= 0.2 * len(b[w]) for u in a) >= 2 for w in b)
    lost = Counter((u, t) for u, w in links for i, t in enumerate(a[u]) if i not in set(match[u, w].tolist()))
    assert Counter(map(tuple, report.missed(frame(truth), frame(found), spark.createDataFrame(links, "label long, label2 long"), 2).select("label", "t").collect())) == lost
    none = report.score_sorting(frame(truth), frame(found).limit(0), 2).first()
    assert (none.true_positives, none.precision, none.recall, none.units) == (0, 0.0, 0.0, 6)


def test_quota_floor_drops_when_the_budget_is_small():
    assert sum(sampling.allocate_quotas([50, 50, 50], 4, 4)) == 4


def test_ledger_sample(views, spark):
    led = recordings._snr(views)
    chosen, even, told = sampling.sample_ledger(led, views.channels(), 200, 7, *views.ledger().agg(F.min("sample_index"), F.max("sample_index") + 1).first(), 5)
    rows = chosen.collect()
    assert len(rows) == told["selected"] == 200 == even.count() and told["depth_axis"] == "y"
    assert sum(r.weight for r in rows) == pytest.approx(told["rows"])
    again, _, _ = sampling.sample_ledger(led.repartition(5), views.channels(), 200, 7, *views.ledger().agg(F.min("sample_index"), F.max("sample_index") + 1).first(), 5)
    assert {r.row_id for r in again.collect()} == {r.row_id for r in rows}
    d = spark.createDataFrame([(1, 0, 5, 2), (1, 0, 5, 1), (1, 0, 6, 3), (1, 1, 7, 4)], "unit long, win long, sample long, v long")
    assert sorted((r.sample, r.v) for r in sampling.window_evidence(d, "unit", "win", "sample", 9).collect()) == [(5, 1), (6, 3), (7, 4)]


# ---- rolling assignment -----------------------------------------------------------------------------


def bank_and_events(spark, n=60):
    rng = np.random.default_rng(8)
    shapes = rng.normal(0, 1, (3, 16, 4))
    bank = spark.createDataFrame([(u, 10 * u, [10 * u + s for s in range(4)], shapes[u].ravel().tolist()) for u in range(3)], "unit long, anchor long, contacts array<long>, w array<double>")
    rows = []
    for i in range(n):
        u = int(rng.integers(0, 3))
        w = (shapes[u] * (1 + i / 100) + rng.normal(0, 0.03, (16, 4))).ravel().tolist()
        rows.append((i, 100 * i + int(rng.integers(0, 3)), 10 * u, [10 * u + s for s in range(4)], w))
    events = spark.createDataFrame(rows, "row_id long, t long, channel long, contacts array<long>, w array<double>")
    patches = spark.createDataFrame([(10 * u, 10 * u) for u in range(3)], "channel long, neighbour long")
    return bank, events, patches, rows, shapes


def test_rolling_assignment(spark, tmp_path):
    bank, events, patches, rows, shapes = bank_and_events(spark)
    begin = lambda name: assignment.RollingTemplates.begin(spark, f"file://{tmp_path}/{name}", bank, "probe", 2000, 2)
    whole = begin("whole")
    assert assignment.sort_epochs(events, whole, f"file://{tmp_path}/out", patches, 61) == 3
    got = {r.row_id: r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert [got[r[0]].unit for r in rows] == [r[2] // 10 for r in rows] and all(r.teaches and r.isolated for r in got.values())
    # the window's two bins are those of samples 2000 to 5999, weighted by their spikes
    for r in whole.snapshot().collect():
        mine = [np.array(x[4]) for x in rows if x[2] == r.anchor and 2000 <= x[1] < 6000]
        assert np.allclose(r.last, np.mean(mine, axis=0)) and r.assigned == sum(x[2] == r.anchor for x in rows)
    # two runs, the second of which goes on where the first stopped, end the same
    parts = begin("parts")
    assignment.sort_epochs(events.where("t < 2000"), parts, f"file://{tmp_path}/out2", patches, 61)
    parts = assignment.RollingTemplates(spark, f"file://{tmp_path}/parts")
    assignment.sort_epochs(events.where("t >= 2000"), parts, f"file://{tmp_path}/out2", patches, 61)
    assert {r.unit: r.assigned for r in parts.snapshot().collect()} == {r.unit: r.assigned for r in whole.snapshot().collect()}
    assert all(np.allclose(a.last, b.last) for a, b in zip(parts.snapshot().orderBy("unit").collect(), whole.snapshot().orderBy("unit").collect(), strict=True))
    with pytest.raises(ValueError, match="late"):
        assignment.sort_epochs(events.where("t < 500"), parts, f"file://{tmp_path}/out2", patches, 61)
    with pytest.raises(ValueError, match="stale"):
        parts.commit(0, 100, None, "probe", parts.meta["version"])
    with pytest.raises(ValueError, match="stale"):
        parts.commit(90_000, 90_100, None, "other", parts.meta["version"])
    with pytest.raises(ValueError, match="stale"):
        parts.commit(90_000, 90_100, None, "probe", parts.meta["version"] - 1)
    summary = spark.createDataFrame([(0, shapes[0].ravel().tolist(), 3, 1.0, 3)], "unit long, mean array<double>, n long, confidence double, assigned long")
    with pytest.raises(ValueError, match="border"):
        parts.commit(91_000, 93_000, summary, "probe", parts.meta["version"])
    before = {r.unit: r.last for r in parts.snapshot().collect()}
    parts.commit(99_000, 99_001, None, "probe", parts.meta["version"])  # all bins are gone, the shapes stay
    assert {r.unit: r.last for r in parts.snapshot().collect()} == before and parts.snapshot().where(F.size("bins") > 0).isEmpty()


def test_assignment_stream(spark, tmp_path):
    bank, events, patches, rows, _ = bank_and_events(spark, 30)
    assignment.RollingTemplates.begin(spark, f"file://{tmp_path}/s/templates", bank, "probe", 2000, 2)
    events.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    assignment.sort_stream(stream, f"file://{tmp_path}/s", patches, 61).awaitTermination(300)
    got = {r.row_id: r.unit for r in spark.read.parquet(f"file://{tmp_path}/s/assigned").collect()}
    assert got == {r[0]: r[2] // 10 for r in rows}


def test_shifted_match_by_brute_force(views, spark):
    models = recordings._day_models(views).limit(30)
    left = models.select(F.col("unit").alias("a"), F.col("w").alias("lw"), F.col("contacts").alias("lc"))
    right = models.select(F.col("unit").alias("b"), F.transform("w", lambda x, i: F.when(i != 17, x)).alias("rw"), F.col("contacts").alias("rc"))
    rows = {r.unit: r for r in models.collect()}
    met = left.join(right, F.array_intersect("lc", "rc") != F.array().cast("array<bigint>")).withColumn("m", assignment.shifted_match(F.col("lw"), F.col("lc"), F.col("rw"), F.col("rc"), valid=0.5))
    for r in met.collect():
        a, b = np.array(r.lw).reshape(16, 4), np.array([np.nan if x is None else x for x in r.rw]).reshape(16, 4)
        common = sorted(set(r.lc) & set(r.rc))
        x, y = a[:, [r.lc.index(c) for c in common]], b[:, [r.rc.index(c) for c in common]]
        best = (-1.0, None, 0)
        if (x**2).sum() >= 0.7 * (a**2).sum() and np.nansum(y**2) >= 0.7 * np.nansum(b**2):
            for s in range(-2, 3):
                p, q = (x[: 16 - s], y[s:]) if s >= 0 else (x[-s:], y[: 16 + s])
                ok = np.isfinite(q)
                score = float((p[ok] * q[ok]).sum() / np.sqrt((p[ok] ** 2).sum() * (q[ok] ** 2).sum()))
                if score > best[0]:
                    best = (score, float((p[ok] * q[ok]).sum() / (p[ok] ** 2).sum()), s)
        assert r.m.score == pytest.approx(best[0]) and r.m.shift == best[2] and (best[1] is None or r.m.amplitude == pytest.approx(best[1]))
    assert rows


# ---- metadata and journal ---------------------------------------------------------------------------

XML = b"""<parameters><acquisitionSystem><nBits>16</nBits><nChannels>5</nChannels><samplingRate>20000</samplingRate><offset>0</offset></acquisitionSystem>
<anatomicalDescription><channelGroups><group><channel skip="0">0</channel><channel skip="1">1</channel></group><group><channel>3</channel><channel>2</channel></group></channelGroups></anatomicalDescription></parameters>"""


def test_xml_and_probes(spark):
    meta = neuroscope.read_xml(XML, 0.195)
    assert (meta["groups"], meta["bad"], meta["rate"]) == ([[0, 1], [3, 2]], [1, 4], 20000.0)
    assert neuroscope.generate_probe(meta) == [(0, 180.0, -20.0, 0), (2, 420.0, -40.0, 1), (3, 380.0, -20.0, 1)]
    assert neuroscope.configure_probe(meta, [3, 0, 1], [1.0, 2.0, 3.0], [0.0, 0.0, 0.0]) == [(3, 1.0, 0.0, 1), (0, 2.0, 0.0, 0)]
    assert neuroscope.probe_frame(spark, neuroscope.generate_probe(meta)).count() == 3
    for bad in (XML.replace(b"16", b"12"), XML.replace(b"<channel>3</channel>", b"<channel>0</channel>"), XML.replace(b"parameters", b"settings"), b"<!DOCTYPE x>" + XML, b"<parameters>", XML.replace(b">2</channel>", b">9</channel>")):
        with pytest.raises(ValueError):
            neuroscope.read_xml(bad)
    with pytest.raises(ValueError):
        neuroscope.configure_probe(meta, [3, 3], [1.0, 2.0], [0.0, 0.0])


def test_journal_resumes_and_carries_models(spark, tmp_path):
    (tmp_path / "m.json").write_text("{}")
    (tmp_path / "a.dat").write_bytes(b"abc")
    record = journal.source_record(spark, f"file://{tmp_path}/m.json", f"file://{tmp_path}/a.dat")
    assert record["sources"][0]["bytes"] == 3 and len(record["manifest_sha256"]) == 64
    run = journal.RunJournal(spark, f"file://{tmp_path}/run", record, {"a": 1})
    planned = [(0, 100), (100, 200), (200, 250)]
    calls = []

    def sort(start, stop, models):
        calls.append((start, [r.n for r in models.collect()]))
        return {"spikes": spark.createDataFrame([(start, 1)], "t long, unit long")}, models.select((F.col("n") + 1).alias("n"))

    seed = spark.createDataFrame([(0,)], "n long")
    assert journal.run_shards(run, "p", planned[:2], seed, sort) == 2
    with pytest.raises(FileExistsError):
        journal.RunJournal(spark, f"file://{tmp_path}/run", record, {"a": 1})
    with pytest.raises(ValueError):
        journal.RunJournal(spark, f"file://{tmp_path}/run", record, {"a": 2}, resume=True)
    again = journal.RunJournal(spark, f"file://{tmp_path}/run", record, {"a": 1}, resume=True)
    assert again.open([("p", *x) for x in planned]) == [("p", 200, 250)]
    assert journal.run_shards(again, "p", planned, seed, sort) == 1
    assert calls == [(0, [0]), (100, [1]), (200, [2])]
    assert sorted(r.t for r in again.table("p", "spikes", planned).collect()) == [0, 100, 200]
    assert again.latest_models("p", 199, planned)[0] == 100 and again.latest_models("p", 50, planned) is None
    (tmp_path / "copy").mkdir()
    (tmp_path / "copy" / "a.dat").write_bytes(b"abd")
    assert files.copies_differ(spark, [f"file://{tmp_path}/a.dat"], [f"file://{tmp_path}/copy/a.dat"]).count() == 1
    assert files.copies_differ(spark, [f"file://{tmp_path}/a.dat"], [f"file://{tmp_path}/a.dat"]).isEmpty()


def test_unit_window_sample_settles_equal_times_by_row(spark, tmp_path):
    rows = [(i, 1704067205, 7) for i in range(40)] + [(40 + i, 1704067300 + i, 8) for i in range(5)]
    want = None
    for n, order in ((1, "event_id"), (7, "event_id desc")):
        at = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, "event_id long, at long, user_id long").selectExpr("event_id", "timestamp_seconds(at) as ts", "user_id", "'click' as event_type", "1.0D as value").orderBy(F.expr(order) if " " not in order else F.desc("event_id")).coalesce(1).write.parquet(f"{at}/events.parquet")
        got = sorted(r.row_id for r in catalog.QUERIES["unit_window_sample"](spark, at).collect())
        assert got[:3] == [0, 1, 2] and len(got) == 6
        assert want is None or got == want
        want = got


def test_novelty_sample_settles_equal_events_by_row(spark, tmp_path):
    rows = [(i, 1704067205, 7 + 32 * (i % 3)) for i in range(40)]
    for n in (1, 2):
        at = f"{tmp_path}/{n}"
        events = spark.createDataFrame(rows, "event_id long, at long, user_id long").selectExpr("event_id", "timestamp_seconds(at) as ts", "user_id", "'click' as event_type", "1.0D as value")
        events.orderBy(F.asc("event_id") if n == 1 else F.desc("event_id")).coalesce(1).write.parquet(f"{at}/events.parquet")
        assert sorted(r.row_id for r in catalog.QUERIES["novelty_sample"](spark, at).collect()) == list(range(16))


def test_decoded_waveforms_of_large_sums(spark, tmp_path):
    from compare import connect, differences

    views = Views(spark, SF)
    views.table("lineitem").withColumn("l_quantity", F.col("l_quantity") * 1000).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = connect(SF)
    con.execute(f"create or replace view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert differences(catalog.QUERIES["decoded_waveforms"](spark, str(tmp_path)), con, catalog.ORACLES["decoded_waveforms"]) is None
    with pytest.raises(Exception, match="exceeds int16"):
        spark.range(1).select(waveforms.encoded(F.array(F.lit(32767.6)), 1.0)).collect()


def test_pair_cosine_ties_are_of_rounded_scores(spark, tmp_path):
    from compare import connect, differences

    rng = np.random.default_rng(3)
    rows = []
    for i in range(6):  # of period 4 but for a trace: shifts score alike to six digits, the higher one better beyond
        w = np.tile(rng.normal(size=4), 16) + rng.normal(size=64) * 1e-6
        rows.append((32 * i, [float(np.float32(x)) for x in w], i))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(SF)
    con.execute(f"create or replace view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert differences(catalog.QUERIES["pair_cosine_five_shift"](spark, str(tmp_path)), con, catalog.ORACLES["pair_cosine_five_shift"]) is None


@pytest.mark.parametrize("name", ["best_two_templates", "assigned_events", "best_per_identity"])
def test_templates_are_chosen_without_a_table_of_all_scores(spark, tmp_path, monkeypatch, name):
    from compare import connect, differences
    from tidepool.operators import templates

    seen = []
    real = templates._blocked
    monkeypatch.setattr(templates, "_blocked", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(templates, "CELLS", 1000)
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=64).astype("f4").tolist() for _ in range(60)]  # many equal ones
    spark.createDataFrame([(i, vectors[i * 7 % 60] if i % 3 else vectors[0], i % 4) for i in range(300)], "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(SF)
    con.execute(f"create or replace view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert differences(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name]) is None
    assert len(seen) == 1 and seen[0].count() <= 15 * 8 * (4 if name == "best_per_identity" else 2)


@pytest.mark.parametrize("share", [2, 1 << 11])
def test_best_of_many_identities_is_handed_on_in_pieces(spark, tmp_path, monkeypatch, share):
    import pyarrow as pa

    from compare import connect, differences
    from tidepool.operators import templates

    seen, runs = [], []
    blocked, met = templates._blocked, templates.met
    monkeypatch.setattr(templates, "_blocked", lambda *a: seen.append(blocked(*a)) or seen[-1])
    monkeypatch.setattr(templates, "met", lambda *a: runs.append(a[3]) or met(*a))
    monkeypatch.setattr(templates, "SHARE", share, raising=False)
    rng = np.random.default_rng(7)
    vectors = [rng.normal(size=64).astype("f4").tolist() for _ in range(60)]  # many equal ones
    spark.createDataFrame([(i, vectors[i * 7 % 60] if i % 3 else vectors[0], i % 61 or None) for i in range(300)], "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(SF)
    con.execute(f"create or replace view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = catalog.QUERIES["best_per_identity"](spark, str(tmp_path))
    assert differences(found, con, catalog.ORACLES["best_per_identity"]) is None
    assert found.count() == 15 * 61
    if share > 2:
        assert seen[0].count() == 15 * 61  # an identity's templates met in one block
    monkeypatch.setattr(templates, "PIECE", 100)
    e = pa.array([{"qu": 1000 + i, "qw": vectors[i]} for i in range(50)])
    b = pa.array([{"bu": i, "bw": vectors[i % 60], "identity": i} for i in range(300)])
    sizes = [x.num_rows for x in runs[0]((0,), e, b)]
    assert sum(sizes) == 50 * 300 and max(sizes) <= 100


def test_assignment_tries_every_template_of_an_anchor(spark):
    from tidepool.operators.templates import contact_matches

    rng = np.random.default_rng(6)
    shapes = rng.normal(size=(700, 64)).astype("f4").astype(float)
    shapes[500:520] = shapes[:20]  # equal ones: the higher unit stays
    bank = [(u, 5 if u % 7 else 6, [5, 6, 7, 8] if u % 7 else [6, 7, 8, -1], shapes[u].tolist()) for u in range(700)]
    rows = []
    for e in range(24):
        w = (shapes[e * 25] * 0.9 + rng.normal(size=64) * 0.3).tolist()
        if e % 5 == 0:
            w[17] = None
        rows.append((e, e, 5, [5, 6, 7, 8] if e % 3 else [6, 5, 4, -1], w))
    events = spark.createDataFrame(rows, "row_id long, t long, channel long, contacts array<long>, w array<double>")
    state = spark.createDataFrame(bank, "unit long, anchor long, contacts array<long>, last array<double>")
    got = {r.row_id: r for r in assignment.assigned(events, state, 0.3, 0.01).collect()}
    lw, lc = shapes.reshape(700, 16, 4), np.array([b[2] for b in bank])
    found = 0
    for e, _, _, contacts, w in rows:
        near = [u for u in range(700) if bank[u][1] in contacts]
        rw = np.tile(np.array([np.nan if x is None else x for x in w]).reshape(16, 4), (len(near), 1, 1))
        score, amplitude, shift = contact_matches(lw[near], lc[near], rw, np.tile(contacts, (len(near), 1)), 2, 0.7, 0.9, False)
        best = sorted(((score[n], u, amplitude[n], shift[n]) for n, u in enumerate(near) if score[n] > -1), reverse=True)
        if not best:
            assert got[e].score is None and got[e].unit == -1
            continue
        runner = best[1][0] if len(best) > 1 else 0.0
        gap = best[0][0] - max(runner, 0.0)
        assert (got[e].score, got[e].runner, got[e].amplitude, got[e].shift) == pytest.approx((best[0][0], runner, best[0][2], best[0][3]))
        assert got[e].unit == (best[0][1] if best[0][0] >= 0.3 and gap >= 0.01 else -1)
        found += got[e].unit >= 0
    assert found >= 10


def rows_written(df):
    """Rows that went through exchanges when df was made."""
    df.count()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    df.collect()
    stack = [plan]
    while stack:
        p = stack.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            stack.append(p.plan())
        else:
            if p.nodeName() == "Exchange":
                total += p.metrics().apply("shuffleRecordsWritten").value()
            stack += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_shared_contacts_send_templates_not_pairs(spark, tmp_path, monkeypatch):
    from compare import connect, differences
    from tidepool.operators import templates

    monkeypatch.setattr(templates, "PIECE", 100)
    rng = np.random.default_rng(8)
    spark.createDataFrame([(i * 8 + i % 3, rng.normal(size=64).astype("f4").tolist(), 0) for i in range(250)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(SF)
    con.execute(f"create or replace view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = catalog.QUERIES["shared_contact_cosine"](spark, str(tmp_path))
    assert differences(df, con, catalog.ORACLES["shared_contact_cosine"]) is None and df.count() > 3000
    assert 0 < rows_written(df) <= 250 * 6


def test_spatial_pairs_send_units_not_pairs(spark, monkeypatch):
    from tidepool.operators import geometry

    monkeypatch.setattr(geometry, "PIECE", 500)
    rng = np.random.default_rng(9)
    at = np.concatenate([rng.uniform(-40, 40, (150, 2)), [[0.0, 0.0], [9.0, 12.0], [15.0, 0.0], [15.0, 1e-6]]])
    units = spark.createDataFrame([(i, float(x), float(y), i % 2) for i, (x, y) in enumerate(at)], "id long, x double, y double, probe int")
    df = geometry.spatial_pairs(units, units, 15.0, 100)
    want = {(i, j) for i in range(len(at)) for j in range(len(at)) if i % 2 == j % 2 and ((at[i] - at[j]) ** 2).sum() <= 225}
    got = df.collect()
    assert len(got) == len(want) and {(r.left, r.right) for r in got} == want and len(want) > 1000
    assert all(r.probe == r.left % 2 and r.distance <= 15 for r in got)
    assert 0 < rows_written(df) <= len(at) * (1 + 9 * geometry.SLICES)
    dense = units.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0)).withColumn("probe", F.lit(0))
    assert rows_written(geometry.spatial_pairs(dense, dense, 15.0, 200)) <= len(at) * (1 + 9 * geometry.SLICES) < len(at) ** 2
    with pytest.raises(Exception, match="over 100 neighbours"):
        geometry.spatial_pairs(dense, dense, 15.0, 100).collect()


@pytest.mark.parametrize("rows", [40, 20_000])
def test_one_to_one_match_sends_meetings_not_whole_labels(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "ROWS", rows)
    rng = np.random.default_rng(rows)
    side = lambda n, labels: [(int(t), int(k)) for t, k in zip(rng.integers(-300, 3000, n), rng.integers(0, labels, n), strict=True)]
    truth, predicted = side(700, 5), side(600, 6)
    truth += truth[:50] * 2  # equal events
    truth += [(t, 9) for t in range(0, 900, 2)]  # a chain over blocks
    frame = lambda rows: spark.createDataFrame(rows, "t long, label long")
    df = quality.matched_pairs(frame(truth + [(None, 1), (5, None)]), frame(predicted), 2)
    want = {}
    for a in {k for _, k in truth}:
        for b in {k for _, k in predicted}:
            i, _ = quality.two_pointer(np.sort([t for t, k in truth if k == a]), np.sort([t for t, k in predicted if k == b]), 2)
            if len(i):
                want[a, b] = len(i)
    assert {(r.label, r.label2): r.matched for r in df.collect()} == want
    met = sum(abs(t - u) <= 2 for t, _ in truth for u, _ in predicted)
    assert 0 < rows_written(df) <= 1.1 * (len(truth) + len(predicted)) + met
