"""More queries over the views: preprocessing, waveforms, evidence, reports, samplers and rolling assignment, with their SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..operators import evidence as D
from ..operators import ledger as L
from ..operators import preprocess as P
from ..operators import quality as Q
from ..operators import report as R
from ..operators import sampling as S
from ..operators import session as E
from ..operators import waveforms as WF
from ..sources import files, ledger_store
from ..streaming import assignment as RA
from .catalog import FIRST, SEED, _shown, _snr, query
from .views import Views, with_views

CORE = 256
CHANNELS = "chans as (select range as channel, range // 4 as shank, range = 3 as bad from range(8))"
GRID = with_views("select 1", "grid").removesuffix(" select 1")


def _channels(v: Views) -> DataFrame:
    c = F.col("id")
    return v.spark.range(8).select(c.alias("channel"), F.floor(c / 4).alias("shank"), (c == 3).alias("bad"))


def grid_query(sql: str, *ctes: str):
    """A query over the grid whose SQL brings its own tables along."""
    return query(", ".join([GRID, CHANNELS, *ctes]) + " " + sql)


# ---- preprocessing --------------------------------------------------------------------------------


@grid_query("select t, channel, round(v * case when channel % 2 = 0 then 0.195 else 0.2 end + case when channel % 2 = 0 then 0 else 1 end, 6) as v from grid")
def channel_calibration(v):
    even = v.spark.range(8).where("id % 2 = 0").select(F.col("id").alias("channel"), F.lit(0.195).alias("gain"), F.lit(0.0).alias("offset"))
    return _shown(P.calibrated(v.grid(), even, 0.2, 1.0), "v")


REFERENCED = "ref as (select g.t, g.channel, g.v - case when count(*) filter (not bad) over w >= 2 then median(case when not bad then g.v end) over w else 0 end as v from grid g join chans using (channel) window w as (partition by t, shank))"


@grid_query("select t, channel, v from ref", REFERENCED)
def shank_median_reference(v):
    return P.shank_reference(v.grid(), _channels(v))


NOISE = f"strided as (select t // {CORE} as core, channel, v from ref where t % {CORE} % 8 = 0), noise as (select core, channel, greatest(median(abs(v - m)) / 0.67448975, 0.01) as noise from (select *, median(v) over (partition by core, channel) as m from strided) group by 1, 2)"


@grid_query("select core, channel, round(noise, 6) as noise from noise", REFERENCED, NOISE)
def strided_core_noise(v):
    return _shown(P.strided_noise(P.shank_reference(v.grid(), _channels(v)), CORE, CORE // 8), "noise")


QUALITY = f"""shares as (select core, channel, avg((abs(v) >= 700)::int) as saturated, coalesce(avg((v = p)::int), 1) as flat, avg((v = 0)::int) as zero from (select t // {CORE} as core, channel, v, lag(v) over (partition by t // {CORE}, channel order by t) as p from grid) group by 1, 2),
flagged as (select s.*, n.noise, (saturated > 1e-4)::int | 2 * (flat > 0.98)::int | 4 * (zero > 0.99)::int | 8 * (noise > greatest(5 * median(noise) over (partition by core, shank), 100.0))::int | 32 * bad::int as flags from shares s join noise n using (core, channel) join chans using (channel)),
instants as (select r.t // {CORE} as core, r.t, count(*) as n, avg((abs(r.v) > 10 * f.noise)::int) as loud from ref r join flagged f on f.core = r.t // {CORE} and f.channel = r.channel and f.flags = 0 group by 1, 2),
quality as (select core, channel, saturated, flat, zero, noise, (flags | 16 * coalesce(artifact, false)::int)::bigint as flags, coalesce(artifact, false) or avg((flags <> 0)::int) over (partition by core) > 0.2 as interval_bad from flagged left join (select core, bool_or(n >= 8 and loud > 0.3) as artifact from instants group by 1) using (core))"""


def _quality(v: Views) -> tuple[DataFrame, DataFrame]:
    grid, channels = v.grid(), _channels(v)
    signal = P.shank_reference(grid, channels)
    return signal, P.assessed(grid, signal, channels, CORE, 700.0, CORE // 8)


@grid_query("select core, channel, round(saturated, 6) as saturated, round(flat, 6) as flat, round(zero, 6) as zero, round(noise, 6) as noise, flags, interval_bad from quality", REFERENCED, NOISE, QUALITY)
def core_quality_flags(v):
    return _shown(_quality(v)[1], "saturated", "flat", "zero", "noise")


@grid_query(f"select r.t, r.channel, case when q.flags & 239 = 0 then r.v else 0 end as v, q.flags & 239 = 0 as usable from ref r join quality q on q.core = r.t // {CORE} and q.channel = r.channel", REFERENCED, NOISE, QUALITY)
def masked_channels(v):
    signal, quality = _quality(v)
    return P.masked(signal, quality, CORE).select("t", "channel", "v", (F.col("noise") != float("inf")).alias("usable"))


@grid_query(f"select t, channel, v from ref where t // {CORE} not in (select core from quality where interval_bad)", REFERENCED, NOISE, QUALITY)
def artifact_free_rows(v):
    signal, quality = _quality(v)
    return P.without_artifacts(signal, quality, CORE)


@query()
def band_passed_cores(v):
    return _shown(P.band_passed(v.grid(), 20_000.0, CORE, 128), "v", digits=4)


KERNELS = [[1.0, 2.0, 1.0], [-1.0, 0.0, 1.0], [1.0, -2.0, 1.0]]


def _kernel(k: list[float]) -> str:
    return f"{k[0]} * coalesce(lag(v) over w, 0) + {k[1]} * v + {k[2]} * coalesce(lead(v) over w, 0)"


CORRELATED = "corr as (" + " union all ".join(f"select t, channel, {i} as kernel, {_kernel(k)} as v from grid window w as (partition by channel order by t)" for i, k in enumerate(KERNELS)) + ")"
WEIGHTS = "weights as (select f as filter, c as choice, ch as channel, (1 + (f * 3 + c * 5 + ch) % 4) / 4.0 as w from (select range as f from range(4)) cross join (select range as c from range(2)) cross join (select range as ch from range(8)) where ch // 2 = f)"
SCORED = "scored as (select t, filter, choice * 1000 + kernel as choice, sum((w * v)::decimal(38, 9))::double as score from corr join weights using (channel) group by all), best as (select t, filter, arg_max(score, struct_pack(a := abs(score), c := -choice)) as score, arg_max(choice, struct_pack(a := abs(score), c := -choice))::bigint as choice from scored group by 1, 2)"


@grid_query("select t, channel, kernel::bigint as kernel, round(v, 6) as v from corr", CORRELATED)
def temporal_correlations(v):
    return _shown(P.correlated(v.grid(), KERNELS, CORE), "v")


def _best_scores(v: Views) -> DataFrame:
    f, c, ch = F.col("filter"), F.col("choice"), F.col("channel")
    pairs = v.spark.range(64).select(F.floor(F.col("id") / 16).alias("filter"), (F.floor(F.col("id") / 8) % 2).alias("choice"), (F.col("id") % 8).alias("channel")).where(F.floor(ch / 2) == f)
    weights = pairs.withColumn("w", (1 + (f * 3 + c * 5 + ch) % 4) / 4.0)
    return P.signed_maxima(P.template_scores(P.correlated(v.grid(), KERNELS, CORE), weights))


@grid_query("select t, filter, round(score, 6) as score, choice from best", CORRELATED, WEIGHTS, SCORED)
def signed_template_maxima(v):
    return _shown(_best_scores(v), "score")


@grid_query("select b.t, b.filter, round(max(n.score), 6) as most from best b join best n on n.t = b.t and abs(n.filter - b.filter) <= 1 group by 1, 2", CORRELATED, WEIGHTS, SCORED)
def neighbour_template_maxima(v):
    near = v.spark.range(16).select(F.floor(F.col("id") / 4).alias("filter"), (F.col("id") % 4).alias("neighbour")).where("abs(filter - neighbour) <= 1")
    return _shown(P.neighbour_maxima(_best_scores(v), near), "most")


@grid_query("select t, round(max(x), 6) as best, arg_max(channel, struct_pack(x := x, c := -channel)) as unit from (select t, channel, case when t between (select min(t) + 20 from grid) and (select max(t) - 20 from grid) then greatest(v - 100, 0.0) ** 2 / (1 + channel) else 0 end as x from grid) group by t")
def learned_unit_maxima(v):
    scores = v.grid().select("t", F.col("channel").alias("unit"), (F.col("v") - 100).alias("b"))
    ends = scores.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()  # one row
    norms = v.spark.range(8).select(F.col("id").alias("unit"), (F.col("id") + 1.0).alias("norm"))
    return _shown(P.learned_maxima(scores, norms, ends.a or 0, ends.b or 0, 20), "best")


@grid_query("select g.t, g.channel as unit, round(g.v - coalesce(x, 0), 6) as b from grid g left join (select e.t + l.lag as t, u.unit, sum((e.v / 100 * (1 - abs(l.lag) / 4.0) / (1 + abs(u.unit - e.channel)))::decimal(38, 9))::double as x from (select * from grid where v > 300) e cross join (select range - 3 as lag from range(7)) l cross join (select range as unit from range(8)) u group by 1, 2) s on s.t = g.t and s.unit = g.channel")
def correlation_subtraction(v):
    scores = v.grid().select("t", F.col("channel").alias("unit"), F.col("v").alias("b"))
    events = v.grid().where("v > 300").select("t", F.col("channel").alias("unit"), (F.col("v") / 100).alias("amplitude"))
    table = v.spark.range(8 * 8 * 7).select((F.col("id") % 8).alias("unit"), (F.floor(F.col("id") / 8) % 8).alias("other"), (F.floor(F.col("id") / 64) - 3).alias("lag"))
    table = table.withColumn("c", (1 - F.abs("lag") / 4.0) / (1 + F.abs(F.col("unit") - F.col("other"))))
    return _shown(P.subtracted(scores, events, table, 3), "b")


# ---- ledger store and waveforms --------------------------------------------------------------------


def _stored(v: Views) -> ledger_store.Ledger:
    """A ledger of the view's events above the floor, one per sample and channel, written below the shared folder."""
    import uuid

    led = v.ledger()
    noise = L.robust_noise(led)
    events = L.first_observation(L.with_snr(led, noise).where("snr > 0.5"), ["sample_index", "channel_index"], ["row_id"]).select("sample_index", "channel_index", "amplitude_uv", "snr")
    span = led.agg(F.min("sample_index").alias("a"), F.max("sample_index").alias("b")).first()  # one row
    return ledger_store.write_ledger(events, noise, f"{files.shared_folder(v.spark)}/tidepool/ledger-{uuid.uuid4().hex}", 0.5, span.a, span.b + 1, 86400)


ONCE = "once as (select sample_index, channel_index, amplitude_uv, snr, row_number() over (order by sample_index, channel_index) - 1 as row_id from (select *, row_number() over (partition by sample_index, channel_index order by row_id) r from snr where snr > 0.5) where r = 1)"


@query(with_views("select 1", "snr").removesuffix(" select 1") + f", {ONCE} select row_id, sample_index, channel_index, amplitude_uv, snr from once where snr > 1 and sample_index >= {FIRST + 100000} and sample_index < {FIRST + 300000} and amplitude_uv < 0")
def ledger_write_read(v):
    found = _stored(v).query(1.0, start=FIRST + 100000, stop=FIRST + 300000, polarity="neg")
    return _shown(found.select("row_id", "sample_index", "channel_index", "amplitude_uv", "snr"))


@query(with_views("select 1", "snr").removesuffix(" select 1") + f", {ONCE} select sample_index // 86400 as block_id, min(row_id) as row_start, max(row_id) + 1 as row_stop, count(*) as n from once group by 1")
def ledger_block_index(v):
    store = _stored(v)
    store.verify()
    index = v.spark.createDataFrame([(b[0], b[3], b[4]) for b in store.manifest["blocks"] if b[4] > b[3]], "block_id long, row_start long, row_stop long")  # a row per block
    return index.withColumn("n", F.col("row_stop") - F.col("row_start"))


SPEC = WF.WaveformSpec(tuple((c, *[x for x in (c - 1, c + 1) if 0 <= x < 8], *[-1] * (2 - sum(0 <= x < 8 for x in (c - 1, c + 1)))) for c in range(8)), 3, 4, 0.5)


def _peaks(v: Views) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    grid = v.grid()
    events = grid.where("v > 250").select((F.col("t") * 8 + F.col("channel")).alias("row_id"), F.col("t").alias("sample_index"), F.col("channel").alias("channel_index"), F.col("v").alias("amplitude_uv"))
    frames = grid.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("channel", "v")))["v"].alias("uv"))
    span = grid.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()  # one row
    return events, frames, (span.a or 0, (span.b or 0) + 1)


WINDOWS = "peaks as (select t * 8 + channel as row_id, t, channel from grid where v > 250), span as (select min(t) as a, max(t) + 1 as b from grid), cells as (select p.row_id, p.t, o.o, s.s, case s.s when 0 then p.channel when 1 then case when p.channel > 0 then p.channel - 1 else 1 end else case when p.channel in (0, 7) then -1 else p.channel + 1 end end as c from peaks p cross join (select range as o from range(8)) o cross join (select range as s from range(3)) s), wave as (select w.row_id, w.o, w.s, w.c, w.t - 3 + w.o as pos, coalesce(g.v, 0) as v from cells w left join grid g on g.t = w.t - 3 + w.o and g.channel = w.c)"


@grid_query("select row_id, greatest(0, any_value(a) - min(pos))::int as valid_start, least(8, any_value(b) - min(pos))::int as valid_stop, string_agg(v::bigint::varchar, ',' order by o, s) as shape from wave cross join span group by row_id", WINDOWS)
def waveform_windows(v):
    events, frames, (a, b) = _peaks(v)
    cut = WF.extracted(events, frames, SPEC, a, b, CORE)
    return cut.select("row_id", "valid_start", "valid_stop", F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), ",").alias("shape"))


@grid_query("select row_id, count(*) filter (pos >= a and pos < b and c >= 0) as recorded, sum(case when pos >= a and pos < b and c >= 0 then round_even(v / 0.5, 0)::int * 0.5 end) as total from wave cross join span group by row_id", WINDOWS)
def decoded_waveforms(v):
    events, frames, (a, b) = _peaks(v)
    cut = WF.extracted(events, frames, SPEC, a, b, CORE)
    back = WF.decoded(WF.encoded(F.col("values"), SPEC.scale_uv, 32), F.col("valid_start"), F.col("valid_stop"), F.col("channel_index"), SPEC)
    real = F.filter("uv", lambda x: x.isNotNull())
    return cut.withColumn("uv", back).select("row_id", F.size(real).cast("long").alias("recorded"), F.aggregate(real, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"select row_id, t, channel, amplitude_uv, round(abs(amplitude_uv) / noise_uv, 6) as snr from (select row_id, row_id // 32 + {FIRST} as t, row_id % 32 as channel, amplitude_uv from ledger) join noise on channel = channel_index", "ledger", "noise")
def indexed_events_with_snr(v):
    led = v.ledger()
    events = L.events_from_index(led.select("row_id", "amplitude_uv"), 32, "row_id", FIRST).withColumn("channel_index", F.col("channel"))
    return _shown(L.with_snr(events, L.robust_noise(led)).select("row_id", "t", "channel", "amplitude_uv", "snr"))


# ---- evidence ---------------------------------------------------------------------------------------

NEAR = "near as (select a.channel_index as channel, b.channel_index as contact from channels a, channels b where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 400)"
SPIKES = "spikes as (select row_id, sample_index as t, channel_index as unit, row_id % 5 as pass, 0.8 + row_id % 20 / 100.0 as score, row_id % 30 / 100.0 as margin, 0.4 + row_id % 18 / 10.0 as amplitude from ledger)"


def _near(v: Views) -> DataFrame:
    from ..operators import geometry as G

    return G.neighbours(v.channels(), 20.0).select("channel", F.col("neighbour").alias("contact"))


def _with_ledger(*more: str) -> str:
    views = with_views("select 1", "snr", "channels").removesuffix(" select 1")
    return ", ".join([views, *more]) + " "


@query(_with_ledger(NEAR) + "select row_id, t, channel from (select row_id, sample_index as t, channel_index as channel from snr join (select event_id, event_type as kind from events) on event_id = row_id where snr >= 1.5 and kind <> 'click') e where not exists (select 1 from near n join near m on m.contact = n.contact join ledger s on s.channel_index = m.channel and s.event_type = 'click' and abs(s.sample_index - e.t) <= 60 where n.channel = e.channel)")
def unexplained_events(v):
    near = _near(v)
    contacts = near.select(F.col("channel").alias("owner"), F.lit("channel").alias("kind"), "contact").unionByName(near.select(F.col("channel").alias("owner"), F.lit("unit").alias("kind"), "contact"))
    led = v.ledger()
    snr = L.with_snr(led, L.robust_noise(led))
    events = snr.where("event_type <> 'click'").select("row_id", F.col("sample_index").alias("t"), F.col("channel_index").alias("channel"), "snr")
    spikes = snr.where("event_type = 'click'").select(F.col("sample_index").alias("t"), F.col("channel_index").alias("unit"))
    return D.unexplained(events, spikes, contacts, 60, 1.5).select("row_id", "t", "channel")


def _matches(v: Views) -> DataFrame:
    r = F.col("row_id")
    return v.ledger().select(r.alias("id"), F.col("sample_index").alias("t"), F.col("channel_index").alias("unit"), (r % 5).alias("pass"), (0.8 + r % 20 / 100).alias("score"), (r % 30 / 100).alias("margin"), (0.4 + r % 18 / 10).alias("amplitude"))


@query(_with_ledger(NEAR, SPIKES) + "select row_id as id, t, unit from spikes a where pass = 0 and score >= 0.9 and margin >= 0.1 and amplitude between 0.5 and 2 and not exists (select 1 from spikes b join near n on n.channel = a.unit join near m on m.contact = n.contact and m.channel = b.unit where b.row_id <> a.row_id and abs(b.t - a.t) <= 600)")
def teaching_events(v):
    return D.teaching_events(_matches(v), _near(v).withColumnRenamed("channel", "unit"), 600).select("id", "t", "unit")


@query(_with_ledger("ev as (select row_id, sample_index as t, channel_index as channel, sample_index // 43200 as epoch from ledger)") + "select row_id, not exists (select 1 from ev b where b.row_id <> a.row_id and abs(b.t - a.t) <= 600 and (b.epoch <> a.epoch or abs(b.channel - a.channel) <= 1)) as isolated from ev a")
def epoch_isolated_events(v):
    events = v.ledger().select("row_id", F.col("sample_index").alias("t"), F.col("channel_index").alias("channel"), F.floor(F.col("sample_index") / 43200).alias("epoch"))
    near = v.spark.range(1024).select((F.col("id") % 32).alias("channel"), F.floor(F.col("id") / 32).alias("neighbour")).where("abs(channel - neighbour) <= 1")
    return D.epoch_isolated(events, near, 600).select("row_id", "isolated")


@query("select row_id, sample_index as sample, channel_index as channel, coalesce(unit, -1) as unit from ledger left join (select sample_index as s, channel_index as c, arg_max(user_id, row_id) as unit from ledger where event_type = 'click' group by 1, 2) on s = sample_index and c = channel_index", "ledger")
def matched_candidates(v):
    led = v.ledger()
    spikes = led.where("event_type = 'click'").select(F.col("sample_index").alias("candidate_sample"), F.col("channel_index").alias("channel"), F.col("user_id").alias("unit"), F.lit(1.0).alias("score"), F.col("row_id").alias("order"))
    return D.matched_candidates(led.select("row_id", F.col("sample_index").alias("sample"), F.col("channel_index").alias("channel")), spikes).drop("score")


@query("select row_id, t, file_id as id from truth left join (select * from sources where file_id % 3 <> 1) on t >= start_sample and t < start_sample + samples", "truth", "sources")
def spike_intervals(v):
    kept = v.sources().where("file_id % 3 <> 1").select(F.col("file_id").alias("id"), F.col("start_sample").alias("start"), (F.col("start_sample") + F.col("samples")).alias("stop"))
    return D.interval_of(v.truth().select("row_id", "t"), kept, 86400).select("row_id", "t", "id")


@query("select row_id, t - start_sample + file_id * 1000000 as t from truth join sources on t >= start_sample and t < start_sample + samples", "truth", "sources")
def preview_remap(v):
    windows = v.sources().select(F.col("start_sample").alias("preview_start"), (F.col("start_sample") + F.col("samples")).alias("preview_stop"), (F.col("file_id") * 1_000_000).alias("source_start"))
    return D.remapped(v.truth().select("row_id", "t"), windows, 86400)


@query("select t, 'p/d' || (t // 604800)::varchar || '/' || (label // 2)::varchar as label from truth", "truth")
def resolved_unit_labels(v):
    day = F.concat(F.lit("d"), F.floor(F.col("t") / 604800).cast("string"))
    spikes = v.truth().select("t", day.alias("day"), F.col("label").alias("unit")).withColumn("shard", F.floor(F.col("t") / 86400))
    links = spikes.select("day", "shard", "unit").distinct().withColumn("linked", F.floor(F.col("unit") / 2))
    return D.resolved_labels(spikes, links, "p")


@query(f"select t, 'p/d0/' || label::varchar as label from truth where t >= {FIRST + 50000} and t < {FIRST + 400000} and row_id % 7 <> 0", "truth")
def shard_spikes(v):
    shards = v.sources().select(F.col("file_id").alias("shard"), F.lit("d0").alias("day"), F.col("start_sample").alias("start"), (F.col("start_sample") + F.col("samples")).alias("stop"), F.lit(True).alias("complete"))
    spikes = v.truth().select(F.floor((F.col("t") - FIRST) / 86400).alias("shard"), "t", F.col("label").alias("unit"), (F.col("row_id") % 7 != 0).alias("export"))
    return D.shard_spikes(spikes, shards, "p", FIRST + 50000, FIRST + 400000, exported=True)


@query("select unit, i // 4 as time, (anchor + i % 4) % 32 as channel, v as value from (select unit, anchor, unnest(w) as v, generate_subscripts(w, 1) - 1 as i from templates) where i < 4", "templates")
def gathered_features(v):
    t = v.templates().select(F.col("unit").alias("row_id"), F.col("anchor").alias("channel"), F.slice("w", 1, 4).alias("values"))
    local = v.spark.range(128).select(F.floor(F.col("id") / 4).alias("channel"), (F.col("id") % 4).alias("slot")).withColumn("contact", (F.col("channel") + F.col("slot")) % 32)
    return D.gathered_features(t, local).select(F.col("row_id").alias("unit"), F.lit(0).cast("long").alias("time"), "channel", "value")


@query("select channel_index as channel from channels where channel_index % 9 = 4 or channel_index = 31", "channels")
def geometry_differences(v):
    c = v.channels().select(F.col("channel_index").alias("channel"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    other = c.where("channel <> 31").withColumn("x", F.when(F.col("channel") % 9 == 4, F.col("x") + 0.02).otherwise(F.col("x") + 0.005))
    return D.geometry_differs(c, other).select("channel")


@query("select shank, avg(x) as x, min(y) as lowest, max(y) as highest, count(*) as contacts from channels group by 1", "channels")
def shank_centres(v):
    return D.shank_centres(v.channels())


@query("select axis, positions, span from (select 'x' as axis, count(distinct x) as positions, (max(x) - min(x))::double as span, 1 as turn from channels union all select 'y', count(distinct y), (max(y) - min(y))::double, 0 from channels) order by positions desc, span desc, turn desc limit 1", "channels")
def depth_axis(v):
    return D.depth_axis(v.channels())


@query("select channel_index as channel from channels where shank = 0 and channel_index not in (select channel_index from ledger group by 1 having avg((event_type = 'error')::int) > 0.2)", "channels", "ledger")
def good_shank_channels(v):
    """A shank's channels less the bad ones."""
    bad = v.ledger().groupBy("channel_index").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("e")).where("e > 0.2").select(F.col("channel_index").alias("channel"))
    return v.channels().where("shank = 0").select(F.col("channel_index").alias("channel")).exceptAll(bad)


@query("select distinct user_id as probe from events where event_type = 'click' intersect select distinct user_id from events where event_type = 'error'")
def probes_in_both(v):
    of = lambda kind: v.table("events").where(F.col("event_type") == kind).select(F.col("user_id").alias("probe"))
    return of("click").intersect(of("error"))


@query("select sample_index // 86400 as shard, row_id, sample_index from ledger", "ledger")
def shards_in_order(v):
    """Shards put end to end again: a union that carries the shard it came from."""
    led = v.ledger().select(F.floor(F.col("sample_index") / 86400).alias("shard"), "row_id", "sample_index")
    return led.where("shard % 2 = 0").unionByName(led.where("shard % 2 <> 0"))


def _day_models(v: Views) -> DataFrame:
    t = v.templates()
    contacts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: (F.col("anchor") + s) % 32)
    return t.select(F.lit("p").alias("probe"), F.concat(F.lit("d"), (F.col("unit") % 3).cast("string")).alias("day"), (F.col("unit") % 3).alias("day_index"), "unit", "anchor", contacts.alias("contacts"), "w", (F.col("unit") % 11).alias("assigned"))


@query()
def cross_day_links(v):
    at = v.channels().select(F.col("channel_index").alias("channel"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "shank")
    return _shown(D.cross_day_links(_day_models(v), at, 20.0, 100_000), "cosine", "distance")  # the view's units lie close together


@query()
def canonical_templates(v):
    t = _day_models(v).select("unit", "contacts", "w")
    return D.canonical(t).select("unit", F.array_join(F.transform("contacts", lambda c: c.cast("string")), ",").alias("contacts"), F.round(F.element_at("w", 33), 6).alias("peak"), "moved")


@query()
def energy_masked_templates(v):
    return D.energy_masked(_day_models(v), 0.9).select("unit", F.array_join(F.transform("contacts", lambda c: c.cast("string")), ",").alias("contacts"))


@query()
def low_rank_templates(v):
    return D.low_rank(v.templates(), 2).select("unit", F.round(F.element_at("w", 1), 6).alias("first"), F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"))


@query("select unit, round(list_sum(list_transform(w, lambda x, i: x * (i % 3 - 1))), 6) as a, round(list_sum(list_transform(w, lambda x, i: x * (i % 5 - 2))), 6) as b from templates", "templates")
def projected_templates(v):
    import numpy as np

    i = np.arange(1, 65)
    done = P.projected(v.templates(), "w", np.stack([i % 3 - 1, i % 5 - 2], axis=1))
    return done.select("unit", F.round(F.element_at("features", 1), 6).alias("a"), F.round(F.element_at("features", 2), 6).alias("b"))


# ---- reports ----------------------------------------------------------------------------------------


@query()
def sorting_scores(v):
    return _shown(R.score_sorting(v.truth().select("t", "label"), v.predicted().select("t", "label"), 2, 3), "precision", "recall", "f1")


@query()
def missed_spikes(v):
    truth, found = v.truth().select("t", "label"), v.predicted().select("t", "label")
    return R.missed(truth, found, Q.unit_assignment(truth, found, 2), 2)


@query("select label, string_agg(t::varchar, ',' order by t) as times from truth group by 1", "truth")
def grouped_times(v):
    return R.unit_times(v.truth().select("t", "label")).select("label", F.array_join(F.transform("times", lambda t: t.cast("string")), ",").alias("times"))


@query("select t // 86400 as shard, count(*) as spikes, count(distinct label) as units, count(g) as intervals, count(*) filter (g < 3600) as short, round(count(*) filter (g < 3600) / greatest(count(g), 1), 6) as share from (select *, t - lag(t) over (partition by label order by t) as g from truth) group by 1", "truth")
def interval_report(v):
    return _shown(R.interval_report(v.truth().select("t", "label"), 3600, 86400), "share")


@query("select sample_index // 86400 as shard, median(abs(amplitude_uv)) as median_rss, max(abs(amplitude_uv)) as peak_rss, max(row_id) as peak_pool from ledger group by 1", "ledger")
def memory_report(v):
    return R.memory_report(v.ledger().select((F.col("sample_index") + 1).alias("stop"), F.abs("amplitude_uv").alias("rss"), F.col("row_id").alias("pool")), 86400)


CASES = "cases as (select 'c' || g::varchar as name, ['base', 'drift', 'collision'][(g % 3 + 1)::int] as kind, 100 as units, 90 - g % 4 as s_recovered, 91 as b_recovered, (950 - g) / 1000.0 as s_precision, 0.95 as b_precision, (900 + g) / 1000.0 as s_recall, 0.9 as b_recall, 50 as collisions, 40 - g as s_collisions, 41 as b_collisions from range(6) t(g))"


@query(f"with {CASES} select true as complete, round(sum(b_recovered - s_recovered) / sum(units), 6) as recovery_loss, round(avg(b_precision - s_precision), 6) as precision_loss, round(avg(b_recall - s_recall), 6) as recall_loss, round(max(greatest((b_recovered - s_recovered) / units, b_precision - s_precision, b_recall - s_recall, (b_collisions - s_collisions) / collisions)), 6) as worst_subgroup_loss, false as passed from cases")
def suite_gate(v):
    g = F.col("id")
    name, kind = F.concat(F.lit("c"), g.cast("string")).alias("name"), F.element_at(F.array(*map(F.lit, R.KINDS)), (g % 3 + 1).cast("int")).alias("kind")
    none = [F.lit(0).alias(c) for c in ("rare_units", "rare_recovered", "late_units", "late_recovered")]
    base = v.spark.range(6)
    ours = base.select(name, kind, F.lit("session").alias("route"), F.lit(100).alias("units"), (90 - g % 4).alias("recovered_units"), ((950 - g) / 1000).alias("precision"), ((900 + g) / 1000).alias("recall"), F.lit(50).alias("collision_spikes"), (40 - g).alias("collision_recovered"), *none)
    theirs = base.select(name, kind, F.lit("baseline").alias("route"), F.lit(100).alias("units"), F.lit(91).cast("long").alias("recovered_units"), F.lit(0.95).alias("precision"), F.lit(0.9).alias("recall"), F.lit(50).alias("collision_spikes"), F.lit(41).cast("long").alias("collision_recovered"), *none)
    return _shown(R.suite_gate(ours.unionByName(theirs)), "recovery_loss", "precision_loss", "recall_loss", "worst_subgroup_loss")


@query("select target, case when row_id % 4 = 0 then 'expected_winner_low_gain' when row_id % 4 = 1 then 'refractory_suppressed' when row_id % 4 = 2 then 'expected_template_amplitude_rejected' when loud <= 3 then 'no_candidate_below_threshold_or_masked' else 'no_candidate_in_mapped_patch_time_window' end as classification from (select row_id as target, row_id, abs(amplitude_uv) / 10 as loud from ledger)", "ledger")
def failure_classes(v):
    k = F.col("row_id") % 4
    traces = v.ledger().select(F.col("row_id").alias("target"), F.col("user_id").alias("unit"), F.col("sample_index").alias("sample"), (F.abs("amplitude_uv") / 10).alias("max_snr"), F.when(k < 2, F.col("user_id")).otherwise(-1).alias("winner"), F.when(k == 0, "gain_rejected").when(k == 1, "refractory").when(k == 2, "lost").alias("decision"), F.col("sample_index").alias("fitted"), F.lit(True).alias("inside"), F.lit(False).alias("eligible"), F.lit(0.9).alias("score"))
    return D.failure_classes(traces, 3.0, 0.75, 2)


# ---- samplers and rolling assignment ----------------------------------------------------------------


@query()
def ledger_sample(v):
    span = v.ledger().agg(F.min("sample_index").alias("a"), F.max("sample_index").alias("b")).first()  # one row
    chosen, _, _ = S.sample_ledger(_snr(v), v.channels(), 300, SEED, span.a, span.b + 1, 10)
    return _shown(chosen, "weight")


@query()
def refractory_kept(v):
    p = v.ledger().select(F.col("user_id").alias("unit"), F.col("sample_index").alias("t"), F.abs("amplitude_uv").alias("gain"), F.col("row_id").alias("id"))
    return D.refractory_kept(p, 3600).select("id", "unit", "t")


@query(with_views("select 1", "ledger").removesuffix(" select 1").replace("with ", "with recursive ", 1) + ", per as (select sample_index // 43200 as bin, sample_index as t, count(*) as n, row_number() over (partition by sample_index // 43200 order by sample_index) as i from ledger group by 1, 2), walk as (select bin, t, n, i, 0 as piece, n as run from per where i = 1 union all select p.bin, p.t, p.n, p.i, w.piece + (w.run >= 20)::int, p.n + case when w.run >= 20 then 0 else w.run end from walk w join per p on p.bin = w.bin and p.i = w.i + 1) select row_id, bin, piece::bigint as piece from ledger join walk on t = sample_index")
def event_epochs(v):
    events = v.ledger().select("row_id", F.col("sample_index").alias("t"))
    return RA.epochs(events, 43200, 20).select("row_id", "epoch.bin", "epoch.piece")


@query()
def shifted_assignment(v):
    """Events against the templates of their contacts; the view's vectors are nearly random, so the threshold is low."""
    t = _day_models(v)
    bank = t.select("unit", "anchor", "contacts", F.col("w").alias("last"))
    events = t.select(F.col("unit").alias("row_id"), F.col("unit").alias("t"), F.col("anchor").alias("channel"), "contacts", "w")
    return _shown(RA.assigned(events, bank, 0.3, 0.01).select("row_id", "unit", "score", "runner", "margin", "amplitude", "shift", "teaches"), "score", "runner", "margin", "amplitude")


@query("select unit, count(*) filter (early) as n, (case when count(*) filter (early) >= 20 and avg((abs(shift) >= 2)::int) filter (early) >= 0.05 then 3 else 2 end)::bigint as radius from (select user_id as unit, row_id % 6 - 3 as shift, sample_index < (select min(sample_index) from ledger) + 1000000 as early from ledger) group by 1", "ledger")
def pilot_shift_radius(v):
    fits = v.ledger().select(F.col("user_id").alias("unit"), F.col("sample_index").alias("t"), (F.col("row_id") % 6 - 3).alias("shift"))
    return E.pilot_radius(fits, 2, 1000.0, 1000.0)


@query("select row_id as id, row_id % 90 as done, 90::bigint as total, case when row_id % 2 = 0 then row_id % 3 * 3600 + row_id % 60 * 60 + 7 end as eta_seconds from ledger", "ledger")
def log_progress(v):
    r = F.col("row_id")
    eta = F.format_string("%d:%02d:07", r % 3, r % 60)
    log = F.concat(F.lit("start 1/90 [00:01<00:05, 2it/s]\n"), (r % 90).cast("string"), F.lit("/90 [00:09<"), F.when(r % 2 == 0, eta).otherwise("?"), F.lit(", 3it/s] x"))
    return E.log_progress(v.ledger().select(r.alias("id"), log.alias("log")))


@query("select user_id as job, round(100 * ([0, 5, 25][(place + 1)::int] + [5, 20, 75][(place + 1)::int] * least(done / 40.0, 0.99)) / 100, 6) as percent, ['load', 'detect', 'sort'][(place + 1)::int] as stage from (select user_id, max(row_id % 3) as place, arg_max(row_id % 41, row_id % 3) as done from (select * from ledger qualify row_number() over (partition by user_id, row_id % 3 order by row_id) = 1) group by 1)", "ledger")
def job_progress(v):
    steps = v.spark.createDataFrame([(0, "load", 5), (1, "detect", 20), (2, "sort", 75)], "place int, stage string, weight long")
    names = F.element_at(F.array(F.lit("load"), F.lit("detect"), F.lit("sort")), (F.col("row_id") % 3 + 1).cast("int"))
    first = L.first_observation(v.ledger().select("user_id", "row_id", names.alias("stage")), ["user_id", "stage"], ["row_id"])
    tasks = first.select(F.col("user_id").alias("job"), "stage", (F.col("row_id") % 41).alias("done"), F.lit(40).cast("long").alias("total"))
    return _shown(E.job_progress(steps, tasks), "percent")


NATURAL = "'src' || lpad(regexp_extract(source, '([0-9]+)', 1), 20, '0')"


@query(f"select source, row_number() over (order by {NATURAL}) as place from (select distinct source from documents where regexp_matches(source, '^src[0-9]+$'))")
def natural_order(v):
    from pyspark.sql import Window

    from ..operators.session import natural_key

    names = v.table("documents").select("source").where(F.col("source").rlike("^src[0-9]+$")).distinct()
    return names.select("source", F.row_number().over(Window.orderBy(natural_key("source"))).cast("long").alias("place"))  # a row per source


@query("select event_id as row_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, sha256('{\"kind\":\"' || event_type || '\",\"user\":' || user_id::varchar || '}') as digest from events")
def event_records(v):
    """Times as ISO 8601 and digests of canonical JSON."""
    e = v.table("events")
    record = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return e.select(F.col("event_id").alias("row_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.sha2(record.cast("binary"), 256).alias("digest"))

