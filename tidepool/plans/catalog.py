"""Queries over the views, one per operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from ..functions import hashing as H
from ..operators import adaptation as A
from ..operators import consolidate as C
from ..operators import evidence as D
from ..operators import geometry as G
from ..operators import learning as N
from ..operators import ledger as L
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import sampling as S
from ..operators import session as E
from ..operators import signal as W
from ..operators import templates as T
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FIRST = 1704067200
EDGES = [50.0, 200.0]
SEED = 19
ROWS = "row_id, sample_index, channel_index, amplitude_uv, snr"
MOD64 = "18446744073709551616::uhugeint"


def query(sql: str | None = None, *views: str):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _snr(v: Views) -> DataFrame:
    led = v.ledger()
    return L.with_snr(led, L.robust_noise(led)).select("row_id", "sample_index", "channel_index", "amplitude_uv", "snr")


def _shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Numbers as both engines can agree on them: rounding belongs to queries, not to operators."""
    return df.withColumns({c: F.round(c, digits) for c in columns or ("snr",)})


# ---- ledger -------------------------------------------------------------------------------------


@query(f"select {ROWS} from snr where snr > 1.5", "snr")
def snr_threshold_query(v):
    return _shown(L.query(_snr(v), 1.5))


@query(f"select {ROWS} from snr where snr > 1 and sample_index >= {FIRST + 86400} and sample_index < {FIRST + 5 * 86400}", "snr")
def time_range_query(v):
    return _shown(L.query(_snr(v), 1.0, time=(FIRST + 86400, FIRST + 5 * 86400)))


@query(f"select {ROWS} from snr where snr > 1 and channel_index in (1, 5, 9)", "snr")
def channel_filter_query(v):
    return _shown(L.query(_snr(v), 1.0, channels=[1, 5, 9], known=set(range(32))))


@query(f"select {ROWS} from snr where snr > 1 and amplitude_uv < 0", "snr")
def polarity_query(v):
    return _shown(L.query(_snr(v), 1.0, polarity="neg"))


@query("select sample_index // 86400 as block_id, min(sample_index) as start_sample, max(sample_index) + 1 as stop_sample, min(row_id) as row_start, max(row_id) + 1 as row_stop from ledger group by 1", "ledger")
def block_index(v):
    return L.blocks(v.ledger(), 86400)


@query(f"select row_id, sample_index, channel_index, amplitude_uv from ledger where sample_index >= {FIRST + 100000} and sample_index < {FIRST + 300000}", "ledger")
def block_pruned_query(v):
    led = v.ledger()
    return L.pruned(led, L.blocks(led, 86400), 86400, FIRST + 100000, FIRST + 300000).select("row_id", "sample_index", "channel_index", "amplitude_uv")


@query("select (select count(*) from ledger)::bigint as rows, (select sum(n - 1) from (select count(*) n from ledger group by sample_index, channel_index))::bigint as doubled, (select count(*) from ledger where channel_index not in (select channel_index from noise))::bigint as uncalibrated", "ledger", "noise")
def ledger_validation(v):
    led = v.ledger()
    return L.validate(led, L.robust_noise(led))


@query("select channel_index, round(noise_uv, 6) as noise_uv from noise", "noise")
def channel_noise_mad(v):
    return L.robust_noise(v.ledger()).select("channel_index", F.round("noise_uv", 6).alias("noise_uv"))


@query("select row_id, round_even(amplitude_uv / 0.05, 0)::int as q, round_even(amplitude_uv / 0.05, 0)::int * 0.05::double as decoded from ledger", "ledger")
def quantise_waveforms(v):
    q = L.quantised(F.col("amplitude_uv"), 0.05)
    return v.ledger().select("row_id", q.alias("q"), (q * F.lit(0.05)).alias("decoded"))


@query("select row_id, row_id // 32 as t, row_id % 32 as channel, amplitude_uv from ledger", "ledger")
def flat_index_events(v):
    return L.events_from_index(v.ledger().select("row_id", "amplitude_uv"), 32, "row_id")


@query("select row_id, amplitude_uv from ledger where row_id in (select row_id from ledger where abs(amplitude_uv) > 400)", "ledger")
def row_id_fetch(v):
    led = v.ledger()
    return L.cut_waveforms(led.select("row_id", "amplitude_uv"), led.where(F.abs("amplitude_uv") > 400).select("row_id"))


@query("select row_id, n, (sum(n) over (order by row_id) - n)::bigint as \"offset\" from (select row_id, row_id % 7 + 1 as n from ledger)", "ledger")
def csr_offsets(v):
    return L.csr_offsets(v.ledger().select("row_id", (F.col("row_id") % 7 + 1).alias("n")), "row_id", "n")


@query("select user_id, event_type, row_id, sample_index from (select *, row_number() over (partition by user_id, event_type order by sample_index, row_id) r from ledger) where r = 1", "ledger")
def first_observation(v):
    return L.first_observation(v.ledger().select("user_id", "event_type", "row_id", "sample_index"), ["user_id", "event_type"], ["sample_index", "row_id"])


@query("select row_id, amplitude_uv, case when row_id % 97 = 0 then 'left' else 'x' end as side from ledger where row_id % 97 = 0 union all select row_id, amplitude_uv + 1, 'right' from ledger where row_id % 97 = 0", "ledger")
def ledger_diff(v):
    led = v.ledger().select("row_id", "amplitude_uv")
    return L.differences(led, led.withColumn("amplitude_uv", F.when(F.col("row_id") % 97 == 0, F.col("amplitude_uv") + 1).otherwise(F.col("amplitude_uv"))))


@query("select row_id, amplitude_uv, (abs(amplitude_uv) >= 100)::int as exported from ledger", "ledger")
def export_mask(v):
    return v.ledger().select("row_id", "amplitude_uv", (F.abs("amplitude_uv") >= 100).cast("int").alias("exported"))


@query("select row_id, sample_index from ledger where sample_index % 86400 >= 600 and sample_index % 86400 < 85800", "ledger")
def core_ownership(v):
    t = F.col("sample_index") % 86400
    return v.ledger().where((t >= 600) & (t < 85800)).select("row_id", "sample_index")


# ---- signal -------------------------------------------------------------------------------------


@query("select t, channel, v, v - median(v) over (partition by t) as r from grid", "grid")
def common_median_reference(v):
    return W.common_median(v.grid())


def _peaks_sql(r: int, src: str = "grid", floor: float = 60.0) -> str:
    w = "partition by channel order by t rows between"
    return f"select t, channel, v from (select *, max(v) over ({w} {r} preceding and 1 preceding) p, max(v) over ({w} 1 following and {r} following) n from {src}) where v > {floor} and (p is null or v > p) and (n is null or v >= n)"


@query(_peaks_sql(1), "grid")
def temporal_local_max_r1(v):
    return W.local_maxima(v.grid(), 1, 60.0, 256)


@query(_peaks_sql(5), "grid")
def temporal_local_max_r5(v):
    return W.local_maxima(v.grid(), 5, 60.0, 256)


SMOOTH = "(select t, channel, case when a is null or b is null then v else (a + 2 * v + b) * 0.25::double end as v from (select *, lag(v) over w a, lead(v) over w b from grid window w as (partition by channel order by t)))"


@query(_peaks_sql(2, SMOOTH), "grid")
def smooth3_local_max(v):
    return W.local_maxima(W.smooth3(v.grid(), 256), 2, 60.0, 256)


@query(f"select a.t, a.channel, a.v from ({_peaks_sql(2)}) a join ({_peaks_sql(2)}) b on abs(a.channel - b.channel) <= 1 and abs(a.t - b.t) <= 4 group by all having a.v >= max(b.v) - 1e-8", "grid")
def spatial_nms(v):
    n = v.spark.range(8).select(F.col("id").alias("channel")).withColumn("neighbour", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("channel") - 1), F.least(F.lit(7).cast("long"), F.col("channel") + 1))))
    return W.spatial_suppression(W.local_maxima(v.grid(), 2, 60.0, 256), n, 2)


@query("select *, ((saturated > 1e-4)::bigint | 2 * (flat > 0.98)::bigint | 4 * (zero > 0.99)::bigint) as flags from (select channel, round(avg((v >= 700)::int), 6) as saturated, round(avg((v = p)::int), 6) as flat, round(avg((v = 0)::int), 6) as zero from (select *, lag(v) over (partition by channel order by t) as p from grid) group by 1)", "grid")
def qc_channel_flags(v):
    return W.channel_flags(v.grid(), 700.0, core=256)


@query("select sample_index // 86400 as block_id, count(*) as n, avg((event_type = 'error')::int) > 0.2 as interval_bad from ledger group by 1", "ledger")
def qc_interval_bad(v):
    return W.bad_intervals(v.ledger(), 86400, 0.2)


TAPS = [1, 4, 10, 16, 19, 16, 10, 4, 1]


@query(f"select channel, k, round(sum((v * ({TAPS})[(t - k * 4 + 5)::int])::decimal(38,6))::double / 81, 6) as y from (select *, unnest(range(ceil((t - 4) / 4)::bigint, floor((t + 4) / 4)::bigint + 1)) as k from grid) group by 1, 2", "grid")
def lfp_decimate(v):
    return W.decimate(v.grid(), TAPS, 4)


@query("select t, max(v) as best, arg_max(channel, struct_pack(v := v, c := -channel)) as channel from grid group by t", "grid")
def channel_arg_max(v):
    return v.grid().groupBy("t").agg(F.max("v").alias("best"), F.max_by("channel", F.struct("v", -F.col("channel"))).alias("channel"))


# ---- geometry -----------------------------------------------------------------------------------

PAIRS = "select a.channel_index as channel, b.channel_index as neighbour, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) as distance from channels a, channels b where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {r2}"


@query(PAIRS.format(r2=2500), "channels")
def neighbor_table(v):
    return _shown(G.neighbours(v.channels(), 50.0), "distance")


@query("select channel, slot, contact from (select a.channel_index as channel, b.channel_index as contact, row_number() over (partition by a.channel_index order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.channel_index) - 1 as slot from channels a join channels b on a.shank = b.shank and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 3600) where slot < 6", "channels")
def channel_map_topk(v):
    return G.channel_map(v.channels(), 60.0, 6).withColumn("slot", F.col("slot").cast("long"))


@query("select a.channel_index as channel, string_agg(b.channel_index, ',' order by b.channel_index) as mates from channels a join channels b using (shank) group by 1", "channels")
def same_group_map(v):
    c = v.channels()
    mates = c.select("shank", F.col("channel_index").alias("mate"))
    return c.join(mates, "shank").groupBy(F.col("channel_index").alias("channel")).agg(F.array_join(F.sort_array(F.collect_list("mate")), ",").alias("mates"))


CENTRES = "(select unit, round(sum(e * x) / greatest(sum(e), 1e-12), 6) as x, round(sum(e * y) / greatest(sum(e), 1e-12), 6) as y from (select unit, (anchor + (i - 1) % 4) % 32 as contact, sum(v * v) as e from (select unit, anchor, unnest(w) as v, generate_subscripts(w, 1) as i from templates) group by 1, 2) join channels on contact = channel_index group by 1)"


@query(f"select * from {CENTRES}", "templates", "channels")
def template_centroids(v):
    return _shown(T.centroids(v.templates(), v.channels()), "x", "y")


@query(f"select a.unit as \"left\", b.unit as \"right\" from {CENTRES} a join {CENTRES} b on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 225", "templates", "channels")
def spatial_pair_join(v):
    c = _shown(T.centroids(v.templates(), v.channels()), "x", "y").select(F.col("unit").alias("id"), "x", "y", F.lit(0).alias("probe"))
    return G.spatial_pairs(c, c, 15.0, 100_000, bare=True)  # the view's units lie close together


@query("select l.row_id, t.unit from ledger l join (" + PAIRS.format(r2=400) + ") p on l.channel_index = p.channel join templates t on t.anchor = p.neighbour group by all", "ledger", "channels", "templates")
def template_proposals(v):
    contacts = G.neighbours(v.channels(), 20.0).select("channel", F.col("neighbour").alias("contact"))
    return G.template_candidates(v.ledger(), contacts, v.templates())


# ---- templates ----------------------------------------------------------------------------------

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


SCORES = f"scores as (select e.unit as event, t.unit as unit, round({_dot('e.w', 't.w')} / sqrt(greatest({_dot('e.w', 'e.w')} * {_dot('t.w', 't.w')}, 1e-24)), 6) as gain from templates e join templates t on e.unit % 20 = 0 and e.unit <> t.unit)"


def _top(v: Views) -> DataFrame:
    t = v.templates()
    return T.top_cosines(t.where("unit % 20 = 0"), t, 2, 6)


def with_scores(sql: str) -> str:
    return with_views("select 1", "templates").removesuffix(" select 1") + ", " + SCORES + " " + sql


BEST = "best as (select event, max(unit) filter (r = 1) as best, max(gain) filter (r = 1) as gain, max(unit) filter (r = 2) as runner, max(gain) filter (r = 2) as runner_gain from (select *, row_number() over (partition by event order by gain desc, unit) r from scores) group by 1), margins as (select *, round(1 - coalesce(runner_gain, 0) / greatest(gain, 1e-12), 6) as margin from best)"


@query()
def best_two_templates(v):
    return _shown(T.best_two(_top(v)), "margin")


ORACLES["best_two_templates"] = with_scores("select * from margins").replace(SCORES, SCORES + ", " + BEST)


@query()
def assigned_events(v):
    return T.assigned(_shown(T.best_two(_top(v)), "margin"), 0.3, 0.03)


ORACLES["assigned_events"] = with_scores("select event, case when ok then best else -1 end as unit, ok and gain >= 0.96 and margin >= 0.08 as teaches from (select *, gain >= 0.3 and margin >= 0.03 as ok from margins)").replace(SCORES, SCORES + ", " + BEST)


@query()
def best_per_identity(v):
    t = v.templates().withColumnRenamed("label", "identity")
    return T.best_per_identity(T.identity_cosines(t.where("unit % 20 = 0"), t, 6)).select("event", "identity", "unit", "gain")


ORACLES["best_per_identity"] = with_scores("select event, identity, unit, gain from (select s.*, label as identity, row_number() over (partition by event, label order by gain desc, s.unit) r from scores s join templates t on s.unit = t.unit) where r = 1")


@query("select unit, case when unit < 400 then label else (select max(label) from templates where unit < 400) + row_number() over (partition by unit < 400 order by unit) end as identity from templates", "templates")
def identity_map_extension(v):
    t = v.templates()
    return T.extended_identities(t.where("unit < 400").select("unit", F.col("label").alias("identity")), t.select("unit"))


def _shift_sql(s: int) -> str:
    b = f"b.w[{(2 + s) * 4 + 1}:{(2 + s) * 4 + 48}]"
    a = "a.w[9:56]"
    return f"{{'score': round({_dot(a, b)} / sqrt(greatest({_dot(a, a)} * {_dot(b, b)}, 1e-24)), 6), 'neg': {-s}, 'shift': {s}}}"


def _shift_query() -> str:
    each = ", ".join(_shift_sql(s) for s in (0, -1, 1, -2, 2))
    return f"select \"left\", \"right\", best.score as score, best.shift as shift from (select a.unit as \"left\", b.unit as \"right\", list_max([{each}]) as best from templates a join templates b on a.anchor = b.anchor and a.unit < b.unit)"


@query(_shift_query(), "templates")
def pair_cosine_five_shift(v):
    t = v.templates()
    a, b = t.select(F.col("unit").alias("left"), "anchor", F.col("w").alias("_a")), t.select(F.col("unit").alias("right"), "anchor", F.col("w").alias("_b"))
    best = T.shifted_cosines(F.col("_a"), F.col("_b"), digits=6)
    return a.join(b, "anchor").where("left < right").withColumn("best", best).select("left", "right", "best.score", "best.shift")


ENERGY = "e as (select unit, (anchor + (i - 1) % 4) % 32 as contact, (i - 1) // 4 as time, v from (select unit, anchor, unnest(w) as v, generate_subscripts(w, 1) as i from templates)), tot as (select unit, sum(v * v) as total from e group by 1)"


@query()
def shared_contact_cosine(v):
    return T.shared_contacts(v.templates(), 1, 0.7, 6)


ORACLES["shared_contact_cosine"] = with_views("select 1", "templates").removesuffix(" select 1") + ", " + ENERGY + " select \"left\", \"right\", round(ab / sqrt(aa * bb), 6) as score from (select a.unit as \"left\", b.unit as \"right\", sum(a.v * b.v) as ab, sum(a.v * a.v) as aa, sum(b.v * b.v) as bb from e a join e b on a.contact = b.contact and a.time = b.time and a.unit < b.unit join templates x on x.unit = a.unit join templates y on y.unit = b.unit where ((x.anchor - y.anchor + 1) % 32 + 32) % 32 <= 2 group by 1, 2) join tot p on p.unit = \"left\" join tot q on q.unit = \"right\" where aa >= 0.7 * p.total and bb >= 0.7 * q.total"


@query("select label, (i - 1)::int as i, round(avg(v), 6) as mean, round(median(v), 6) as median from (select label, unnest(w) as v, generate_subscripts(w, 1) as i from templates) group by 1, 2", "templates")
def mean_median_waveform(v):
    return _shown(T.mean_waveform(v.templates(), "label"), "mean", "median")


FITS = "(select row_id, (0.5 + row_id % 50 / 100.0)::double as score, (row_id % 37 / 10.0)::double as amplitude, (row_id % 23 / 100.0)::double as margin, row_id % 4 as pass, row_id % 11 = 0 as rescue from ledger)"


@query(f"select reason, pass, count(*) as n from (select *, case when score < case when pass >= 3 or rescue then 0.85 else 0.75 end then 'score' when not amplitude between 0.3 and 3.0 then 'amplitude' when margin < case when rescue then 0.1 else 0.03 end then 'margin' else 'accepted' end as reason from {FITS}) group by 1, 2", "ledger")
def fit_rejections(v):
    r = F.col("row_id")
    fits = v.ledger().select("row_id", (F.lit(0.5) + r % 50 / 100).alias("score"), (r % 37 / 10).alias("amplitude"), (r % 23 / 100).alias("margin"), (r % 4).alias("pass"), (r % 11 == 0).alias("rescue"))
    return T.acceptance(fits).groupBy("reason", "pass").agg(F.count("*").alias("n"))


@query("select unit, rank, neighbour, d2 from (select a.unit, b.unit as neighbour, round(list_sum(list_transform(list_zip(a.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) as d2, row_number() over (partition by a.unit order by round(list_sum(list_transform(list_zip(a.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6), b.unit) as rank from templates a join templates b on a.unit % 20 = 0 and a.unit <> b.unit) where rank <= 10", "templates")
def nearest_neighbours(v):
    t = v.templates()
    return _shown(T.nearest(t.where("unit % 20 = 0"), t, 10), "d2").withColumn("rank", F.col("rank").cast("long"))


# ---- sampling -----------------------------------------------------------------------------------

MIX = "xor(z3, z3 >> 31)"


def _mixed(x: str) -> str:
    """Nested selects that mix the UBIGINT expression x into h, over ledger rows."""
    m1, m2 = f"{H.MIX_1}::uhugeint", f"{H.MIX_2}::uhugeint"
    return f"(select *, xor(z3, z3 >> 31) as h from (select *, ((xor(z2, z2 >> 27)::uhugeint * {m2}) % {MOD64})::ubigint as z3 from (select *, ((xor(z1, z1 >> 30)::uhugeint * {m1}) % {MOD64})::ubigint as z2 from (select *, ({x})::ubigint as z1 from ledger))))"


BY_INDEX = _mixed(f"(row_id::uhugeint + {SEED}) % {MOD64}")
BY_TIME = _mixed(f"(sample_index::uhugeint + {H.GOLDEN}) % {MOD64}")
BY_BOTH = _mixed(f"xor(sample_index::ubigint, ((channel_index::uhugeint * {H.GOLDEN}) % {MOD64})::ubigint)")
PRODUCT = f"(select *, xor(((sample_index::uhugeint * {H.FIBONACCI}) % {MOD64})::ubigint, channel_index::ubigint) as h from ledger)"
PRODUCTS = f"(select *, xor(((sample_index::uhugeint * {H.FIBONACCI}) % {MOD64})::ubigint, ((channel_index::uhugeint * {H.SECOND}) % {MOD64})::ubigint) as h from ledger)"


@query(f"select row_id from {BY_INDEX} order by h limit 500", "ledger")
def uniform_hash_sample(v):
    return S.uniform(v.ledger(), "row_id", 500, SEED).select("row_id")


STRATUM = "((sample_index // 259200) * 2 + channel_index // 16) * 3 + (abs(amplitude_uv) > 50)::bigint + (abs(amplitude_uv) > 200)::bigint"


@query(f"select {STRATUM} as stratum, count(*) as n from ledger group by 1", "ledger")
def stratum_counts(v):
    return S.strata(v.ledger(), 259200, EDGES).groupBy("stratum").agg(F.count("*").alias("n"))


@query()
def quota_allocation(v):
    counts = S.strata(v.ledger(), 259200, EDGES).groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()  # a row per stratum
    quotas = S.allocate_quotas([r.n for r in counts], 600, 4)
    return v.spark.createDataFrame([(r.stratum, r.n, q, r.n / max(q, 1)) for r, q in zip(counts, quotas, strict=True)], "stratum long, n long, quota long, weight double")


@query(f"select row_id, stratum from (select row_id, {STRATUM} as stratum, row_number() over (partition by {STRATUM} order by h) r from {BY_INDEX}) where r <= 7", "ledger")
def stratified_sample(v):
    s = S.strata(v.ledger(), 259200, EDGES)
    quotas = s.select("stratum").distinct().withColumn("quota", F.lit(7))
    return S.stratified(s, "row_id", quotas, SEED).select("row_id", "stratum")


@query(f"select row_id from (select row_id, h, row_number() over (partition by channel_index order by h) r from {BY_BOTH}) where r <= 8 order by h limit 100", "ledger")
def calibration_reservoir(v):
    return S.reservoir(v.ledger(), "channel_index", 8, 100).select("row_id")


@query(f"select row_id, user_id, b from (select row_id, user_id, sample_index // 604800 as b, row_number() over (partition by user_id, sample_index // 604800 order by h) r from {BY_TIME}) where r <= 3", "ledger")
def unit_window_sample(v):
    led = v.ledger().withColumn("b", F.floor(F.col("sample_index") / 604800))
    return S.least_per_group(led, ["user_id", "b"], lambda: H.by_time(F.col("sample_index")), 3, ["row_id"]).select("row_id", "user_id", "b")


@query(f"select row_id, b from (select row_id, sample_index // 86400 as b, row_number() over (partition by sample_index // 86400 order by h) r from {PRODUCTS}) where r <= 16", "ledger")
def novelty_sample(v):
    led = v.ledger().withColumn("b", F.floor(F.col("sample_index") / 86400))
    return S.least_per_group(led, ["b"], lambda: H.by_two_products(F.col("sample_index"), F.col("channel_index")), 16, ["row_id"]).select("row_id", "b")


@query(f"select row_id, block_id, case when r <= 6 then 'snr' else 'hash' end as why from (select *, row_number() over (partition by block_id, r > 6 order by h) q from (select p.row_id, p.sample_index // 86400 as block_id, p.h, row_number() over (partition by p.sample_index // 86400 order by s.snr desc, p.row_id) r from {PRODUCT} p join snr s on p.row_id = s.row_id)) where r <= 6 or q <= 6", "snr")
def waveform_cache_selection(v):
    led = _snr(v).withColumn("block_id", F.floor(F.col("sample_index") / 86400))
    return S.waveform_cache(led, 12).select("row_id", "block_id", "why")


@query("select row_id, sample_index from ledger where row_id in (select i * ((select max(row_id) from ledger)) // 49 from (select range as i from range(50)))", "ledger")
def evenly_spaced_sample(v):
    return S.evenly_spaced(v.ledger().select("row_id", "sample_index"), "row_id", 50)


@query("select distinct probe, greatest(\"start\", least(w0, \"stop\" - 60)) as window_start, least(greatest(\"start\", least(w0, \"stop\" - 60)) + 60, \"stop\") as window_stop from (select *, \"start\" + ((\"stop\" - \"start\") * (2 * i + 1)) // (2 * n) - 30 as w0 from (select *, unnest(range(n)) as i from (select *, greatest(3, ceil((\"stop\" - \"start\") / 7200))::bigint as n from (select sample_index // 604800 as probe, min(sample_index) as \"start\", max(sample_index) as \"stop\" from ledger group by 1))))", "ledger")
def calibration_windows(v):
    spans = v.ledger().groupBy(F.floor(F.col("sample_index") / 604800).alias("probe")).agg(F.min("sample_index").alias("start"), F.max("sample_index").alias("stop"))
    return S.calibration_windows(spans)


@query("select round(quantile_cont(abs(amplitude_uv), 0.5), 6) as q50, round(quantile_cont(abs(amplitude_uv), 0.9), 6) as q90 from ledger where row_id % greatest(1, (select count(*) // 100000 from ledger)) = 0", "ledger")
def quantile_edges(v):
    return _shown(S.quantile_edges(v.ledger().withColumn("size", F.abs("amplitude_uv")), "row_id", "size"), "q50", "q90")


# ---- quality ------------------------------------------------------------------------------------


@query("select g.t, g.label, p.t as t2, p.label as label2 from truth g join predicted p on p.t between g.t - 2 and g.t + 2", "truth", "predicted")
def gt_pred_interval_pairs(v):
    return Q.interval_pairs(v.truth().select("t", "label"), v.predicted().select("t", "label"), 2)


@query("select t, label, before_t, before_label from (select t, label, lag(t) over w as before_t, lag(label) over w as before_label from truth window w as (order by t, label)) where t - before_t <= 30 and label <> before_label", "truth")
def collision_spikes(v):
    return Q.collisions(v.truth().select("t", "label"), 30)


@query("select label, n, round(coalesce(avg((g < 3600)::int), 0), 6) as violations from (select label, t - lag(t) over (partition by label order by t) as g, count(*) over (partition by label) as n from truth) group by 1, 2", "truth")
def isi_violations(v):
    return _shown(Q.isi_violations(v.truth().select("t", "label"), 3600), "violations")


@query("select p.row_id, p.t from truth p where exists (select 1 from (select sample_index as a, sample_index + 600 as b from ledger where event_type = 'error') s where p.t >= s.a and p.t < s.b)", "truth")
def spans_semi_join(v):
    spans = v.ledger().where("event_type = 'error'").select(F.col("sample_index").alias("start"), (F.col("sample_index") + 600).alias("stop"))
    return Q.inside_spans(v.truth().select("row_id", "t"), spans, 600)


@query("select row_id, sample_index from ledger join (select sample_index // 86400 as b, avg((event_type = 'error')::int) > 0.2 as bad from ledger group by 1) on b = sample_index // 86400 where bad", "ledger")
def spikes_in_bad_intervals(v):
    led = v.ledger()
    bad = W.bad_intervals(led, 86400, 0.2).where("interval_bad").select("block_id")
    return led.withColumn("block_id", F.floor(F.col("sample_index") / 86400)).join(bad, "block_id", "left_semi").select("row_id", "sample_index")


@query("select row_id, t, c from (select row_id, t, label % 32 as c from truth) a where not exists (select 1 from (select row_id as r2, t as t2, label % 32 as c2 from truth) b where c2 = c and r2 <> row_id and abs(t2 - t) <= 1800)", "truth")
def isolated_events_anti_join(v):
    p = v.truth().select("row_id", "t", (F.col("label") % 32).alias("c"))
    return Q.isolated(p, 1800, F.col("c"))


@query("select label, count(*) as units, count(*) >= 2 as split, max(owners) >= 2 as merged from (select p.*, count(*) over (partition by label2) as owners from (select g.label, p.label as label2, count(distinct g.t) as n from truth g join predicted p on p.t between g.t - 2 and g.t + 2 group by 1, 2) p join (select label, count(distinct t) as size from truth group by 1) s on p.label = s.label where n >= 0.2 * size) group by 1", "truth", "predicted")
def split_merge_metrics(v):
    return Q.split_and_merged(v.truth(), v.predicted(), 2)


@query()
def one_to_one_match(v):
    return Q.matched_pairs(v.truth().select("t", "label"), v.predicted().select("t", "label"), 2)


@query()
def unit_assignment(v):
    return _shown(Q.unit_assignment(v.truth().select("t", "label"), v.predicted().select("t", "label"), 2), "iou")


@query("select a as unit, recovered, f1 from (select label as a, count(*)::bigint as recovered, round(avg((event_type = 'click')::int), 6) as f1 from (select user_id as label, event_type from ledger) group by 1) where f1 >= (select max(f1) from (select round(avg((event_type = 'click')::int), 6) as f1 from ledger group by user_id)) - 0.2 order by recovered desc, f1 desc, a limit 2", "ledger")
def config_selection(v):
    per = v.ledger().groupBy(F.col("user_id").alias("unit")).agg(F.count("*").alias("recovered"), F.round(F.avg((F.col("event_type") == "click").cast("double")), 6).alias("f1"))
    best = F.broadcast(per.agg(F.max("f1").alias("_best")))
    return per.join(best, F.col("f1") >= F.col("_best") - 0.2).orderBy(F.desc("recovered"), F.desc("f1"), "unit").limit(2).drop("_best")


@query("select event_type, count(*) as n, round(sum(amplitude_uv::decimal(38,6))::double, 6) as total, max(amplitude_uv) as peak from ledger group by 1", "ledger")
def telemetry_rollup(v):
    return v.ledger().groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("amplitude_uv").cast("decimal(38,6)")).cast("double"), 6).alias("total"), F.max("amplitude_uv").alias("peak"))


# ---- sessions -----------------------------------------------------------------------------------


@query("select file_id, samples, (sum(samples) over (order by file_id) - samples)::bigint as \"start\", (sum(samples) over (order by file_id))::bigint as \"stop\" from sources", "sources")
def virtual_source_offsets(v):
    return E.offsets(v.sources().select("file_id", "samples"))


@query(f"select row_id, t, file_id, t - start_sample as local from truth left join sources on t >= start_sample and t < start_sample + samples", "truth", "sources")
def virtual_source_locate(v):
    files = v.sources().select("file_id", F.col("start_sample").alias("start"), (F.col("start_sample") + F.col("samples")).alias("stop"))
    return E.locate(v.truth().select("row_id", "t"), files, 86400)


@query("select file_id, s as shard_start, least(s + 7000, \"stop\") as shard_stop from (select file_id, start_sample + samples as \"stop\", unnest(range(start_sample, start_sample + samples, 7000)) as s from sources)", "sources")
def shard_intervals(v):
    return E.shard_intervals(v.sources().select("file_id", F.col("start_sample").alias("start"), (F.col("start_sample") + F.col("samples")).alias("stop")), 7000)


@query("select b.bound, (select arg_max(row_id, struct_pack(s := sample_index, r := row_id)) from ledger l where l.sample_index <= b.bound) as model from (select start_sample as bound from sources) b", "ledger", "sources")
def latest_model(v):
    models = v.ledger().select(F.col("sample_index").alias("stop"), F.col("row_id").alias("model"))
    return D.latest_models(models, v.sources().select(F.col("start_sample").alias("bound")), 86400)


@query("select user_id as unit, count(*) as n, (case when count(*) >= 20 and avg((abs(row_id % 6 - 3) >= 2)::int) >= 0.05 then 3 else 2 end)::bigint as radius from ledger group by 1", "ledger")
def adaptive_shift_radius(v):
    return E.boundary_radius(v.ledger().select(F.col("user_id").alias("unit"), (F.col("row_id") % 6 - 3).alias("shift")), 2)


@query("select sample_index // 43200 as epoch, count(*) as events, min(sample_index) as first_sample, max(sample_index) as last_sample from ledger group by 1", "ledger")
def epoch_batches(v):
    return C.epochs(v.ledger(), 43200)


@query("select label, bin, n, round(1e-9 + sum(w * mean) over (partition by label order by bin range between 5 preceding and current row) / sum(w) over (partition by label order by bin range between 5 preceding and current row), 4) as rolling from (select label, t // 43200 as bin, count(*) as n, sum(v::decimal(38,6))::double / count(*) as mean, least(count(*), 100)::double as w from (select user_id as label, sample_index as t, abs(amplitude_uv) as v from ledger) group by 1, 2)", "ledger")
def rolling_template_bins(v):
    events = v.ledger().select(F.col("user_id").alias("label"), F.col("sample_index").alias("t"), F.abs("amplitude_uv").alias("v"))
    return C.rolling_bins(events, 43200, 6).withColumn("rolling", F.round(F.col("rolling") + 1e-9, 4))


def consolidation_patches(v: Views, radius: float = 45.0) -> dict[int, set[int]]:
    patches: dict[int, set[int]] = {}
    for r in G.neighbours(v.channels(), radius).collect():  # the probe's geometry, a few hundred rows
        patches.setdefault(r.channel, set()).add(r.neighbour)
    return patches


@query()
def consolidate_events(v):
    return _shown(C.consolidate(_snr(v), consolidation_patches(v), 60))


# ---- learning -----------------------------------------------------------------------------------

DUPLICATE = 0.3  # the view's vectors are nearly random: the operator's own threshold would find no pair
DUPLICATES = f"near as (select a.channel_index as anchor, b.channel_index as other from channels a join channels b on a.shank = b.shank and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1024), dup as (select a.unit as \"left\", b.unit as \"right\", round(sum(a.v * b.v) / sqrt(max(p.total) * max(q.total)), 6) as score from near n join templates x on x.anchor = n.anchor join templates y on y.anchor = n.other and x.unit < y.unit join e a on a.unit = x.unit join e b on b.unit = y.unit and a.contact = b.contact and a.time = b.time join tot p on p.unit = x.unit join tot q on q.unit = y.unit where p.total > 1e-24 and q.total > 1e-24 group by 1, 2 having round(sum(a.v * b.v) / sqrt(max(p.total) * max(q.total)), 6) >= {DUPLICATE})"


def _duplicates_sql(sql: str) -> str:
    views = with_views("select 1", "templates", "channels").removesuffix(" select 1").replace("with ", "with recursive ", 1)
    return f"{views}, {ENERGY}, {DUPLICATES}{sql}"


@query()
def duplicate_template_pairs(v):
    return _shown(N.duplicate_pairs(v.templates(), v.channels(), DUPLICATE), "score")


ORACLES["duplicate_template_pairs"] = _duplicates_sql(" select * from dup")


@query()
def linked_identities(v):
    t = v.templates()
    return N.linked_identities(t, N.duplicate_pairs(t, v.channels(), DUPLICATE))


ORACLES["linked_identities"] = _duplicates_sql(", links as (select \"left\" as a, \"right\" as b from dup union select \"right\", \"left\" from dup), reach as (select unit, unit as r from templates union select reach.unit, b from reach join links on r = a) select unit, dense_rank() over (order by root) - 1 as identity from (select unit, min(r) as root from reach group by 1)")


def _snippets(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = v.templates().select(F.col("label").alias("unit"), "w", F.col("unit").alias("row"))
    models = t.groupBy("unit").agg(F.min_by("w", "row").alias("w"))
    return models, t.where("row % 3 <> 0").withColumn("core", F.col("row") % 5), t.where("row % 3 = 0")


MOVED = "models as (select label as unit, arg_min(w, unit) as w from templates group by 1), target as (select label as unit, i, median(v) as v from (select label, unnest(w) as v, generate_subscripts(w, 1) as i from templates where unit % 3 <> 0) group by 1, 2), moved as (select m.unit, m.i, m.v, 0.75::double * m.v + 0.25::double * t.v as p from (select unit, unnest(w) as v, generate_subscripts(w, 1) as i from models) m join target t on m.unit = t.unit and m.i = t.i), changes as (select unit, round(sqrt(sum((p - v) ** 2)) / greatest(sqrt(sum(v ** 2)), 1e-12), 6) as c from moved group by 1), errors as (select h.unit, h.row, avg((h.x - m.v) ** 2) as old, avg((h.x - m.p) ** 2) as new from (select label as unit, unit as row, unnest(w) as x, generate_subscripts(w, 1) as i from templates where unit % 3 = 0) h join moved m on h.unit = m.unit and h.i = m.i group by 1, 2), judged as (select unit, count(*) as k, round(1 - avg(new) / greatest(avg(old), 1e-12), 6) as g, quantile_cont(new - old, 0.9) > 0.05 * greatest(avg(old), 1e-12) as worse from errors group by 1), seen as (select label as unit, count(*) as n, count(distinct unit % 5) as cores from templates where unit % 3 <> 0 group by 1)"


@query()
def heldout_refinement(v):
    return N.heldout_refinement(*_snippets(v))


ORACLES["heldout_refinement"] = with_views("select 1", "templates").removesuffix(" select 1") + ", " + MOVED + " select unit, training_count, validation_count, case when few then 'insufficient_evidence' when c > 0.1 or g < 0.005 or worse then 'validation_rejected' else 'heldout_waveform_improvement' end as reason, case when not few then c end as relative_change, case when not few then g end as validation_gain from (select unit, coalesce(n, 0) as training_count, coalesce(k, 0) as validation_count, coalesce(n, 0) < 12 or coalesce(k, 0) < 6 or coalesce(cores, 0) < 2 as few, c, g, worse from models left join changes using (unit) left join judged using (unit) left join seen using (unit))"


@query()
def calibration_clusters(v):
    t = v.templates()
    held = S.least_per_group(t, ["label"], lambda: H.by_time(F.col("unit")), 400)
    return N.calibrate(held.select(F.col("unit").alias("row_id"), F.col("label").alias("anchor"), "w"))


# ---- adaptation and matching --------------------------------------------------------------------


def _evidence(v: Views) -> tuple[DataFrame, DataFrame]:
    t = v.templates().select(F.col("label").alias("unit"), "w", F.col("unit").alias("sample"), F.floor(F.col("unit") / 40).alias("core"))
    return t.groupBy("unit").agg(F.min_by("w", "sample").alias("w")), t


@query()
def template_promotion(v):
    models, rows = _evidence(v)
    now = rows.agg(F.max("sample")).first()[0] or 0
    units = models.count()
    last = models.select("unit", F.lit(-1).cast("long").alias("promoted_at"))
    return A.promote(models, A.recent_evidence(rows, now, 1 << 40, units), last)


@query()
def pca_split_units(v):
    models, rows = _evidence(v)
    held = S.least_per_group(rows, ["unit", "core"], lambda: H.by_time(F.col("sample")), 64)
    return A.pca_splits(models, held.select("unit", F.col("sample").alias("row"), "core", (F.col("core") % 3 == 0).alias("held"), "w"), 16, (4, 13))


def _patches(v: Views) -> DataFrame:
    return v.spark.range(32).select(F.col("id").alias("anchor"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: (F.col("id") + s) % 32).alias("contacts"))


@query()
def novelty_enrolment(v):
    t = v.templates()
    held = S.least_per_group(t.withColumn("core", F.floor(F.col("unit") / 400)), ["anchor", "core"], lambda: H.by_time(F.col("unit")), 256)
    known = t.groupBy("anchor").agg(F.min_by("w", "unit").alias("w"))
    return A.enrolment(A.proposals(held.select("anchor", F.col("unit").alias("sample"), "core", "w"), 1 << 40, 2), known, 1, contacts=_patches(v))


@query()
def residual_matches(v):
    """The grid's eight channels against each label's mean template; the view's vectors are nearly random, so scores are low."""
    grid = v.grid()
    middle = grid.groupBy("channel").agg(F.median("v").alias("m"))
    level = grid.join(F.broadcast(middle), "channel").select("t", "channel", (F.col("v") - F.col("m")).alias("u"))  # a row per channel
    noise = level.groupBy("channel").agg((F.median(F.abs("u")) / 0.67448975).alias("n"))
    sigma = [r.n for r in noise.orderBy("channel").collect()]  # a row per channel
    frames = level.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("channel", "u")))["u"].alias("uv"))
    means = v.templates().select("label", F.posexplode("w").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    waves = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("m"))
    unit = (F.row_number().over(Window.orderBy("label")) - 1).cast("long")  # a row per label
    scale = 40 * max(sigma, default=1.0)
    bank = waves.select(unit.alias("unit"), F.transform("m", lambda x: F.round(x, 9) * scale).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: (F.col("label") + s) % 8).alias("contacts"), unit.alias("identity"))
    rules = M.Rules(score=0.3, snr=2.5, amplitude=(0.01, 100.0), centre=4, refit_rounds=1)
    found = M.match_cores(M.cut_cores(frames, 500, 100), sigma, M.Bank.collected(bank), rules)
    return found.select("core", "t", "channel", "unit", "step", *[F.round(c, 6).alias(c) for c in ("score", "runner_up", "amplitude", "gain", "margin")])
