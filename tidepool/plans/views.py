"""The engine's inputs as views over the driver's tables (events, lineitem, embeddings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOOR = 0.01
MAD = 0.67448975
BLOCK_SAMPLES = 86400


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def ledger(self) -> DataFrame:
        sign = F.when(F.col("event_type").isin("error", "view"), -1.0).otherwise(1.0)
        return self.table("events").select(
            F.col("event_id").alias("row_id"),
            F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("sample_index"),
            (F.col("user_id") % 32).alias("channel_index"),
            (F.col("value") * sign).alias("amplitude_uv"),
            "event_type",
            "user_id",
        )

    def big_ledger(self) -> DataFrame:
        sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
        return self.table("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_index"), (F.col("l_suppkey") % 32).alias("channel_index"), (F.col("l_extendedprice") * sign).alias("amplitude_uv"), F.col("l_partkey").alias("part"))

    def channels(self) -> DataFrame:
        c = F.col("id")
        return self.spark.range(32).select(c.alias("channel_index"), ((c % 4) * 20).alias("x"), (F.floor(c / 4) * 20).alias("y"), F.floor(c / 16).alias("shank"))

    def grid(self) -> DataFrame:
        """(t, channel, v), dense: every day between the first and last, on 8 channels."""
        day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
        sums = self.table("lineitem").groupBy(day.alias("t"), (F.col("l_suppkey") % 8).alias("channel")).agg(F.sum("l_quantity").alias("v"))
        span = sums.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence("a", "b")).alias("t"))
        dense = span.select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("channel"))
        return dense.join(sums, ["t", "channel"], "left").select("t", "channel", F.coalesce("v", F.lit(0.0)).alias("v"))

    def templates(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("unit"), (F.col("vec_id") % 32).alias("anchor"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("w"))

    def truth(self) -> DataFrame:
        return self.ledger().select(F.col("sample_index").alias("t"), F.col("user_id").alias("label"), "row_id")

    def predicted(self) -> DataFrame:
        g = self.ledger().where("row_id % 10 <> 0")
        return g.select((F.col("sample_index") + F.col("row_id") % 5 - 2).alias("t"), F.when(F.col("user_id") < 20, F.floor(F.col("user_id") / 2) * 2).otherwise(F.col("user_id")).alias("label"), "row_id")

    def sources(self) -> DataFrame:
        first = 1704067200
        return self.spark.range(30).select(F.col("id").alias("file_id"), F.lit(BLOCK_SAMPLES).cast("long").alias("samples"), (F.lit(first) + F.col("id") * BLOCK_SAMPLES).alias("start_sample"))


#: The same views in DuckDB, as common table expressions.
CTE = {
    "ledger": "ledger as (select event_id as row_id, epoch_us(ts) // 1000000 as sample_index, user_id % 32 as channel_index, value * case when event_type in ('error', 'view') then -1.0::double else 1.0::double end as amplitude_uv, event_type, user_id from events)",
    "big_ledger": "big_ledger as (select l_orderkey * 8 + l_linenumber as sample_index, l_suppkey % 32 as channel_index, l_extendedprice * case when l_returnflag = 'R' then -1.0::double else 1.0::double end as amplitude_uv, l_partkey as part from lineitem)",
    "noise": "noise as (select channel_index, greatest(median(abs(amplitude_uv - m)) / 0.67448975, 0.01) as noise_uv from (select *, median(amplitude_uv) over (partition by channel_index) as m from ledger) group by 1)",
    "snr": "snr as (select l.*, round(abs(amplitude_uv) / noise_uv, 6) as snr from ledger l join noise using (channel_index))",
    "channels": "channels as (select range as channel_index, range % 4 * 20 as x, range // 4 * 20 as y, range // 16 as shank from range(32))",
    "grid": "sums as (select date_diff('day', date '1970-01-01', l_shipdate::date) as t, l_suppkey % 8 as channel, sum(l_quantity) as v from lineitem group by 1, 2), grid as (select d.t, c.channel, coalesce(v, 0.0) as v from (select unnest(range((select min(t) from sums), (select max(t) from sums) + 1)) as t) d cross join (select range as channel from range(8)) c left join sums using (t, channel))",
    "templates": "templates as (select vec_id as unit, vec_id % 32 as anchor, label::bigint as label, list_transform(embedding, lambda z: z::double) as w from embeddings)",
    "truth": "truth as (select sample_index as t, user_id as label, row_id from ledger)",
    "predicted": "predicted as (select sample_index + row_id % 5 - 2 as t, case when user_id < 20 then user_id // 2 * 2 else user_id end as label, row_id from ledger where row_id % 10 <> 0)",
    "sources": "sources as (select range as file_id, 86400::bigint as samples, 1704067200 + range * 86400 as start_sample from range(30))",
}
NEEDS = {"noise": ("ledger",), "snr": ("ledger", "noise"), "truth": ("ledger",), "predicted": ("ledger",)}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []
    for name in names:
        for x in (*NEEDS.get(name, ()), name):
            if x not in order:
                order.append(x)
    return "with " + ", ".join(CTE[x] for x in order) + " " + sql
