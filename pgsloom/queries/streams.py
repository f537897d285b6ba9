"""Queries over streams, run over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pgsloom.plans.fixtures import Inputs
from pgsloom.queries.base import query
from pgsloom.sources.shared import new_folder
from pgsloom.streaming import events, queue, scoring


def scratch(t: Inputs) -> str:
    """A new folder that driver and executors share."""
    return new_folder(t.spark, "stream")


def source(t: Inputs) -> DataFrame:
    return events.read_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("events_tumbling", "select time_bucket(interval '10 minutes', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling(t: Inputs) -> DataFrame:
    return events.drain(events.tumbling(source(t)), scratch(t), "complete").withColumn("total", F.round("total", 4))


@query("events_sliding", """select start, count(*) as n from (select time_bucket(interval '30 minutes', ts) as start from events union all select time_bucket(interval '30 minutes', ts) - interval '30 minutes' from events) q group by start""")
def sliding(t: Inputs) -> DataFrame:
    return events.drain(events.sliding(source(t)), scratch(t), "complete").select("start", "n")


@query("events_sliding_users")  # users are counted approximately: no SQL
def sliding_users(t: Inputs) -> DataFrame:
    return events.drain(events.sliding(source(t)), scratch(t), "complete")


@query("events_session", """with e as (select user_id, ts, case when ts - lag(ts) over w <= interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
  s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as stop, count(*) as n from s group by user_id, k""")
def session(t: Inputs) -> DataFrame:
    return events.drain(events.sessions(source(t)), scratch(t), "complete")


@query("incremental_scoring", "select individual_id, pgs_id, matched_variants, round(raw_score, 6) as raw_score from fx_agg")
def incremental(t: Inputs) -> DataFrame:
    folder = scratch(t)
    t.view("dna").repartition(2, "individual_id").write.parquet(f"{folder}/dna")
    tasks = t.table("lineitem").count() // 500_000 + 1  # what a task sorts by chromosome does not grow with the table
    part = F.pmod(F.xxhash64("pos"), F.lit(tasks // 22 + 1))
    t.view("pack").repartition(tasks, "chr", part).write.partitionBy("chr").parquet(f"{folder}/pack")
    pack = t.spark.read.parquet(f"{folder}/pack")
    out = scoring.score_stream(events.read_stream(t.spark, f"{folder}/dna", 100), pack, folder)
    return out.select("individual_id", "pgs_id", "matched_variants", F.round("raw_score", 6).alias("raw_score"))




#: Clicks come in two deliveries; what the second one has of windows that the first one closed is late.
SPLIT = "2024-03-15"
ARRIVED = f"""c as (select *, case when arrived_at < timestamp '{SPLIT}' then 1 else 2 end as b from clicks where ts is not null and arrived_at is not null),
  w as (select max(case when b = 1 then ts end) - interval '1 hour' as w1, max(ts) - interval '1 hour' as w2 from c)"""


def delivered(t: Inputs, folder: str, make, prepare=lambda rows: rows) -> DataFrame:
    """Run a stream over the clicks that had come by the split, then, from its checkpoint, over the others."""
    clicks = t.table("clicks").filter("ts is not null and arrived_at is not null")
    first = F.col("arrived_at") < F.lit(SPLIT).cast("timestamp_ntz")
    out = None
    for part in (first, ~first):
        prepare(clicks.filter(part)).write.mode("append").parquet(f"{folder}/in")
        out = events.drain(make(events.read_stream(t.spark, f"{folder}/in", 100_000)), folder)
    return out


@query("clicks_windows", f"""with {ARRIVED}, d as (select *, time_bucket(interval '10 minutes', ts) as start from c, w), e as (select *, start + interval '10 minutes' as stop from d)
  select start, kind, 'window' as outcome, count(*) as n, round(coalesce(sum(value), 0), 4) as total from e where stop <= w2 and not (b = 2 and stop <= w1) group by 1, 2
  union all select start, kind, 'late', count(*), round(coalesce(sum(value), 0), 4) from e where b = 2 and stop <= w1 group by 1, 2""")
def clicks_windows(t: Inputs) -> DataFrame:
    rows = delivered(t, scratch(t), lambda s: events.windows_and_late(s, key="kind"))
    return rows.groupBy("start", "kind", "outcome").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("clicks_distinct_users", f"""with {ARRIVED}, d as (select *, time_bucket(interval '1 hour', ts) as start from c, w) select start, count(distinct client_id) as users from d
  where client_id is not null and start + interval '1 hour' <= w2 and not (b = 2 and start + interval '1 hour' <= w1) group by 1""")
def clicks_distinct_users(t: Inputs) -> DataFrame:
    return delivered(t, scratch(t), lambda s: events.distinct_users(s, "1 hour", user="client_id"))


JOB = "case click_id % 5 when 3 then 'start' when 4 then 'done' else 'add' end"


@query("queue_stream", f"""with {ARRIVED}, m as (select distinct click_id, cast(client_id as string) as individual_id, kind as trait_id, {JOB} as k, cast(click_id % 4 as int) as priority, date_trunc('milliseconds', ts) as ts, b from c where client_id is not null and kind is not null),
  a as (select m.*, w1, w2 from m, w), l as (select individual_id, trait_id, 'late' as outcome, priority, cast(null as timestamp) as added, ts as ended from a where b = 2 and ts <= date_trunc('milliseconds', w1)),
  e as (select *, case k when 'add' then 0 when 'start' then 1 else 2 end as o from a where ts <= date_trunc('milliseconds', w2) and not (b = 2 and ts <= date_trunc('milliseconds', w1))),
  s as (select *, coalesce(sum(case when k = 'done' then 1 else 0 end) over (partition by individual_id, trait_id order by ts, o, cast(click_id as string) rows between unbounded preceding and 1 preceding), 0) as part from e),
  g as (select individual_id, trait_id, part, max(case when k = 'done' then ts end) as ended, min(case when k = 'add' then ts end) as added, max(case when k = 'add' then priority end) as priority from s group by 1, 2, 3)
  select individual_id, trait_id, 'done' as outcome, priority, added, ended from g where ended is not null and added is not null union all select * from l""")
def queue_stream(t: Inputs) -> DataFrame:
    def as_events(rows: DataFrame) -> DataFrame:
        once = rows.select("click_id", "client_id", "kind", "ts").distinct()
        return once.select(F.col("click_id").cast("string").alias("event_id"), F.col("client_id").alias("individual_id"), F.col("kind").alias("trait_id"), F.expr(JOB).alias("kind"), (F.col("click_id") % 4).alias("priority"), "ts")

    buckets = max(64, t.table("clicks").count() // 20_000)  # what a call of Python holds does not grow with the table
    return delivered(t, scratch(t), lambda s: queue.jobs(s, idle_s=1_000 * 86_400, buckets=buckets), as_events)
