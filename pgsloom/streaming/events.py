"""Event-time aggregates over a stream: tumbling, sliding and session windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A Parquet file or folder as a stream; its schema is read once from the files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    path = f"{folder}/[{name[0]}]{name[1:]}"  # as a pattern, a path may also be a single file
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows  # event time has a zone


def tumbling(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Progress and throughput by kind in windows that do not overlap."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote; state and progress are in ``folder``.

    A run that is repeated or broken off goes on from its checkpoint and adds nothing twice.
    """
    out, done = f"{folder}/out", f"{folder}/checkpoint"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", done).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:  # complete results replace the last ones
        stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", done).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def undropped(events: DataFrame, late: str) -> DataFrame:
    """Events with the watermark of ``ts`` whose late rows reach a stateful operator instead of being dropped before it.

    An operator with event-time timers has to be given a column that carries the watermark, and rows go by that column. Here
    it is ``later``, a time that no watermark reaches; ``ts`` itself is left without the mark.
    """
    marked = events.withWatermark("ts", late)
    mark = dict(marked.schema["ts"].metadata)
    return marked.withColumn("later", F.timestamp_seconds(F.unix_seconds("ts") + F.lit(50 * 365 * 86_400)).alias("later", metadata=mark)).withColumn("ts", F.timestamp_micros(F.unix_micros("ts")))


def windows_and_late(events: DataFrame, width_s: int = 600, late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """(start, key, outcome, n, total) in append mode: windows when the watermark passes their end, and late rows.

    ``outcome`` is ``window`` for a window, written once when it closes, which frees its state, or ``late`` for rows
    that came after that: they are counted by window and trigger rather than dropped in silence. State is one row for each
    open window and key.
    """
    import pandas as pd

    start = F.floor(F.unix_micros(F.col("ts")) / (width_s * 1_000_000)).cast("long") * width_s
    rows = undropped(events.filter("ts is not null"), late).select("later", start.alias("s"), F.col(key).cast("string").alias("k"), F.col("value").cast("double").alias("value"))

    def step(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, name = of
        end_ms = (int(begin) + width_s) * 1000
        mark = state.getCurrentWatermarkMs()

        def row(outcome: str, n: int, total: float) -> pd.DataFrame:
            return pd.DataFrame({"s": [begin], "k": [name], "outcome": [outcome], "n": [n], "total": [total]})

        if state.hasTimedOut:
            n, total = state.get
            state.remove()
            yield row("window", n, total)
            return
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())  # nulls add nothing
        if not state.exists and end_ms <= mark:
            yield row("late", n, total)
        else:
            state.update((n, total))
            state.setTimeoutTimestamp(max(end_ms - 1, mark + 1))

    out = rows.groupBy("s", "k").applyInPandasWithState(step, "s bigint, k string, outcome string, n bigint, total double", "n bigint, total double", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("start"), F.col("k").alias(key), "outcome", "n", "total")


def distinct_users(events: DataFrame, width: str = "10 minutes", late: str = "1 hour", user: str = "user_id") -> DataFrame:
    """(start, users): exact numbers of users in windows, in append mode.

    Users are made distinct in their window first, one row of state a user and open window; the count has one a window.
    Both are freed when the watermark passes the window.
    """
    once = events.withWatermark("ts", late).select(F.window("ts", width).alias("w"), user).filter(F.col(user).isNotNull()).dropDuplicates(["w", user])
    counted = once.groupBy(F.window(F.window_time("w"), width).alias("w")).agg(F.count("*").alias("users"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "users")
