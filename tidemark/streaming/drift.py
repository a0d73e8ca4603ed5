"""Streaming twins of the drift operators: event-time windows with watermarks, and a keyed monitor with its own state.

The monitor keeps, for each key, a ring of the last values, their sum, an exponential average and the warm-up mean; the
state's size is the window's, however long the stream runs. Windows drop the rows that their watermark has passed; the monitor takes every row.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.folders import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its file."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if is_file else reader.parquet(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_scores(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean): tumbling or sliding event-time windows; rows later than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def session_scores(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(start, user_id, n, mean): sessions of a user, closed by a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("session_window.start").alias("start"), "user_id", "n", "mean")


class Monitor(StatefulProcessor):
    """For each key: moving average of `win` values, padded by the warm-up mean, exponential average and mistake rate.

    The first `warmup` rows of a key only fill the warm-up mean and give no output. A micro-batch's rows of a key are taken
    in the order of (ts, event_id), in however many pieces they come.
    """

    schema = "user_id long, ts timestamp, event_id long, ma double, ema double, mistakes double"

    def __init__(self, win: int = 20, warmup: int = 5, alpha: float = 0.99):
        self.win, self.warmup, self.alpha = win, warmup, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n long, warm double, ema double, scores array<double>, wrong array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() or (0, 0.0, 0.0, [], [])
        n, warm, ema = int(state[0]), float(state[1]), float(state[2])
        scores, wrong = deque(state[3], self.win), deque(state[4], self.win)
        out = []
        pdf = pd.concat([r[["ts", "event_id", "value", "event_type"]] for r in rows]).sort_values(["ts", "event_id"])
        for ts, event, value, kind in zip(pdf["ts"], pdf["event_id"].tolist(), pdf["value"].tolist(), pdf["event_type"]):
            n += 1
            if n <= self.warmup:
                warm += (float(value) - warm) / n
                ema = warm
                continue
            scores.append(float(value))
            wrong.append(float(kind == "error"))
            ema = self.alpha * ema + (1 - self.alpha) * float(value)
            out.append((key[0], ts, event, (sum(scores) + (self.win - len(scores)) * warm) / self.win, ema, sum(wrong) / self.win))
        self.state.update((n, warm, ema, list(scores), list(wrong)))
        yield pd.DataFrame(out, columns=["user_id", "ts", "event_id", "ma", "ema", "mistakes"])

    def close(self) -> None:
        pass


def monitor(events: DataFrame, **options) -> DataFrame:
    """The stream's monitor rows. Its state has several columns, which the RocksDB state store keeps; the session is told so."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("user_id", "event_id", "ts", "value", "event_type")
    return rows.groupBy("user_id").transformWithStateInPandas(Monitor(**options), Monitor.schema, "append", "none")


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives its result as a table.

    Rows of an append-mode stream go to Parquet files in the shared folder, however many there are; the aggregates of the other
    modes, a row for each window and group, to memory.
    """
    spark = stream.sparkSession
    if mode == "append":
        path = _checkpoint(spark, f"{name}-rows")
        parquet_sink(stream, path, _checkpoint(spark, name)).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", _checkpoint(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _checkpoint(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parquet_sink(stream: DataFrame, path: str, checkpoint: str):
    """An exactly-once file sink of an append-mode stream; returns the running query."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(windowed_scores(event_stream(spark, sf_dir)), "stream_tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(windowed_scores(event_stream(spark, sf_dir), "1 day", "12 hours"), "stream_sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


def _monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(monitor(event_stream(spark, sf_dir)), "stream_monitor", "append").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max_by("ma", F.struct("ts", "event_id")), 6).alias("ma"))


QUERIES |= {"stream_tumbling": _tumbling, "stream_sliding": _sliding, "stream_monitor": _monitor}
_TUMBLE = "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY ALL"
ORACLES["stream_tumbling"] = _TUMBLE
ORACLES["stream_sliding"] = "SELECT start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM (SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOURS AS start, event_type, value FROM events, range(2) t(k)) GROUP BY ALL"
