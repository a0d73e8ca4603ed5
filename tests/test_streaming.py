"""The keyed monitor against a plain loop over each key's rows, and where a stream's rows go."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import drift

USERS, ROWS = 3, 12_500  # more rows of a key than an Arrow batch holds


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Rows of each user from late to early, two at a time at one moment."""
    path = str(tmp_path_factory.mktemp("events"))
    i = F.lit(USERS * ROWS - 1) - F.col("id")
    rows = spark.range(USERS * ROWS).select((i % USERS).alias("user_id"), i.alias("event_id"), F.timestamp_seconds(F.floor(i / (2 * USERS)) * 60).alias("ts"), F.pmod(F.xxhash64(i), F.lit(1000)).cast("double").alias("value"), F.when(F.pmod(i, F.lit(4)) == 0, "error").otherwise("view").alias("event_type"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/events.parquet")
    return path


def test_monitor_takes_rows_in_order_and_keeps_them_off_the_driver(spark, events):
    got = drift.drained(drift.monitor(drift.event_stream(spark, events)), "monitor_test", "append")
    assert got.inputFiles() and "monitor_test" not in [t.name for t in spark.catalog.listTables()]  # files, not the driver's memory
    rows, got = spark.read.parquet(f"{events}/events.parquet").toPandas(), got.toPandas()
    assert len(got) == USERS * (ROWS - 5)
    for user, of in rows.groupby("user_id"):
        of, mine = of.sort_values(["ts", "event_id"]), got[got.user_id == user].sort_values(["ts", "event_id"])
        v, bad = of.value.to_numpy(), (of.event_type == "error").to_numpy(float)
        assert mine.event_id.tolist() == of.event_id.tolist()[5:]
        padded, wrong = np.concatenate([np.full(19, v[:5].mean()), v[5:]]), np.concatenate([np.zeros(19), bad[5:]])
        assert np.allclose(mine.ma, np.convolve(padded, np.ones(20) / 20, "valid")) and np.allclose(mine.mistakes, np.convolve(wrong, np.ones(20) / 20, "valid"))


def test_monitor_query_takes_the_last_row(spark, events):
    got = {r.user_id: (r.n, r.ma) for r in drift.QUERIES["stream_monitor"](spark, events).collect()}
    rows = spark.read.parquet(f"{events}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    assert got == {u: (ROWS - 5, pytest.approx(of.value.to_numpy()[-20:].mean(), abs=1e-6)) for u, of in rows.groupby("user_id")}
