"""Streams over several files must end where one batch over all rows ends."""

import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import windows as w
from gaugeworks.sources.external import decode, encode, kafka_reader
from gaugeworks.sources.files import scratch
from gaugeworks.streaming import core as c
from gaugeworks.streaming import operators as s


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Five files in time order; one source sends most rows."""
    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "us": np.cumsum(rng.integers(1, 40, n)) * 1_000_000, "source": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n)), "t": rng.normal(50, 20, n), "d": rng.normal(5, 1, n)})
    folder = str(tmp_path_factory.mktemp("landed"))
    for i in range(5):
        part = pdf.iloc[i * 80:(i + 1) * 80]
        path = os.path.join(folder, f"part-{i}.parquet")
        part.to_parquet(path, index=False)
        stamp = time.time() - 100 + i
        os.utime(path, (stamp, stamp))
    return folder, spark.createDataFrame(pdf)


def source(spark, landed):
    return c.file_stream(spark, landed[0], landed[1].schema, files_per_batch=1)


def test_sliding_window_state_crosses_batches(spark, landed):
    src = source(spark, landed)
    out, state = scratch(spark, "sl"), scratch(spark, "sl-state")
    c.drain_batches(src, "sl", s.sliding_batches(spark, src.schema, ["source"], ["us", "id"], "t", "d", None, 15, out, state))
    got = spark.read.parquet(out).drop("epoch").toPandas().sort_values("id").reset_index(drop=True)
    want = w.sliding_metrics(landed[1], ["source"], ["us", "id"], "t", "d", None, 15).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], rtol=1e-6, atol=1e-9)


def test_cooldown_state_crosses_batches_and_a_repeated_batch_changes_nothing(spark, landed):
    src = source(spark, landed)
    out, state = scratch(spark, "cd"), scratch(spark, "cd-state")
    handle = s.cooldown_batches(spark, src.schema, ["source"], "us", "id", F.col("t") > 45, 120, out, state)

    def twice(batch, epoch):
        handle(batch, epoch)
        handle(batch, epoch)

    c.drain_batches(src, "cd", twice)
    got = {r["id"]: r["fired"] for r in spark.read.parquet(out).collect()}
    want = {r["id"]: r["fired"] for r in w.cooldown_alerts(landed[1], ["source"], "us", "id", F.col("t") > 45, 120).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)


def test_state_holds_the_batches_keys_and_drops_old_epochs(spark, landed):
    """Snapshots every two epochs, each batch repeated once: the result of one batch, and two generations of state."""
    src = source(spark, landed)
    out, state = scratch(spark, "ks"), scratch(spark, "ks-state")
    handle = s.sliding_batches(spark, src.schema, ["source"], ["us", "id"], "t", "d", None, 15, out, state, every=2)
    sizes = []

    def twice(batch, epoch):
        handle(batch, epoch)
        handle(batch, epoch)
        sizes.append(spark.read.parquet(f"{state}/epoch={epoch}").groupBy("source").count().collect())

    c.drain_batches(src, "ks", twice)
    got = spark.read.parquet(out).drop("epoch").toPandas().sort_values("id").reset_index(drop=True)
    want = w.sliding_metrics(landed[1], ["source"], ["us", "id"], "t", "d", None, 15).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], rtol=1e-6, atol=1e-9)
    assert len(sizes) == 5 and all(r["count"] <= 14 for size in sizes for r in size)
    assert sorted(f for f in os.listdir(state.removeprefix("file:")) if "=" in f) == ["epoch=2", "epoch=3", "epoch=4", "snapshot=2", "snapshot=4"]


def test_idle_keys_leave_the_state(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    tail = s.TailState(spark, scratch(spark, "idle"), rows.schema, ["k"], every=2, idle=2)
    for epoch in range(7):
        batch = rows if epoch == 0 else rows.filter("k = 'a'").withColumn("v", F.lit(epoch))
        held = sorted((r.k, r.v) for r in tail.before(epoch, rows).collect())
        assert held == ([] if epoch == 0 else [("a", max(epoch - 1, 1)), ("b", 1)] if epoch < 4 else [("a", epoch - 1)])
        tail.keep(batch, epoch)


def test_rate_limiter_equals_batch(spark, landed):
    limits = {"minute": 2, "hour": 60, "day": 150}
    with c.keyed_state(spark):
        got = c.drain(s.rate_limit_stream(source(spark, landed), "source", "us", "id", limits), "rl")
        got = {r["id"]: r["verdict"] for r in got.collect()}
    want = {r["id"]: r["verdict"] for r in w.rate_limit(landed[1], ["source"], "us", "id", limits).collect()}
    assert got == want and len(set(got.values())) > 1


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path)
    for i, secs in enumerate([[0, 10, 4000], [4010], [20, 9000]]):
        path = os.path.join(folder, f"p{i}.parquet")
        pd.DataFrame({"ts": pd.to_datetime(secs, unit="s").astype("datetime64[us]"), "v": 1.0}).to_parquet(path, index=False)
        os.utime(path, (time.time() - 10 + i,) * 2)
    src = c.file_stream(spark, folder, "ts timestamp, v double", files_per_batch=1)
    got = c.drain(s.windows(c.event_time(src, "ts", "1 minute"), "ts", [], "v", "10 minutes"), "late").orderBy("start").collect()
    assert [r["n"] for r in got] == [2, 2]


def test_wire_format_round_trip(spark):
    df = spark.createDataFrame([("m1", 1.5, "2024-01-01T00:00:00")], "message_id string, value double, timestamp string")
    wire = encode(df, "message_id")
    assert wire.columns == ["key", "value"] and wire.first()["key"] == "m1"
    back = decode(wire, "message_id string, value double, timestamp string")
    assert back.first()["value"] == 1.5 and dict(back.dtypes)["timestamp"] == "timestamp"


def test_kafka_options_are_set(spark):
    assert kafka_reader(spark, "host:1", "readings") is not None
