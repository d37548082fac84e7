"""The limiter in event time against admissions over the same requests."""

import random

import pytest

from loomquery.streaming import limiter


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_out_of_order_requests_are_judged_in_order(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(3)}", round(i * 0.7 + rng.random(), 3), i) for i in range(120)] + [("c0", 30.0, 500), ("c0", 30.0, 1000), ("c1", 12.25, 501), (None, 5.0, 900), ("c2", None, 901)]
    arrival = sorted(rows, key=lambda r: (r[1] or 0) + rng.uniform(0, 25))
    kind = "client string, t double, query_id long"
    source = str(tmp_path / "in")
    end = [("end", 10_000.0, 9_000)]
    for n, part in enumerate([arrival[:50], arrival[50:90], arrival[90:], end, [("end", 10_001.0, 9_001)]]):
        rocks.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{source}/{n}")
        stream = rocks.readStream.schema(kind).option("recursiveFileLookup", True).parquet(source)
        out = limiter.limited_in_event_time(stream, "60 seconds", limit=3, window_s=15).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination(180)
    got = {(r.client, r.t, r.query_id): r.admitted for r in rocks.read.parquet(str(tmp_path / "out")).collect() if r.client != "end"}
    want = {(r.client, r.t, r.query_id): r.admitted for r in limiter.admissions(rocks.createDataFrame(rows, kind), 3, 15).collect()}
    assert got == want and 20 < sum(got.values()) < 120
