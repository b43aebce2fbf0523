import datetime as dt

import pytest

from panelwright.functions import naive
from panelwright.operators.frame import ArgumentError
from panelwright.streaming.buckets import bucket, forecast_batches


def test_buckets_to_forecasts(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d, h), float(d)) for d in range(1, 15) for h in (1, 13)]
    spark.createDataFrame(rows, "g string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    found = {}
    run = lambda p, n: found.update({n: [r.mean for r in naive.naive(p, "v", 1).collect()]})
    q = (
        bucket(stream, time="ts", value="v", keys=("g",), frequency="day", delay="1 day")
        .writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(forecast_batches(str(tmp_path / "buckets"), ("g",), "v", "day", run))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    # the watermark stands at the 13th, 13:00: twelve days are closed
    assert max(found.items())[1] == [24.0]
    with pytest.raises(ArgumentError):
        bucket(stream, time="ts", value="v", keys=("g",), frequency="month", delay="1 day")
