"""Streams whose rows come late and out of order give what the batch gives."""

import uuid

import pytest
from pyspark.sql import functions as F

from trackguard.operators import risk as RI
from trackguard.plans import q_learn, tables as T
from trackguard.plans.q_ingest import scratch
from trackguard.plans.q_stream import FILES, fed, feed
from trackguard.streaming import ordered as OR, queries as ST

SF = "/root/testdata/sf0.01"
COLUMNS = ("race", "id", "t", "tick", "drivers", "msector", "type", "severity", "evidence")


def rows(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("steps,late", [(2, 0), (5, 12)])
def test_suite_equals_the_batch(spark, steps, late):
    """Ids, drivers and incidents of several cars, whatever the order within the watermark."""
    want = rows(T.detections(spark, SF), COLUMNS)
    got = fed(spark, T.features(spark, SF), lambda s: OR.suite(OR.car_detections(s, T.SCALED), T.SCALED, T.N), steps, late)
    assert len(want) > 50 and any(r[6] == "MULTI" for r in want) and rows(got, COLUMNS) == want


def test_rows_beyond_the_watermark_are_dropped(spark):
    """A row that comes after the watermark has passed it changes nothing, and the rest is that of the rows in time."""
    root = f"{scratch(spark)}-{uuid.uuid4().hex[:6]}"
    df = T.features(spark, SF)
    feed(df, f"{root}/in", 2)
    df.filter("tick < 4").withColumn("speed", F.lit(0.0)).write.mode("append").parquet(f"{root}/in")
    out = OR.suite(OR.car_detections(OR.timed(ST.tick_source(spark, f"{root}/in", df.schema, FILES)), T.SCALED), T.SCALED, T.N)
    ST.run_to_table(out, f"{root}/out", f"{root}/checkpoint")
    assert rows(spark.read.schema(out.schema).parquet(f"{root}/out"), COLUMNS) == rows(T.detections(spark, SF), COLUMNS)


def test_forecasts_join_detections_though_they_run_late(spark):
    """The forecast stream lands in more and later files than the detections; the join waits for both watermarks."""
    features, labelled = T.features(spark, SF), q_learn.labelled(spark, SF)
    models = [RI.fit(labelled, h, iterations=4, min_rows=10) for h in (10, 30)]
    key = ("race", "drv", "tick", "kind", "risk_10s", "risk_30s")
    timed = features.withColumn("ts", OR.event_time(F.col("tick")))
    cars = T.detections(spark, SF).filter("type <> 'MULTI'").select("race", F.col("drivers")[0].alias("drv"), "tick", F.col("type").alias("kind"), OR.event_time(F.col("tick")).alias("ts"))
    want = [tuple(map(str, r)) for r in OR.with_risk(cars, OR.forecasts(timed, *models)).select(*key).collect()]
    root = f"{scratch(spark)}-{uuid.uuid4().hex[:6]}"
    feed(features, f"{root}/ticks", 2)
    feed(features, f"{root}/late", 7, 10)
    ticks, late = (OR.timed(ST.tick_source(spark, f"{root}/{n}", features.schema, FILES)) for n in ("ticks", "late"))
    out = OR.with_risk(OR.car_detections(ticks, T.SCALED), OR.forecasts(late, *models))
    ST.run_to_table(out, f"{root}/out", f"{root}/checkpoint")
    got = [tuple(map(str, r)) for r in spark.read.schema(out.schema).parquet(f"{root}/out").select(*key).collect()]
    assert any(r[4] != "None" for r in want) and sorted(got) == sorted(want)
