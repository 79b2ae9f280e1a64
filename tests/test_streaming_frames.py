"""Row-wise operators accept a streaming frame once their numbers are fitted."""

from pyspark.sql import functions as F

from tallyframe.functions.scalar import clip, hour_band
from tallyframe.operators import outliers, select


def test_fitted_treatment_on_a_stream(spark, small_dir, tmp_path):
    batch = spark.read.parquet(f"{small_dir}/events.parquet")
    low, high = outliers.fit_bounds(batch, "value")
    stream = spark.readStream.schema(batch.schema).parquet(f"{small_dir}/events.parquet*")
    treated = select.filter_equal(stream, "event_type", "click").select(
        clip(F.col("value"), low, high).alias("value"), hour_band(F.hour("ts")).alias("band")
    )
    run = (
        treated.writeStream.format("memory").queryName("treated").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    got = spark.table("treated")
    assert got.count() == batch.where("event_type = 'click'").count()
    assert got.agg(F.max("value")).first()[0] <= high
