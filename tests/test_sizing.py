"""Stage tables."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import sizing


def shuffle_bytes(spark) -> int:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in Path(str(d)).rglob("shuffle_*.data") if os.path.exists(f))


def test_a_stage_table_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sizing, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    before = spark.conf.get(sizing.REMOVE_SHUFFLES, None)
    held = shuffle_bytes(spark)
    rows = spark.range(200_000).groupBy(F.xxhash64("id").alias("h")).count()
    stage = sizing.checkpointed(rows)
    assert shuffle_bytes(spark) - held < 100_000  # about 3 MB while it ran
    assert spark.conf.get(sizing.REMOVE_SHUFFLES, None) == before
    assert stage.count() == 200_000
    assert rows.count() == 200_000  # the frame itself can run again


def test_a_stage_table_can_be_removed_and_nothing_else(spark, tmp_path):
    stage = sizing.checkpointed(spark.range(10))
    folder = Path(stage.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    sizing.removed(stage)
    assert not folder.exists()
    spark.range(3).write.parquet(f"{tmp_path}/given")
    with pytest.raises(ValueError):
        sizing.removed(spark.read.parquet(f"{tmp_path}/given"))
