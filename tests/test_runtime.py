"""What written tables leave behind."""

import os
import time

from pyspark.sql import functions as F

from brickwise import runtime


def test_shuffle_files_end_with_the_write(spark):
    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held = lambda: sum(n.startswith("shuffle_") and n.endswith(".data") for top in folders for _, _, names in os.walk(top) for n in names)
    before, setting = held(), spark.conf.get(runtime.CLEANUP)
    table = runtime.materialize(spark.range(20000).groupBy((F.col("id") % 7000).alias("k")).count(), "counts")
    for _ in range(50):  # deleted in the background
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before
    assert table.count() == 7000
    assert spark.conf.get(runtime.CLEANUP) == setting
