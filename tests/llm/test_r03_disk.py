"""Round 3: the texts that an operator has shuffled once leave the disks before they are shuffled again."""

import time

from pyspark.sql import functions as F

from wardline.llm import textops as X


def _files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(blocks.size()) if (n := blocks.apply(i).getName()).startswith("shuffle_")}


def test_a_saved_table_leaves_no_shuffle_files(spark):
    was = spark.conf.get(X.DROP_SHUFFLES)
    before, scratch = _files(spark), X.Scratch(spark)
    saved = scratch.saved(spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(3, "text"))
    end = time.time() + 20
    while _files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not _files(spark) - before
    assert saved.count() == 5000 and saved.agg(F.countDistinct("text")).first()[0] == 5000
    assert spark.conf.get(X.DROP_SHUFFLES) == was
    scratch.done()
