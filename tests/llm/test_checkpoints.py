import time

import numpy as np
from pyspark.sql import functions as F

from treeloom.llm.filters import bloom, may_hold
from treeloom.operators.checkpoints import checkpointed


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for at in range(files.size()) if (name := files.apply(at).getName()).startswith("shuffle_")}


def test_shuffle_files_go_when_a_checkpoint_is_written(spark):
    before = shuffle_files(spark)
    made = checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k"), "k"))
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert sorted(r["k"] for r in made.collect()) == list(range(7)) and made.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_a_filter_is_not_read_by_a_job_for_each_partition(spark):
    keys = checkpointed(spark.range(5000).select(F.xxhash64("id").alias("key")))
    known = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
    held = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("filter", "filter")
    try:
        bits = bloom(keys)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("filter")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in held.items():
            spark.conf.set(name, value)
    assert may_hold(bits, known).all() and not may_hold(bits, np.arange(9000, dtype=np.uint64)).all()
    assert len(jobs) < 10
