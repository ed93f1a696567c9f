from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom.session import stage


def _shuffle_files(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for d in folders for p in Path(str(d)).glob("*/shuffle_*")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(name, "false")
    try:
        before = _shuffle_files(spark)
        groups = spark.range(10_000, numPartitions=4).groupBy((F.col("id") % 97).alias("k")).count()
        staged = stage(groups.orderBy("k"), "groups")
        assert not _shuffle_files(spark) - before
        assert sorted(r["count"] for r in staged.collect()) == [103] * 88 + [104] * 9 and spark.conf.get(name) == "false"
        # The table staged from may be run again.
        assert groups.count() == 97 and groups.count() == 97
    finally:
        spark.conf.unset(name)
