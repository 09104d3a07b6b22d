"""Shuffle files of a stored step go before the next one fills the disk."""

import time

from wardstone.llm.common import drop_tables, stored, swept, tables


def test_shuffle_files_of_a_stored_step_go(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    had, stood = shuffled(), tables()
    stored(spark.range(100_000).repartition(3, "id"), "swept")
    new = shuffled() - had
    assert new
    swept(spark)
    until = time.time() + 10
    while new & shuffled() and time.time() < until:
        time.sleep(0.1)
    drop_tables(spark, [x for x in tables() if x not in stood])
    assert not new & shuffled()
