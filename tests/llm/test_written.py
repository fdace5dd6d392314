"""Tables in the shared folder."""

import time

from helixgrid.llm import batches


def test_written_leaves_no_shuffle(spark):
    """Shuffle files of a written table go with the write, and the session's setting is as before."""
    jvm = spark.sparkContext._jvm
    blocks = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b.name() for b in jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllBlocks()) if b.name().startswith("shuffle_")}
    before, held = spark.conf.get(batches.CLEAN_UP), shuffles()
    found = batches.written(spark.range(5000).selectExpr("id % 77 k").groupBy("k").count(), "test")
    end = time.time() + 10
    while shuffles() - held and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - held
    assert spark.conf.get(batches.CLEAN_UP) == before and found.count() == 77
