"""The driver's JVM gives memory back between the steps of an operator of many jobs."""

from factloom.llm import common


def test_the_heap_shrinks_when_the_driver_is_relieved(spark):
    jvm = spark._jvm
    used = lambda: jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    spark.range(300_000).selectExpr("repeat(cast(id as string), 20) t").collect()  # leaves garbage
    before = used()
    answer = common.relieve_driver(spark)
    after = used()
    assert after.getUsed() < before.getUsed()
    assert after.getCommitted() <= before.getCommitted()
    assert isinstance(answer, str)
