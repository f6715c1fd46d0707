"""A table that is dealt to micro-batches is worked out once."""

from pyspark.sql import functions as F

from txcompact.streaming.run import available, in_batches


def test_a_table_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def looked_at(x):
        seen.add(1)
        return x

    rows = spark.range(200).select(looked_at("id").alias("at"))
    found = available(in_batches(rows, "at"), each=lambda batch: batch.withColumn("n", F.lit(batch.count())))
    assert found.count() == 200 and found.select("n").distinct().count() >= 1 and max(r.n for r in found.collect()) < 100
    assert seen.value == 200
