"""Hot keys are split by adaptive execution, and results stay whole."""

from pyspark.sql import functions as F

from plumbline.functions.skew import skew_join


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 90000, 1, 12).select(
            "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("x")
        )
        values = rows.groupBy("g").agg(F.min("id").alias("least"))
        assert "skew=true" not in final_plan(rows.join(values, "g"))
        joined = skew_join(rows, values, ["g"])
        assert "skew=true" in final_plan(joined)
        assert joined.count() == 90000
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
