from glyphloom.streaming.metric_stream import early_stopping_stream


def test_fold_with_state_equals_a_loop(spark, tmp_path):
    source = tmp_path / "in"
    schema = "run string, epoch int, val_loss double"
    batches = [[("a", 1, 3.0), ("b", 1, 1.0)], [("a", 2, 2.0), ("a", 3, 2.5), ("b", 2, 1.0)], [("a", 4, 1.0), ("b", 3, 0.5)]]
    spark.createDataFrame([], schema).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = early_stopping_stream(stream, 1).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(tuple(r) for r in spark.table("folded").collect())
    assert got == [("a", 1, 3.0, 3.0, 0, False), ("a", 2, 2.0, 2.0, 0, False), ("a", 3, 2.5, 2.0, 1, True), ("b", 1, 1.0, 1.0, 0, False), ("b", 2, 1.0, 1.0, 1, True)]
