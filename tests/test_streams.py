"""Watermarked stage counts on a stream of stage rows."""

from clausemill.streaming import ingest


def test_stage_counts(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "acquired", "2024-01-01 10:00:00"), ("b", "acquired", "2024-01-01 11:00:00"), ("a", "exported", "2024-01-02 10:00:00"), ("a", "exported", "2024-01-02 10:00:00")],
        "document_id string, completed_stage string, updated_at string",
    ).selectExpr("document_id", "completed_stage", "cast(updated_at as timestamp) as updated_at")
    rows.write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
    counts = ingest.latest_stages(log)
    started = counts.writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    started.awaitTermination()
    found = {(str(r.day.start.date()), r.completed_stage): r.documents for r in spark.table("stages").collect()}
    assert found == {("2024-01-01", "acquired"): 2, ("2024-01-02", "exported"): 1}
