from datetime import datetime as D

from lexigraph.streaming import events


def test_stream_equals_batch(spark, tmp_path, rows):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    data = [(i, D(2024, 1, 1, i % 6, 10), 1, "ab"[i % 2], 1.0) for i in range(30)] + [(99, D(2024, 1, 3), 1, "z", 1.0)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    events.run_available(*args)
    events.run_available(*args)
    batch = events.windowed(spark.read.parquet(str(tmp_path / "in"))).where("event_type <> 'z'")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
