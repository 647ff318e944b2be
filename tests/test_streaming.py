from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.streaming.incremental import append_measured, first_seen, issue_windows


def source(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_windows_equal_the_batch(spark, small, tmp_path):
    rows, stream = source(spark, small, tmp_path)
    run(issue_windows(stream, "ts", "event_type", "1 day", "1 hour"), "w", "complete")
    want = rows.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("code")).agg(F.count("*").alias("n")).select("w.start", "w.end", "code", "n")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))


def test_first_seen(spark, small, tmp_path):
    rows, stream = source(spark, small, tmp_path)
    run(first_seen(stream, "ts", "user_id", "400 days"), "f")
    assert spark.table("f").count() == rows.select("user_id").distinct().count()


def test_batches_are_appended_once(spark, small, tmp_path):
    rows, stream = source(spark, small, tmp_path)
    out = str(tmp_path / "out")
    for _ in range(2):
        append_measured(stream, lambda b: b.withColumn("sha256", F.sha2("event_type", 256)), out, str(tmp_path / "at")).awaitTermination(120)
    assert spark.read.parquet(out).count() == rows.count()
