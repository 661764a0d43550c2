import datetime as dt

from sagalog.model import MESSAGES
from sagalog.plans.registry import TypeRegistry
from sagalog.streaming.ingest import latest_state, validated_sink

T0 = dt.datetime(2024, 1, 1)


def row(i, session, subject, status, at):
    return (i, session, "agent", None, "task", subject, f'{{"title":"t","status":"{status}"}}', T0 + dt.timedelta(seconds=at), None)


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([row(1, "s", "A", "new", 0), row(2, "s", "B", "lost", 1), row(3, "ghost", "C", "new", 2)], MESSAGES).write.parquet(source)
    sessions = spark.createDataFrame([("s",)], "id string")
    stream = spark.readStream.schema(MESSAGES).parquet(source)
    for _ in range(2):
        validated_sink(stream, sessions, TypeRegistry(), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [2, 3]
    spark.createDataFrame([row(4, "s", "A", "done", 9), row(5, "s", "A", "new", 5)], MESSAGES).write.mode("append").parquet(source)
    q = latest_state(spark.readStream.schema(MESSAGES).parquet(source), MESSAGES.fieldNames()).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["subject_id"]: r["id"] for r in spark.sql("select * from latest").collect()} == {"A": 4, "B": 2, "C": 3}
