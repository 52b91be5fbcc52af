import datetime as dt

from pyspark.sql import functions as F

from lodestack.operators.catalog import feedback_ema as batch_ema
from lodestack.streaming import events as E
from lodestack.streaming import ingest as I

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def rows():
    t = dt.datetime(2024, 1, 1)
    kinds = ["purchase", "error", "view", "signup"]
    return [(i, t + dt.timedelta(minutes=7 * i), i % 3, kinds[i % 4], float(i)) for i in range(60)]


def write(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame(rows()[n * 30:n * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_ema_state_equals_the_closed_form(spark, tmp_path):
    got = run(E.feedback_ema(write(spark, tmp_path)), "ema", "update")
    last = {r["user_id"]: r["ema"] for r in got.groupBy("user_id").agg(F.max_by("ema", "n_signals").alias("ema")).collect()}
    want = {r["user_id"]: r["ema"] for r in batch_ema(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert set(last) == set(want) and all(abs(last[k] - want[k]) < 2e-6 for k in want)


def test_windows_and_sessions(spark, tmp_path):
    events = write(spark, tmp_path)
    counted = run(E.event_counts(events), "windows", "update").groupBy("start", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert counted == 60
    closed = run(E.closed_sessions(events, "20 minutes"), "sessions", "append")
    assert closed.filter("n > 1").count() == 0  # each user's events are 21 minutes apart


def test_files_become_chunks_once(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("A line about wind and weather. " * 30)
    (tmp_path / "docs" / "b.md").write_text("1\n")  # dropped by the quality chain
    for _ in range(2):
        I.ingest(I.text_files(spark, str(tmp_path / "docs")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("title").distinct().collect()[0][0] == "a" and got.count() == got.select("chunk_id").distinct().count()
