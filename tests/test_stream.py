from keyfold import queries
from keyfold.operators.aggregates import Measure
from keyfold.streaming import stream_job, stream_lines


def test_no_result_in_the_driver(spark, data):
    out = queries.stream_wordcount(spark, data)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan.lower() and "memory" not in plan.lower()


def test_table_follows_later_files(spark, tmp_path):
    def run(text):
        spark.createDataFrame([(w,) for w in text.split()], "value string").write.mode("append").text(f"{tmp_path}/in")
        rows = stream_lines(spark, f"{tmp_path}/in").withColumnRenamed("value", "word")
        stream_job(rows, ["word"], [Measure("n", "count")], f"{tmp_path}/state", sink="table", path=f"{tmp_path}/out").awaitTermination()
        return {r.word: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert run("a b a") == {"a": 2, "b": 1}
    assert run("b c") == {"a": 2, "b": 2, "c": 1}


def test_messages_count_once(spark, tmp_path):
    def run(rows):
        spark.createDataFrame([(f"{m} {w}",) for m, w in rows], "value string").write.mode("append").text(f"{tmp_path}/in")
        lines = stream_lines(spark, f"{tmp_path}/in", files_per_trigger=1).selectExpr("split(value, ' ')[0] id", "split(value, ' ')[1] word")
        stream_job(lines, ["word"], [Measure("n", "count")], f"{tmp_path}/state", path=f"{tmp_path}/out", dedupe=["id"]).awaitTermination()
        return {r.word: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert run([(1, "a"), (2, "a"), (1, "a")]) == {"a": 2}
    assert run([(2, "a"), (3, "b"), (4, "a")]) == {"a": 3, "b": 1}


def test_late_rows_are_left_out(spark, tmp_path):
    def run(rows):
        spark.createDataFrame([(f"{t} {w}",) for t, w in rows], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        lines = stream_lines(spark, f"{tmp_path}/in").selectExpr("to_timestamp(split(value, ' ')[0]) ts", "split(value, ' ')[1] word")
        stream_job(lines.selectExpr("ts hour", "word"), ["hour", "word"], [Measure("n", "count")], f"{tmp_path}/state", sink="parquet", event_time="hour", delay="1 hour", mode="append", path=f"{tmp_path}/out").awaitTermination()
        return sorted((str(r.hour), r.word, r.n) for r in spark.read.schema("hour timestamp, word string, n long").parquet(f"{tmp_path}/out").collect())

    run([("2024-01-01T00:00:00", "a"), ("2024-01-01T00:00:00", "a")])
    run([("2024-01-01T05:00:00", "b")])
    got = run([("2024-01-01T00:00:00", "a"), ("2024-01-01T09:00:00", "c")])
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 05:00:00", "b", 1)]
