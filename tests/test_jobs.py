"""Jobs from inputs to outputs: reading, map, HAVING, order, sinks, plans and settings."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyfold import Job, JobConfig, Measure
from keyfold.functions import words
from keyfold.operators.aggregates import CELL
from keyfold.plans.job import track
from keyfold.plans.workloads import pricing_summary_long, revenue_forecast
from keyfold.sinks import is_done, json_cells, json_pairs, write_json
from keyfold.sources.readers import LINEITEM_FIELDS, delimited_lines, read_delimited, read_lines, read_whole_files
from keyfold.sources.splits import list_files, plan_line_splits, plan_splits, split_manifest


def counted(*paths, **more):
    return Job(("word",), (Measure("n", "count"),), lambda df: df.select(F.explode(words(F.col("value"))).alias("word")), config=JobConfig(inputs=paths, **more.pop("config", {})), **more)


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "a.txt").write_text("b a c\nb\n")
    (tmp_path / "b.txt").write_text("c b d")
    return str(tmp_path / "a.txt"), str(tmp_path / "b.txt")


def test_run(spark, inputs):
    assert {tuple(r) for r in counted(*inputs).run(spark).collect()} == {("a", 1), ("b", 3), ("c", 2), ("d", 1)}
    assert {tuple(r) for r in counted(*inputs, config={"randomized_partition": True}).run(spark).collect()} == {("a", 1), ("b", 3), ("c", 2), ("d", 1)}
    spark.sparkContext.setLogLevel("ERROR")


def test_filter_and_order(spark, inputs):
    for having in ("n > 1", F.col("n") > 1, lambda df: df.filter("n > 1")):
        assert [tuple(r) for r in counted(*inputs, having=having, sort=("n", "word")).run(spark).collect()] == [("c", 2), ("b", 3)]
    assert [r.word for r in counted(*inputs, sort=lambda df: df.orderBy(F.col("n").desc(), "word")).run(spark).collect()] == ["b", "c", "a", "d"]
    parts = {}
    for r in counted(*inputs, sort=("word",), config={"num_reducers": 2}).run(spark).select("word", F.spark_partition_id().alias("p")).collect():
        parts.setdefault(r.p, []).append(r.word)
    assert all(p == sorted(p) for p in parts.values()) and sum(map(len, parts.values())) == 4


def test_what_can_not_run_is_refused(spark):
    with pytest.raises(ValueError):
        Job((), ()).validate()
    with pytest.raises(ValueError):
        Job(("n",), (Measure("n", "count"),)).validate()
    with pytest.raises(TypeError):
        counted("x", having=lambda a, b: a).validate()
    with pytest.raises(ValueError):
        Job((), (Measure("n", "count"),)).read(spark)
    for bad in ({"num_reducers": 0}, {"salts": 0}, {"split_bytes": 0}):
        with pytest.raises(ValueError):
            JobConfig(**bad)
    assert [JobConfig(log_level=k).spark_log_level for k in (1, 2, 3, 9)] == ["INFO", "ERROR", "WARN", "ERROR"]


def test_plan_and_settings(spark, inputs):
    plan = counted(*inputs).explain(spark)
    assert "HashAggregate" in plan and "Scan text" in plan
    spark.sparkContext.setLogLevel("ERROR")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    counted(*inputs).read(spark)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert track(spark)["stages"] == 0


def test_whole_files(spark, inputs):
    job = Job((), (Measure("bytes", "sum", "length"), Measure("n", "count")), config=JobConfig(inputs=inputs, logical_split=False))
    assert tuple(job.run(spark).first()) == (13, 2)
    spark.sparkContext.setLogLevel("ERROR")
    assert read_whole_files(spark, *inputs, max_bytes=5).count() == 1 and sorted(r.value for r in read_lines(spark, *inputs).collect()) == ["b", "b a c", "c b d"]


def line(k, ship="1995-03-0{}", fields=16):
    values = [str(k), "1", "2", "3", str(10 + k), "1000.5", "0.06", "0.02", "AR"[k % 2], "F", ship.format(k + 1), "d", "d", "i", "m", "c"]
    return "|".join(values[:fields]) + "|"


def test_delimited_lines(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("\n".join([line(0), line(1), line(2, fields=15), line(3) + "more|", "", line(4)]))
    rows = read_delimited(spark, [str(tmp_path / "x.tbl")])
    assert rows.columns == [n for n, _ in LINEITEM_FIELDS] and sorted(r.l_orderkey for r in rows.collect()) == [0, 1, 4]
    got = {r.key: r.value for r in pricing_summary_long(rows.withColumn("l_shipdate", F.to_timestamp_ntz("l_shipdate"))).collect()}
    assert got["A-F-count"] == 2 and got["R-F-count"] == 1 and got["A-F-l_quantity_sum"] == 24 and abs(got["R-F-l_disc_price_sum"] - 940.47) < 1e-9 and abs(got["R-F-l_charge_sum"] - 959.2794) < 1e-9
    sales = revenue_forecast().apply(rows.withColumn("l_shipdate", F.to_timestamp_ntz("l_shipdate"))).first().revenue
    assert abs(sales - 3 * 1000.5 * 0.06) < 1e-9


def test_values_that_are_none(spark):
    lines = spark.createDataFrame([("1|2|",), ("x|3|",)], "value string")
    fields = (("a", "int"), ("b", "int"))
    with pytest.raises(PySparkException):
        delimited_lines(lines, fields).collect()
    assert {tuple(r) for r in delimited_lines(lines, fields, strict=False).collect()} == {(1, 2), (None, 3)}
    assert delimited_lines(lines, fields, trailing=False).count() == 0


def test_json_cells(spark):
    rows = spark.createDataFrame([("s", "sum", 12.5, 2, 0.0, 0.0), ("x", "max", 0.0, 1, -3.0, -2.0), ("m", "min", 0.0, 1, -3.0, 5.0), ("a", "avg", 9.0, 3, 0.0, 0.0), ("z", "sum", 0.0, 1, 0.0, 0.0), ("n", "sum", None, 0, None, None)], CELL)
    got = {r.key: r.json for r in json_cells(rows).collect()}
    assert got == {"s": '{"Sum":"12.5"}', "x": '{"Max":"-2"}', "m": '{"Min":"-3"}', "a": '{"Avg":"3"}', "z": '{"Sum":"0"}', "n": None}
    assert {r.key: r.json for r in json_cells(rows, omit_zero=True).collect()}["z"] == "{}"


def test_json_pairs(spark):
    rows = spark.createDataFrame([("a", 1.5), ("b", 0.0)], "key string, value double")
    assert [r.json for r in json_pairs(rows).orderBy("key").collect()] == ['{"key":"a","value":1.5}', '{"key":"b","value":0.0}']
    assert [r.json for r in json_pairs(rows, omit_zero=True).orderBy("key").collect()] == ['{"key":"a","value":1.5}', '{"key":"b"}']


def test_layouts_of_outputs(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{k * 7 % 20:02}", float(k)) for k in range(20)], "key string, value double")
    parts = lambda name: [[json.loads(x)["key"] for x in p.read_text().splitlines()] for p in sorted((tmp_path / name).glob("part-*"))]
    write_json(rows, str(tmp_path / "global"))
    assert sum(parts("global"), []) == [f"k{k:02}" for k in range(20)]
    write_json(rows, str(tmp_path / "each"), reducers=3)
    each = [p for p in parts("each") if p]
    assert 1 < len(each) <= 3 and all(p == sorted(p) for p in each) and sorted(sum(each, [])) == [f"k{k:02}" for k in range(20)]
    assert is_done(spark, str(tmp_path / "each")) and not is_done(spark, str(tmp_path / "none"))


def test_splits(spark, inputs):
    files = list_files(spark, *inputs)
    assert sorted(r["size"] for r in files.collect()) == [5, 8]
    assert [r.split for r in plan_splits(files, limit=10).orderBy("path").collect()] == [0, 1] and [r.split for r in plan_splits(files, limit=13).collect()] == [0, 0]
    cut = plan_line_splits(files, limit=5).collect()
    assert sorted((r.first_byte, r.last_byte) for r in cut) == [(0, 4), (0, 4), (5, 7)]
    listed = [json.loads(r.value) for r in split_manifest(plan_splits(files, limit=13)).collect()]
    assert [(x["id"], x["size"], len(x["objects"])) for x in listed] == [(0, 13, 2)]
