"""What merging partial aggregates gives, and what it does not depend on."""

import datetime
import itertools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyfold.functions import composite_key, json_number, lenient_int, normalised_date, quirk_date, round_half_away, words
from keyfold.operators.aggregates import CELL, Measure, MixedAggregatorsError, cells, keyed_aggregate, merge_cells, one_kind, to_num, unpivot_measures
from keyfold.operators.dedupe import dedupe_batch, dedupe_simple, drop_padding, expected_batches
from keyfold.operators.ordering import having, sort_by_key, sort_by_value, sort_within_partitions
from keyfold.operators.partition import hash_partitioned, randomly_partitioned, two_stage_aggregate, with_partition_id

KINDS = ("sum", "max", "min", "avg", "count")


def cell(spark, *rows):
    return spark.createDataFrame([(k, kind, float(v), n, float(v), float(v)) for k, kind, v, n in rows], CELL)


def values(df):
    return {r.key: r.value for r in to_num(df).collect()}


def test_new_keys(spark):
    got = merge_cells(cell(spark, ("s", "sum", 1, 1), ("x", "max", 2, 1), ("m", "min", 3, 1), ("a", "avg", 4, 2)))
    assert values(got) == {"s": 1, "x": 2, "m": 3, "a": 2}


def test_existing_keys(spark):
    have = cell(spark, ("s", "sum", 2, 1), ("x", "max", 1, 1), ("m", "min", 90, 1), ("a", "avg", 5, 1))
    assert values(merge_cells(have, cell(spark, ("s", "sum", 1, 1), ("x", "max", 2, 1), ("m", "min", 3, 1), ("a", "avg", 4, 2)))) == {"s": 3, "x": 2, "m": 3, "a": 3}


def test_repeated_adds(spark):
    rows = spark.createDataFrame([("s", 2.0), ("s", 4.0), ("x", 1.0), ("x", 65.0), ("m", 90.0), ("m", 1324.0), ("a", 4.0), ("a", 8.0)], "key string, value double")
    parts = [cells(rows.filter(F.col("key") == k), "key", kind, "value") for k, kind in (("s", "sum"), ("x", "max"), ("m", "min"), ("a", "avg"))]
    assert values(merge_cells(*parts)) == {"s": 6, "x": 65, "m": 90, "a": 6}
    assert [(r["sum"], r.cnt) for r in parts[3].collect()] == [(12, 2)]


def test_an_empty_merge_changes_nothing(spark):
    have = cell(spark, ("s", "sum", 2, 1), ("a", "avg", 5, 1))
    assert values(merge_cells(have, have.limit(0))) == {"s": 2, "a": 5}
    assert merge_cells(have.limit(0)).count() == 0


def test_two_kinds_on_one_key(spark):
    for kind in ("max", "min", "avg"):
        both = (cell(spark, ("k", "sum", 4, 1)), cell(spark, ("k", kind, 7, 1)))
        with pytest.raises(PySparkException, match="Mixed aggregators used"):
            merge_cells(*both).collect()
        with pytest.raises(MixedAggregatorsError, match="Mixed aggregators used: k"):
            one_kind(both[0].unionByName(both[1]))
    assert one_kind(both[0]).count() == 1
    with pytest.raises(ValueError):
        cells(both[0], "key", "median", "sum")


def test_merging_does_not_depend_on_order_or_parts(spark):
    rows = spark.createDataFrame([(f"k{j % 3}", float(v)) for j, v in enumerate((3, -2, 0, 7.5, -2, 11, 4, 4, 0, -9))], "key string, value double")
    for kind in KINDS:
        want = values(cells(rows, "key", kind, "value"))
        parts = [cells(rows.filter(F.pmod(F.hash("value"), F.lit(3)) == k), "key", kind, "value") for k in range(3)]
        for order in itertools.islice(itertools.permutations(parts), 3):
            assert values(merge_cells(merge_cells(*order[:2]), order[2])) == want


def test_nulls_and_nan(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", None), ("c", float("nan")), ("c", 2.0)], "key string, value double")
    got = {r.key: r for r in keyed_aggregate(rows, ["key"], [Measure(k, k, "value") for k in KINDS]).collect()}
    assert tuple(got["a"][1:]) == (None, None, None, None, 0) and tuple(got["b"][1:]) == (1, 1, 1, 1, 1)
    assert got["c"]["min"] == 2 and got["c"]["max"] != got["c"]["max"]
    two = {r.key: r for r in two_stage_aggregate(rows, ["key"], [Measure(k, k, "value") for k in KINDS], salts=3).collect()}
    assert tuple(two["a"][1:]) == (None, None, None, None, 0) and tuple(two["b"][1:]) == (1, 1, 1, 1, 1)


@pytest.mark.parametrize("spread", [(), ("l_orderkey", "l_linenumber")])
def test_two_stages_give_what_one_gives(spark, data, spread):
    rows = spark.read.parquet(f"{data}/lineitem.parquet").repartition(5)
    measures = [Measure(k, k, "l_quantity") for k in KINDS]
    one, two = (sorted(map(tuple, f.collect())) for f in (keyed_aggregate(rows, ["l_suppkey"], measures), two_stage_aggregate(rows, ["l_suppkey"], measures, 7, spread)))
    assert [(a, b, c, d, round(e, 9), f) for a, b, c, d, e, f in one] == [(a, b, c, d, round(e, 9), f) for a, b, c, d, e, f in two]


def test_two_stages_read_only_what_they_need(spark, data):
    out = two_stage_aggregate(spark.read.parquet(f"{data}/lineitem.parquet"), ["l_suppkey"], [Measure("n", "sum", "l_quantity")])
    scan = next(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in x)
    assert scan.rpartition("ReadSchema: ")[2].startswith("struct<l_suppkey:bigint,l_quantity:double>")


def test_global_aggregates(spark):
    none = spark.createDataFrame([], "v double")
    assert [tuple(r) for r in keyed_aggregate(none, [], [Measure("s", "sum", "v"), Measure("n", "count")]).collect()] == [(None, 0)]
    assert keyed_aggregate(none, [], [Measure("s", "sum", "v")], drop_empty=True).count() == 0
    assert two_stage_aggregate(none, [], [Measure("s", "sum", "v")], drop_empty=True).count() == 0
    with pytest.raises(ValueError):
        Measure("x", "median", "v")


def test_ordering(spark):
    rows = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", 5.0)], "key string, value double")
    keys = lambda df: [r.key for r in df.collect()]
    assert keys(sort_by_value(rows)) == ["c", "a", "b", "d"] and keys(sort_by_value(rows, ascending=False)) == ["d", "a", "b", "c"]
    assert keys(sort_by_key(rows)) == ["a", "b", "c", "d"] and keys(sort_by_key(having(rows, F.col("value") > 1))) == ["a", "b", "d"]
    parts = {}
    for r in sort_within_partitions(rows, 2).select("key", F.spark_partition_id().alias("p")).collect():
        parts.setdefault(r.p, []).append(r.key)
    assert len(parts) == 2 and all(p == sorted(p) for p in parts.values())


def test_partitions(spark):
    rows = spark.range(1000).selectExpr("cast(id as string) key", "id")
    by_key = hash_partitioned(rows.unionByName(rows), "key", 5).select("key", F.spark_partition_id().alias("p"))
    assert by_key.groupBy("key").agg(F.countDistinct("p").alias("n")).filter("n > 1").isEmpty()
    spread = {r.p: r["count"] for r in randomly_partitioned(rows, 5).groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert len(spread) == 5 and min(spread.values()) > 100
    assert {r.partition_id for r in with_partition_id(rows, "key", 7).collect()} == set(range(7))


def test_deduplication_is_idempotent(spark):
    rows = spark.createDataFrame([("m", 1, k % 3, "k", 1.0) for k in range(9)] + [("m", 2, 0, "k", 1.0)], "map_id string, batch_id int, message_id int, key string, value double")
    once = dedupe_batch(rows)
    assert once.count() == dedupe_batch(once).count() == 4 and dedupe_simple(rows).count() == 3
    meta = spark.createDataFrame([("a", 5), ("a", 5), ("b", 5)], "map_id string, num_batches int")
    assert expected_batches(meta).first().expected == 10 and expected_batches(meta.limit(0)).first().expected == 0
    assert drop_padding(spark.createDataFrame([(1, True), (2, False), (3, None)], "v int, empty boolean")).count() == 2


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(words(lit(" a\tb  c\n d "))) == ["a", "b", "c", "d"] and one(composite_key(lit("A"), lit("F"), lit("n"))) == "A-F-n"
    assert [one(lenient_int(lit(x))) for x in ("12", "x", "", "-3")] == [12, 0, 0, -3]
    day = datetime.date
    assert one(normalised_date(lit(1994), lit(0), lit(5))) == day(1993, 12, 5) and one(normalised_date(lit(1994), lit(3), lit(0))) == day(1994, 2, 28)
    assert one(quirk_date(lit("1994-10-15"))) == day(1993, 12, 5) and one(quirk_date(lit("1998-12-01"))) == day(1998, 2, 1)
    assert [one(json_number(lit(x))) for x in (2.5, 3.0, -0.0, 1e10, 0.0001)] == ["2.5", "3", "0", "10000000000", "0.0001"]
    assert one(round_half_away(lit(2.345).cast("decimal(10,3)"))) == one(lit("2.35").cast("decimal(10,2)"))


def test_long_measures(spark):
    wide = spark.createDataFrame([("A", "F", 1.5, 2)], "f string, s string, total double, n int")
    assert {tuple(r) for r in unpivot_measures(wide, ["f", "s"], ["total", "n"]).collect()} == {("A-F-total", 1.5), ("A-F-n", 2.0)}
