"""Registered queries of the keyed-aggregation engine, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import words
from keyfold.operators.aggregates import Measure, cells, keyed_aggregate, merge_cells, to_num
from keyfold.operators.dedupe import dedupe_batch, dedupe_simple, drop_padding, expected_batches
from keyfold.operators.ordering import having, sort_by_key, sort_by_value
from keyfold.operators.partition import two_stage_aggregate, with_partition_id
from keyfold.plans.workloads import Q1_MEASURES, pricing_summary, pricing_summary_long, revenue_forecast, word_count
from keyfold.sinks import json_cells
from keyfold.sources.readers import delimited_lines, read_table, union_inputs
from keyfold.sources.splits import plan_splits
from keyfold.streaming import stream_job, stream_lines


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; the warehouse if none is set and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/keyfold-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, *names: str, places: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def q1_pricing_summary(spark, d):
    out = pricing_summary().apply(read_table(spark, d, "lineitem"))
    return _rounded(_rounded(out, *(m.name for m in Q1_MEASURES[:4])), *(m.name for m in Q1_MEASURES[4:7]), places=6)


def q1_long_measures(spark, d):
    return _rounded(pricing_summary_long(read_table(spark, d, "lineitem")), "value")


def q6_revenue(spark, d):
    return _rounded(revenue_forecast().apply(read_table(spark, d, "lineitem")), "revenue")


def q6_revenue_strict(spark, d):
    return _rounded(revenue_forecast(strict=True).apply(read_table(spark, d, "lineitem")), "revenue")


def q6_two_stage_random(spark, d):
    return _rounded(revenue_forecast(randomized_partition=True).apply(read_table(spark, d, "lineitem")), "revenue")


def wordcount(spark, d):
    return word_count().apply(read_table(spark, d, "documents"))


def wordcount_having(spark, d):
    return word_count(at_least=5).apply(read_table(spark, d, "documents"))


def _by_type(kind):
    def query(spark, d):
        return _rounded(keyed_aggregate(read_table(spark, d, "events"), ["event_type"], [Measure("result", kind, "value")]), "result", places=4)

    return query


def agg_count_by_key(spark, d):
    return keyed_aggregate(read_table(spark, d, "events"), ["event_type"], [Measure("result", "count")])


def agg_multi_measure(spark, d):
    measures = [Measure("total", "sum", "o_totalprice"), Measure("top", "max", "o_totalprice"), Measure("low", "min", "o_totalprice"), Measure("mean", "avg", "o_totalprice"), Measure("n", "count")]
    return _rounded(keyed_aggregate(read_table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], measures), "total", "mean")


def agg_global(spark, d):
    return _rounded(keyed_aggregate(read_table(spark, d, "orders"), [], [Measure("total", "sum", "o_totalprice"), Measure("n", "count")]), "total")


def agg_global_drop_empty(spark, d):
    return keyed_aggregate(read_table(spark, d, "orders").filter("o_totalprice < 0"), [], [Measure("total", "sum", "o_totalprice")], drop_empty=True)


def agg_merge_partials(spark, d):
    o = read_table(spark, d, "orders")
    parts = [merge_cells(*(cells(o.filter(F.col("o_orderstatus") == s), F.concat("o_orderpriority", F.lit(f"-{k}")), k, "o_totalprice") for s in "FOP")) for k in ("sum", "max", "min", "avg", "count")]
    return _rounded(to_num(union_inputs(parts)), "value")


def having_filter(spark, d):
    out = keyed_aggregate(read_table(spark, d, "lineitem"), ["l_suppkey"], [Measure("qty", "sum", "l_quantity")])
    return having(out, "qty > 15000")


def _ordered(by):
    def query(spark, d):
        out = keyed_aggregate(read_table(spark, d, "events"), ["event_type"], [Measure("value", "sum", "value")]).select(F.col("event_type").alias("key"), F.round("value", 2).alias("value"))
        return by(out)

    return query


def hash_partition_ids(spark, d):
    return with_partition_id(read_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key")), "key", 7)


def hash_partition_counts(spark, d):
    return hash_partition_ids(spark, d).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))


def two_stage_salted_agg(spark, d):
    measures = [Measure("total", "sum", "l_extendedprice"), Measure("mean", "avg", "l_discount"), Measure("top", "max", "l_extendedprice"), Measure("low", "min", "l_extendedprice"), Measure("n", "count")]
    out = two_stage_aggregate(read_table(spark, d, "lineitem"), ["l_suppkey"], measures, spread_by=["l_orderkey", "l_linenumber"])
    return _rounded(_rounded(out, "total"), "mean", places=10)


def _messages(spark, d):
    e = read_table(spark, d, "events").select(
        (F.col("user_id") % 16).cast("string").alias("map_id"), F.floor(F.col("event_id") / 10).cast("long").alias("batch_id"), (F.col("event_id") % 10).alias("message_id"), F.col("event_type").alias("key"), "value"
    )
    return e.unionByName(e.filter("message_id < 5"))


def dedupe_batch_query(spark, d):
    return _rounded(keyed_aggregate(dedupe_batch(_messages(spark, d)), ["key"], [Measure("total", "sum", "value"), Measure("n", "count")]), "total")


def dedupe_simple_query(spark, d):
    e = read_table(spark, d, "events").select(F.md5(F.col("event_id").cast("string")).alias("message_id"), F.col("event_type").alias("key"), "value")
    return _rounded(keyed_aggregate(dedupe_simple(e.unionByName(e)), ["key"], [Measure("total", "sum", "value"), Measure("n", "count")]), "total")


def expected_batches_query(spark, d):
    meta = read_table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("map_id"), (F.col("c_nationkey") + 1).alias("num_batches"))
    return expected_batches(meta)


def padding_dropped(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_type").alias("key"), "value", (F.col("event_id") % 10 == 9).alias("empty"))
    return keyed_aggregate(drop_padding(e), ["key"], [Measure("n", "count")])


_FIELDS = (("l_orderkey", "bigint"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_returnflag", "string"))


def _lines(spark, d):
    return read_table(spark, d, "lineitem").select(F.concat(F.concat_ws("|", *(F.col(n).cast("string") for n, _ in _FIELDS)), F.lit("|")).alias("value"))


def delimited_scan_roundtrip(spark, d):
    path = shared_folder(spark)
    _lines(spark, d).write.text(path)
    rows = delimited_lines(spark.read.text(path), _FIELDS)
    return _rounded(keyed_aggregate(rows, ["l_returnflag"], [Measure("total", "sum", "l_extendedprice"), Measure("n", "count")]), "total")


def malformed_row_drop(spark, d):
    bad = read_table(spark, d, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"))
    rows = delimited_lines(_lines(spark, d).unionByName(bad), _FIELDS)
    return keyed_aggregate(rows, ["l_returnflag"], [Measure("n", "count")])


def multi_input_union(spark, d):
    a, b = read_table(spark, d, "customer").select(F.col("c_acctbal").alias("bal")), read_table(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"))
    return _rounded(keyed_aggregate(union_inputs([a, b]), [], [Measure("total", "sum", "bal"), Measure("n", "count")]), "total")


def events_by_type(spark, d):
    return _rounded(keyed_aggregate(read_table(spark, d, "events"), ["event_type"], [Measure("n", "count"), Measure("mean", "avg", "value"), Measure("top", "max", "value")]), "mean", places=4)


def split_plan(spark, d):
    files = read_table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return plan_splits(files, limit=40_000, group="source", order="doc_id", size="n_chars")


def json_cell_output(spark, d):
    c = cells(read_table(spark, d, "orders"), "o_orderpriority", "max", "o_totalprice")
    return json_cells(c)


def stream_wordcount(spark, d):
    """Lines written out, then counted by a stream that takes what is there; the batch result is its oracle."""
    base = shared_folder(spark)
    read_table(spark, d, "documents").select(F.regexp_replace("text", "\n", " ").alias("value")).write.text(f"{base}/in")
    rows = stream_lines(spark, f"{base}/in").select(F.explode(words(F.col("value"))).alias("word"))
    stream_job(rows, ["word"], [Measure("n", "count")], f"{base}/state", sink="table", path=f"{base}/out").awaitTermination()
    return spark.read.schema("word string, n long").parquet(f"{base}/out")


QUERIES = {
    "q1_pricing_summary": q1_pricing_summary, "q1_long_measures": q1_long_measures, "q6_revenue": q6_revenue, "q6_revenue_strict": q6_revenue_strict,
    "q6_two_stage_random": q6_two_stage_random, "wordcount": wordcount, "wordcount_having": wordcount_having,
    "agg_sum_by_key": _by_type("sum"), "agg_max_by_key": _by_type("max"), "agg_min_by_key": _by_type("min"), "agg_avg_by_key": _by_type("avg"),
    "agg_count_by_key": agg_count_by_key, "agg_multi_measure": agg_multi_measure, "agg_global": agg_global, "agg_global_drop_empty": agg_global_drop_empty,
    "agg_merge_partials": agg_merge_partials, "having_filter": having_filter, "sort_by_value": _ordered(sort_by_value), "sort_by_key": _ordered(sort_by_key),
    "hash_partition_ids": hash_partition_ids, "hash_partition_counts": hash_partition_counts, "two_stage_salted_agg": two_stage_salted_agg,
    "dedupe_batch": dedupe_batch_query, "dedupe_simple": dedupe_simple_query, "expected_batches": expected_batches_query, "padding_dropped": padding_dropped,
    "delimited_scan_roundtrip": delimited_scan_roundtrip, "malformed_row_drop": malformed_row_drop, "multi_input_union": multi_input_union,
    "events_by_type": events_by_type, "split_plan": split_plan, "json_cell_output": json_cell_output, "stream_wordcount": stream_wordcount,
}

_Q1 = """select l_returnflag, l_linestatus, sum(l_quantity) l_quantity_sum, sum(l_extendedprice) l_base_price_sum,
 sum(l_extendedprice * (1 - l_discount)) l_disc_price_sum, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) l_charge_sum,
 avg(l_quantity) quantity_avg, avg(l_extendedprice) avg_price, avg(l_discount) avg_disc, count(*) "count"
 from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus"""
_Q6 = "select round(sum(l_extendedprice * l_discount), 2) revenue from lineitem where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1996-01-01' and l_quantity < 24 and l_discount {}"
_BETWEEN = "between cast(0.05 as double) and cast(0.07 as double)"
_WORDS = "select word, count(*) n from (select unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) word from documents) where word <> '' group by word"
_TYPE = "select event_type, round({}(value), 4) result from events group by event_type"
_MSG = "select (user_id % 16)::varchar map_id, event_id // 10 batch_id, event_id % 10 message_id, event_type key, value from events"
_NAMES = [m.name for m in Q1_MEASURES]

ORACLE_SQL = {
    "q1_pricing_summary": "select l_returnflag, l_linestatus, " + ", ".join(f"round({n}, {2 if k < 4 else 6}) {n}" for k, n in enumerate(_NAMES[:7])) + f', "count" from ({_Q1})',
    "q1_long_measures": f"with q as ({_Q1}) " + " union all ".join(f"select l_returnflag || '-' || l_linestatus || '-{n}' as key, round(\"{n}\"::double, 2) as value from q" for n in _NAMES),
    "q6_revenue": _Q6.format(_BETWEEN), "q6_two_stage_random": _Q6.format(_BETWEEN), "q6_revenue_strict": _Q6.format("> cast(0.05 as double) and l_discount < cast(0.07 as double)"),
    "wordcount": _WORDS, "stream_wordcount": _WORDS, "wordcount_having": _WORDS + " having count(*) >= 5",
    **{f"agg_{k}_by_key": _TYPE.format(k) for k in ("sum", "max", "min", "avg")},
    "agg_count_by_key": "select event_type, count(*) result from events group by event_type",
    "agg_multi_measure": "select o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) total, max(o_totalprice) top, min(o_totalprice) low, round(avg(o_totalprice), 2) mean, count(*) n from orders group by all",
    "agg_global": "select round(sum(o_totalprice), 2) total, count(*) n from orders",
    "agg_global_drop_empty": "select sum(o_totalprice) total from orders where o_totalprice < 0 having count(*) > 0",
    "agg_merge_partials": " union all ".join(f"select o_orderpriority || '-{k}' as key, round({k}(o_totalprice)::double, 2) as value from orders group by o_orderpriority" for k in ("sum", "max", "min", "avg", "count")),
    "having_filter": "select l_suppkey, sum(l_quantity) qty from lineitem group by l_suppkey having sum(l_quantity) > 15000",
    "sort_by_value": "select event_type key, round(sum(value), 2) value from events group by event_type order by value, key",
    "sort_by_key": "select event_type key, round(sum(value), 2) value from events group by event_type order by key",
    "hash_partition_ids": "select o_orderkey::varchar key, (('0x' || substr(md5(o_orderkey::varchar), 17, 16))::ubigint % 7)::int partition_id from orders",
    "hash_partition_counts": "select (('0x' || substr(md5(o_orderkey::varchar), 17, 16))::ubigint % 7)::int partition_id, count(*) n from orders group by 1",
    "two_stage_salted_agg": "select l_suppkey, round(sum(l_extendedprice), 2) total, round(avg(l_discount), 10) mean, max(l_extendedprice) top, min(l_extendedprice) low, count(*) n from lineitem group by l_suppkey",
    "dedupe_batch": f"select key, round(sum(value), 2) total, count(*) n from (select distinct * from ({_MSG} union all select * from ({_MSG}) where message_id < 5)) group by key",
    "dedupe_simple": "select event_type key, round(sum(value), 2) total, count(*) n from events group by event_type",
    "expected_batches": "select coalesce(sum(k + 1), 0)::bigint expected from (select distinct c_nationkey k from customer)",
    "padding_dropped": "select event_type key, count(*) n from events where event_id % 10 <> 9 group by event_type",
    "delimited_scan_roundtrip": "select l_returnflag, round(sum(l_extendedprice), 2) total, count(*) n from lineitem group by l_returnflag",
    "malformed_row_drop": "select l_returnflag, count(*) n from lineitem group by l_returnflag",
    "multi_input_union": "select round(sum(bal), 2) total, count(*) n from (select c_acctbal bal from customer union all select s_acctbal from supplier)",
    "events_by_type": "select event_type, count(*) n, round(avg(value), 4) mean, max(value) top from events group by event_type",
    "split_plan": """with recursive o as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) k from documents),
 p as (select source, doc_id, n_chars, k, 0 split, n_chars used from o where k = 1 union all
 select o.source, o.doc_id, o.n_chars, o.k, case when p.used + o.n_chars > 40000 then p.split + 1 else p.split end,
 case when p.used + o.n_chars > 40000 then o.n_chars else p.used + o.n_chars end from p join o on o.source = p.source and o.k = p.k + 1)
 select source, doc_id, n_chars, split from p""",
    "json_cell_output": """select o_orderpriority key, '{"Max":"' || regexp_replace(max(o_totalprice)::decimal(38, 2)::varchar, '\\.?0+$', '') || '"}' json from orders group by o_orderpriority""",
}
