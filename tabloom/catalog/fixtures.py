"""Tables derived from the given ones by one rule, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import h, table
from tabloom.functions.draws import hash32

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _holes(name: str, key: list[str]):
    return F.when(hash32("n", name, *[F.col(k) for k in key]) % 20 == 0, None).otherwise(F.col(name))


def _holes_sql(name: str, key: list[str]) -> str:
    return f"CASE WHEN {h(repr('n'), repr(name), *key)} % 20 = 0 THEN NULL ELSE {name} END AS {name}"


def events_nulls(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    return df.withColumns({c: _holes(c, ["event_id"]) for c in ("value", "event_type")})


EVENTS_NULLS = f"""events_nulls AS (SELECT event_id, user_id, ts, {_holes_sql('event_type', ['event_id'])}, props,
  {_holes_sql('value', ['event_id'])} FROM events)"""


def events_dups(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    return df.unionByName(df.where("event_id % 10 = 0")).drop("event_id")


EVENTS_DUPS = """events_dups AS (SELECT user_id, ts, event_type, props, value FROM events
  UNION ALL SELECT user_id, ts, event_type, props, value FROM events WHERE event_id % 10 = 0)"""

HOLED = ["l_quantity", "l_tax", "l_discount", "l_linestatus"]
LINE_COLS = [*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def lines_nulls(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(*LINE_COLS)
    return df.withColumns({c: _holes(c, LINE_KEY) for c in HOLED})


LINES_NULLS = f"""lines_nulls AS (SELECT {', '.join(LINE_KEY)}, l_extendedprice, l_returnflag,
  {', '.join(_holes_sql(c, LINE_KEY) for c in HOLED)} FROM lineitem)"""


def corr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(*LINE_KEY[:3], *LINE_NUMBERS)
    noise = hash32("noise", *[F.col(k) for k in LINE_KEY]) % 7
    return df.withColumn("twice_quantity", 2 * F.col("l_quantity") + 1).withColumn("near_quantity", F.col("l_quantity") + noise)


CORR_COLS = [*LINE_NUMBERS, "twice_quantity", "near_quantity"]
CORR_PAIRS = f"""corr_pairs AS (SELECT {', '.join(LINE_NUMBERS)}, 2 * l_quantity + 1 AS twice_quantity,
  l_quantity + {h("'noise'", *LINE_KEY)} % 7 AS near_quantity FROM lineitem)"""


def dates_text(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders")
    as_text = F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return df.select("o_orderkey", "o_orderdate", as_text.alias("o_datetext"), "o_orderstatus")


def docs_labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id")


DOCS_LABELLED = "docs_labelled AS (SELECT doc_id, quality, toxic, lang, source, n_chars FROM labels JOIN documents USING (doc_id))"


def split_case(key: list[str], seed: int = 42) -> str:
    bucket = f"{h(repr(str(seed)), *key)} % 10000"
    return f"CASE WHEN {bucket} < 7000 THEN 'train' WHEN {bucket} < 8500 THEN 'val' ELSE 'test' END"
