"""Queries on profiling, cleaning and single-table statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog import fixtures as fx
from tabloom.catalog.registry import h, query, r, rnd, rounded, table
from tabloom.functions.draws import hash32
from tabloom.operators import clean, components, correlate, impute, information, profile, shared
from tabloom.operators.quantiles import quantiles
from tabloom.sources import tables

NUMS = fx.LINE_NUMBERS
LINE_TEXT = ["l_returnflag", "l_linestatus"]


def _union(template: str, cols: list[str]) -> str:
    return "\nUNION ALL ".join(template.format(c=c) for c in cols)


_COUNTS = "SELECT '{c}' AS \"column\", count({c})::BIGINT AS n_values, count(DISTINCT {c})::BIGINT AS n_distinct, "
_NUM = _COUNTS + ", ".join([
    r("100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)") + " AS missing_pct", r("avg({c})") + " AS mean", r("stddev_samp({c})") + " AS std",
    r("min({c})::DOUBLE") + " AS min", r("quantile_cont({c}::DOUBLE, 0.25)") + " AS q25", r("quantile_cont({c}::DOUBLE, 0.5)") + " AS q50",
    r("quantile_cont({c}::DOUBLE, 0.75)") + " AS q75", r("max({c})::DOUBLE") + " AS max",
]) + " FROM lines_nulls"
_TXT = _COUNTS + r("100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)") + " AS missing_pct, " + ", ".join(
    f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "q25", "q50", "q75", "max")
) + " FROM lines_nulls"
PROFILE_NUMS = [*fx.LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_profile", f"WITH {fx.LINES_NULLS} {_union(_NUM, PROFILE_NUMS)} UNION ALL {_union(_TXT, LINE_TEXT)}")
def column_profile(spark, sf):
    out = profile.column_profile(fx.lines_nulls(spark, sf))
    return rounded(out, ["missing_pct", "mean", "std", "min", "q25", "q50", "q75", "max"])


VALUE_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("value_counts", _union(
    "SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*)::BIGINT AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share"
    " FROM lineitem GROUP BY {c}", VALUE_COLS))
def value_counts(spark, sf):
    counts = profile.value_counts(table(spark, sf, "lineitem"), VALUE_COLS)
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    out = shared.lookup_join(counts, totals, ["column"])
    return out.select("column", "value", "count", rnd(F.col("count") / F.col("total")).alias("share"))


PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("column_quantiles", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS prob, {r(f'quantile_cont({c}::DOUBLE, {p})')} AS value FROM lineitem" for c in NUMS for p in PROBS))
def column_quantiles(spark, sf):
    return rounded(quantiles(table(spark, sf, "lineitem"), NUMS, PROBS), ["value"])


@query("bracketed_quantiles", "\nUNION ALL ".join(
    f"SELECT event_type, 'value' AS \"column\", {p}::DOUBLE AS prob, {r(f'quantile_cont(value, {p})')} AS value FROM events GROUP BY event_type"
    for p in PROBS))
def bracketed_quantiles(spark, sf):
    """The path for groups too large for one buffer, per event type."""
    out = quantiles(table(spark, sf, "events"), ["value"], PROBS, ["event_type"], small=0)
    return rounded(out, ["value"])


_ODD_SQL = "odd AS (SELECT event_id, event_type, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 THEN value END AS value FROM events)"


def _odd(spark, sf):
    """Events with NaN, infinities and nulls among the values."""
    value = (F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf"))
             .when(F.col("event_id") % 17 != 0, F.col("value")))
    return table(spark, sf, "events").select("event_id", "event_type", value.alias("value"))


@query("quantiles_nonfinite", f"WITH {_ODD_SQL} " + "\nUNION ALL ".join(
    f"SELECT event_type, 'value' AS \"column\", {p}::DOUBLE AS prob, {r(f'quantile_cont(value, {p})')} AS value FROM odd GROUP BY event_type"
    for p in PROBS))
def quantiles_nonfinite(spark, sf):
    return rounded(quantiles(_odd(spark, sf), ["value"], PROBS, ["event_type"], small=0), ["value"])


@query("impute_nonfinite", f"WITH {_ODD_SQL} SELECT event_id, {r('coalesce(value, (SELECT avg(value) FROM odd))')} AS value FROM odd")
def impute_nonfinite(spark, sf):
    df = _odd(spark, sf)
    return rounded(impute.apply_impute(df, impute.fit_impute(df, ["value"])).select("event_id", "value"), ["value"])


_EVENT_COLS = ["event_id", "user_id", "ts", "event_type", "props", "value"]
_MISSING = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _EVENT_COLS)


@query("missing_pct", f"WITH {fx.EVENTS_NULLS} SELECT {r(f'100.0 * ({_MISSING}) / (6 * count(*))')} AS missing_values_pct FROM events_nulls")
def missing_pct(spark, sf):
    return rounded(profile.missing_pct(fx.events_nulls(spark, sf)), ["missing_values_pct"])


@query("skew_kurt", _union("SELECT '{c}' AS \"column\", " + r("skewness({c})") + " AS skewness, " + r("kurtosis({c})") + " AS kurtosis FROM lineitem", NUMS))
def skew_kurt(spark, sf):
    return rounded(profile.shape_stats(table(spark, sf, "lineitem"), NUMS), ["skewness", "kurtosis"])


@query("var_of_stats", f"""WITH s AS ({_union('SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem', NUMS)})
SELECT {r('var_samp(m)', 2)} AS var_mean, {r('var_samp(s)', 2)} AS var_std FROM s""")
def var_of_stats(spark, sf):
    return rounded(profile.variance_of_stats(table(spark, sf, "lineitem"), NUMS), ["var_mean", "var_std"], 2)


def _corr_union(cols, source, extra=""):
    return "\nUNION ALL ".join(
        f"SELECT {i}::INT AS i, {j}::INT AS j, '{cols[i]}' AS \"left\", '{cols[j]}' AS \"right\", corr({cols[i]}, {cols[j]}) AS c FROM {source}{extra}"
        for i in range(len(cols)) for j in range(i + 1, len(cols)))


@query("corr_matrix", f"WITH {fx.CORR_PAIRS}, c AS ({_corr_union(fx.CORR_COLS, 'corr_pairs')}) SELECT i, j, \"left\", \"right\", {r('c')} AS corr FROM c")
def corr_matrix(spark, sf):
    return rounded(correlate.correlation_pairs(fx.corr_pairs(spark, sf), fx.CORR_COLS), ["corr"])


WIDE = [f"v{i}" for i in range(1, 65)]
_WIDE_SQL = "wide AS (SELECT " + ", ".join(f"CASE WHEN vec_id % {i + 6} <> 0 THEN embedding[{i}]::DOUBLE END AS v{i}" for i in range(1, 65)) + " FROM embeddings)"


@query("corr_wide", f"WITH {_WIDE_SQL}, c AS ({_corr_union(WIDE, 'wide')}) SELECT i, j, \"left\", \"right\", {r('c')} AS corr FROM c")
def corr_wide(spark, sf):
    """All columns, each with gaps of its own: every pair has other rows."""
    values = [F.when(F.col("vec_id") % (i + 6) != 0, F.col("embedding")[i - 1].cast("double")).alias(f"v{i}") for i in range(1, 65)]
    df = table(spark, sf, "embeddings").select(*values)
    return rounded(correlate.correlation_pairs(df, WIDE), ["corr"])


@query("corr_summary", f"""WITH {fx.CORR_PAIRS}, c AS ({_corr_union(fx.CORR_COLS, 'corr_pairs')})
SELECT {r('avg(abs(c))')} AS avg_correlation, {r('max(abs(c))')} AS max_correlation FROM c""")
def corr_summary(spark, sf):
    pairs = correlate.correlation_pairs(fx.corr_pairs(spark, sf), fx.CORR_COLS)
    return rounded(correlate.correlation_summary(pairs), ["avg_correlation", "max_correlation"])


_CT = [c for c in NUMS if c != "l_extendedprice"]


@query("corr_with_target", _union("SELECT '{c}' AS \"column\", " + r("corr({c}, l_extendedprice)") + " AS corr FROM lineitem", _CT))
def corr_with_target(spark, sf):
    return rounded(correlate.label_correlations(table(spark, sf, "lineitem"), _CT, F.col("l_extendedprice")), ["corr"])


@query("class_entropy", f"""WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT n / sum(n) OVER () AS p FROM c)
SELECT {r('-sum(p * log2(p))')} AS class_entropy, count(*)::BIGINT AS n_classes FROM t""")
def class_entropy(spark, sf):
    return rounded(information.class_entropy(table(spark, sf, "lineitem"), "l_returnflag"), ["class_entropy"])


def _hist_sql(cols, source):
    return "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", least(floor(({c} - lo) / (hi - lo) * 10.0::DOUBLE), 9)::INT AS bin
      FROM {source}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {source}) WHERE {c} IS NOT NULL""" for c in cols)


_HIST = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("histogram10", f"SELECT \"column\", bin, count(*)::BIGINT AS count FROM ({_hist_sql(_HIST, 'lineitem')}) GROUP BY 1, 2")
def histogram10(spark, sf):
    return information.histogram(table(spark, sf, "lineitem"), _HIST)


@query("feature_entropy", f"""WITH b AS ({_hist_sql(_HIST, 'lineitem')}
  UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem),
 c AS (SELECT "column", bin, count(*) AS n FROM b GROUP BY 1, 2), p AS (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p FROM c)
SELECT "column", {r('-sum(p * ln(p))')} AS entropy FROM p GROUP BY 1""")
def feature_entropy(spark, sf):
    return rounded(information.feature_entropy(table(spark, sf, "lineitem"), [*_HIST, "l_linenumber"]), ["entropy"])


def mutual_sql(cols, label, source):
    cuts = ", ".join(f"quantile_cont({{c}}::DOUBLE, {p}) AS q{i}" for i, p in enumerate(information.DECILES))
    code = " + ".join(f"({{c}} > q{i})::INT" for i in range(9))
    binned = _union(f"SELECT '{{c}}' AS col, {code} AS bin, {label} AS cls FROM {source}, (SELECT {cuts} FROM {source})", cols)
    return f"""b AS ({binned}), j AS (SELECT col, bin, cls, count(*) AS n FROM b GROUP BY ALL),
 w AS (SELECT col, n, sum(n) OVER (PARTITION BY col) AS t, sum(n) OVER (PARTITION BY col, bin) AS nb, sum(n) OVER (PARTITION BY col, cls) AS nc FROM j),
 mi AS (SELECT col, sum(n / t * ln(n * t / (nb * nc))) AS mi FROM w GROUP BY col)"""


@query("mutual_info", f"WITH {mutual_sql(_HIST, 'l_returnflag', 'lineitem')} SELECT col AS \"column\", {r('mi')} AS mutual_info FROM mi")
def mutual_info(spark, sf):
    return rounded(information.mutual_information(table(spark, sf, "lineitem"), _HIST, "l_returnflag"), ["mutual_info"])


@query("pca_fraction", f"""WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a FROM lineitem)
SELECT {r('(1 + a) / 2')} AS first_share, CASE WHEN (1 + a) / 2 >= 0.95 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS pca_fraction_95 FROM c""")
def pca_fraction(spark, sf):
    df = table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice"]
    shares = components.explained_shares(correlate.correlation_pairs(df, cols).collect(), 2)
    needed = components.components_needed(shares) / 2
    return rounded(spark.createDataFrame([(float(shares[0]), needed)], "first_share double, pca_fraction_95 double"), ["first_share"])


@query("cumulative_share", f"""WITH v AS ({_union("SELECT '{c}' AS \"column\", var_samp({c}) AS v FROM lineitem", NUMS)})
SELECT "column", {r('v / sum(v) OVER ()')} AS share, {r('sum(v) OVER (ORDER BY v DESC) / sum(v) OVER ()')} AS cumulative FROM v""")
def cumulative_share(spark, sf):
    """Share of the total variance per column and its running sum, largest first."""
    stats = profile.wide_stats(table(spark, sf, "lineitem"), NUMS, {"v": F.var_samp})
    stats = stats.withColumn("minus", -F.col("v"))
    run = shared.running_sum(stats, ["minus"], "v", "upto")
    total = run.agg(F.sum("v")).first()[0]
    return run.select("column", rnd(F.col("v") / total).alias("share"), rnd(F.col("upto") / total).alias("cumulative"))


# --- cleaning -------------------------------------------------------------


@query("dedupe_rows", f"""WITH {fx.EVENTS_DUPS}, d AS (SELECT DISTINCT * FROM events_dups)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type, props, {r('value')} AS value FROM d""")
def dedupe_rows(spark, sf):
    out = clean.drop_duplicate_rows(fx.events_dups(spark, sf))
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", "props", rnd("value").alias("value"))


_TASKS = {"l_linenumber": "int", "l_orderkey": "int", "l_quantity": "float", "l_returnflag": "text", "l_suppkey": "int"}


@query("task_type", "\nUNION ALL ".join(
    f"SELECT '{c}' AS label, CASE WHEN {'count(*) >= 0' if k == 'text' else 'count(*) < 0' if k == 'float' else f'count(DISTINCT {c}) <= 20'}"
    f" THEN 'classification' ELSE 'regression' END AS task_type FROM lineitem" for c, k in _TASKS.items()))
def task_type(spark, sf):
    found = clean.task_types(table(spark, sf, "lineitem"), list(_TASKS))
    return spark.createDataFrame(list(found.items()), "label string, task_type string")


@query("bad_columns", """WITH t AS (SELECT event_id, user_id, event_type, value, NULL::VARCHAR AS empty, 7 AS seven,
 CASE WHEN event_id % 3 = 0 THEN 'x' END AS only_x FROM events)
SELECT * FROM (SELECT 'empty' AS "column", CASE WHEN count(empty) = 0 THEN 'all_null' WHEN min(empty) = max(empty) THEN 'constant' END AS reason FROM t
 UNION ALL SELECT 'seven', CASE WHEN count(seven) = 0 THEN 'all_null' WHEN min(seven) = max(seven) THEN 'constant' END FROM t
 UNION ALL SELECT 'only_x', CASE WHEN count(only_x) = 0 THEN 'all_null' WHEN min(only_x) = max(only_x) THEN 'constant' END FROM t
 UNION ALL SELECT 'event_id', CASE WHEN count(event_id) = 0 THEN 'all_null' WHEN min(event_id) = max(event_id) THEN 'constant' END FROM t
 UNION ALL SELECT 'user_id', CASE WHEN count(user_id) = 0 THEN 'all_null' WHEN min(user_id) = max(user_id) THEN 'constant' END FROM t
 UNION ALL SELECT 'event_type', CASE WHEN count(event_type) = 0 THEN 'all_null' WHEN min(event_type) = max(event_type) THEN 'constant' END FROM t)
WHERE reason IS NOT NULL""")
def bad_columns(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.lit(None).cast("string").alias("empty"), F.lit(7).alias("seven"),
        F.when(F.col("event_id") % 3 == 0, "x").alias("only_x"))
    return clean.unusable_columns(df, label="value")


@query("identifier_columns", """WITH c AS (SELECT c_custkey AS customer, c_name AS full_text, c_mktsegment, c_nationkey AS nation, c_acctbal,
 c_custkey // 2 AS half, c_custkey AS row_guid FROM customer),
 s AS (SELECT count(*) AS n, count(DISTINCT customer) AS a, count(DISTINCT full_text) AS b, count(DISTINCT c_mktsegment) AS d,
  count(DISTINCT nation) AS e, count(DISTINCT half) AS f, count(DISTINCT c_acctbal) AS g FROM c),
 m AS (SELECT bool_and(coalesce(nation >= pn, TRUE)) AS nation_up, bool_and(coalesce(half >= ph, TRUE)) AS half_up FROM
  (SELECT nation, half, lag(nation) OVER (ORDER BY customer) AS pn, lag(half) OVER (ORDER BY customer) AS ph FROM c))
SELECT * FROM (SELECT 'customer' AS "column", CASE WHEN a / n >= 0.98 THEN 'unique' END AS reason FROM s
 UNION ALL SELECT 'full_text', CASE WHEN b / n >= 0.98 THEN 'unique' END FROM s
 UNION ALL SELECT 'c_mktsegment', CASE WHEN d / n >= 0.98 THEN 'unique' END FROM s
 UNION ALL SELECT 'nation', CASE WHEN e / n >= 0.98 THEN 'unique' WHEN nation_up THEN 'monotonic' END FROM s, m
 UNION ALL SELECT 'half', CASE WHEN f / n >= 0.98 THEN 'unique' WHEN half_up THEN 'monotonic' END FROM s, m
 UNION ALL SELECT 'row_guid', 'name') WHERE reason IS NOT NULL""")
def identifier_columns(spark, sf):
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer"), F.col("c_name").alias("full_text"), "c_mktsegment", F.col("c_nationkey").alias("nation"),
        "c_acctbal", F.floor(F.col("c_custkey") / 2).cast("long").alias("half"), F.col("c_custkey").alias("row_guid"))
    return clean.identifier_columns(df, label="c_acctbal", order="customer")


@query("is_monotonic", """SELECT 'l_linenumber' AS "column", bool_and(coalesce(l_linenumber >= p, TRUE)) AS is_monotonic FROM
 (SELECT l_linenumber, lag(l_linenumber) OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS p FROM lineitem)
UNION ALL SELECT 'l_orderkey', bool_and(coalesce(l_orderkey >= p, TRUE)) FROM
 (SELECT l_orderkey, lag(l_orderkey) OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS p FROM lineitem)""")
def is_monotonic(spark, sf):
    df = table(spark, sf, "lineitem").select(F.struct(*fx.LINE_KEY).alias("at"), "l_linenumber", "l_orderkey")
    return shared.is_monotonic(df, "at", ["l_linenumber", "l_orderkey"])


@query("is_monotonic_nulls", "\nUNION ALL ".join(
    f"SELECT '{name}' AS \"column\", bool_and(v IS NOT NULL AND coalesce(v >= p, TRUE)) AS is_monotonic FROM (SELECT {sql} AS v, lag({sql}) OVER (ORDER BY event_id) AS p FROM events)"
    for name, sql in (("up", "event_id"), ("gaps", "CASE WHEN event_id % 5 <> 0 THEN event_id END"), ("falls", "event_id % 100"))))
def is_monotonic_nulls(spark, sf):
    at = F.col("event_id")
    df = table(spark, sf, "events").select("event_id", at.alias("up"), F.when(at % 5 != 0, at).alias("gaps"), (at % 100).alias("falls"))
    return shared.is_monotonic(df, "event_id", ["up", "gaps", "falls"])


def _date_parts(c: str, expr: str, source: str) -> str:
    return ", ".join([
        f"year({expr})::INT AS {c}_year", f"month({expr})::INT AS {c}_month", f"day({expr})::INT AS {c}_day", f"(isodow({expr}) - 1)::INT AS {c}_weekday",
        f"hour({expr})::INT AS {c}_hour", f"minute({expr})::INT AS {c}_minute", f"second({expr})::INT AS {c}_second",
        f"floor((epoch_us({expr}) - (SELECT min(epoch_us({expr})) FROM {source})) / 86400000000.0)::BIGINT AS {c}_elapsed_days"])


_PARSED = "try_strptime(o_datetext, '%Y-%m-%d')"


@query("datetime_features", f"""WITH d AS (SELECT o_orderkey, o_orderdate, o_orderstatus,
 CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_datetext FROM orders)
SELECT o_orderkey, o_orderstatus, {_date_parts('o_orderdate', 'o_orderdate', 'd')}, {_date_parts('o_datetext', _PARSED, 'd')} FROM d""")
def datetime_features(spark, sf):
    return clean.expand_dates(fx.dates_text(spark, sf), label="o_orderstatus")


@query("target_not_null", f"WITH {fx.EVENTS_NULLS} SELECT event_id, event_type, {r('value')} AS value FROM events_nulls WHERE value IS NOT NULL")
def target_not_null(spark, sf):
    return clean.drop_null_labels(fx.events_nulls(spark, sf), "value").select("event_id", "event_type", rnd("value").alias("value"))


@query("align_columns", "SELECT event_type, NULL::DOUBLE AS absent, user_id, event_id FROM events")
def align_columns(spark, sf):
    wanted = [("event_type", "string"), ("absent", "double"), ("user_id", "bigint"), ("event_id", "bigint")]
    return clean.align(table(spark, sf, "events"), wanted)


@query("feature_type_counts", """SELECT count(*) FILTER (WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE'))::BIGINT AS n_num_features,
 count(*) FILTER (WHERE column_type NOT IN ('BIGINT', 'INTEGER', 'DOUBLE'))::BIGINT AS n_cat_features,
 (SELECT count(*) FROM lineitem)::BIGINT AS n_instances
FROM (DESCRIBE lineitem) WHERE column_name <> 'l_returnflag'""")
def feature_type_counts(spark, sf):
    df = table(spark, sf, "lineitem")
    num, cat = clean.feature_type_counts(df, "l_returnflag")
    return df.agg(F.lit(num).cast("long").alias("n_num_features"), F.lit(cat).cast("long").alias("n_cat_features"), F.count("*").alias("n_instances"))


@query("string_features", """SELECT doc_id, lower(trim(source)) AS source, length(lang)::INT AS lang_len, contains(lower(text), 'the') AS has_the,
 regexp_matches(text, '[0-9]{3,}') AS has_number, concat('lang_', lang) AS prefixed, split_part(source, '-', 1) AS head FROM documents""")
def string_features(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.lower(F.trim("source")).alias("source"), F.length("lang").alias("lang_len"), F.contains(F.lower("text"), F.lit("the")).alias("has_the"),
        F.col("text").rlike("[0-9]{3,}").alias("has_number"), F.concat(F.lit("lang_"), "lang").alias("prefixed"),
        F.split_part("source", F.lit("-"), F.lit(1)).alias("head"))


# --- sources --------------------------------------------------------------


_TOKENS = ["NA", "N/A", "na", "Na", "NULL", "null", "?"]
_PICK = f"{h(repr('csv'), 'event_id')} % 20"


@query("list_columns", """WITH n AS (UNPIVOT (SELECT count(l_orderkey) AS l_orderkey, count(l_partkey) AS l_partkey, count(l_suppkey) AS l_suppkey,
 count(l_linenumber) AS l_linenumber, count(l_quantity) AS l_quantity, count(l_extendedprice) AS l_extendedprice, count(l_discount) AS l_discount,
 count(l_tax) AS l_tax, count(l_returnflag) AS l_returnflag, count(l_linestatus) AS l_linestatus, count(l_shipdate) AS l_shipdate FROM lineitem)
 ON COLUMNS(*) INTO NAME "column" VALUE n_values)
SELECT (list_position(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax',
  'l_returnflag', 'l_linestatus', 'l_shipdate'], column_name) - 1)::INT AS ordinal, column_name AS "column",
 CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
  ELSE 'timestamp_ntz' END AS type, n_values::BIGINT AS n_values
FROM (DESCRIBE lineitem) JOIN n ON n."column" = column_name""")
def list_columns(spark, sf):
    return tables.list_columns(table(spark, sf, "lineitem"))


@query("read_csv_na", f"""SELECT event_id, CASE WHEN {_PICK} < 7 THEN NULL ELSE user_id END AS user_id,
 CASE WHEN {_PICK} = 7 THEN NULL ELSE event_type END AS event_type, CASE WHEN {_PICK} < 7 THEN NULL ELSE {r('value')} END AS value FROM events""")
def read_csv_na(spark, sf):
    """Write events as CSV with every null token in it, read it back, infer types."""
    pick = hash32("csv", F.col("event_id")) % 20
    token = F.array(*[F.lit(t) for t in _TOKENS])[F.least(pick, F.lit(6)).cast("int")]
    df = table(spark, sf, "events").select(
        F.col("event_id").cast("string"), F.when(pick < 7, token).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(pick == 7, "").otherwise(F.col("event_type")).alias("event_type"),
        F.when(pick < 7, token).otherwise(F.col("value").cast("string")).alias("value"))
    path = shared.scratch_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return rounded(tables.read_table(spark, path), ["value"])


@query("pending_queue", """SELECT concat('user_', c_nationkey) AS user_id, c_name AS dataset_name, concat('/data/', c_name, '.csv') AS dataset_path,
 c_mktsegment AS target_col FROM customer WHERE c_custkey % 7 <> 0""")
def pending_queue(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.concat(F.lit("user_"), "c_nationkey").alias(" User_Id"), F.col("c_name").alias("Dataset_Name "),
        F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.concat(F.lit("/data/"), "c_name", F.lit(".csv"))).alias("DATASET_PATH"),
        F.col("c_mktsegment").alias("target_col"))
    return tables.pending_queue(raw)
