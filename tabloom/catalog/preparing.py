"""Queries on splits, preprocessing steps and class balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog import fixtures as fx
from tabloom.catalog.registry import h, query, r, rnd, rounded, table
from tabloom.operators import balance, components, correlate, encode, impute, outliers, scale, shared, split
from tabloom.plans import prepare
from tabloom.sources import tables

KEY = fx.LINE_KEY
KEYS = ", ".join(KEY)


@query("split_hash", f"SELECT {KEYS}, {fx.split_case(KEY)} AS split FROM lineitem")
def split_hash(spark, sf):
    return split.hash_split(table(spark, sf, "lineitem"), KEY).select(*KEY, "split")


def _exact(partition: str, source: str) -> str:
    return f"""WITH d AS (SELECT {KEYS}, l_returnflag, row_number() OVER ({partition} ORDER BY {h("'42'", *KEY)}, {KEYS}) - 1 AS spot,
  count(*) OVER ({partition}) AS n FROM {source}), s AS (SELECT *, ceil(0.3::DOUBLE * n) AS held FROM d)
SELECT {KEYS}, CASE WHEN spot < n - held THEN 'train' WHEN spot < n - ceil(0.5 * held) THEN 'val' ELSE 'test' END AS split FROM s"""


@query("split_exact", _exact("", "lineitem"))
def split_exact(spark, sf):
    return split.exact_split(table(spark, sf, "lineitem").select(*KEY), KEY).select(*KEY, "split")


@query("split_stratified", _exact("PARTITION BY l_returnflag", "lineitem"))
def split_stratified(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY, "l_returnflag")
    return split.exact_split(df, KEY, stratify="l_returnflag").select(*KEY, "split")


@query("stratified_folds", f"""SELECT event_id, event_type, ((row_number() OVER (PARTITION BY event_type ORDER BY {h("'42'", 'event_id')}, event_id) - 1) % 5)::INT
 AS fold FROM events""")
def stratified_folds(spark, sf):
    return split.stratified_folds(table(spark, sf, "events").select("event_id", "event_type"), ["event_id"], "event_type", 5)


@query("split_info", f"""SELECT 'lineitem' AS dataset_name, 'l_returnflag' AS target_col, split, count(*)::BIGINT AS n_rows,
 'l_quantity,l_tax' AS features FROM (SELECT {fx.split_case(KEY)} AS split FROM lineitem) GROUP BY split""")
def split_info(spark, sf):
    df = split.hash_split(table(spark, sf, "lineitem").select(*KEY, "l_quantity", "l_tax", "l_returnflag"), KEY)
    folder = shared.scratch_path(spark, "splits")
    return tables.save_splits(df, ["l_quantity", "l_tax"], "lineitem", "l_returnflag", folder).drop("created_at")


@query("impute_mode", f"""WITH {fx.LINES_NULLS}, c AS (SELECT l_linestatus, count(*) AS n FROM lines_nulls WHERE l_linestatus IS NOT NULL GROUP BY 1)
SELECT {KEYS}, coalesce(l_linestatus, (SELECT l_linestatus FROM c ORDER BY n DESC, l_linestatus LIMIT 1)) AS l_linestatus FROM lines_nulls""")
def impute_mode(spark, sf):
    df = fx.lines_nulls(spark, sf)
    return impute.apply_impute(df, impute.fit_impute(df, ["l_linestatus"])).select(*KEY, "l_linestatus")


@query("impute_mean", f"""WITH {fx.LINES_NULLS} SELECT {KEYS}, {r('coalesce(l_quantity, (SELECT avg(l_quantity) FROM lines_nulls))')} AS l_quantity FROM lines_nulls""")
def impute_mean(spark, sf):
    df = fx.lines_nulls(spark, sf)
    return rounded(impute.apply_impute(df, impute.fit_impute(df, ["l_quantity"])).select(*KEY, "l_quantity"), ["l_quantity"])


@query("impute_median", f"""WITH {fx.LINES_NULLS} SELECT {KEYS}, {r('coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM lines_nulls))')} AS l_tax FROM lines_nulls""")
def impute_median(spark, sf):
    df = fx.lines_nulls(spark, sf)
    return rounded(impute.apply_impute(df, impute.fit_impute(df, ["l_tax"])).select(*KEY, "l_tax"), ["l_tax"])


@query("impute_fallback", f"""WITH {fx.EVENTS_NULLS} SELECT event_id, 0.0::DOUBLE AS empty_number, 'missing' AS empty_text,
 coalesce(event_type, (SELECT event_type FROM events_nulls WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type
FROM events_nulls""")
def impute_fallback(spark, sf):
    df = fx.events_nulls(spark, sf).withColumn("empty_number", F.lit(None).cast("double")).withColumn("empty_text", F.lit(None).cast("string"))
    cols = ["empty_number", "empty_text", "event_type"]
    return impute.apply_impute(df, impute.fit_impute(df, cols)).select("event_id", *cols)


_IQR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _bounds_sql(cols, source):
    return "b AS (SELECT " + ", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS a{i}, quantile_cont({c}::DOUBLE, 0.75) AS z{i}" for i, c in enumerate(cols)) + f" FROM {source})"


def _out_sql(c, i):
    return f"coalesce(({c} < a{i} - 1.5::DOUBLE * (z{i} - a{i}) OR {c} > z{i} + 1.5::DOUBLE * (z{i} - a{i}))::INT, 0)"


@query("outliers_iqr", f"""WITH {_bounds_sql(['value'], 'events')} SELECT event_id, {r('value')} AS value FROM events, b WHERE {_out_sql('value', 0)} < 1""")
def outliers_iqr(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(outliers.drop_outliers(df, outliers.fit_iqr(df, ["value"])), ["value"])


_REPORT = ["n_chars", "quality", "toxic"]


@query("outlier_report", f"""WITH {fx.DOCS_LABELLED}, {_bounds_sql(_REPORT, 'docs_labelled')}
SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS " + '"column"' + f", sum({_out_sql(c, i)})::BIGINT AS violations FROM docs_labelled, b" for i, c in enumerate(_REPORT))})
ORDER BY violations DESC, 1 LIMIT 10""")
def outlier_report(spark, sf):
    df = fx.docs_labelled(spark, sf)
    return outliers.outlier_report(df, outliers.fit_iqr(df, _REPORT))


@query("encode_onehot", f"""WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, {fx.split_case(['o_orderkey'])} AS split FROM orders)
SELECT o_orderkey, split, {', '.join(f"(o_orderstatus = '{v}')::INT AS o_orderstatus_{v}" for v in ('O', 'P'))},
 {', '.join(f"(o_orderpriority = '{v}')::INT AS " + '"' + f"o_orderpriority_{v}" + '"' for v in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))} FROM t""")
def encode_onehot(spark, sf):
    df = split.hash_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])
    kept = encode.onehot_columns(df.where("split = 'train'"), ["o_orderstatus", "o_orderpriority"])
    return df.select("o_orderkey", "split", *[f for c, names in kept.items() for f in encode.indicators(c, names)])


_TARGET = f"""t AS (SELECT event_id, 'u' || user_id AS who, value, {fx.split_case(['event_id'])} AS split FROM events)"""


def _users(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("who"), "value")
    return split.hash_split(df, ["event_id"])


@query("encode_target", f"""WITH {_TARGET}, m AS (SELECT who, avg(value) AS e FROM t WHERE split = 'train' GROUP BY who)
SELECT event_id, split, {r('coalesce(e, (SELECT avg(e) FROM m))')} AS who FROM t LEFT JOIN m USING (who)""")
def encode_target(spark, sf):
    df = _users(spark, sf)
    means = shared.settle(encode.target_means(df.where("split = 'train'"), "who", F.col("value")))
    return rounded(encode.apply_map(df, "who", means, encode.unseen_default(means)).select("event_id", "split", "who"), ["who"])


@query("encode_frequency", f"""WITH {_TARGET}, m AS (SELECT who, count(*) / sum(count(*)) OVER () AS e FROM t WHERE split = 'train' GROUP BY who)
SELECT event_id, split, {r('coalesce(e, 0)')} AS who FROM t LEFT JOIN m USING (who)""")
def encode_frequency(spark, sf):
    df = _users(spark, sf)
    shares = encode.frequencies(df.where("split = 'train'"), "who")
    return rounded(encode.apply_map(df, "who", shares, 0.0).select("event_id", "split", "who"), ["who"])


@query("label_codes", "SELECT o_orderkey, o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders")
def label_codes(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return df.withColumn("code", encode.label_code("o_orderpriority", encode.label_levels(df, "o_orderpriority")))


_SCALE = ["l_quantity", "l_extendedprice"]


@query("scale_standard", f"""WITH t AS (SELECT *, {fx.split_case(KEY)} AS split FROM lineitem)
SELECT {KEYS}, split, {', '.join(r(f"({c} - (SELECT avg({c}) FROM t WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM t WHERE split = 'train')") + f' AS {c}' for c in _SCALE)} FROM t""")
def scale_standard(spark, sf):
    df = split.hash_split(table(spark, sf, "lineitem").select(*KEY, *_SCALE), KEY)
    return rounded(scale.apply_scale(df, scale.fit_scale(df.where("split = 'train'"), _SCALE)), _SCALE)


@query("scale_minmax", f"""SELECT {KEYS}, {', '.join(r(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())") + f' AS {c}' for c in _SCALE)} FROM lineitem""")
def scale_minmax(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY, *_SCALE)
    return rounded(scale.apply_scale(df, scale.fit_scale(df, _SCALE, "minmax")), _SCALE)


_PRUNE_PAIRS = " UNION ALL ".join(
    f"SELECT '{b}' AS col, abs(corr({a}, {b})) AS c FROM corr_pairs" for i, a in enumerate(fx.CORR_COLS) for b in fx.CORR_COLS[i + 1:])


@query("prune_correlated", f"""WITH {fx.CORR_PAIRS}, c AS ({_PRUNE_PAIRS})
SELECT col AS "column", (max(coalesce(c, 0)) >= 0.95) AS dropped, (SELECT count(*) FROM corr_pairs)::BIGINT AS n_rows FROM c GROUP BY col""")
def prune_correlated(spark, sf):
    df = fx.corr_pairs(spark, sf)
    kept, dropped = correlate.prune_correlated(df, fx.CORR_COLS)
    flags = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in dropped).alias("dropped")) for c in fx.CORR_COLS[1:]])
    return kept.agg(F.count("*").alias("n_rows")).select(F.explode(flags).alias("e"), "n_rows").select("e.*", "n_rows")


@query("pca_two_columns", f"""WITH s AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a FROM lineitem)
SELECT 'PC1' AS component, {r('(1 + a) / 2')} AS share FROM s UNION ALL SELECT 'PC2', {r('(1 - a) / 2')} FROM s""")
def pca_two_columns(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    cols = ["l_quantity", "l_extendedprice"]
    scaled = scale.apply_scale(df, scale.fit_scale(df, cols))
    shares = components.fit_components(scaled, cols, min_features=2).shares
    return spark.createDataFrame([(f"PC{i + 1}", float(s)) for i, s in enumerate(shares)], "component string, share double").select("component", rnd("share").alias("share"))


@query("pca_reduce")
def pca_reduce(spark, sf):
    """64 standardised embedding columns reduced to the components that hold 95 % of the variance."""
    names = [f"v{i}" for i in range(64)]
    df = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    scaled = scale.apply_scale(df, scale.fit_scale(df, names))
    return components.fit_components(scaled, names).apply(scaled)


_SM_COLS = ["n_chars", "n_words"]


def _docs(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", " ")).cast("double").alias("n_words"))
    return fx.docs_labelled(spark, sf).join(words, "doc_id").select("doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"), "n_words")


_SM = f"""d AS (SELECT doc_id, quality AS label, n_chars::DOUBLE AS x, length(text) - length(replace(text, ' ', '')) + 1.0::DOUBLE AS y
 FROM labels JOIN documents USING (doc_id)),
 c AS (SELECT label, count(*) AS n FROM d GROUP BY label),
 p AS (SELECT label, n, CASE WHEN (SELECT count(*) FROM c) >= 20 OR (SELECT min(n) FROM c) < 3 THEN 0 ELSE (SELECT max(n) FROM c) - n END AS need,
  least(5, n - 1) AS k FROM c)"""


@query("smote_plan", f"WITH {_SM} SELECT label, n::BIGINT AS n, need::BIGINT AS need, k::INT AS k FROM p")
def smote_plan(spark, sf):
    return balance.smote_plan(_docs(spark, sf), "quality")


@query("smote_rows", f"""WITH {_SM}, m AS (SELECT d.* FROM d JOIN p USING (label) WHERE need > 0),
 pos AS (SELECT label, doc_id, x, y, row_number() OVER (PARTITION BY label ORDER BY {h("'42'", 'doc_id')}, doc_id) - 1 AS spot FROM m),
 nb AS (SELECT a.doc_id AS base, b.doc_id AS neighbor, b.x AS bx, b.y AS ny, row_number() OVER (PARTITION BY a.doc_id ORDER BY
  sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.doc_id) AS nth FROM m a JOIN m b ON a.label = b.label AND a.doc_id <> b.doc_id),
 dr AS (SELECT label, n, k, unnest(range(1, need + 1)) AS draw FROM p WHERE need > 0),
 dd AS (SELECT label, draw, {h("'base'", "'42'", 'label', 'draw')} % n AS spot, {h("'near'", "'42'", 'label', 'draw')} % k + 1 AS nth,
  {h("'gap'", "'42'", 'label', 'draw')} / 4294967296.0::DOUBLE AS gap FROM dr)
SELECT dd.label, draw::BIGINT AS draw, pos.doc_id AS base, neighbor, {r('x + (bx - x) * gap')} AS n_chars, {r('y + (ny - y) * gap')} AS n_words
FROM dd JOIN pos ON pos.label = dd.label AND pos.spot = dd.spot JOIN nb ON nb.base = pos.doc_id AND nb.nth = dd.nth""")
def smote_rows(spark, sf):
    return rounded(balance.smote_rows(_docs(spark, sf), "quality", _SM_COLS, "doc_id"), _SM_COLS)


# --- the whole chain ------------------------------------------------------

_CHAIN_NUMS = ["l_extendedprice", "l_quantity", "l_tax", "l_discount"]


def _chain_sql() -> str:
    med = "(SELECT quantile_cont({c}, 0.5) FROM s WHERE split = 'train')"
    avg = "(SELECT avg({c}) FROM s WHERE split = 'train')"
    fills = {"l_extendedprice": avg, "l_quantity": avg, "l_tax": med, "l_discount": med}
    filled = ", ".join(f"coalesce({c}, {fills[c].format(c=c)}) AS {c}" for c in _CHAIN_NUMS)
    out = " + ".join(_out_sql(c, i) for i, c in enumerate(_CHAIN_NUMS))
    scaled = ", ".join(
        r(f"({c} - (SELECT avg({c}) FROM k WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM k WHERE split = 'train')") + f" AS {c}"
        for c in ("l_extendedprice", "l_quantity"))
    return f"""WITH {fx.LINES_NULLS}, s AS (SELECT *, {fx.split_case(KEY)} AS split FROM (SELECT DISTINCT * FROM lines_nulls)),
 f AS (SELECT {KEYS}, l_returnflag, split, {filled}, coalesce(l_linestatus, (SELECT l_linestatus FROM s WHERE split = 'train' AND l_linestatus IS NOT NULL
   GROUP BY 1 ORDER BY count(*) DESC, l_linestatus LIMIT 1)) AS l_linestatus FROM s),
 {_bounds_sql(_CHAIN_NUMS, "f WHERE split = 'train'")}, k AS (SELECT f.* FROM f, b WHERE split <> 'train' OR {out} < 1)
SELECT {KEYS}, l_returnflag, split, {scaled}, {r('l_tax')} AS l_tax, {r('l_discount')} AS l_discount, (l_linestatus = 'O')::INT AS "l_linestatus_O" FROM k"""


@query("prep_chain", _chain_sql())
def prep_chain(spark, sf):
    """Duplicates, task, columns, split, imputation, outliers, encoding, scaling, pruning."""
    out = prepare.prepare(fx.lines_nulls(spark, sf), "l_returnflag", KEY)
    return rounded(out.rows, _CHAIN_NUMS)


def _apply_sql() -> str:
    return f"""WITH t AS (SELECT o_orderkey, o_orderpriority, o_totalprice, 'c' || o_custkey AS who, {fx.split_case(['o_orderkey'])} AS split FROM orders),
 {_bounds_sql(['o_totalprice'], "t WHERE split = 'train'")}, k AS (SELECT t.* FROM t, b WHERE split = 'train' AND {_out_sql('o_totalprice', 0)} < 1),
 m AS (SELECT who, avg(code) AS e FROM (SELECT who, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM k) GROUP BY who),
 d AS (SELECT avg(e) AS de FROM m), w AS (SELECT e FROM k JOIN m USING (who))
SELECT o_orderkey, {r("(o_totalprice - (SELECT avg(o_totalprice) FROM k)) / (SELECT stddev_pop(o_totalprice) FROM k)")} AS o_totalprice,
 {r("(coalesce(e, de) - (SELECT avg(e) FROM w)) / (SELECT stddev_pop(e) FROM w)")} AS who FROM t LEFT JOIN m USING (who), d"""


@query("apply_artifact", _apply_sql())
def apply_artifact(spark, sf):
    """Fit on training orders, store, load, and transform the whole table without dropping a row."""
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("who"))
    art = prepare.prepare(df, "o_orderpriority", ["o_orderkey"]).artifact
    path = shared.scratch_path(spark, "artifact")
    art.save(path, spark)
    return rounded(prepare.Artifact.load(path, spark).apply(df, ["o_orderkey"]), ["o_totalprice", "who"])


_DATED = ["o_totalprice", "year", "month", "day", "weekday", "elapsed"]


def _dated_sql() -> str:
    out = " + ".join(_out_sql(c, i) for i, c in enumerate(_DATED))
    scaled = ", ".join(r(f"({c} - (SELECT avg({c}) FROM k)) / (SELECT stddev_pop({c}) FROM k)") + f" AS {name}" for c, name in (("o_totalprice", "o_totalprice"), ("day", "o_orderdate_day")))
    return f"""WITH s AS (SELECT o_orderkey, o_totalprice, o_orderdate, {fx.split_case(['o_orderkey'])} AS split FROM orders),
 t AS (SELECT o_orderkey, o_totalprice, split, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, isodow(o_orderdate) - 1 AS weekday,
  floor((epoch_us(o_orderdate) - (SELECT min(epoch_us(o_orderdate)) FROM s WHERE split = 'train')) / 86400000000.0)::BIGINT AS elapsed FROM s),
 {_bounds_sql(_DATED, "t WHERE split = 'train'")}, k AS (SELECT t.* FROM t, b WHERE split = 'train' AND {out} < 1)
SELECT o_orderkey, {scaled}, year::DOUBLE AS o_orderdate_year, month::DOUBLE AS o_orderdate_month, weekday::DOUBLE AS o_orderdate_weekday, elapsed::DOUBLE AS elapsed_days FROM t"""


@query("apply_artifact_dates", _dated_sql())
def apply_artifact_dates(spark, sf):
    """A stored chain cuts the dates of raw rows itself, counting days from the first training date.

    Year and elapsed days go together, so pruning drops the latter; they are read from the step before it.
    """
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    path = shared.scratch_path(spark, "artifact")
    prepare.prepare(df, "o_orderpriority", ["o_orderkey"], expand_dates=True).artifact.save(path, spark)
    art = prepare.Artifact.load(path, spark)
    days = art.fill(df, ["o_orderkey"]).select("o_orderkey", F.col("o_orderdate_elapsed_days").cast("double").alias("elapsed_days"))
    out = art.apply(df, ["o_orderkey"]).select("o_orderkey", "o_totalprice", *[f"o_orderdate_{p}" for p in ("year", "month", "day", "weekday")])
    return rounded(out, ["o_totalprice", "o_orderdate_day"]).join(days, "o_orderkey")


@query("eval_union", f"SELECT split, count(*)::BIGINT AS n, {r('sum(value)', 3)} AS total FROM (SELECT value, {fx.split_case(['event_id'])} AS split FROM events) WHERE split <> 'train' GROUP BY split")
def eval_union(spark, sf):
    df = split.hash_split(table(spark, sf, "events"), ["event_id"])
    both = df.where("split = 'val'").unionByName(df.where("split = 'test'"))
    return both.groupBy("split").agg(F.count("*").alias("n"), rnd(F.sum("value"), 3).alias("total"))


@query("union_by_name", """SELECT doc_id, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels""")
def union_by_name(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.unionByName(table(spark, sf, "labels").select("doc_id", "quality"), allowMissingColumns=True)
