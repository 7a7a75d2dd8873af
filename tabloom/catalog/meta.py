"""Queries on meta-features, for one table and for a corpus of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog import fixtures as fx
from tabloom.catalog.registry import query, r, rounded, table
from tabloom.operators import clusterscore, grouped_fit, grouped_trees, learners, metafeatures, select, split
from tabloom.operators.shared import scratch_path
from tabloom.plans import corpus, search
from tabloom.sources import results
from tabloom.operators.cluster import kmeans
from tabloom.operators.information import DECILES
from tabloom.operators.scale import apply_scale, fit_scale
from tabloom.functions.vectors import pack

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
FLOATS = ["n_features", "n_instances"]


def _meta_sql(source: str, raw: str, raw_cols: list[str], by: str, label: str, task: str, n_cat: int) -> str:
    """All meta-features but the component fraction, per value of ``by``."""
    n = len(FEATURES)
    whole = [f"coalesce({c}, quantile_cont({c}, 0.5) OVER (PARTITION BY {by})) AS {c}" if c in fx.HOLED else c for c in FEATURES]
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
    corr = " UNION ALL ".join(f"SELECT {by} AS g, abs(corr({a}, {b})) AS c FROM f GROUP BY {by}" for a, b in pairs)
    skew = " + ".join(f"skewness({c})" for c in FEATURES)
    kurt = " + ".join(f"kurtosis({c})" for c in FEATURES)
    missing = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in raw_cols)
    parts = [
        f"f AS (SELECT {by}, {label}, {', '.join(whole)} FROM {source})",
        f"base AS (SELECT {by} AS g, count(*) AS n_instances, ({skew}) / {n} AS mean_skewness, ({kurt}) / {n} AS mean_kurtosis FROM {source} GROUP BY {by})",
        f"miss AS (SELECT {by} AS g, 100.0 * ({missing}) / ({len(raw_cols)} * count(*)) AS missing_values_pct FROM {raw} GROUP BY {by})",
        f"cc AS (SELECT g, avg(c) AS avg_correlation, max(c) AS max_correlation FROM ({corr}) GROUP BY g)",
    ]
    cols = [
        "n_instances::BIGINT AS n_instances", f"{n}::BIGINT AS n_features", f"{n}::BIGINT AS n_num_features", f"{n_cat}::BIGINT AS n_cat_features",
        f"{r('missing_values_pct')} AS missing_values_pct", f"{r('mean_skewness')} AS mean_skewness", f"{r('mean_kurtosis')} AS mean_kurtosis",
        f"{r('avg_correlation')} AS avg_correlation", f"{r('max_correlation')} AS max_correlation",
        f"{r(f'{n}.0::DOUBLE / n_instances')} AS feature_to_instance_ratio", f"'{task}' AS task_type", "NULL::VARCHAR AS best_model",
    ]
    if task == "regression":
        stats = " UNION ALL ".join(f"SELECT {by} AS g, avg({c}) AS m, stddev_samp({c}) AS s FROM f GROUP BY {by}" for c in FEATURES)
        target = " UNION ALL ".join(f"SELECT {by} AS g, abs(corr({c}, {label})) AS c FROM f GROUP BY {by}" for c in FEATURES)
        bins = " UNION ALL ".join(
            f"SELECT {by} AS g, '{c}' AS col, " + (
                f"{c}::DOUBLE" if c == "l_linenumber" else
                f"least(floor(({c} - min({c}) OVER (PARTITION BY {by})) / (max({c}) OVER (PARTITION BY {by}) - min({c}) OVER (PARTITION BY {by})) * 10.0::DOUBLE), 9)"
            ) + " AS bin FROM f" for c in FEATURES)
        parts += [
            f"vs AS (SELECT g, var_samp(m) AS var_mean, var_samp(s) AS var_std FROM ({stats}) GROUP BY g)",
            f"ct AS (SELECT g, avg(c) AS mean_corr_with_target, max(c) AS max_corr_with_target FROM ({target}) GROUP BY g)",
            f"bins AS (SELECT g, col, bin, count(*) AS k FROM ({bins}) GROUP BY ALL)",
            "sh AS (SELECT g, col, k / sum(k) OVER (PARTITION BY g, col) AS p FROM bins)",
            "en AS (SELECT g, avg(e) AS mean_feature_entropy FROM (SELECT g, col, -sum(p * ln(p)) AS e FROM sh GROUP BY g, col) GROUP BY g)",
        ]
        cols += [f"{r(c)} AS {c}" for c in ("mean_corr_with_target", "max_corr_with_target", "var_mean", "var_std", "mean_feature_entropy")]
        joins = "JOIN vs USING (g) JOIN ct USING (g) JOIN en USING (g)"
    else:
        cuts = ", ".join(f"quantile_cont({c}::DOUBLE, {p}) AS q_{c}_{i}" for c in FEATURES for i, p in enumerate(DECILES))
        code = {c: " + ".join(f"({c} > q_{c}_{i})::INT" for i in range(9)) for c in FEATURES}
        binned = " UNION ALL ".join(f"SELECT f.{by} AS g, '{c}' AS col, {code[c]} AS bin, {label} AS cls FROM f JOIN cuts ON cuts.g = f.{by}" for c in FEATURES)
        parts += [
            f"cuts AS (SELECT {by} AS g, {cuts} FROM f GROUP BY {by})",
            f"j AS (SELECT g, col, bin, cls, count(*) AS k FROM ({binned}) GROUP BY ALL)",
            """w AS (SELECT g, col, k, sum(k) OVER (PARTITION BY g, col) AS t, sum(k) OVER (PARTITION BY g, col, bin) AS nb,
              sum(k) OVER (PARTITION BY g, col, cls) AS nc FROM j)""",
            "mi AS (SELECT g, avg(m) AS mean_mutual_info, max(m) AS max_mutual_info FROM (SELECT g, col, sum(k / t * ln(k * t / (nb * nc))) AS m FROM w GROUP BY g, col) GROUP BY g)",
            f"lc AS (SELECT {by} AS g, {label} AS cls, count(*) AS k FROM f GROUP BY ALL)",
            "ls AS (SELECT g, k / sum(k) OVER (PARTITION BY g) AS p FROM lc)",
            "ce AS (SELECT g, -sum(p * log2(p)) AS class_entropy, count(*) AS n_classes FROM ls GROUP BY g)",
        ]
        cols += [f"{r(c)} AS {c}" for c in ("class_entropy", "mean_mutual_info", "max_mutual_info")]
        cols += ["n_classes::BIGINT AS n_classes", "0.0::DOUBLE AS mean_corr_with_target", "0.0::DOUBLE AS max_corr_with_target"]
        joins = "JOIN mi USING (g) JOIN ce USING (g)"
    name = "" if by == "one" else f"g AS {by}, "
    return f"{', '.join(parts)} SELECT {name}{', '.join(cols)} FROM base JOIN miss USING (g) JOIN cc USING (g) {joins}"


def _finish(df):
    df = df.drop("pca_fraction_95")
    return rounded(df, [f.name for f in df.schema.fields if f.dataType.typeName() == "double"])


def _lines(spark, sf):
    raw = fx.lines_nulls(spark, sf)
    return raw.withColumn("dataset_id", F.concat("l_returnflag", F.coalesce("l_linestatus", F.lit("-")))), raw


_RAW = [c for c in fx.LINE_COLS]
_SRC = f"WITH {fx.LINES_NULLS}, src AS (SELECT *, 0 AS one, concat(l_returnflag, coalesce(l_linestatus, '-')) AS dataset_id FROM lines_nulls), "


@query("meta_features_regression", _SRC + _meta_sql("src", "src", _RAW, "one", "l_extendedprice", "regression", 2))
def meta_features_regression(spark, sf):
    _, raw = _lines(spark, sf)
    return _finish(metafeatures.meta_features(raw, FEATURES, "l_extendedprice", "regression", raw=raw))


@query("meta_features_classification", _SRC + _meta_sql("src", "src", _RAW, "one", "l_returnflag", "classification", 1))
def meta_features_classification(spark, sf):
    _, raw = _lines(spark, sf)
    return _finish(metafeatures.meta_features(raw, FEATURES, "l_returnflag", "classification", raw=raw))


_CORPUS_RAW = ["l_orderkey", "l_extendedprice", *FEATURES]


@query("meta_features_corpus", _SRC + _meta_sql("src", "src", _CORPUS_RAW, "dataset_id", "l_extendedprice", "regression", 0))
def meta_features_corpus(spark, sf):
    """One dataset per return flag and line status, described together."""
    df, _ = _lines(spark, sf)
    raw = df.select("dataset_id", *_CORPUS_RAW)
    return _finish(metafeatures.meta_features(df, FEATURES, "l_extendedprice", "regression", by=["dataset_id"], raw=raw))


@query("meta_features_clustering")
def meta_features_clustering(spark, sf):
    """Clustering row: shape and correlation features plus the scores of k-means with three clusters."""
    vectors = table(spark, sf, "embeddings")
    names = [f"v{i}" for i in range(vectors.agg(F.max(F.size("embedding"))).first()[0])]
    df = vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    row = metafeatures.meta_features(df, names, None, "clustering")
    scaled = apply_scale(df, fit_scale(df, names)).select("vec_id", pack(names).alias("vec"))
    labels, _ = kmeans(scaled, "vec_id", "vec", 3, seed=0)
    scores = clusterscore.score_labels(labels, "vec_id", "cluster", "vec").first()
    return row.withColumns({
        "silhouette_kmeans": F.lit(scores["silhouette"]), "davies_bouldin": F.lit(scores["davies_bouldin"]),
        "calinski_harabasz": F.lit(scores["calinski_harabasz"])})


_SPLIT = f"s AS (SELECT *, concat(l_returnflag, l_linestatus) AS dataset_id, {fx.split_case(fx.LINE_KEY)} AS split FROM lineitem)"
_FITS = f"""{_SPLIT}, t AS (SELECT dataset_id, covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx,
  avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM s WHERE split = 'train' GROUP BY 1),
 w AS (SELECT dataset_id, 'LinearRegression' AS model, sxy / sxx AS b, mx, my FROM t UNION ALL SELECT dataset_id, 'Ridge', sxy / (sxx + 1), mx, my FROM t),
 sc AS (SELECT dataset_id, model, 1 - sum((l_extendedprice - my - b * (l_quantity - mx)) ** 2) / (var_pop(l_extendedprice) * count(*)) AS score
  FROM s JOIN w USING (dataset_id) WHERE split = 'val' GROUP BY 1, 2)"""


def _split_lines(spark, sf):
    df = split.hash_split(table(spark, sf, "lineitem"), fx.LINE_KEY)
    return df.withColumn("dataset_id", F.concat("l_returnflag", "l_linestatus"))


@query("grouped_fits", f"WITH {_FITS} SELECT dataset_id, model, {r('score')} AS score FROM sc")
def grouped_fits(spark, sf):
    """Linear and ridge regression fitted and scored for every dataset in one job."""
    out = grouped_fit.grouped_scores(_split_lines(spark, sf), ["dataset_id"], ["l_quantity"], "l_extendedprice", ["LinearRegression", "Ridge"])
    return rounded(out, ["score"])


@query("meta_labels", f"""WITH {_FITS}, best AS (SELECT dataset_id, model, score, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, model) AS p FROM sc),
 n AS (SELECT dataset_id, count(*) AS n_instances, avg(l_quantity) AS mean_quantity FROM s GROUP BY 1)
SELECT dataset_id, n_instances::BIGINT AS n_instances, {r('mean_quantity')} AS mean_quantity, model AS best_model, {r('score')} AS best_score
FROM n JOIN best USING (dataset_id) WHERE p = 1""")
def meta_labels(spark, sf):
    """Best learner per dataset from its result rows, joined to the dataset's description."""
    df = _split_lines(spark, sf)
    scores = grouped_fit.grouped_scores(df, ["dataset_id"], ["l_quantity"], "l_extendedprice", ["LinearRegression", "Ridge"])
    best = select.best_per(scores, ["dataset_id"])
    about = df.groupBy("dataset_id").agg(F.count("*").alias("n_instances"), F.avg("l_quantity").alias("mean_quantity"))
    return rounded(about.join(best, "dataset_id"), ["mean_quantity", "best_score"])


_TREE_BINS, _TREE_LEAST = 16, 20
_TREE_LONG = " UNION ALL ".join(f"SELECT dataset_id, {i} AS f, '{c}' AS feature, {c}::DOUBLE AS x, l_extendedprice AS y, rid FROM d" for i, c in enumerate(FEATURES))


def _level_sql(node: str, source: str) -> str:
    """Best split of every node of one level."""
    return f"""c_{node} AS (SELECT dataset_id, node, f, feature, t, count(*) AS n, count(*) FILTER (WHERE x <= t) AS nl, sum(y) AS s, sum(y) FILTER (WHERE x <= t) AS sl
  FROM {source} JOIN cuts USING (dataset_id, f, feature) GROUP BY ALL),
 g_{node} AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM c_{node} WHERE nl >= {_TREE_LEAST} AND n - nl >= {_TREE_LEAST}),
 b_{node} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, node ORDER BY round(gain, 9) DESC, f, t) AS p FROM g_{node}) WHERE p = 1)"""


@query("grouped_trees", f"""WITH d AS (SELECT *, concat(l_returnflag, l_linestatus) AS dataset_id, row_number() OVER () AS rid FROM lineitem), l AS ({_TREE_LONG}),
 cuts AS (SELECT DISTINCT dataset_id, f, feature, unnest(q) AS t FROM (SELECT dataset_id, f, feature, quantile_cont(x, {[i / _TREE_BINS for i in range(1, _TREE_BINS)]}) AS q FROM l GROUP BY ALL)),
 l0 AS (SELECT *, 0 AS node FROM l), {_level_sql("r", "l0")},
 placed AS (SELECT l.dataset_id, rid, CASE WHEN x <= t THEN 1 ELSE 2 END AS node FROM l JOIN b_r USING (dataset_id, f, feature)),
 l1 AS (SELECT l.*, placed.node FROM l JOIN placed USING (dataset_id, rid)), {_level_sql("s", "l1")}
SELECT dataset_id, node, feature, {r('t')} AS threshold, n, {r('gain / s', 6)} AS gain_share FROM (SELECT * FROM b_r UNION ALL SELECT * FROM b_s)""")
def grouped_trees_query(spark, sf):
    """The splits of two-level regression trees for the price in every dataset, all datasets at once."""
    df = table(spark, sf, "lineitem").withColumn("dataset_id", F.concat("l_returnflag", "l_linestatus"))
    models, splits = grouped_trees.fit_grouped_trees(df, ["dataset_id"], FEATURES, "l_extendedprice", "regression", depth=2, least=_TREE_LEAST, bins=_TREE_BINS)
    # The share of the node's sum of prices, as gains are too large to compare digit by digit.
    binned = grouped_trees._binned(df, ["dataset_id"], FEATURES, models.select("dataset_id", "cuts")).join(models.select("dataset_id", "splits"), "dataset_id")
    inside = binned.select("dataset_id", "l_extendedprice", F.explode(F.array(F.lit(0), grouped_trees.walk(F.col("splits"), F.col("bins"), 1))).alias("node"))
    sums = inside.groupBy("dataset_id", "node").agg(F.sum("l_extendedprice").alias("s"))
    out = splits.join(sums, ["dataset_id", "node"]).withColumn("gain_share", F.col("gain") / F.col("s"))
    return rounded(out.select("dataset_id", "node", "feature", "threshold", "n", "gain_share"), ["threshold", "gain_share"])


_RUN_FITS = f"""{_SPLIT}, t AS (SELECT dataset_id, covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx,
  avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM s WHERE split = 'train' GROUP BY 1),
 sc AS (SELECT dataset_id, split, 1 - sum((l_extendedprice - my - sxy / sxx * (l_quantity - mx)) ** 2) / (var_pop(l_extendedprice) * count(*)) AS score FROM s JOIN t USING (dataset_id) GROUP BY 1, 2)"""


@query("corpus_leaderboard", f"""WITH {_RUN_FITS}
SELECT dataset_id AS dataset_name, 'done' AS status, count(*)::BIGINT AS n_rows, 'regression' AS task_type, 'LinearRegression' AS best_model, (SELECT {r('score')} FROM sc WHERE sc.dataset_id = s.dataset_id AND sc.split = 'test') AS score
FROM s GROUP BY dataset_id UNION ALL SELECT 'absent', 'missing', NULL, NULL, NULL, NULL UNION ALL SELECT 'nothing', 'empty', 0, NULL, NULL, NULL
UNION ALL SELECT 'no target', 'failed', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'), NULL, NULL, NULL""")
def corpus_leaderboard(spark, sf):
    """A queue of datasets worked through: one per return flag and line status, and three that have no result."""
    lines, root = table(spark, sf, "lineitem").withColumn("dataset_id", F.concat("l_returnflag", "l_linestatus")), scratch_path(spark, "corpus")
    lines.write.partitionBy("dataset_id").parquet(f"{root}/data")
    lines.limit(0).write.parquet(f"{root}/nothing")
    lines.where("l_returnflag = 'R'").write.parquet(f"{root}/returned")
    names = [row["dataset_id"] for row in lines.select("dataset_id").distinct().collect()]
    queue = [(n, f"{root}/data/dataset_id={n}", "l_extendedprice") for n in names]
    queue += [("absent", f"{root}/none", "x"), ("nothing", f"{root}/nothing", "l_tax"), ("no target", f"{root}/returned", "price")]
    for name, path, target in queue:
        results.enqueue(spark, f"{root}/queue", "user", name, path, target)

    def fit(df, target):
        rows = learners.to_rows(split.hash_split(df, fx.LINE_KEY), fx.LINE_KEY, ["l_quantity"], F.col(target))
        return "regression", search.train_candidates(rows, "regression", ["LinearRegression"])[0], None

    found = corpus.run_queue(spark, spark.read.parquet(f"{root}/queue"), f"{root}/store", fit)
    return rounded(found.select("dataset_name", "status", "n_rows", "task_type", "best_model", "score"), ["score"])


_CLASS_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_CLASS_LONG = " UNION ALL ".join(f"SELECT dataset_id, {i} AS f, '{c}' AS feature, {c}::DOUBLE AS x, l_returnflag AS y FROM d" for i, c in enumerate(_CLASS_FEATURES))


@query("grouped_trees_classification", f"""WITH d AS (SELECT *, concat(l_linestatus, l_linenumber) AS dataset_id FROM lineitem), l AS ({_CLASS_LONG}),
 cuts AS (SELECT DISTINCT dataset_id, f, feature, unnest(q) AS t FROM (SELECT dataset_id, f, feature, quantile_cont(x, {[i / _TREE_BINS for i in range(1, _TREE_BINS)]}) AS q FROM l GROUP BY ALL)),
 c AS (SELECT dataset_id, f, feature, t, y, count(*) AS n, count(*) FILTER (WHERE x <= t) AS nl FROM l JOIN cuts USING (dataset_id, f, feature) GROUP BY ALL),
 g AS (SELECT dataset_id, f, feature, t, sum(n)::BIGINT AS n, sum(nl) AS left_n, sum(nl * nl) / sum(nl) + sum((n - nl) * (n - nl)) / sum(n - nl) - sum(n * n) / sum(n) AS gain FROM c GROUP BY ALL HAVING sum(nl) >= {_TREE_LEAST} AND sum(n - nl) >= {_TREE_LEAST}),
 b AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY round(gain, 9) DESC, f, t) AS p FROM g)
SELECT dataset_id, 0 AS node, feature, {r('t')} AS threshold, n, {r('gain')} AS gain FROM b WHERE p = 1""")
def grouped_trees_classification(spark, sf):
    """The first Gini split for the return flag in every dataset."""
    df = table(spark, sf, "lineitem").withColumn("dataset_id", F.concat("l_linestatus", "l_linenumber"))
    _, splits = grouped_trees.fit_grouped_trees(df, ["dataset_id"], _CLASS_FEATURES, "l_returnflag", "classification", depth=1, least=_TREE_LEAST, bins=_TREE_BINS)
    return rounded(splits, ["threshold", "gain"])
