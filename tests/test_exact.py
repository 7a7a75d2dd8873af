"""Distributed algorithms against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import balance, cluster, clusterscore, density, neighbors, quantiles, shared, split


@pytest.fixture(scope="module")
def cloud():
    """Blobs, noise, a chain of cells, and one point with many copies."""
    rng = np.random.default_rng(3)
    return np.concatenate([
        rng.normal(0, 0.05, (150, 2)), rng.normal(1, 0.3, (100, 2)), rng.uniform(-2, 3, (80, 2)), np.repeat([[2.0, 2.0]], 60, 0),
        np.c_[np.linspace(-2, 2, 120), np.full(120, -1.9)],
    ])


@pytest.fixture(scope="module")
def points(spark, cloud):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cloud)], "id long, x double, y double").repartition(4)


def distance_matrix(cloud):
    return np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(-1))


def brute_dbscan(cloud, eps, m):
    near = distance_matrix(cloud) <= eps
    core, labels, c = near.sum(1) >= m, -np.ones(len(cloud), int), 0
    for i in range(len(cloud)):
        if core[i] and labels[i] == -1:
            todo, labels[i] = [i], c
            while todo:
                u = todo.pop()
                if core[u]:
                    for v in np.flatnonzero(near[u] & (labels == -1)):
                        labels[v] = c
                        todo.append(v)
            c += 1
    return near.sum(1), core, labels


@pytest.mark.parametrize("tight", [{}, {"pair_budget": 50}])
def test_dbscan(points, cloud, tight):
    counts, core, labels = brute_dbscan(cloud, 0.1, 5)
    got = {r.id: r.n_neighbors for r in density.neighbor_counts(points, "id", ["x", "y"], 0.1, tight.get("pair_budget")).collect()}
    assert [got[i] for i in range(len(cloud))] == counts.tolist()
    rows = {r.id: (r.cluster, r.is_core) for r in density.dbscan(points, "id", ["x", "y"], 0.1, 5, **tight).collect()}
    assert [rows[i] for i in range(len(cloud))] == list(zip(labels.tolist(), core.tolist()))


def test_dbscan_all_noise(points):
    out = density.dbscan(points, "id", ["x", "y"], 1e-6, 100)
    assert out.where("cluster <> -1").count() == 0 and out.count() == points.count()


def test_border_point_between_clusters(spark):
    left, right = [(-1.0 - i / 100, 0.0) for i in range(5)], [(1.0 + i / 100, 0.0) for i in range(5)]
    rows = [(i, x) for i, (x, _) in enumerate([*right, *left, (0.0, 0.0)])]
    out = density.dbscan(spark.createDataFrame(rows, "id long, x double"), "id", ["x"], 1.0, 5)
    found = {r.id: r.cluster for r in out.collect()}
    assert [found[i] for i in range(11)] == [0] * 5 + [1] * 5 + [0]


@pytest.mark.parametrize("block_rows,itself,metric", [(4096, False, "manhattan"), (40, True, "euclidean")])
def test_neighbors(points, cloud, block_rows, itself, metric):
    v = points.select("id", F.array("x", "y").alias("vec"))
    got = neighbors.knn_join(v, v, 4, "id", "id", "vec", metric=metric, exclude_self=itself, block_rows=block_rows)
    d = distance_matrix(cloud) if metric == "euclidean" else np.abs(cloud[:, None] - cloud[None]).sum(-1)
    if itself:
        np.fill_diagonal(d, np.inf)
    n = len(cloud)
    want = {(i, int(j), r + 1) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), d[i]))[:4])}
    assert {(r.id, r.neighbor, r["rank"]) for r in got.collect()} == want


def test_neighbors_within_groups(points, cloud):
    v = points.select("id", F.array("x", "y").alias("vec"), (F.col("id") % 3).alias("g"))
    got = neighbors.knn_join(v, v, 2, "id", "id", "vec", by="g", exclude_self=True, block_rows=20).collect()
    d, n = distance_matrix(cloud), len(cloud)
    for r in got:
        mates = [j for j in range(n) if j % 3 == r.id % 3 and j != r.id]
        assert sorted((d[r.id, j], j) for j in mates)[r["rank"] - 1][1] == r.neighbor
    assert len(got) == 2 * n


def test_vote_and_average(spark):
    near = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.5), (1, 1, 4.0), (2, 5, 0.0), (2, 3, 1.0)], "q int, label int, distance double")
    assert {r.q: r.prediction for r in neighbors.vote(near, "q", "label").collect()} == {1: 1, 2: 3}
    assert {r.q: r.prediction for r in neighbors.vote(near, "q", "label", "distance").collect()} == {1: 1, 2: 5}
    averages = {r.q: r.prediction for r in neighbors.average(near, "q", "label", "distance").collect()}
    assert averages[1] == pytest.approx((2 + 0.25) / 3.25) and averages[2] == pytest.approx(5)


def test_bracketed_quantiles_agree(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501), "b": np.r_[np.zeros(400), 1e12, -1e12, rng.exponential(size=99)], "c": [3.0], "d": [1.0, 2.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probs = [0.0, 0.1, 0.5, 0.75, 0.99, 1.0]
    for small in (0, 10**6):
        got = {(r.g, r.prob): r.value for r in quantiles.quantiles(df, ["v"], probs, ["g"], small=small).collect()}
        for g, vs in groups.items():
            assert [got[g, p] for p in probs] == pytest.approx(np.quantile(vs, probs).tolist())


def test_order_helpers(spark):
    rng = np.random.default_rng(5)
    values = rng.permutation(500).tolist()
    df = spark.createDataFrame([(v, v % 7) for v in values], "k long, w long").repartition(5)
    ranks = {r.k: r.r for r in shared.row_rank(df, ["k"], "r").collect()}
    sums = {r.k: r.s for r in shared.running_sum(df, ["k"], "w", "s").collect()}
    assert all(ranks[k] == k for k in range(500))
    assert [sums[k] for k in range(500)] == np.cumsum([k % 7 for k in range(500)]).tolist()
    flags = {r.column: r.is_monotonic for r in shared.is_monotonic(df.withColumn("up", F.col("k") * 2), "k", ["up", "w"]).collect()}
    assert flags == {"up": True, "w": False}


def test_shuffled_lookup_equals_broadcast(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        a = shared.lookup_join(big, small, ["k"], how)
        b = shared.lookup_join(big, small, ["k"], how, bound=0)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_exact_silhouette_and_scores(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (30, 3)), rng.normal(3, 1, (20, 3)), [[9, 9, 9]], [[0.5, 0.5, 0.5]] * 5]
    labels = np.r_[np.zeros(30), np.ones(20), [2], np.zeros(5)].astype(int)
    df = spark.createDataFrame([(i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(labels, x))], "id long, c int, vec array<double>")
    d = distance_matrix(x)
    want = []
    for i in range(len(x)):
        same = [j for j in range(len(x)) if labels[j] == labels[i] and j != i]
        if not same:
            want.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == k].mean() for k in set(labels) - {labels[i]})
        want.append((b - a) / max(a, b))
    for block in (2048, 7):
        got = {r.id: r.s for r in clusterscore.silhouette_rows(df, "id", "c", "vec", block).collect()}
        assert [got[i] for i in range(len(x))] == pytest.approx(want)
    centers = np.array([x[labels == k].mean(0) for k in range(3)])
    spread = np.array([np.sqrt(((x[labels == k] - centers[k]) ** 2).sum(1)).mean() for k in range(3)])
    gap = distance_matrix(centers)
    worst = np.mean([max((spread[i] + spread[j]) / gap[i, j] for j in range(3) if j != i) for i in range(3)])
    assert clusterscore.davies_bouldin(df, "c", "vec", 2).first()[0] == pytest.approx(worst)


def test_score_needs_two_clusters(spark):
    df = spark.createDataFrame([(1, -1, [0.0]), (2, 0, [1.0]), (3, 0, [2.0])], "id long, c int, vec array<double>")
    row = clusterscore.score_labels(df, "id", "c", "vec").first()
    assert row["n_clusters"] == 1 and row["silhouette"] is None


@pytest.mark.parametrize("linkage,micro", [("ward", 1000), ("complete", 30), ("average", 1000)])
def test_hierarchical_finds_blobs(spark, linkage, micro):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in (0, 3, 8)])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    found = {r.id: r.cluster for r in cluster.hierarchical(df, "id", "vec", 3, linkage, micro=micro).collect()}
    groups = [{found[i] for i in range(s, s + 40)} for s in (0, 40, 80)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_smote_rows_lie_between_neighbors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "big", *map(float, rng.normal(size=2))) for i in range(50)] + [(100 + i, "small", *map(float, rng.normal(5, 1, 2))) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, label string, x double, y double")
    at = {r[0]: np.array(r[2:]) for r in rows}
    made = balance.smote_rows(df, "label", ["x", "y"], "id").collect()
    assert len(made) == 42
    for r in made:
        a, b, p = at[r.base], at[r.neighbor], np.array([r.x, r.y])
        assert np.linalg.norm(p - a) + np.linalg.norm(b - p) == pytest.approx(np.linalg.norm(b - a), abs=1e-9)
    sizes = {r["label"]: r["count"] for r in balance.balanced(df, "label", ["x", "y"], "id").groupBy("label").count().collect()}
    assert sizes == {"big": 50, "small": 50}
    again = balance.smote_rows(df.repartition(7), "label", ["x", "y"], "id").collect()
    assert sorted(map(str, again)) == sorted(map(str, made))


@pytest.mark.parametrize("small,needs", [(2, 0), (3, 27)])
def test_smote_guards(spark, small, needs):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(30)] + [(50 + i, 1, float(i)) for i in range(small)], "id long, label int, x double")
    assert balance.smote_rows(df, "label", ["x"], "id").count() == needs
    assert balance.smote_plan(df, "label", shrink_k=False).agg(F.sum("need")).first()[0] == 0


def test_exact_split_sizes(spark):
    for n in (1, 7, 101):
        df = spark.range(n).withColumnRenamed("id", "k")
        got = {r["split"]: r["count"] for r in split.exact_split(df, ["k"]).groupBy("split").count().collect()}
        want = dict(zip(("train", "val", "test"), split.split_sizes(n)))
        assert got == {k: v for k, v in want.items() if v}


def test_hash_split_is_stable(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a = {r.k: r["split"] for r in split.hash_split(df, ["k"]).collect()}
    b = {r.k: r["split"] for r in split.hash_split(df.repartition(9), ["k"]).collect()}
    assert a == b and 0.67 < sum(v == "train" for v in a.values()) / 3000 < 0.73


def test_neighbors_in_regions_and_in_shared_tasks(spark, monkeypatch):
    """Wide points, where cells are put together, beside many groups of a few rows that share tasks."""
    from tabloom.operators import blocks

    assert neighbors._packed([10, 10, 30, 5, 70, 4], 50, 0.9) == [[0], [0], [0], [1], [2, 3], [4]]
    assert neighbors._packed([10, 70, 5], 50, 0.1) == [[0], [1, 2], [3]]
    assert blocks.block_rows(100_000) == 12_500 and blocks.block_rows(10**7) == blocks.MOST
    rng = np.random.default_rng(8)
    x, groups = rng.normal(size=(700, 12)), np.r_[np.zeros(300, int), rng.integers(1, 90, 400)]
    df = spark.createDataFrame([(i, f"g{g}", [float(c) for c in v]) for i, (g, v) in enumerate(zip(groups, x))], "id long, g string, vec array<double>").repartition(3)
    asked = []
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbors, "_dealt", lambda *args, real=neighbors._dealt: asked.append(args) or real(*args))
    for metric in ("euclidean", "manhattan"):
        got = neighbors.knn_join(df, df, 3, "id", "id", "vec", by="g", metric=metric, exclude_self=True, block_rows=60).collect()
        d = distance_matrix(x) if metric == "euclidean" else np.abs(x[:, None] - x[None]).sum(-1)
        d[(groups[:, None] != groups[None]) | np.eye(len(x), dtype=bool)] = np.inf
        want = {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:3]) if d[i, j] < np.inf}
        assert {(r.id, r.neighbor, r["rank"]) for r in got} == want
    assert len(asked) == 2


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_block_distances_keep_their_digits(offset):
    from tabloom.operators import blocks

    rng = np.random.default_rng(9)
    a = rng.normal(size=(40, 5)) + offset
    b = np.r_[a[:20] + 1e-7, a[:5], rng.normal(size=(30, 5)) + offset]
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert np.allclose(blocks.distances(a, b), want, rtol=1e-7, atol=0)
    i, j, d = blocks.nearest(a, b, 4, "euclidean")
    assert d.tolist() == np.sort(want, 1)[:, :4].ravel().tolist() and d.tolist() == want[i, j].tolist()


def test_one_pass_scores_several_labellings(spark, monkeypatch):
    """Trials share one pass over distances; repeated rows and labels beyond the matrix product count too."""
    rng = np.random.default_rng(10)
    x = np.r_[rng.normal(size=(60, 3)), np.repeat(rng.normal(size=(4, 3)), 5, 0)]
    labels = [rng.integers(0, k, len(x)) for k in (2, 9)]
    tables = [spark.createDataFrame([(i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(l, x))], "id long, cluster int, vec array<double>") for l in labels]
    want = [clusterscore.silhouette(t, "id", "cluster", "vec", 2048).first()[0] for t in tables]
    d = distance_matrix(x)
    for l, w in zip(labels, want):
        sums = np.stack([d[:, l == c].sum(1) / (l == c).sum() for c in range(l.max() + 1)], 1)
        n = np.bincount(l)[l]
        a, sums[np.arange(len(x)), l] = sums[np.arange(len(x)), l] * n / (n - 1), np.inf
        assert w == pytest.approx(((sums.min(1) - a) / np.maximum(a, sums.min(1))).mean())
    passes = []
    monkeypatch.setattr(clusterscore, "_mean_gaps", lambda *args, real=clusterscore._mean_gaps: passes.append(1) or real(*args))
    monkeypatch.setattr(clusterscore, "DENSE", 4)
    assert clusterscore.silhouettes(tables, "cluster", "vec", 13) == pytest.approx(want)
    got = {r.params: r.silhouette for r in cluster.evaluate(tables[0], "id", "vec", [("KMeans", {"n_clusters": k}) for k in (2, 3)]).collect()}
    assert len(passes) == 2 and len(got) == 2 and all(v is not None for v in got.values())
