import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fityard.operators import kmeans as km
from fityard.operators import features, linear, mlp, pca, suite, trees
from fityard.operators.evaluation import accuracy
from fityard.plans import model_plans
from fityard.plans.fixtures import SUSY_FEATURES, emb, susy, susy_split, susy_vectors
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def sides(spark):
    train, test = susy_vectors(spark, "/root/testdata/sf0.001", SUSY_FEATURES)
    return train.cache(), test.cache()


@pytest.fixture(scope="module")
def matrix(sides):
    rows = sides[0].select("label", *[F.col(f"`{f}`") for f in SUSY_FEATURES]).collect()
    data = np.array([list(r) for r in rows])
    return data[:, 1:], data[:, 0]


def _majority(test):
    share = test.agg(F.avg("label")).first()[0]
    return max(share, 1 - share)


def test_logreg_gradient_vanishes(sides, matrix):
    x, y = matrix
    model = linear.fit_logreg(sides[0], tol=1e-10)
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    assert np.abs(x.T @ (y - p)).max() / len(y) < 1e-5 and abs((y - p).sum()) / len(y) < 1e-5


def test_newton_meets_the_optimum(spark, sides, matrix, wide):
    x, y = matrix
    fit = linear.fit_logreg_newton(sides[0], SUSY_FEATURES)
    p = 1 / (1 + np.exp(-(x @ np.array(fit.coefficients) + fit.intercept)))
    assert np.abs(x.T @ (y - p)).max() / len(y) < 1e-9 and abs((y - p).sum()) / len(y) < 1e-9 and fit.steps < 15
    df, _ = wide
    model = linear.fit_logreg(df, max_iter=500, tol=1e-12)
    both = linear.fit_logreg_newton(df.repartition(3), "features")
    assert np.allclose(both.coefficients, model.coefficients.toArray(), atol=1e-3)
    parted = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, label double")
    with pytest.raises(ValueError):
        linear.fit_logreg_newton(parted, ["x"])
    with pytest.raises(ValueError, match="missing"):
        linear.fit_logreg_newton(spark.createDataFrame([(1.0, 1.0), (None, 0.0)], "x double, label double"), ["x"])
    with pytest.raises(ValueError, match="depend"):
        linear.fit_logreg_newton(sides[0].withColumn("copy", F.col("`0`") * 2), ["0", "copy"])


@pytest.mark.parametrize("lam", [0.01, 0.1])
def test_elastic_net_meets_the_optimality_conditions(sides, matrix, lam):
    x, y = matrix
    model = linear.fit_elastic_net(sides[0], reg_param=lam, max_iter=500, tol=1e-10, standardization=False)
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    smooth = x.T @ (p - y) / len(y) + lam * 0.5 * w
    for g, wi in zip(smooth, w):
        assert abs(g) <= lam * 0.5 + 1e-4 if wi == 0 else abs(g + lam * 0.5 * np.sign(wi)) < 1e-4


def test_no_penalty_equals_the_plain_fit(sides):
    a, b = linear.fit_logreg(sides[0]), linear.fit_elastic_net(sides[0], reg_param=0.0)
    assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6)


def test_given_weights_score_as_the_model_does(sides):
    train, test = sides
    model = linear.fit_logreg(train)
    mine = linear.score_weights(test, SUSY_FEATURES, model.coefficients.toArray().tolist(), model.intercept)
    theirs = linear.with_margin(model.transform(mine.withColumnsRenamed(
        {"margin": "m", "probability": "p", "prediction": "q"})))
    assert theirs.filter(F.abs(F.col("margin") - F.col("m")) > 1e-9).count() == 0
    assert theirs.filter("prediction <> q").count() == 0
    low = linear.score_weights(test, ["0"], [1.0], 0.0, threshold=0.0)
    assert low.filter("prediction = 0").count() == 0


def test_mlp_repeats_with_its_seed_and_learns(sides):
    train, test = sides
    one, two = (mlp.fit_mlp(train, 4).weights.toArray() for _ in range(2))
    assert np.allclose(one, two)
    model = mlp.fit_mlp(train, 4, max_iter=100, solver="l-bfgs")
    assert accuracy(model.transform(test)).first()["accuracy"] > _majority(test) + 0.05


def test_network_expressions_equal_the_model(sides):
    train, test = sides
    model = mlp.fit_mlp(train, 4, hidden=(5, 3), max_iter=30, solver="l-bfgs")
    layers = mlp.layers_of(model)
    mine = mlp.score_network(test, SUSY_FEATURES, layers, "sigmoid").withColumnsRenamed(
        {"margin": "m", "prediction": "q"})
    raw = vector_to_array("rawPrediction")
    both = model.transform(mine)
    assert both.filter(F.abs(raw[1] - raw[0] - F.col("m")) > 1e-9).count() == 0
    assert both.filter("prediction <> q").count() == 0
    as_tanh = mlp.score_network(mine, SUSY_FEATURES, mlp.to_tanh(layers), "tanh")
    assert as_tanh.filter(F.abs(F.col("margin") - F.col("m")) > 1e-9).count() == 0
    with pytest.raises(ValueError):
        mlp.score_network(test, SUSY_FEATURES, layers, "relu")


def test_tanh_network_learns_by_its_gradient(spark, sides, matrix):
    x, y = matrix
    start = mlp.random_layers([4, 5, 3, 2], seed=2)
    flat = [(np.array(layer.weights), np.array(layer.bias)) for layer in start]
    loss, gradient = mlp._gradient(x, y, flat)
    at = 0
    for w, b in flat:
        for a in (w, b):
            for i in (0, a.size - 1):
                old = a.flat[i]
                a.flat[i] = old + 1e-6
                up = mlp._gradient(x, y, flat)[0]
                a.flat[i] = old - 1e-6
                down = mlp._gradient(x, y, flat)[0]
                a.flat[i] = old
                assert gradient[at + i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-3)
            at += a.size
    assert at == len(gradient)
    train, test = sides
    layers, losses = mlp.fit_mlp_tanh(train, SUSY_FEATURES, hidden=(6, 4), max_iter=200, step_size=0.5, seed=5)
    assert len(losses) == 201 and losses[-1] < losses[0] - 0.1 and all(b < a for a, b in zip(losses[:30], losses[1:30]))
    scored = mlp.score_network(test, SUSY_FEATURES, layers, "tanh")
    assert accuracy(scored).first()["accuracy"] > _majority(test) + 0.05
    assert scored.select("prediction").distinct().count() == 2
    again = mlp.fit_mlp_tanh(train.repartition(3), SUSY_FEATURES, hidden=(6, 4), max_iter=20, step_size=0.5, seed=5, tol=0.0)[1]
    assert np.allclose(again, losses[:21])
    assert len(mlp.fit_mlp_tanh(train, "features", hidden=(3,), max_iter=50, step_size=1e-9, tol=1e-6)[1]) == 2


def test_network_from_given_weights(sides):
    layers = mlp.random_layers([4, 3, 2], seed=1)
    model = mlp.fit_mlp(sides[0], 4, start=layers, max_iter=1, step_size=1e-300)
    assert np.allclose(model.weights.toArray(), mlp.flat_weights(layers))
    assert mlp.flat_weights(mlp.layers_of(model)) == model.weights.toArray().tolist()


def test_trees_as_a_table(spark, sides):
    train, test = sides
    model = trees.fit_gbt(train, seed=1, n_trees=4)
    nodes = trees.model_nodes(model, spark).drop("n")
    mine = trees.score_trees(test, SUSY_FEATURES, nodes, model.treeWeights).withColumnsRenamed({"margin": "m", "prediction": "q"})
    both = model.transform(mine)
    raw = vector_to_array("rawPrediction")
    assert both.filter(F.abs(raw[1] - F.col("m") * 1) > 1e-9).filter(F.abs(raw[1] - F.col("m") * 2) > 1e-9).count() == 0
    assert both.filter("prediction <> q").count() == 0
    with pytest.raises(ValueError):
        trees.score_trees(test, SUSY_FEATURES, nodes, [1.0])


def test_grown_tree_lowers_the_squared_error_most(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, size=(400, 3)).astype(float)
    t = np.where((x[:, 1] > 2) & (x[:, 0] < 2), 1.0, -1.0) + rng.integers(0, 2, 400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, t)], "a double, b double, c double, t double")

    def best(rows):
        found = []
        for f in range(3):
            values = np.unique(x[rows, f])
            for lo, hi in zip(values, values[1:]):
                left = x[rows, f] <= (lo + hi) / 2
                error = sum(((t[rows][s] - t[rows][s].mean()) ** 2).sum() for s in (left, ~left))
                found.append((error, f, (lo + hi) / 2))
        return min(found) if found else None

    got = {r["node"]: r for r in trees.grow_tree(df.repartition(4), ["a", "b", "c"], "t", 2).collect()}
    places = {1: np.arange(400)}
    for node in sorted(got):
        rows = places[node]
        assert got[node]["n"] == len(rows) and got[node]["value"] == pytest.approx(t[rows].mean())
        if got[node]["cut"] is not None:
            f, cut = got[node]["feature"], got[node]["cut"]
            left = x[rows, f] <= cut
            error = sum(((t[rows][s] - t[rows][s].mean()) ** 2).sum() for s in (left, ~left))
            assert error == pytest.approx(best(rows)[0])
            places[2 * node], places[2 * node + 1] = rows[left], rows[~left]
    assert set(got) == set(places) and len(got) > 3


def test_gbt(sides):
    train, test = sides
    model = trees.fit_gbt(train, seed=1, n_trees=5)
    assert accuracy(model.transform(test)).first()["accuracy"] > _majority(test)
    importances = trees.importance_table(train, model, SUSY_FEATURES)
    assert importances.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_weights_stand_for_equal_rows(spark):
    rows = [(float(i * 7 % 10 > 4 + i % 3), float(i % 3), float(i * 7 % 10)) for i in range(600)]
    df = spark.createDataFrame(rows, "label double, a double, b double")
    distinct = trees.collapsed(df, ["label", "a", "b"])
    assert distinct.count() == len(set(rows)) and distinct.agg(F.sum("weight")).first()[0] == 600

    def nodes(table, **params):
        model = trees.fit_gbt(features.assemble_features(table, ["a", "b"]), seed=1, n_trees=3, **params)
        return [(r["tree"], r["node"], r["feature"], r["cut"], round(r["value"], 9), r["n"])
                for r in trees.model_nodes(model, spark).orderBy("tree", "node").collect()]

    assert nodes(distinct, weightCol="weight") == nodes(df) and nodes(df)[0][5] == 600


def test_gbt_query_fits_distinct_rows(spark, sf_dir, monkeypatch):
    seen = []

    def fit(rows, **params):
        seen.append((rows.count(), rows.distinct().count()))
        return trees_fit(rows, **params)

    trees_fit = trees.fit_gbt
    monkeypatch.setattr(trees, "fit_gbt", fit)
    assert rows_of(model_plans._gbt(spark, sf_dir)) == rows_of(model_plans._grow(spark, sf_dir))
    assert seen[0][0] == seen[0][1]


def test_lloyd_steps(spark, matrix):
    x = matrix[0][:, :2]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "`0` double, `1` double").repartition(4)
    start = [[0.1, 0.1], [0.9, 0.9], [50.0, 50.0]]
    want = np.array(start)
    for _ in range(4):
        near = ((x[:, None, :] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([x[near == j].mean(axis=0) if (near == j).any() else want[j] for j in range(3)])
    got = km.kmeans_lloyd(df, ["0", "1"], start, 4)
    assert np.allclose(got, want) and got[2] == start[2]
    vectors = df.select(array_to_vector(F.array("`0`", "`1`")).alias("features"))
    got = km.kmeans_lloyd_vectors(vectors.repartition(7), start, 4)
    assert np.allclose(got, want) and got[2] == start[2]


def test_nearest_center_ties(spark):
    df = spark.createDataFrame([(0.0,), (0.6,)], "x double")
    assert rows_of(km.assign_clusters(df, ["x"], [[1.0], [-1.0], [1.0]])) == [(0.0, 0), (0.6, 0)]


def test_seeding_does_not_depend_on_partitions(spark, sides):
    rows = susy(spark, "/root/testdata/sf0.001")
    one = km.seed_centers(rows, SUSY_FEATURES, "split_key", 3)
    assert one == km.seed_centers(rows.repartition(7), SUSY_FEATURES, "split_key", 3) and len(one) == 3
    far = spark.createDataFrame([(i, float(i % 3) * 100 + i / 1000) for i in range(300)], "k bigint, x double").repartition(5)
    seeds = sorted(round(c[0] / 100) for c in km.seed_centers(far, ["x"], "k", 3))
    assert seeds == [0, 1, 2]
    centers = km.fit_kmeans_seeded(far, ["x"], "k", 3)
    assert np.allclose(sorted(c[0] for c in centers), [0.1485, 100.1495, 200.1505], atol=0.01)
    with pytest.raises(ValueError, match="fewer"):
        km.seed_centers(spark.createDataFrame([(1, 5.0)] * 4, "k bigint, x double"), ["x"], "k", 2)
    with pytest.raises(ValueError, match="no rows"):
        km.seed_centers(far.limit(0), ["x"], "k", 2)


def test_wide_lloyd_steps_with_tasks_that_have_no_rows(spark):
    rows = [(0.0, 0.0), (0.0, 2.0), (9.0, 9.0)]
    vectors = spark.createDataFrame([(Vectors.dense(r),) for r in rows], ["features"]).repartition(11)
    assert vectors.rdd.glom().filter(lambda part: not part).count() >= 8
    assert km.kmeans_lloyd_vectors(vectors, [[0.0, 0.0], [9.0, 9.0]], 3) == [[0.0, 1.0], [9.0, 9.0]]


def test_library_fit_from_given_centers(spark):
    points = [(0.0,), (1.0,), (2.0,), (4.0,), (5.0,), (6.0,), (3.0,)]
    vectors = spark.createDataFrame([(Vectors.dense(p),) for p in points], ["features"]).repartition(3)
    for start, want in (([[1.0], [4.5]], [1.0, 4.5]), ([[0.0], [6.0]], [1.5, 5.0])):
        got = km.fit_kmeans_from(vectors, start).clusterCenters
        assert np.allclose(sorted(c[0] for c in got), want)


def test_fit_kmeans_query_returns_the_fit(spark, tmp_path):
    lines = [(o, n, o % 7, o % 5, 1000.0 * o, 1.0 + o % 50, 0.01 * (o % 9), 0.01 * (o % 8)) for o in range(1, 301) for n in (1, 2, 7)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, "
                          "l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = model_plans._fit_kmeans(spark, str(tmp_path)).collect()
    train = susy_split(spark, str(tmp_path)).filter("split = 'train'").select(*[f"`{f}`" for f in SUSY_FEATURES]).collect()
    x = np.array([list(r) for r in train])
    low, high = x[x[:, 3] < 5], x[x[:, 3] > 5]
    assert len(got) == 8 and {(r["k"], r["width"], r["n"], r["moved"]) for r in got} == {(2, 4, len(x), 0.0)}
    assert sorted({r["size"] for r in got}) == sorted({len(low), len(high)})
    centers = sorted(([r["value"] for r in sorted((r for r in got if r["cluster"] == c), key=lambda r: r["dim"])] for c in (0, 1)),
                     key=lambda c: c[3])
    assert np.allclose(centers, [low.mean(axis=0), high.mean(axis=0)], atol=1e-6)
    cost = (np.square(low - centers[0]).sum() + np.square(high - centers[1]).sum()) / len(x)
    assert got[0]["mean_cost"] == pytest.approx(cost, abs=2e-6)


def test_kmeans_centers_are_fixed_points(spark, sf_dir):
    rows = susy(spark, sf_dir).select(array_to_vector(F.array("`0`")).alias("features"), F.col("`0`"))
    centers = km.fit_kmeans(rows, seed=1).clusterCenters()
    moved = km.kmeans_lloyd(rows, ["0"], centers, 1)
    assert np.allclose(sorted(moved), sorted(map(list, centers)), atol=1e-3)
    table = km.center_table(rows, centers).orderBy("cluster").collect()
    assert table[0]["value"] < table[1]["value"]


@pytest.fixture(scope="module")
def wide(spark):
    df = emb(spark, "/root/testdata/sf0.001").cache()
    return df, np.array([r["features"].toArray() for r in df.collect()])


def test_pca(wide):
    df, x = wide
    model = pca.fit_pca(df, 10)
    v = model.pc.toArray()
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-8)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(model.explainedVariance.toArray(), values[:10] / values.sum())
    fixed = pca.fix_signs(v)
    assert (fixed[np.abs(fixed).argmax(axis=0), range(10)] > 0).all()
    with pytest.raises(Exception):
        pca.fit_pca(df, 65)


def test_sweep_equals_separate_fits(wide):
    df, _ = wide
    got = pca.pca_k_sweep(df, (10, 30, 64, 65)).orderBy("k").collect()
    for r in got[:3]:
        assert r["ok"] and r["explained"] == pytest.approx(sum(pca.fit_pca(df, r["k"]).explainedVariance))
    assert not got[3]["ok"] and "65" in got[3]["error"]


def test_sweep_where_nothing_fits(spark):
    df = spark.createDataFrame([(Vectors.dense(1.0, 2.0),)] * 3, ["features"])
    assert rows_of(pca.pca_k_sweep(df, (10, 20)), "k", "ok") == [(10, False), (20, False)]


def test_matrices_of_vectors_with_a_constant_column(spark):
    x = np.random.default_rng(0).normal(size=(50, 4))
    x[:, 2] = 3.0
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x], ["features"])
    n, mean, cov = pca.vector_moments(df)
    assert n == 50 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    assert np.allclose(pca.vector_gram(df), x.T @ x)
    cols = spark.createDataFrame([tuple(map(float, r)) for r in x], ["a", "b", "c", "d"])
    long = pca.collect_matrix(pca.covariance_matrix(cols, cols.columns), 4, "cov")
    assert np.allclose(long, np.cov(x.T))
    with pytest.raises(ValueError):
        pca.covariance_matrix(cols, ["a"] * 25)


def test_power_method(wide):
    df, x = wide
    gram = x[:, :3].T @ x[:, :3] + np.diag([300.0, 100.0, 0.0])
    vectors, values = pca.power_components(gram, 3)
    want, basis = np.linalg.eigh(gram)
    assert np.allclose(values, want[::-1])
    assert np.allclose(pca.fix_signs(vectors), pca.fix_signs(basis[:, ::-1]), atol=1e-6)
    with pytest.raises(ValueError):
        pca.power_components(gram, 4)


@pytest.mark.parametrize("k", [1, 10, 40, 64])
@pytest.mark.parametrize("centered", [True, False])
def test_components_of_wide_rows(wide, k, centered):
    df, x = wide
    moment = np.cov(x.T, bias=True) if centered else x.T @ x
    want, basis = np.linalg.eigh(moment)
    vectors, ratios = pca.fit_components(df.repartition(5), "features", k, centered)
    assert np.allclose(ratios, want[::-1][:k] / want.sum(), atol=1e-10)
    assert np.allclose(pca.fix_signs(vectors), pca.fix_signs(basis[:, ::-1][:, :k]), atol=1e-6)


def test_components_of_rows_with_holes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 90)) * np.linspace(1, 3, 90) + 5
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = 2.5
    full = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x], ["features"]).repartition(7)
    for centered, moment in ((True, np.cov(full.T)), (False, full.T @ full)):
        want, basis = np.linalg.eigh(moment)
        vectors, ratios = pca.fit_components(df, "features", 3, centered)
        assert np.allclose(ratios, want[::-1][:3] / want.sum(), atol=1e-10)
        assert np.allclose(pca.fix_signs(vectors), pca.fix_signs(basis[:, ::-1][:, :3]), atol=1e-6)
    n, mean, cov = pca.vector_moments(df)
    assert n == 300 and np.allclose(mean, full.mean(axis=0)) and np.allclose(cov, np.cov(full.T)) and (cov[4] == 0).all()
    table = {(r["i"], r["j"]): r["cov"] for r in pca.covariance_table(df).collect()}
    assert len(table) == 8100 and np.allclose([table[i, 7] for i in range(90)], cov[:, 7])
    cols = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r[:5]) for r in x], "a double, b double, c double, d double, e double")
    assert np.allclose(pca.fit_pca_uncentered(cols, cols.columns, 2)[1], np.linalg.eigvalsh(full[:, :5].T @ full[:, :5])[::-1][:2]
                       / (full[:, :5] ** 2).sum(), atol=1e-10)


def test_components_need_values_and_passes(spark, wide):
    df = spark.createDataFrame([(Vectors.dense(1.0, float("nan")),)] * 3, ["features"])
    with pytest.raises(ValueError, match="no value"):
        pca.fit_components(df, "features", 1)
    with pytest.raises(ValueError, match="no rows"):
        pca.fit_components(df.limit(0), "features", 1)
    with pytest.raises(ValueError, match="converged"):
        pca.fit_components(wide[0], "features", 5, max_passes=1)
    with pytest.raises(ValueError, match="k must"):
        pca.fit_components(wide[0], "features", 65)


def test_one_failing_model_does_not_stop_the_rest(sides):
    train, test = (s.select("label", "features") for s in sides)
    got = suite.fit_all_models(train, test, suite.default_models(4, seed=1)).orderBy("ord").collect()
    assert [(r["model"], r["ok"]) for r in got] == [
        ("kmeans", True), ("logistic_regression", True), ("pca", False), ("mlp", True)]
    assert got[2]["error"] and got[1]["test_metric"] > 0.7 and got[0]["train_metric"] is None


def test_uncentered_components_of_any_matrix():
    vectors, values = pca.power_components(np.array([[2.0, -1.0], [-1.0, 2.0]]), 2)
    assert np.allclose(values, [3.0, 1.0]) and np.allclose(np.abs(vectors), np.sqrt(0.5))
    with pytest.raises(ValueError, match="converged"):
        pca.power_components(np.diag([1.0, 0.999]), 1, steps=3, tol=1e-12)
    with pytest.raises(ValueError, match="finite"):
        pca.power_components(np.full((2, 2), np.nan), 1)
