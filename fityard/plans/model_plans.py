"""Fitting and applying models."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fityard.functions.vectors import squared_distance
from fityard.operators import features as ft
from fityard.operators import kmeans as km
from fityard.operators import linear, mlp, pca, suite, trees
from fityard.operators.splits import positional_split, train_val_split
from fityard.plans.feature_plans import MISSING_SQL, SCORED_SQL, scored, with_missing
from fityard.plans.fixtures import (
    INDEXED_SQL, KEYS_SQL, N_TEST, N_TRAIN, SPLIT_SQL, SUSY_FEATURES, SUSY_KEYS, SUSY_SQL, VAL_HASH_SQL, chunk_rows, emb, susy,
    susy_prefix, susy_split, susy_table, susy_vectors)
from fityard.plans.registry import query
from fityard.runtime import written

SEED = 123

# --- logistic regression -------------------------------------------------------------------------

NEWTON_STEPS = 12


def _solve_sql(n: int, source: str) -> str:
    """``source`` with columns ``s0 ...`` that solve the system ``h<i>_<j> s = g<i>`` (``h`` symmetric), by elimination."""
    cells = {(i, j): f"h{min(i, j)}_{max(i, j)}" if j < n else f"g{i}" for i in range(n) for j in range(n + 1)}
    for p in range(n - 1):
        made = []
        for r in range(p + 1, n):
            for c in range(p + 1, n + 1):
                made.append(f"{cells[r, c]} - {cells[r, p]} / {cells[p, p]} * {cells[p, c]} as e{p}_{r}_{c}")
            cells.update({(r, c): f"e{p}_{r}_{c}" for c in range(p + 1, n + 1)})
        source = f"(select *, {', '.join(made)} from {source})"
    for i in reversed(range(n)):
        rest = "".join(f" - {cells[i, j]} * s{j}" for j in range(i + 1, n))
        source = f"(select *, ({cells[i, n]}{rest}) / {cells[i, i]} as s{i} from {source})"
    return source


def _newton_sql(side: str = "split = 'train'", base: str = SPLIT_SQL, rows: str = "sp") -> str:
    """Newton steps on all features, from zero; ``nw`` holds the optimum: ``w0`` is the intercept, ``w<i + 1>`` belongs to feature i."""
    n = len(SUSY_FEATURES) + 1
    inputs = ", ".join(f'"{f}" as x{i + 1}' for i, f in enumerate(SUSY_FEATURES))
    steps = [f"d as materialized (select target as y, cast(1 as double) as x0, {inputs} from {rows} where {side})",
             "n0 as materialized (select " + ", ".join(f"cast(0 as double) as w{i}" for i in range(n)) + ")"]
    held = ", ".join(f"any_value(w{i}) as w{i}" for i in range(n))
    sums = ", ".join([*(f"sum((y - p) * x{i}) as g{i}" for i in range(n)),
                      *(f"sum(p * (1 - p) * x{i} * x{j}) as h{i}_{j}" for i in range(n) for j in range(i, n))])
    margin = " + ".join(f"w{i} * x{i}" for i in range(n))
    for t in range(NEWTON_STEPS):
        totals = f"(select {held}, {sums} from (select *, 1 / (1 + exp(-({margin}))) as p from d, n{t}))"
        steps.append(f"""n{t + 1} as materialized (
  select {", ".join(f"w{i} + s{i} as w{i}" for i in range(n))} from {_solve_sql(n, totals)})""")
    return ", ".join([base, *steps, f"nw as (select * from n{NEWTON_STEPS})"])


NEWTON_SQL = _newton_sql()
MARGIN_SQL = "w0 + " + " + ".join(f'w{i + 1} * "{f}"' for i, f in enumerate(SUSY_FEATURES))


def logreg_all(spark, sf_dir):
    """Fit on all features of the train side, and both sides."""
    train, test = susy_vectors(spark, sf_dir, SUSY_FEATURES)
    return linear.fit_logreg_newton(train, SUSY_FEATURES), train, test


@query("fit_logreg", f"""with {NEWTON_SQL} select solver, term, round(value, 4) + 0 as value
from (values ('library'), ('newton')) as s(solver), (
  select 'intercept' as term, w0 as value from nw """ + " ".join(
    f"union all select '{f}', w{i + 1} from nw" for i, f in enumerate(SUSY_FEATURES)) + ")")
def _logreg(spark, sf_dir):
    fit, train, _ = logreg_all(spark, sf_dir)
    model = linear.fit_logreg(train.select("label", "features"), max_iter=200, tol=1e-12)
    library = linear.coefficient_table(train, model, SUSY_FEATURES).withColumn("solver", F.lit("library"))
    own = spark.createDataFrame([("intercept", fit.intercept), *zip(SUSY_FEATURES, fit.coefficients)],
                                "term string, value double").withColumn("solver", F.lit("newton"))
    return library.unionByName(own).select("solver", "term", (F.round("value", 4) + F.lit(0.0)).alias("value"))


PREFIX_SQL = INDEXED_SQL + f""", px as (
  select *, case when row_idx < {N_TRAIN} * chunk_rows then 'train' else 'test' end as split
  from ix where row_idx < {N_TRAIN + N_TEST} * chunk_rows)"""


@query("prefix_to_score", f"""with {_newton_sql(base=PREFIX_SQL, rows="px")}
select split, count(*) as n, round(avg(case when ({MARGIN_SQL} > 0) = (target = 1) then 1.0 else 0.0 end), 9) as accuracy,
       round(avg(ln(1 + exp(case when target = 1 then -({MARGIN_SQL}) else {MARGIN_SQL} end))), 7) as log_loss
from px, nw group by 1""")
def _prefix_to_score(spark, sf_dir):
    """From the files to the score: prefix of the feature files, split by position, fit on its train side, scores of both."""
    rows = ft.rename_label(susy_prefix(spark, sf_dir).drop(*SUSY_KEYS))
    sides = positional_split(written(rows, "prefix"), chunk_rows(spark, sf_dir), N_TRAIN, N_TEST)
    fit = linear.fit_logreg_newton(sides.filter("split = 'train'"), SUSY_FEATURES)
    scored = linear.score_weights(sides, SUSY_FEATURES, fit.coefficients, fit.intercept)
    sign = F.when(F.col("label") == 1, -F.col("margin")).otherwise(F.col("margin"))
    return scored.groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 9).alias("accuracy"),
        F.round(F.avg(F.log1p(F.exp(sign))), 7).alias("log_loss"))


@query("training_accuracy", f"""with {NEWTON_SQL}
select round(avg(case when ({MARGIN_SQL} > 0) = (target = 1) then 1.0 else 0.0 end), 9) as accuracy
from sp, nw where split = 'train'""")
def _training_accuracy(spark, sf_dir):
    train, _ = susy_vectors(spark, sf_dir, SUSY_FEATURES)
    model = linear.fit_logreg(train.select("label", "features"), max_iter=200, tol=1e-12)
    return spark.createDataFrame([(model.summary.accuracy,)], "accuracy double").select(
        F.round("accuracy", 9).alias("accuracy"))


REG_PARAM, MIX = 0.01, 0.5
PROXIMAL_STEPS, STEP_SIZE = 120, 3.0


def _elastic_sql() -> str:
    """Proximal gradient steps on standardised features (they are all but uncorrelated, so a fixed
    step size converges fast); ``en`` holds intercept and weights on the original scale."""
    n = range(len(SUSY_FEATURES))
    stats = ", ".join(f'avg("{i}") as m{i}, stddev_samp("{i}") as s{i}' for i in n)
    scaled = ", ".join(f'("{i}" - m{i}) / s{i} as z{i}' for i in n)
    margin = "b + " + " + ".join(f"w{i} * z{i}" for i in n)
    grads = "avg(p - y) as g, " + ", ".join(f"avg((p - y) * z{i}) as g{i}" for i in n)

    def shrunk(i):
        moved = f"(w{i} - {STEP_SIZE} * (g{i} + {REG_PARAM * (1 - MIX)} * w{i}))"
        return f"sign{moved} * greatest(abs{moved} - {STEP_SIZE * REG_PARAM * MIX}, 0)"

    held = ", ".join(f"any_value(w{i}) as w{i}" for i in n)
    zeros = ", ".join(f"cast(0 as double) as w{i}" for i in n)
    return f"""with recursive {SPLIT_SQL}, st as materialized (
  select {stats} from sp where split = 'train'), d as materialized (
  select target as y, {scaled} from sp, st where split = 'train'), it as (
  select 0 as step, cast(0 as double) as b, {zeros}
  union all
  select step + 1, b - {STEP_SIZE} * g, {", ".join(shrunk(i) for i in n)}
  from (select any_value(step) as step, any_value(b) as b, {held}, {grads}
        from (select *, 1 / (1 + exp(-({margin}))) as p from d, it where step < {PROXIMAL_STEPS})
        having count(*) > 0)), en as (
  select b - ({" + ".join(f"w{i} * m{i} / s{i}" for i in n)}) as b,
         {", ".join(f"w{i} / s{i} as w{i}" for i in n)}
  from it, st where step = {PROXIMAL_STEPS})"""


@query("fit_elastic_net", _elastic_sql() + " select 'intercept' as term, round(b, 3) as value from en " + " ".join(
    f"union all select '{i}', round(w{i}, 3) + 0 from en" for i in SUSY_FEATURES))
def _elastic(spark, sf_dir):
    train, _ = susy_vectors(spark, sf_dir, SUSY_FEATURES)
    model = linear.fit_elastic_net(train.select("label", "features"), REG_PARAM, MIX)
    return linear.coefficient_table(train, model, SUSY_FEATURES).withColumn(
        "value", F.round("value", 3))


@query("score_logreg", f"""with {SCORED_SQL}
select {KEYS_SQL}, round(margin, 9) as margin, round(probability, 9) as probability, prediction
from scored where split = 'test'""")
def _score_logreg(spark, sf_dir):
    return scored(spark, sf_dir).filter("split = 'test'").select(
        *SUSY_KEYS, F.round("margin", 9).alias("margin"),
        F.round("probability", 9).alias("probability"), "prediction")


# --- perceptron and trees ------------------------------------------------------------------------

# A fixed network 4-3-2.
NETWORK = (
    mlp.Layer(((1.5, -0.5, 0.25, 0.125), (-2.0, 0.75, 1.0, -0.25), (0.5, 0.5, -3.0, 0.0625)),
              (-0.5, 0.25, 0.125)),
    mlp.Layer(((-1.0, 1.25, 0.5), (2.0, -0.75, 0.25)), (0.125, -0.625)),
)


def _network_sql(activation: str) -> str:
    act = {"sigmoid": "1 / (1 + exp(-({})))", "tanh": "tanh({})"}[activation]

    def affine(w, b, names):
        return " + ".join([str(b), *[f"({v}) * {n}" for v, n in zip(w, names)]])

    inputs = [f'"{f}"' for f in SUSY_FEATURES]
    hidden, out = NETWORK
    h = ", ".join(f"{act.format(affine(w, b, inputs))} as h{j}"
                  for j, (w, b) in enumerate(zip(hidden.weights, hidden.bias)))
    z = [affine(w, b, ["h0", "h1", "h2"]) for w, b in zip(out.weights, out.bias)]
    return f"""with {SPLIT_SQL}, hd as (select *, {h} from sp), ot as (
  select *, ({z[1]}) - ({z[0]}) as margin from hd)
select {KEYS_SQL}, round(margin, 9) as margin,
       cast(case when margin > 0 then 1 else 0 end as double) as prediction
from ot where split = 'test'"""


def _network(activation):
    def run(spark, sf_dir):
        test = susy_split(spark, sf_dir).filter("split = 'test'")
        return mlp.score_network(test, SUSY_FEATURES, NETWORK, activation).select(
            *SUSY_KEYS, F.round("margin", 9).alias("margin"), "prediction")
    return run


LEARN_STEPS, LEARN_RATE = 10, 0.5


def _learn_sql(activation: str, side: str = "split = 'train'") -> tuple[str, str, str, str]:
    """Steps of gradient descent over all rows of one side from the fixed network; ``n<t>`` holds the weights after t
    steps, ``f<t>`` the mean loss before step t + 1. Returns these tables, and queries of the weights after the last step, of all losses
    and of the accuracy on the test side."""
    hidden, out = NETWORK
    slope = {"sigmoid": "h{j} * (1 - h{j})", "tanh": "(1 - h{j} * h{j})"}[activation]
    act = {"sigmoid": "1 / (1 + exp(-({z})))", "tanh": "tanh({z})"}[activation]
    units, inputs = range(len(hidden.bias)), range(len(SUSY_FEATURES))
    start = [*(f"{b!r}::double as b0_{j}" for j, b in enumerate(hidden.bias)),
             *(f"{v!r}::double as w0_{j}_{i}" for j, w in enumerate(hidden.weights) for i, v in enumerate(w)),
             *(f"{b!r}::double as b1_{k}" for k, b in enumerate(out.bias)),
             *(f"{v!r}::double as w1_{k}_{j}" for k, w in enumerate(out.weights) for j, v in enumerate(w))]
    names = [s.rsplit(" ", 1)[1] for s in start]
    h = ", ".join(act.format(z=f"b0_{j} + " + " + ".join(f"w0_{j}_{i} * x{i}" for i in inputs)) + f" as h{j}" for j in units)
    margin = "b1_1 - b1_0 + " + " + ".join(f"(w1_1_{j} - w1_0_{j}) * h{j}" for j in units)
    error = {0: "(y - p)", 1: "(p - y)"}
    delta = ", ".join(f"({error[0]} * w1_0_{j} + {error[1]} * w1_1_{j}) * {slope.format(j=j)} as d{j}" for j in units)
    grads = [*(f"avg(d{j}) as g_b0_{j}" for j in units), *(f"avg(d{j} * x{i}) as g_w0_{j}_{i}" for j in units for i in inputs),
             *(f"avg({error[k]}) as g_b1_{k}" for k in (0, 1)),
             *(f"avg({error[k]} * h{j}) as g_w1_{k}_{j}" for k in (0, 1) for j in units)]
    held = ", ".join(f"any_value({n}) as {n}" for n in names)
    features = ", ".join(f'"{f}" as x{i}' for i, f in enumerate(SUSY_FEATURES))
    ctes = [f"d as materialized (select target as y, {features} from sp where {side})",
            f"n0 as materialized (select {', '.join(start)})"]
    for t in range(LEARN_STEPS + 1):
        ctes.append(f"""f{t} as materialized (
  select {held}, avg(greatest(m, 0) - y * m + ln(1 + exp(-abs(m)))) as loss, {", ".join(grads)}
  from (select *, {delta} from (select *, 1 / (1 + exp(-m)) as p from (select *, {margin} as m
  from (select *, {h} from d, n{t})))))""")
        ctes.append(f"n{t + 1} as materialized (select " + ", ".join(f"{n} - {LEARN_RATE} * g_{n} as {n}" for n in names) + f" from f{t})")
    cells = [(d, j, i, f"w{d}_{j}_{i}" if i >= 0 else f"b{d}_{j}") for d, layer in enumerate(NETWORK)
             for j, w in enumerate(layer.weights) for i in range(-1, len(w))]
    weights = " union all ".join(
        f"select cast({d} as integer) as layer, cast({j} as integer) as unit, cast({i} as integer) as input, "
        f"round({c}, 7) + 0 as value from n{LEARN_STEPS}" for d, j, i, c in cells)
    losses = " union all ".join(
        f"select cast(-1 as integer), cast({t} as integer), cast(-1 as integer), round(loss, 7) from f{t}" for t in range(LEARN_STEPS + 1))
    hits = f"""select round(avg(case when (m > 0) = (target = 1) then 1.0 else 0.0 end), 9)
  from (select *, {margin} as m from (select *, {h} from (select target, {features} from sp where split = 'test'), n{LEARN_STEPS}))"""
    return f"{SPLIT_SQL}, {', '.join(ctes)}", weights, losses, hits


def _weights(spark, layers):
    return mlp.weight_table(spark, layers).withColumn("value", F.round("value", 7) + F.lit(0.0))


SIGMOID_SQL, SIGMOID_WEIGHTS, _, SIGMOID_HITS = _learn_sql("sigmoid")
TANH_SQL, TANH_WEIGHTS, TANH_LOSSES, _ = _learn_sql("tanh")
SIGMOID = {"start": NETWORK, "max_iter": LEARN_STEPS, "step_size": LEARN_RATE, "blockSize": 1, "tol": 0.0}
TANH = {"start": NETWORK, "max_iter": LEARN_STEPS, "step_size": LEARN_RATE}


@query("fit_mlp", f"with {SIGMOID_SQL} {SIGMOID_WEIGHTS}")
def _mlp(spark, sf_dir):
    # With one row per block the library's gradient is the plain mean over all rows.
    train, _ = susy_vectors(spark, sf_dir, SUSY_FEATURES)
    model = mlp.fit_mlp(train.select("label", "features"), len(SUSY_FEATURES), **SIGMOID)
    return _weights(spark, mlp.layers_of(model))


@query("fit_mlp_tanh", f"with {TANH_SQL} {TANH_WEIGHTS} union all {TANH_LOSSES}")
def _mlp_tanh(spark, sf_dir):
    """Weights after the last step, and the loss before each step and after the last one (layer -1)."""
    train, _ = susy_vectors(spark, sf_dir, SUSY_FEATURES)
    layers, losses = mlp.fit_mlp_tanh(train, SUSY_FEATURES, **TANH)
    lost = spark.createDataFrame([(-1, t, -1, v) for t, v in enumerate(losses)], "layer int, unit int, input int, value double")
    return _weights(spark, layers).unionByName(lost.withColumn("value", F.round("value", 7)))


query("score_mlp", _network_sql("sigmoid"))(_network("sigmoid"))
query("score_mlp_tanh", _network_sql("tanh"))(_network("tanh"))


# Discrete features: price in tens of thousands, quantity, discount and line number.
BINS_SQL = SPLIT_SQL + """, bn as materialized (
  select [least(floor("0" * 10), 9), "1" * 50, "2", "3"] as x, 2 * target - 1 as t from sp where split = 'train')"""
DISCRETE, TREE_DEPTH = ["price", "quantity", "discount", "line"], 3


def _tree_sql() -> str:
    """The tree that lowers the squared error of the labels (as -1 and 1) most, level by level."""
    ctes = ["a0 as (select 1 as node, x, t from bn)"]
    for depth in range(TREE_DEPTH + 1):
        ctes.append(f"""h{depth} as materialized (
  select node, f, v, count(*) as n, sum(t) as s
  from (select node, t, unnest(x) as v, unnest(range({len(DISCRETE)})) as f from a{depth}) group by 1, 2, 3), r{depth} as materialized (
  select node, f, v, lead(v) over w as nv, sum(n) over w as a, sum(s) over w as p,
         sum(n) over (partition by node, f) as n, sum(s) over (partition by node, f) as s
  from h{depth} window w as (partition by node, f order by v)), g{depth} as (
  select *, p * p / a + (s - p) * (s - p) / (n - a) - s * s / n as gain from r{depth} where nv is not null), b{depth} as materialized (
  select node, f, (v + nv) / 2 as cut from g{depth} where gain > 0 and {depth} < {TREE_DEPTH}
  qualify row_number() over (partition by node order by gain desc, f, v) = 1), o{depth} as materialized (
  select node, any_value(n) as n, any_value(s) as s from r{depth} where f = 0 group by 1), a{depth + 1} as (
  select node * 2 + case when x[f + 1] > cut then 1 else 0 end as node, x, t from a{depth} join b{depth} using (node))""")
    found = " union all ".join(
        f"""select cast(node as integer) as node, cast(coalesce(f, -1) as integer) as feature, round(cut, 9) as cut,
       round(s / n, 9) as value, cast(n as bigint) as n from o{d} left join b{d} using (node)""" for d in range(TREE_DEPTH + 1))
    return f"with {BINS_SQL}, {', '.join(ctes)} {found}"


def _discrete(spark, sf_dir):
    train, _ = susy_vectors(spark, sf_dir, SUSY_FEATURES)
    return train.select("label", (F.col("label") * 2 - 1).alias("target"), F.least(
        F.floor(F.col("`0`") * 10).cast("double"), F.lit(9.0)).alias("price"), (F.col("`1`") * 50).alias("quantity"),
        F.col("`2`").alias("discount"), F.col("`3`").alias("line"))


def _rounded_tree(nodes):
    return nodes.select("node", "feature", F.round("cut", 9).alias("cut"), F.round("value", 9).alias("value"), "n")


@query("fit_gbt", _tree_sql())
def _gbt(spark, sf_dir):
    """The first of all fitted trees, its nodes numbered as those of ``grow_tree``."""
    distinct = trees.collapsed(_discrete(spark, sf_dir), ["label", *DISCRETE])
    rows = ft.assemble_features(distinct, DISCRETE).select("label", "features", "weight")
    model = trees.fit_gbt(rows, seed=SEED, maxBins=64, weightCol="weight")
    nodes = {r["node"]: r for r in trees.model_nodes(model, spark).filter("tree = 0").collect()}
    found, queue = [], [(0, 1)]
    while queue:
        at, name = queue.pop()
        n = nodes[at]
        found.append((name, n["feature"], n["cut"], n["value"], n["n"]))
        if n["left"] >= 0:
            queue += [(n["left"], 2 * name), (n["right"], 2 * name + 1)]
    return _rounded_tree(spark.createDataFrame(found, "node int, feature int, cut double, value double, n bigint"))


@query("grow_tree", _tree_sql())
def _grow(spark, sf_dir):
    return _rounded_tree(trees.grow_tree(_discrete(spark, sf_dir), DISCRETE, "target", TREE_DEPTH))


# Given trees on the four features: (tree, node, feature, cut, left, right, value), and their weights.
TREES = tuple(trees.Node(*n) for n in (
    (0, 0, 0, 0.5, 1, 2, 0.0), (0, 1, 0, 0.375, 3, 4, 0.0), (0, 2, 0, 0.625, 5, 6, 0.0), (0, 3, -1, None, -1, -1, -0.875),
    (0, 4, 2, 0.045, 7, 8, 0.0), (0, 5, -1, None, -1, -1, 0.25), (0, 6, -1, None, -1, -1, 0.75),
    (0, 7, -1, None, -1, -1, -0.125), (0, 8, -1, None, -1, -1, -0.375),
    (1, 0, 2, 0.065, 1, 2, 0.0), (1, 1, 0, 0.5625, 3, 4, 0.0), (1, 2, 0, 0.6875, 5, 6, 0.0), (1, 3, -1, None, -1, -1, -0.5),
    (1, 4, -1, None, -1, -1, 0.625), (1, 5, -1, None, -1, -1, -0.75), (1, 6, -1, None, -1, -1, 0.5),
    (2, 0, 1, 0.51, 1, 2, 0.0), (2, 1, 3, 3.5, 3, 4, 0.0), (2, 2, -1, None, -1, -1, 0.0625), (2, 3, -1, None, -1, -1, 0.03125),
    (2, 4, -1, None, -1, -1, -0.03125),
    (3, 0, -1, None, -1, -1, 0.015625)))
TREE_WEIGHTS = (1.0, 0.5, 0.25, 0.125)


def _case_sql(tree: int, node: int = 0) -> str:
    n = next(x for x in TREES if (x.tree, x.node) == (tree, node))
    if n.left < 0:
        return f"cast({n.value} as double)"
    return f'case when "{SUSY_FEATURES[n.feature]}" <= {n.cut} then {_case_sql(tree, n.left)} else {_case_sql(tree, n.right)} end'


@query("score_gbt", f"with {SPLIT_SQL}, sc as (select *, " + " + ".join(
    f"{w} * {_case_sql(t)}" for t, w in enumerate(TREE_WEIGHTS)) + f""" as margin from sp where split = 'test')
select {KEYS_SQL}, round(margin, 9) as margin, cast(case when margin > 0 then 1 else 0 end as double) as prediction from sc""")
def _score_gbt(spark, sf_dir):
    test = susy_split(spark, sf_dir).filter("split = 'test'")
    return trees.score_trees(test, SUSY_FEATURES, trees.node_table(spark, TREES), TREE_WEIGHTS).select(
        *SUSY_KEYS, F.round("margin", 9).alias("margin"), "prediction")


# --- k-means -------------------------------------------------------------------------------------

def _hash_sql(multiplier: int) -> str:
    return f"((split_key % 2147483648) * {multiplier} % 4294967296 / 4294967296.0)"


N_SEEDS, LLOYD_LIMIT = 2, 300


def _seeded_sql() -> str:
    """Seeding as in ``seed_centers``, then steps from two centers until they rest; ``km`` holds all steps."""
    n = range(len(SUSY_FEATURES))
    x = "[" + ", ".join(f'"{f}"' for f in SUSY_FEATURES) + "]"
    m = km.SEED_MULTIPLIERS

    def near(cands):
        return f"list_min(list_transform({cands}, lambda c: list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))"

    rounds = [f"""pt as materialized (select {x} as x, split_key, {", ".join(f'"{f}" as x{i}' for i, f in enumerate(SUSY_FEATURES))}
  from sp where split = 'train'), c0 as materialized (
  select [min(struct_pack(h := {_hash_sql(m[0])}, x := x)).x] as cs from pt)"""]
    for r in (1, 2):
        rounds.append(f"""d{r} as materialized (select x, split_key, cs, {near("cs")} as d from pt, c{r - 1}), c{r} as materialized (
  select list_concat(any_value(cs), coalesce(list_sort(list_distinct(list(x) filter (
           where {_hash_sql(m[r])} < d * ({2.0 * N_SEEDS} / total)))), [])) as cs
  from (select *, sum(d) over () as total from d{r}))""")
    dist = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds.append(f"""cand as materialized (select unnest(cs) as c, unnest(range(len(cs))) as i from c2), wt as materialized (
  select i, count(*) as w from (
    select list_position(ds, list_min(ds)) - 1 as i
    from (select list_transform(cs, lambda c: {dist.format(a="x", b="c")}) as ds from pt, c2)) group by 1),
s1 as materialized (select c, i from cand join wt using (i) order by w desc, i limit 1),
s2 as materialized (select cand.c from cand join wt using (i), s1 order by w * {dist.format(a="cand.c", b="s1.c")} desc, cand.i limit 1)""")
    cells = [(j, i) for j in range(2) for i in n]
    far = [" + ".join(f"(x{i} - k{j}_{i}) * (x{i} - k{j}_{i})" for i in n) for j in range(2)]
    means = ", ".join(f"coalesce(avg(x{i}) filter (where near{'' if j == 0 else ' = false'}), any_value(k{j}_{i})) as m{j}_{i}" for j, i in cells)
    moved = "greatest(" + ", ".join(f"abs(m{j}_{i} - k{j}_{i})" for j, i in cells) + ")"
    rounds.append(f"""km as (
  select 0 as step, true as moved, {", ".join(f"s{j + 1}.c[{i + 1}] as k{j}_{i}" for j, i in cells)} from s1, s2
  union all
  select step + 1, {moved} > 1e-12, {", ".join(f"m{j}_{i}" for j, i in cells)}
  from (select any_value(step) as step, {", ".join(f"any_value(k{j}_{i}) as k{j}_{i}" for j, i in cells)}, {means}
        from (select *, {far[0]} <= {far[1]} as near from pt, km where moved and step < {LLOYD_LIMIT}) having count(*) > 0)),
fin as materialized (select * from km order by step desc limit 1)""")
    return f"with recursive {SPLIT_SQL}, {', '.join(rounds)}"


SEEDED_SQL = _seeded_sql()


def _train_side(spark, sf_dir):
    return susy_table(spark, sf_dir).filter("split = 'train'")


# Several fixed points are possible: the library starts from the same centers as the SQL, so that all its numbers are compared.
@query("fit_kmeans", SEEDED_SQL + f""", fitted as (
  select *, {" + ".join(f"(x{i} - k0_{i}) * (x{i} - k0_{i})" for i in range(4))} as d0,
         {" + ".join(f"(x{i} - k1_{i}) * (x{i} - k1_{i})" for i in range(4))} as d1 from pt, fin), totals as (
  select count(*) as n, sum(least(d0, d1)) as cost, {" + ".join(f"var_pop(x{i})" for i in range(4))} as one,
         greatest({", ".join(f"abs(avg(x{i}) filter (where {near}) - any_value(k{j}_{i}))"
                             for j, near in enumerate(("d0 <= d1", "d0 > d1")) for i in range(4))}) as moved
  from fitted), ordered as (
  select [{", ".join(f"any_value(k0_{i})" for i in range(4))}] as c, count(*) filter (where d0 <= d1) as size from fitted union all
  select [{", ".join(f"any_value(k1_{i})" for i in range(4))}], count(*) filter (where d0 > d1) from fitted), numbered as (
  select cast(row_number() over (order by c) - 1 as integer) as cluster, c, size from ordered)
select cast(2 as integer) as k, cast(len(c) as integer) as width, n, cluster, size, cast(unnest(range(4)) as integer) as dim,
       round(unnest(c), 6) as value, round(cost / n, 6) as mean_cost, round(moved, 4) as moved,
       cost < one * n as lower_than_one_center
from numbered, totals""")
def _fit_kmeans(spark, sf_dir):
    rows = _train_side(spark, sf_dir)
    seeds = km.seed_centers(rows, SUSY_FEATURES, "split_key", N_SEEDS)
    model = km.fit_kmeans_from(ft.assemble_features(rows, SUSY_FEATURES), seeds)
    centers = sorted(c.tolist() for c in model.clusterCenters)
    squares = F.least(*[squared_distance(c, SUSY_FEATURES) for c in centers])
    found = (km.assign_clusters(rows, SUSY_FEATURES, centers).groupBy("prediction")
             .agg(F.count("*").alias("n"), F.sum(squares).alias("cost")).collect())
    sizes, cost = {r["prediction"]: r["n"] for r in found}, sum(r["cost"] for r in found)
    n = sum(sizes.values())
    # One more step over the whole side must leave the centers where they are.
    after = km.kmeans_lloyd(rows, SUSY_FEATURES, centers, 1)
    moved = float(np.abs(np.subtract(after, centers)).max())
    one = rows.agg(*[F.var_pop(f"`{f}`") for f in SUSY_FEATURES]).first()
    cells = [(model.k, len(c), n, j, sizes.get(j, 0), d, v, cost / n, moved, cost < sum(one) * n)
             for j, c in enumerate(centers) for d, v in enumerate(c)]
    return spark.createDataFrame(
        cells, "k int, width int, n bigint, cluster int, size bigint, dim int, value double, mean_cost double, moved double, "
        "lower_than_one_center boolean").withColumns(
            {"value": F.round("value", 6), "mean_cost": F.round("mean_cost", 6), "moved": F.round("moved", 4)})


@query("fit_kmeans_wide", """
select cast(10 as integer) as k, cast(any_value(len(embedding)) as integer) as width, count(*) as n, cast(0 as double) as moved
from embeddings""")
def _fit_kmeans_wide(spark, sf_dir):
    rows = emb(spark, sf_dir)
    model = km.fit_kmeans(rows, seed=SEED, k=WIDE_K, tol=0.0)
    centers = np.array([c.toArray() if hasattr(c, "toArray") else c for c in model.clusterCenters()])
    after = km.kmeans_lloyd_vectors(rows, centers, 1)
    row = (WIDE_K, centers.shape[1], sum(model.summary.clusterSizes), float(np.abs(np.subtract(after, centers)).max()))
    return spark.createDataFrame([row], "k int, width int, n bigint, moved double").withColumn("moved", F.round("moved", 4))


@query("cluster_centers", SEEDED_SQL + f""", ordered as (
  select [{", ".join(f"k0_{i}" for i in range(4))}] as c from fin union all select [{", ".join(f"k1_{i}" for i in range(4))}] from fin),
numbered as (select cast(row_number() over (order by c) - 1 as integer) as cluster, c from ordered)
select cluster, cast(unnest(range(4)) as integer) as dim, round(unnest(c), 6) as value from numbered""")
def _centers(spark, sf_dir):
    rows = _train_side(spark, sf_dir)
    centers = km.fit_kmeans_seeded(rows, SUSY_FEATURES, "split_key", N_SEEDS)
    return km.center_table(rows, centers).withColumn("value", F.round("value", 6))


START = ((0.2, 0.2, 0.02, 2.0), (0.5, 0.8, 0.05, 4.0), (0.8, 0.4, 0.08, 6.0))
LLOYD_STEPS = 5


def nearest_sql(centers: str, n: int, cols: list[str]) -> str:
    """Number of the nearest of ``n`` centers whose coordinates are ``<centers><j>_<dim>``."""
    dist = [" + ".join(f"({c} - {centers}{j}_{d}) * ({c} - {centers}{j}_{d})"
                       for d, c in enumerate(cols)) for j in range(n)]
    both = f"[{', '.join(dist)}]"
    return f"list_position({both}, list_min({both})) - 1"


def _constants(centers) -> str:
    return ", ".join(f"cast({v} as double) as c{j}_{d}"
                     for j, c in enumerate(centers) for d, v in enumerate(c))


def _lloyd_sql() -> str:
    cols = [f"x{d}" for d in range(len(SUSY_FEATURES))]
    named = ", ".join(f'"{f}" as {x}' for f, x in zip(SUSY_FEATURES, cols))
    steps = [f"d as materialized (select {named} from susy)", f"k0 as materialized (select {_constants(START)})"]
    for i in range(LLOYD_STEPS):
        means = ", ".join(f"coalesce(avg(x{d}) filter (where c = {j}), any_value(c{j}_{d})) as c{j}_{d}"
                          for j in range(3) for d in range(len(cols)))
        steps.append(f"""k{i + 1} as materialized (select {means} from (
  select *, {nearest_sql('c', 3, cols)} as c from d, k{i}))""")
    return ", ".join([SUSY_SQL, *steps])


@query("kmeans_lloyd", f"with {_lloyd_sql()} " + " union all ".join(
    f"select cast({j} as integer) as cluster, cast({d} as integer) as dim, "
    f"round(c{j}_{d}, 8) as value from k{LLOYD_STEPS}" for j in range(3) for d in range(len(SUSY_FEATURES))))
def _lloyd(spark, sf_dir):
    rows = susy_table(spark, sf_dir)
    centers = km.kmeans_lloyd(rows, SUSY_FEATURES, START, LLOYD_STEPS)
    cells = [(j, d, v) for j, c in enumerate(centers) for d, v in enumerate(c)]
    return spark.createDataFrame(cells, "cluster int, dim int, value double").withColumn(
        "value", F.round("value", 8))


WIDE_K, WIDE_STEPS = 10, 3


def _lloyd_wide_sql() -> str:
    steps = ["""u as materialized (
  select vec_id, cast(unnest(embedding) as double) as x, unnest(range(len(embedding))) as d
  from embeddings)""",
             f"k0 as materialized (select vec_id as c, d, x from u where vec_id < {WIDE_K})"]
    for i in range(WIDE_STEPS):
        steps.append(f"""a{i} as materialized (
  select vec_id, arg_min(c, {{'s': s, 'c': c}}) as c
  from (select u.vec_id, k.c, sum((u.x - k.x) * (u.x - k.x)) as s from u join k{i} k using (d) group by 1, 2)
  group by 1), k{i + 1} as materialized (
  select k.c, k.d, coalesce(m.x, k.x) as x
  from k{i} k left join (select a.c, u.d, avg(u.x) as x from u join a{i} a using (vec_id) group by 1, 2) m
       on m.c = k.c and m.d = k.d)""")
    return "with " + ", ".join(steps)


@query("kmeans_lloyd_wide", _lloyd_wide_sql() + f"""
select cast(c as integer) as cluster, cast(d as integer) as dim, round(x, 8) as value from k{WIDE_STEPS}""")
def _lloyd_wide(spark, sf_dir):
    rows = emb(spark, sf_dir)
    first = rows.filter(F.col("vec_id") < WIDE_K).orderBy("vec_id").select("features").collect()
    centers = km.kmeans_lloyd_vectors(rows, [r["features"].toArray() for r in first], WIDE_STEPS)
    cells = [(j, d, v) for j, c in enumerate(centers) for d, v in enumerate(c)]
    return spark.createDataFrame(cells, "cluster int, dim int, value double").withColumn(
        "value", F.round("value", 8))


# Two fixed centers for scoring and cluster metrics.
CENTERS = ((0.25, 0.5, 0.05, 3.0), (0.75, 0.5, 0.05, 5.0))
CLUSTERED_SQL = SPLIT_SQL + f""", kc as (select {_constants(CENTERS)}), cl as (
  select sp.*, target as label,
         cast({nearest_sql('c', 2, [f'"{f}"' for f in SUSY_FEATURES])} as integer) as prediction from sp, kc)"""


def clustered(spark, sf_dir):
    return km.assign_clusters(ft.rename_label(susy_split(spark, sf_dir)), SUSY_FEATURES, CENTERS)


@query("assign_clusters", f"with {CLUSTERED_SQL} select {KEYS_SQL}, prediction from cl")
def _assign(spark, sf_dir):
    return clustered(spark, sf_dir).select(*SUSY_KEYS, "prediction")


# --- principal components ------------------------------------------------------------------------

# Squarings of a matrix before its leading vector is read off: its eigenvalues are taken to the power of 2 ** 20.
SQUARINGS = 20


def eigen_sql(k: int) -> str:
    """Leading ``k`` eigenvectors of the symmetric matrix that ``g0(m)`` holds as a list of rows, run to convergence:
    repeated squaring, read the vector off, deflate. Gives ``tot(trace)`` and ``sg(component, lam, ratio, cumulative, v)``
    with the entry of largest magnitude positive."""
    turns = SQUARINGS + 1
    diagonal = "list_transform({m}, lambda r, i: r[i])"
    return f"""tot as materialized (select list_sum({diagonal.format(m="m")}) as trace from g0),
eg(step, b, p, v, lam) as (
  select 0, m, list_transform(m, lambda r: list_transform(r, lambda z: z / trace)), cast(null as double[]),
         cast(null as double) from g0, tot
  union all
  select step + 1, coalesce(nb, b), list_transform(x, lambda r: list_transform(r, lambda z: z / greatest(t, 1e-300))), nv, nl
  from (select *, list_max({diagonal.format(m="x")}) as t
  from (select *, coalesce(q, nb) as x
  from (select *, case when q is null then list_transform(b, lambda r, i:
                    list_transform(r, lambda z, j: z - nl * nv[i] * nv[j])) end as nb
  from (select *, case when q is null then
                    list_dot_product(nv, list_transform(b, lambda r: list_dot_product(r, nv))) end as nl
  from (select *, case when q is null then list_transform(c, lambda z: z / sqrt(list_dot_product(c, c))) end as nv
  from (select step, b, p, case when step % {turns} < {SQUARINGS} then
                    list_transform(p, lambda r: list_transform(p, lambda s: list_dot_product(r, s))) end as q,
               p[list_position({diagonal.format(m="p")}, list_max({diagonal.format(m="p")}))] as c
        from eg where step < {k * turns}))))))),
es as materialized (select cast(step // {turns} - 1 as integer) as component, lam,
                           list_position(list_transform(v, lambda z: abs(z)),
                                         list_max(list_transform(v, lambda z: abs(z)))) as top, v from eg where v is not null),
sg as materialized (
  select component, lam, lam / trace as ratio, sum(lam) over (order by component) / trace as cumulative,
         list_transform(v, lambda z: z * sign(v[top])) as v from es, tot)"""


def _narrow_matrix_sql(cell: str, rows: str) -> str:
    """``g0`` of the four features from any two-column aggregate."""
    return "g0 as materialized (select [" + ", ".join(
        "[" + ", ".join(cell.format(x=f'"{a}"', y=f'"{b}"') for b in SUSY_FEATURES) + "]" for a in SUSY_FEATURES) + f"] as m from {rows})"


def _wide_matrix_sql(cell: str) -> str:
    """``g0`` of the embeddings in ``u(vec_id, x, d)``."""
    return f"""cells as (select a.d as i, b.d as j, {cell} as g from u a join u b using (vec_id) group by 1, 2),
g0 as materialized (select list(r order by i) as m from (select i, list(g order by j) as r from cells group by 1))"""


EMB_SQL = """u as materialized (
  select vec_id, cast(unnest(embedding) as double) as x, unnest(range(len(embedding))) as d from embeddings)"""
LOADINGS_SQL = """select component, cast(unnest(range(len(v))) as integer) as dim, round(unnest(v), 5) + 0 as loading,
       round(ratio, 9) as ratio, round(cumulative, 9) as cumulative from sg"""
N_NARROW, N_WIDE = len(SUSY_FEATURES), 10

PCA_SQL = f"with recursive {SPLIT_SQL}, " + _narrow_matrix_sql("covar_samp({x}, {y})", "sp where split = 'train'") \
    + f", {eigen_sql(N_NARROW)}"
PCA_WIDE_SQL = f"with recursive {EMB_SQL}, {_wide_matrix_sql('covar_samp(a.x, b.x)')}, {eigen_sql(N_WIDE)}"


def _loadings(spark, vectors, ratios):
    return pca.component_table(spark, vectors, ratios).select(
        "component", "dim", F.round("loading", 5).alias("loading"),
        F.round("ratio", 9).alias("ratio"), F.round("cumulative", 9).alias("cumulative"))


def _pca_model(spark, sf_dir):
    """All four features, as many components."""
    train, test = susy_vectors(spark, sf_dir, SUSY_FEATURES)
    return pca.fit_pca(train, N_NARROW), test


@query("fit_pca", f"{PCA_SQL} {LOADINGS_SQL}")
def _fit_pca(spark, sf_dir):
    model, _ = _pca_model(spark, sf_dir)
    return _loadings(spark, model.pc.toArray(), model.explainedVariance.toArray())


@query("fit_pca_wide", f"{PCA_WIDE_SQL} {LOADINGS_SQL}")
def _fit_pca_wide(spark, sf_dir):
    model = pca.fit_pca(emb(spark, sf_dir), N_WIDE)
    return _loadings(spark, model.pc.toArray(), model.explainedVariance.toArray())


@query("fit_components_wide", f"{PCA_WIDE_SQL} {LOADINGS_SQL}")
def _fit_components_wide(spark, sf_dir):
    vectors, ratios = pca.fit_components(emb(spark, sf_dir), "features", N_WIDE)
    return _loadings(spark, vectors, ratios)


@query("pca_explained_variance", f"""{PCA_SQL}
select component, round(ratio, 9) as ratio, round(cumulative, 9) as cumulative from sg""")
def _variance(spark, sf_dir):
    model, _ = _pca_model(spark, sf_dir)
    return pca.variance_table(spark, model.explainedVariance.toArray().tolist()).select(
        "component", F.round("ratio", 9).alias("ratio"), F.round("cumulative", 9).alias("cumulative"))


@query("project_pca", f"""{PCA_SQL}, w as (
  select {", ".join(f"any_value(v) filter (where component = {c}) as v{c}" for c in range(N_NARROW))} from sg)
select {KEYS_SQL}, """ + ", ".join("round(" + " + ".join(
    f'"{f}" * v{c}[{i + 1}]' for i, f in enumerate(SUSY_FEATURES)) + f", 6) + 0 as pc{c}" for c in range(N_NARROW))
    + " from sp, w where split = 'test'")
def _project(spark, sf_dir):
    model, test = _pca_model(spark, sf_dir)
    projected = pca.project(test, SUSY_FEATURES, pca.fix_signs(model.pc.toArray()))
    return projected.select(*SUSY_KEYS, *[(F.round(f"pc{c}", 6) + F.lit(0.0)).alias(f"pc{c}") for c in range(N_NARROW)])


@query("project_pca_wide", f"""{PCA_WIDE_SQL}
select vec_id, component, round(list_dot_product(cast(embedding as double[]), v), 6) + 0 as value from embeddings, sg""")
def _project_wide(spark, sf_dir):
    rows = emb(spark, sf_dir)
    model = pca.fit_pca(rows, N_WIDE)
    plain = model.pc.toArray()
    signs = np.sign((pca.fix_signs(plain) * plain).sum(axis=0))
    values = vector_to_array("pca_features")
    scored = model.transform(rows).select("vec_id", F.posexplode(F.array(
        *[values[c] * F.lit(float(signs[c])) for c in range(N_WIDE)])).alias("component", "value"))
    return scored.withColumn("value", F.round("value", 6) + F.lit(0.0))


def _matrix_sql(cell: str, out: str, digits: int) -> str:
    return f"with {SUSY_SQL} " + " union all ".join(
        f"select cast({i} as integer) as i, cast({j} as integer) as j, round("
        + cell.format(x=f'"{a}"', y=f'"{b}"') + f", {digits}) as {out} from susy"
        for i, a in enumerate(SUSY_FEATURES) for j, b in enumerate(SUSY_FEATURES))


@query("covariance_matrix", _matrix_sql("covar_samp({x}, {y})", "cov", 9))
def _covariance(spark, sf_dir):
    return pca.covariance_matrix(susy(spark, sf_dir), SUSY_FEATURES).withColumn(
        "cov", F.round("cov", 9))


@query("covariance_matrix_wide", """with u as (
  select vec_id, cast(unnest(embedding) as double) as x, unnest(range(len(embedding))) as d
  from embeddings)
select cast(a.d as integer) as i, cast(b.d as integer) as j, round(covar_samp(a.x, b.x), 9) + 0 as cov
from u a join u b using (vec_id) group by 1, 2""")
def _covariance_wide(spark, sf_dir):
    return pca.covariance_table(emb(spark, sf_dir)).withColumn("cov", F.round("cov", 9) + F.lit(0.0))


@query("gram_matrix", _matrix_sql("sum({x} * {y})", "gram", 4))
def _gram(spark, sf_dir):
    return pca.gram_matrix(susy(spark, sf_dir), SUSY_FEATURES).withColumn("gram", F.round("gram", 4))


UNCENTERED_SQL = f"with recursive {MISSING_SQL}, " + _narrow_matrix_sql("sum({x} * {y})", "im") + f", {eigen_sql(N_NARROW)}"


def _uncentered(spark, sf_dir):
    return pca.fit_pca_uncentered(with_missing(spark, sf_dir), SUSY_FEATURES, k=N_NARROW)


@query("fit_pca_uncentered", f"{UNCENTERED_SQL} {LOADINGS_SQL}")
def _fit_uncentered(spark, sf_dir):
    return _loadings(spark, *_uncentered(spark, sf_dir))


@query("pca_cumulative_importance", f"""{UNCENTERED_SQL}
select component + 1 as k, round(cumulative, 9) as cumulative from sg""")
def _importance(spark, sf_dir):
    _, ratios = _uncentered(spark, sf_dir)
    return pca.variance_table(spark, ratios.tolist()).select(
        (F.col("component") + 1).alias("k"), F.round("cumulative", 9).alias("cumulative"))


# Every 17th number is missing.
HOLES_SQL = """u as materialized (
  select vec_id, d, coalesce(x, avg(x) over (partition by d)) as x
  from (select vec_id, d, case when (vec_id + d) % 17 = 0 then null else x end as x
        from (select vec_id, cast(unnest(embedding) as double) as x, unnest(range(len(embedding))) as d from embeddings)))"""


@query("fit_pca_uncentered_wide", f"with recursive {HOLES_SQL}, {_wide_matrix_sql('sum(a.x * b.x)')}, "
       f"{eigen_sql(N_WIDE)} {LOADINGS_SQL}")
def _uncentered_wide(spark, sf_dir):
    holes = F.transform(vector_to_array("features"), lambda x, d: F.when(
        (F.col("vec_id") + d) % 17 == 0, F.lit(float("nan"))).otherwise(x))
    rows = emb(spark, sf_dir).select(array_to_vector(holes).alias("features"))
    return _loadings(spark, *pca.fit_pca_uncentered_vectors(rows, k=N_WIDE))


@query("pca_k_sweep", f"""with recursive {EMB_SQL}, {_wide_matrix_sql('covar_samp(a.x, b.x)')}, {eigen_sql(max(pca.SWEEP))}
select component + 1 as k, true as ok, cast(null as varchar) as error, round(cumulative, 9) as explained
from sg where component + 1 in {pca.SWEEP}""")
def _sweep(spark, sf_dir):
    return pca.pca_k_sweep(emb(spark, sf_dir)).withColumn("explained", F.round("explained", 9))


# --- all models ----------------------------------------------------------------------------------

_EXACT = {"max_iter": 200, "tol": 1e-12}
_HITS_SQL = f"select round(avg(case when ({MARGIN_SQL} > 0) = (target = 1) then 1.0 else 0.0 end), 9) from sp, nw where split = '{{}}'"


def _suite_row(ord_: int, model: str, train: str = "null", test: str = "null", ok: bool = True) -> str:
    return (f"select cast({ord_} as integer) as ord, '{model}' as model, {str(ok).lower()} as ok, {str(not ok).lower()} as failed, "
            f"cast(({train}) as double) as train_metric, cast(({test}) as double) as test_metric")


def _suite(found):
    return found.select("ord", "model", "ok", F.col("error").isNotNull().alias("failed"),
                        F.round("train_metric", 9).alias("train_metric"), F.round("test_metric", 9).alias("test_metric"))


# Ten components don't fit four features: that model fails, the others don't.
@query("fit_all_models", " union all ".join([
    _suite_row(0, "kmeans"),
    _suite_row(1, "logistic_regression", f"with {NEWTON_SQL} {_HITS_SQL.format('train')}", f"with {NEWTON_SQL} {_HITS_SQL.format('test')}"),
    _suite_row(2, "pca", ok=False),
    _suite_row(3, "mlp", test=f"with {SIGMOID_SQL} {SIGMOID_HITS}")]))
def _all(spark, sf_dir):
    train, test = (side.select("label", "features") for side in susy_vectors(spark, sf_dir, SUSY_FEATURES))
    models = suite.default_models(len(SUSY_FEATURES), SEED, k_pca=10, logistic=_EXACT, network=SIGMOID)
    return _suite(suite.fit_all_models(train, test, models))


# The second library fits on four fifths of the train side; the rest of it is for validation only.
FIT_SIDE = f"split = 'train' and {VAL_HASH_SQL} < 0.8"
FIT_SQL, _, FIT_LOSSES, FIT_HITS = _learn_sql("tanh", FIT_SIDE)


@query("fit_all_models_second", " union all ".join([
    _suite_row(0, "kmeans"),
    _suite_row(1, "logistic_regression", test=f"with {_newton_sql(FIT_SIDE)} {_HITS_SQL.format('test')}"),
    _suite_row(2, "pca", f"with recursive {SPLIT_SQL}, " + _narrow_matrix_sql("sum({x} * {y})", f"sp where {FIT_SIDE}")
               + f", {eigen_sql(2)} select round(max(cumulative), 9) from sg"),
    _suite_row(3, "mlp", f"with {FIT_SQL} select round(loss, 9) from f{LEARN_STEPS}", f"with {FIT_SQL} {FIT_HITS}"),
    _suite_row(4, "pca_10", ok=False)]))
def _all_second(spark, sf_dir):
    rows = ft.rename_label(train_val_split(susy_table(spark, sf_dir), "split_key", 0.8)).select(
        "label", "split_key", *[F.col(f"`{f}`") for f in SUSY_FEATURES], "split")
    train, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    models = suite.second_models(SUSY_FEATURES, "split_key", k_pca=2, network=TANH)
    models["pca_10"] = suite.second_models(SUSY_FEATURES, "split_key", k_pca=10)["pca"]
    return _suite(suite.fit_all_models(train, test, models))
