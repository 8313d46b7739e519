"""Fitted models proved by what SQL can state: closed forms over all subsets or all cuts, and the
conditions that only an optimum meets, judged on the rows learned from."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.errors import PrepareError, TrainError
from tabloom.operators import metrics
from tabloom.plans import training
from tabloom.plans.features import FEATURES
from tabloom.plans.prepare import prepare
from tabloom.queries.common import LABELLED_SQL, QueryMap, embedding_dims, embedding_sql, labelled_documents, rounded, table
from tabloom.queries.models import LINE_KEY
from tabloom.queries.proofs import COMPONENTS, HELD, LINE_SQL, NUMBERS, WIDE, _errors, _lines
from tabloom.session import scratch_path
from tabloom.sources import writers

SIZES = ["n_chars", "text_len", "n_spaces"]
DOC_HELD = "doc_id % 5 = 0"
FLIPPED = ["less", "l_discount", "l_tax"]


def _nonnegative(spark, sf):
    """The quantity enters with its sign turned, so its coefficient must stop at zero."""
    df = _lines(spark, sf).withColumn("less", -F.col("l_quantity")).drop("l_quantity")
    df = df.select(*LINE_KEY, *FLIPPED, "price_k")
    found = training.fit_model(df, "LinearRegression", "price_k", {"positive": True}, LINE_KEY, held_out=HELD).metrics
    return rounded(found, 3)


def _tree(spark, sf):
    """What a tree of depth two says about every line, held out or not."""
    df = _lines(spark, sf)
    fit = training.fit_model(df, "DecisionTreeRegressor", "price_k", {"max_depth": 2}, LINE_KEY, held_out=HELD)
    return training.score(fit.model, df).select(*LINE_KEY, F.round("Prediction", 6).alias("prediction"))


def _json_scores(spark, sf):
    """Predictions for lines that arrive as JSON records."""
    df = _lines(spark, sf)
    model = training.fit_model(df, "LinearRegression", "price_k", key=LINE_KEY, held_out=HELD).model
    path = scratch_path(spark, "records")
    writers.save(df.drop("price_k"), path, "json")
    out = training.score_json(model, spark, path, df.drop("price_k").schema)
    return out.select(*LINE_KEY, F.round("Prediction", 5).alias("prediction"))


def _docs(spark, sf) -> DataFrame:
    return labelled_documents(spark, sf).select("doc_id", *SIZES, "quality")


def _learned_rows(fit, df: DataFrame, held: str) -> DataFrame:
    return fit.model.featurize(training.with_label(df.where(f"NOT ({held})"), fit.model.target, fit.model.classes))


def _logistic(spark, sf):
    """Slopes of the penalised loss at the fitted coefficients: all zero at the optimum."""
    df = _docs(spark, sf)
    fit = training.fit_model(df, "LogisticRegression", "quality", {"max_iter": 1000}, ["doc_id"], held_out=DOC_HELD)
    rows = fit.model.model.transform(_learned_rows(fit, df, DOC_HELD))
    error = F.get(vector_to_array("probability"), F.lit(1)) - F.col("_label")
    weights = fit.model.model.coefficients.toArray().tolist()
    x = vector_to_array(FEATURES)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("s"), *[F.sum(error * F.get(x, F.lit(i))).alias(f"s{i}") for i in range(len(weights))])
    slopes = [F.struct(F.lit("intercept").alias("term"), (F.col("s") / F.col("n")).alias("v"))]
    slopes += [F.struct(F.lit(c).alias("term"), ((F.col(f"s{i}") + w) / F.col("n")).alias("v")) for i, (c, w) in enumerate(zip(SIZES, weights))]
    return sums.select(F.explode(F.array(*slopes)).alias("t")).select("t.term", (F.round(F.abs("t.v"), 4) + 0.0).alias("slope"))


def _lasso(spark, sf):
    """Per feature, how far the slope of the squared loss is from what the penalty allows."""
    df = _lines(spark, sf)
    fit = training.fit_model(df, "Lasso", "price_k", {"alpha": 0.5}, LINE_KEY, held_out=HELD)
    model, weights = fit.model.model, fit.model.model.coefficients.toArray().tolist()
    rows = model.transform(_learned_rows(fit, df, HELD))
    x, left = vector_to_array(FEATURES), F.col("_label") - F.col("prediction")
    sums = rows.agg(F.avg(left).alias("s"), *[F.avg(left * F.get(x, F.lit(i))).alias(f"s{i}") for i in range(len(weights))])
    excess = [F.struct(F.lit("intercept").alias("term"), F.abs("s").alias("v"))]
    for i, (c, w) in enumerate(zip(NUMBERS, weights)):
        slope = F.col(f"s{i}")
        gap = F.greatest(F.abs(slope) - 0.5, F.lit(0.0)) if w == 0 else F.abs(slope - (0.5 if w > 0 else -0.5))
        excess.append(F.struct(F.lit(c).alias("term"), gap.alias("v")))
    return sums.select(F.explode(F.array(*excess)).alias("t")).select("t.term", (F.round("t.v", 3) + 0.0).alias("excess"))


def _clusters(spark, sf):
    """Rows that are nearer to another centre than to their own, and how far any centre is from the mean of
    its rows."""
    df = embedding_dims(spark, sf, WIDE, "vec_id")
    fit = training.fit_model(df, "KMeans", None, {"n_clusters": 10, "tol": 0.0}, ["vec_id"], held_out="vec_id % 5 = 0")
    centres = [c.tolist() for c in fit.model.model.clusterCenters()]
    rows = fit.model.model.transform(fit.model.featurize(df.where("vec_id % 5 <> 0"))).select(vector_to_array(FEATURES).alias("x"), "prediction")

    def apart(c):
        return F.aggregate(F.zip_with("x", F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    gaps = rows.withColumn("gaps", F.array(*[apart(c) for c in centres]))
    wrong = F.count_if(F.get("gaps", F.col("prediction")) > F.array_min("gaps") + 1e-9)
    means = rows.groupBy("prediction").agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(WIDE)])
    off = F.greatest(
        *[F.abs(F.col(f"m{i}") - F.get(F.array(*[F.lit(c[i]) for c in centres]), F.col("prediction"))) for i in range(WIDE)]
    )
    one = gaps.agg(F.count(F.lit(1)).alias("rows"), wrong.alias("wrong"))
    return one.crossJoin(means.agg(F.count(F.lit(1)).alias("clusters"), (F.round(F.max(off), 4) + 0.0).alias("off")))


def _support_vectors(spark, sf):
    """Optimality of the dual over all rows learned from: rows on the wrong side without a multiplier, free
    ones off the margin, and the balance of the multipliers."""
    df = _docs(spark, sf)
    fit = training.fit_model(df, "SVC", "quality", {"C": 2.0}, ["doc_id"], held_out=DOC_HELD)
    machine = fit.model.model
    rows = machine.margins(_learned_rows(fit, df, DOC_HELD)).select(
        vector_to_array(FEATURES).alias("x"), F.when(F.col("_label") == 0, 1.0).otherwise(-1.0).alias("y"), F.get("_margins", F.lit(0)).alias("f")
    )
    # rows of one feature vector and label share their multipliers
    held = machine.table.groupBy("x").agg(F.sum(F.get("coefs", F.lit(0))).alias("a"))
    met = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.first("f").alias("f")).join(held, "x", "left")
    both = met.groupBy("x").agg(F.count(F.lit(1)).alias("sides"))
    pure = met.join(both.where("sides = 1"), "x").withColumn("a", F.coalesce(F.abs("a"), F.lit(0.0)))
    edge = F.col("y") * F.col("f")
    outside = F.count_if((F.col("a") == 0) & (edge < 1 - 0.01))
    loose = F.count_if((F.col("a") > 1e-6) & (F.col("a") < 2 * F.col("n") - 1e-6) & (F.abs(edge - 1) > 0.01))
    full = F.count_if((F.col("a") >= 2 * F.col("n") - 1e-9) & (edge > 1 + 0.01))
    rows_of = rows.agg(F.count(F.lit(1)).alias("rows"))
    total = machine.table.agg((F.round(F.abs(F.sum(F.get("coefs", F.lit(0)))), 6) + 0.0).alias("balance"))
    return rows_of.crossJoin(pure.agg(outside.alias("outside"), loose.alias("loose"), full.alias("above"))).crossJoin(total)


def _tube(spark, sf):
    """The same for a regression: rows inside the tube have no multiplier, rows outside the largest."""
    df = _docs(spark, sf).select("doc_id", "n_chars", "text_len", "n_spaces")
    df = df.withColumn("n_spaces", F.log1p("n_spaces"))
    fit = training.fit_model(df, "SVR", "n_spaces", {"C": 1.0, "epsilon": 0.2}, ["doc_id"], held_out=DOC_HELD)
    machine = fit.model.model
    rows = machine.margins(_learned_rows(fit, df, DOC_HELD)).select(
        vector_to_array(FEATURES).alias("x"), (F.col("_label") - F.get("_margins", F.lit(0))).alias("left")
    )
    # copies of one row and its value share their multipliers
    held = machine.table.groupBy("x").agg(F.sum(F.get("coefs", F.lit(0))).alias("a"))
    met = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("left").alias("low"), F.max("left").alias("high"))
    met = met.join(held, "x", "left").withColumn("a", F.coalesce("a", F.lit(0.0))).where("high - low < 1e-9")
    inside = F.count_if((F.abs("low") < 0.2 - 0.01) & (F.abs("a") > 1e-6))
    outside = F.count_if((F.abs("low") > 0.2 + 0.01) & (F.abs("a") < F.col("n") - 1e-6))
    total = machine.table.agg((F.round(F.abs(F.sum(F.get("coefs", F.lit(0)))), 6) + 0.0).alias("balance"))
    return rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(met.agg(inside.alias("inside"), outside.alias("outside"))).crossJoin(total)


def _facts(spark, sf):
    """What a report says about the models themselves."""
    df = _docs(spark, sf)
    tree = training.fit_model(df, "DecisionTree", "quality", {"max_depth": 2}, ["doc_id"], held_out=DOC_HELD)
    forest = training.fit_model(df, "RandomForest", "quality", {"n_estimators": 7, "max_depth": 3}, ["doc_id"], held_out=DOC_HELD)
    facts = tree.metrics.where("metric = 'tree_depth'").unionByName(forest.metrics.where("metric = 'n_estimators'"))
    return facts.select("metric", "value")


def _compared(spark, sf):
    """Every classifier is there, has a score and an area, and the best of them leads the board."""
    df = labelled_documents(spark, sf).drop("toxic").select("doc_id", *SIZES, "lang", "quality")
    found, curves = training.compare_models(df, "quality", ["doc_id"])
    board = metrics.leaderboard(found)
    best = board.agg(F.max("accuracy").alias("top")).first()["top"]
    return board.select(
        "model", F.col("error").isNull().alias("fitted"), F.col("accuracy").between(0, 1).alias("scored"), F.col("roc_auc").isNotNull().alias("area"),
        F.col("model").isin(list(curves)).alias("curve"), (F.col("is_best") <= (F.col("accuracy") == best)).alias("led"),
    )


def _board(spark, sf):
    """Order priorities ranked like models, by the share of urgent handling."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("accuracy")
    )
    return metrics.leaderboard(orders).withColumn("rank", F.col("rank").cast("bigint"))


def _refusals(spark, sf):
    """The step and operation named by the errors of requests that the table does not allow."""
    df = table(spark, sf, "customer").select("c_acctbal", "c_mktsegment", "c_nationkey")
    asked = {
        "encode numbers": ({"encoding": ["onehot"]}, ["c_acctbal"], None),
        "label numbers": ({"encoding": ["label"]}, ["c_nationkey"], None),
        "target without one": ({"encoding": ["target"]}, ["c_mktsegment"], None),
        "outliers of text": ({"outliers": ["iqr"]}, ["c_mktsegment"], None),
        "scale text": ({"scaling": ["standard"]}, ["c_mktsegment"], None),
        "discriminants without target": ({"data_reduction": ["lda"]}, ["c_acctbal", "c_nationkey"], None),
        "unknown step": ({"polish": ["hard"]}, ["c_acctbal"], None),
        "nothing": ({}, ["c_acctbal"], None),
    }
    rows = []
    for case, (operations, attributes, target) in asked.items():
        try:
            prepare(df, operations, attributes, target)
            rows.append((case, "none", "none"))
        except PrepareError as e:
            rows.append((case, e.step, e.op or "-"))
    try:
        training.fit_model(df, "LinearRegression", "c_mktsegment")
        rows.append(("regress on text", "none", "none"))
    except TrainError:
        rows.append(("regress on text", "train", "-"))
    return spark.createDataFrame(rows, "request string, step string, op string")


QUERIES: QueryMap = {
    "fit_nonnegative_metrics": _nonnegative,
    "fit_tree_splits": _tree,
    "score_json_lines": _json_scores,
    "fit_logistic_slopes": _logistic,
    "fit_lasso_slopes": _lasso,
    "fit_kmeans_fixed_point": _clusters,
    "fit_svc_conditions": _support_vectors,
    "fit_svr_conditions": _tube,
    "model_facts": _facts,
    "compare_models_board": _compared,
    "leaderboard_orders": _board,
    "refusals": _refusals,
}


def _nonnegative_sql() -> str:
    """Of the least squares over every subset of the features, the best without a negative coefficient."""
    f = ["f0", "f1", "f2"]
    on = "FILTER (WHERE NOT t)"
    sums = [f"covar_pop({a}, {b}) {on} AS g{i}{j}" for i, a in enumerate(f) for j, b in enumerate(f)]
    sums += [f"covar_pop({a}, y) {on} AS c{i}" for i, a in enumerate(f)] + [f"avg({a}) {on} AS m{i}" for i, a in enumerate(f)] + [f"avg(y) {on} AS my"]
    rows = ["SELECT 0.0 AS w0, 0.0 AS w1, 0.0 AS w2 FROM s"]
    for size in (1, 2, 3):
        for some in combinations(range(3), size):
            w = dict.fromkeys(range(3), "0.0")
            if size == 1:
                (i,) = some
                w[i] = f"c{i} / g{i}{i}"
            elif size == 2:
                i, j = some
                det = f"(g{i}{i} * g{j}{j} - g{i}{j} * g{i}{j})"
                w[i], w[j] = f"(c{i} * g{j}{j} - c{j} * g{i}{j}) / {det}", f"(c{j} * g{i}{i} - c{i} * g{i}{j}) / {det}"
            else:
                det3 = lambda a: f"({a[0]} * ({a[4]} * {a[8]} - {a[5]} * {a[7]}) - {a[1]} * ({a[3]} * {a[8]} - {a[5]} * {a[6]}) + {a[2]} * ({a[3]} * {a[7]} - {a[4]} * {a[6]}))"
                whole = [f"g{i}{j}" for i in range(3) for j in range(3)]
                for k in range(3):
                    part = list(whole)
                    for i in range(3):
                        part[3 * i + k] = f"c{i}"
                    w[k] = f"{det3(part)} / {det3(whole)}"
            rows.append(f"SELECT {', '.join(f'{w[k]} AS w{k}' for k in range(3))} FROM s")
    loss = " + ".join(f"w{i} * g{i}{j} * w{j}" for i in range(3) for j in range(3)) + "".join(f" - 2 * w{i} * c{i}" for i in range(3))
    return f"""WITH base AS (SELECT {HELD} AS t, l_extendedprice / 1000 AS y, -CAST(l_quantity AS DOUBLE) AS f0, l_discount AS f1, l_tax AS f2 FROM lineitem),
    s AS (SELECT {', '.join(sums)} FROM base), w AS ({' UNION ALL '.join(rows)}),
    best AS (SELECT w0, w1, w2, my - w0 * m0 - w1 * m1 - w2 * m2 AS b FROM w, s WHERE least(w0, w1, w2) >= 0 ORDER BY {loss} LIMIT 1),
    fit AS (SELECT t, y, y - (b + w0 * f0 + w1 * f1 + w2 * f2) AS r FROM base, best)""" + _errors("(FROM fit WHERE t)", 3)


def _tree_sql(depth: int = 2) -> str:
    """All cuts between values of every feature, level by level: the one of least squared error per node."""
    cells = ", ".join(f"CAST({c} AS DOUBLE)" for c in NUMBERS)
    parts = [f"n0 AS (SELECT {LINE_SQL}, {HELD} AS t, l_extendedprice / 1000 AS y, [{cells}] AS x, 1 AS node FROM lineitem)"]
    for d in range(depth):
        parts.append(f"""v{d} AS (SELECT node, j, v, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM (
          SELECT node, y, unnest(x) AS v, unnest([1, 2, 3]) AS j FROM n{d} WHERE NOT t) GROUP BY node, j, v)""")
        over = "OVER (PARTITION BY node, j ORDER BY v)"
        parts.append(f"""u{d} AS (SELECT node, j, (v + lead(v) {over}) / 2 AS cut, sum(n) {over} AS n, sum(s) {over} AS s, sum(q) {over} AS q,
          sum(n) OVER w AS an, sum(s) OVER w AS sa, sum(q) OVER w AS qa FROM v{d} WINDOW w AS (PARTITION BY node, j))""")
        parts.append(f"""k{d} AS (SELECT node, j, cut FROM (SELECT *, row_number() OVER (PARTITION BY node
          ORDER BY (q - s * s / n) + ((qa - q) - (sa - s) * (sa - s) / (an - n)), j, cut) AS place FROM u{d} WHERE cut IS NOT NULL) WHERE place = 1)""")
        parts.append(f"n{d + 1} AS (SELECT a.* REPLACE (CASE WHEN x[j] <= cut THEN 2 * a.node ELSE 2 * a.node + 1 END AS node) FROM n{d} a JOIN k{d} k ON k.node = a.node)")
    return f"""WITH {', '.join(parts)}, leaf AS (SELECT node, avg(y) AS p FROM n{depth} WHERE NOT t GROUP BY node)
      SELECT {LINE_SQL}, round(p, 6) AS prediction FROM n{depth} JOIN leaf USING (node)"""


def _zeros(column: str, terms: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS term, 0.0::DOUBLE AS {column}" for t in ["intercept", *terms])


_LEARNED = f"(SELECT count(*) FROM {LABELLED_SQL} WHERE NOT ({DOC_HELD}))"

ORACLES = {
    "fit_nonnegative_metrics": _nonnegative_sql(),
    "fit_tree_splits": _tree_sql(),
    "fit_logistic_slopes": _zeros("slope", SIZES),
    "fit_lasso_slopes": _zeros("excess", NUMBERS),
    "fit_kmeans_fixed_point": f"""SELECT count(*) AS rows, 0::BIGINT AS wrong, 10::BIGINT AS clusters, 0.0::DOUBLE AS "off"
      FROM {embedding_sql(1, 'vec_id')} WHERE vec_id % 5 <> 0""",
    "fit_svc_conditions": f"SELECT {_LEARNED} AS rows, 0::BIGINT AS outside, 0::BIGINT AS loose, 0::BIGINT AS above, 0.0::DOUBLE AS balance",
    "fit_svr_conditions": f"SELECT {_LEARNED} AS rows, 0::BIGINT AS inside, 0::BIGINT AS outside, 0.0::DOUBLE AS balance",
    "model_facts": "SELECT 'tree_depth' AS metric, 2.0::DOUBLE AS value UNION ALL SELECT 'n_estimators', 7.0",
    "compare_models_board": """SELECT unnest(['Logistic Regression', 'Decision Tree', 'Random Forest', 'KNN Classifier', 'SVC']) AS model,
      true AS fitted, true AS scored, true AS area, true AS curve, true AS led""",
    "leaderboard_orders": """SELECT model, accuracy, "rank", "rank" = 1 AS is_best FROM (SELECT *, row_number() OVER (ORDER BY accuracy DESC, model) AS "rank"
      FROM (SELECT o_orderpriority AS model, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM orders GROUP BY 1))""",
    "refusals": """SELECT * FROM (VALUES ('encode numbers', 'encoding', 'onehot'), ('label numbers', 'encoding', 'label'),
      ('target without one', 'encoding', 'target'), ('outliers of text', 'outliers', 'iqr'), ('scale text', 'scaling', '-'),
      ('discriminants without target', 'data_reduction', 'lda'), ('unknown step', 'polish', 'hard'), ('nothing', 'request', '-'),
      ('regress on text', 'train', '-')) v(request, step, op)""",
}


def _predicted() -> str:
    from tabloom.queries.proofs import ORACLES as proofs

    return proofs["score_lines"]


ORACLES["score_json_lines"] = _predicted()
