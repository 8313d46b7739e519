"""Fits, samples and files proved by what SQL can state: closed forms, brute force over all
rows, and properties that every right result has."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import plots, reduce, sampling
from tabloom.operators.knn_impute import impute_knn
from tabloom.plans import training
from tabloom.plans.models import FittedModel
from tabloom.plans.prepare import prepare
from tabloom.plans.sql import run_select
from tabloom.queries.common import LABELLED_SQL, QueryMap, embedding_dims, embedding_sql, labelled_documents, rounded, table
from tabloom.queries.models import LINE_KEY
from tabloom.session import scratch_path
from tabloom.sources import readers, writers
from tabloom.streaming import jobs

LINE_SQL = ", ".join(LINE_KEY)
HELD = "l_orderkey % 5 = 0"
NUMBERS = ["l_quantity", "l_discount", "l_tax"]
WIDE = 64
COMPONENTS = [f"e{i}" for i in range(WIDE)]
SIZES = ["n_chars", "text_len", "n_spaces"]


def _lines(spark, sf, *extra):
    return table(spark, sf, "lineitem").select(*LINE_KEY, *NUMBERS, *extra, (F.col("l_extendedprice") / 1000).alias("price_k"))


def _price(algorithm, *extra, **params):
    def run(spark, sf):
        found = training.fit_model(_lines(spark, sf, *extra), algorithm, "price_k", params, LINE_KEY, held_out=HELD).metrics
        return rounded(found, 3)

    return run


def _scores(spark, sf):
    """Fit, store, load and apply: a prediction for every line."""
    df = _lines(spark, sf)
    path = scratch_path(spark, "model")
    training.fit_model(df, "LinearRegression", "price_k", key=LINE_KEY, held_out=HELD).model.save(spark, path)
    return training.score(FittedModel.load(spark, path), df).select(*LINE_KEY, F.round("Prediction", 5).alias("prediction"))


def _score_stream(spark, sf):
    """The same predictions for the lines arriving in several files and batches."""
    df = _lines(spark, sf)
    model = training.fit_model(df, "LinearRegression", "price_k", key=LINE_KEY, held_out=HELD).model
    arrivals, out = scratch_path(spark, "arrivals"), scratch_path(spark, "scored")
    df.repartition(6, *LINE_KEY).write.parquet(arrivals)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(arrivals)
    query = jobs.score_stream(model, stream, out, scratch_path(spark, "s"), available_now=True)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"stream failed: {query.exception()}")
    return spark.read.parquet(out).select(*LINE_KEY, F.round("Prediction", 5).alias("prediction"))


def _knn_classes(spark, sf):
    df = embedding_dims(spark, sf, WIDE, "vec_id", "label").withColumn("label", F.concat(F.lit("c"), "label"))
    fit = training.fit_model(df, "KNeighborsClassifier", "label", key=["vec_id"], held_out="vec_id % 5 = 0")
    return fit.confusion.where("n > 0")


def _knn_value(spark, sf):
    df = embedding_dims(spark, sf, WIDE, "vec_id")
    fit = training.fit_model(df, "KNeighborsRegressor", "e0", {"weights": "distance"}, ["vec_id"], held_out="vec_id % 5 = 0")
    return rounded(fit.metrics, 3)


def _trace(spark, sf):
    """Sum and sum of squares of all variances along the principal axes."""
    found = reduce.pca_variance(embedding_dims(spark, sf, WIDE), COMPONENTS)
    sums = found.agg(F.sum("variance").alias("total"), F.sum(F.col("variance") * F.col("variance")).alias("squares"), F.sum("ratio").alias("ratio"))
    return rounded(sums, 6)


def _whitened(spark, sf):
    df = embedding_dims(spark, sf, WIDE)
    out = prepare(df, {"data_reduction": ["ica"]}, COMPONENTS).df
    return reduce.covariance_long(out, out.columns).select(
        F.dense_rank().over(_by("col_a")).cast("bigint").alias("a"), F.dense_rank().over(_by("col_b")).cast("bigint").alias("b"),
        (F.round(F.abs("cov"), 2) + 0.0).alias("cov"),
    )


def _by(column):
    from pyspark.sql import Window

    return Window.orderBy(column)  # one row per pair of components


def _within(spark, sf):
    """Covariance of the discriminants inside the classes: each has one, no two share any."""
    df = embedding_dims(spark, sf, WIDE, "label")
    out = prepare(df, {"data_reduction": ["lda"]}, COMPONENTS, target="label").df
    names = [c for c in out.columns if c != "label"]
    middle = out.groupBy("label").agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    inside = out.join(F.broadcast(middle), "label").select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])
    classes, rows = middle.count(), out.count()
    found = reduce.covariance_long(inside, names)
    at = {c: i + 1 for i, c in enumerate(names)}
    place = F.create_map(*[F.lit(v) for pair in at.items() for v in pair])
    value = F.round(F.abs(F.col("cov") * (rows - 1) / (rows - classes)), 6)
    return found.select(place[F.col("col_a")].cast("bigint").alias("a"), place[F.col("col_b")].cast("bigint").alias("b"), value.alias("cov"))


def _smote(spark, sf):
    """New rows lie between old ones, which all stay: the extremes of a class do not move."""
    out = prepare(labelled_documents(spark, sf), {"imbalanced_data": ["smote"]}, SIZES, target="quality").df
    return out.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in SIZES for k, f in (("low", F.min), ("high", F.max))]
    )


def _knn_fill(spark, sf):
    df = embedding_dims(spark, sf, WIDE, "vec_id").withColumn("e0", F.when(F.col("vec_id") % 7 != 0, F.col("e0")))
    df = df.withColumn("vec_id", F.col("vec_id").cast("string"))
    return rounded(impute_knn(df).withColumn("vec_id", F.col("vec_id").cast("bigint")), 6)


def _sample(spark, sf):
    df = table(spark, sf, "lineitem")
    taken = sampling.sample_cap(df, key=LINE_KEY)
    known = taken.join(df.select(*LINE_KEY, F.lit(1).alias("known")).dropDuplicates(LINE_KEY), LINE_KEY, "left")
    return known.agg(F.count(F.lit(1)).alias("rows"), F.count("known").alias("known"))


def _split(spark, sf):
    """How the sides of a split cover the orders."""
    train, test = sampling.train_test_split(table(spark, sf, "orders"), key=["o_orderkey"])
    both = train.select("o_orderkey", F.lit(0).alias("held")).unionByName(test.select("o_orderkey", F.lit(1).alias("held")))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"),
        F.round(F.avg("held"), 1).alias("share"),
    )


def _scatter(spark, sf):
    """Every point of the plot, with its number of lines, is one of the table."""
    df = table(spark, sf, "lineitem")
    points = plots.scatter_points(df, "l_extendedprice", "l_quantity", key=LINE_KEY)
    known = df.select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.lit(1).alias("known")).distinct()
    return points.join(known, ["x", "y"], "left").agg(F.count(F.lit(1)).alias("points"), F.count("known").alias("known"))


def _power(name, column, key, method):
    def run(spark, sf):
        df = table(spark, sf, name).select(*key, column)
        return rounded(prepare(df, {"transformations": [method]}, [column]).df, 2, column)  # a power is found to about 1e-7

    return run


def _csv_glob(spark, sf):
    path = scratch_path(spark, "files")
    for status in ("F", "O", "P"):
        writers.save(table(spark, sf, "orders").where(F.col("o_orderstatus") == status), f"{path}/{status}.csv", "csv")
    return run_select(spark, f"{path}/*.csv", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS total FROM TABLE WHERE o_totalprice > 1000")


def _sniffed(spark, sf):
    """A folder whose name tells no format."""
    path = scratch_path(spark, "unnamed")
    writers.save(table(spark, sf, "part"), path, "csv")
    return readers.load(spark, path)


def _header(spark, sf):
    path = scratch_path(spark, "head")
    writers.save(table(spark, sf, "customer"), path, "csv")
    names = readers.header(spark, path)
    return spark.read.text(path).limit(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("at", "name"))


def _published(spark, sf):
    where = writers.publish(table(spark, sf, "customer"), scratch_path(spark, "store"), "customers of the year", owner="o1")
    return readers.load(spark, where)


def _report_tables(spark, sf):
    """The confusion matrix of a fit, written with the other tables of its report."""
    df = embedding_dims(spark, sf, WIDE, "vec_id", "label").withColumn("label", F.concat(F.lit("c"), "label"))
    fit = training.fit_model(df, "KNeighborsClassifier", "label", key=["vec_id"], held_out="vec_id % 5 = 0")
    paths = writers.save_report(fit.tables(), scratch_path(spark, "report"))
    return spark.read.parquet(paths["confusion_matrix"]).groupBy("actual").agg(F.sum("n").alias("n")).where("n > 0")


QUERIES: QueryMap = {
    "fit_linear_metrics": _price("LinearRegression", "l_returnflag"),
    "fit_ridge_metrics": _price("Ridge", "l_returnflag", alpha=10.0),
    "score_lines": _scores,
    "stream_score_batches": _score_stream,
    "fit_knn_confusion": _knn_classes,
    "fit_knn_metrics": _knn_value,
    "pca_trace": _trace,
    "ica_whitened": _whitened,
    "discriminant_within": _within,
    "smote_ranges": _smote,
    "impute_knn_vectors": _knn_fill,
    "sample_cap_members": _sample,
    "train_test_cover": _split,
    "scatter_members": _scatter,
    "tx_yeojohnson_best": _power("customer", "c_acctbal", ["c_custkey"], "yeojohnson"),
    "tx_boxcox_best": _power("lineitem", "l_extendedprice", LINE_KEY, "boxcox"),
    "csv_glob_select": _csv_glob,
    "sniffed_csv": _sniffed,
    "csv_header": _header,
    "published": _published,
    "report_tables": _report_tables,
}


def _residuals(features: list[str], ridge: float | None = None) -> str:
    """CTEs that end in ``fit(keys, y, t, r)``: residuals of least squares over the rows that are
    not held out, by making the features orthogonal one after the other. A ridge is as many
    extra rows with its root on the diagonal."""
    n = len(features)
    on = "FILTER (WHERE NOT t) OVER ()"
    parts = [
        f"base AS (SELECT {LINE_SQL}, {HELD} AS t, l_extendedprice / 1000 AS y, "
        + ", ".join(f"CAST({f} AS DOUBLE) AS f{i}" for i, f in enumerate(features))
        + " FROM lineitem)"
    ]
    wide = f"stddev_pop(f{{i}}) {on}" if ridge else "1.0"
    centred = [
        f"(f{i} - avg(f{i}) {on})" + (f" / {wide.format(i=i)}" if ridge and i < len(NUMBERS) else "") + f" AS g{i}" for i in range(n)
    ]
    first = f"SELECT {LINE_SQL}, true AS own, t, y, y - avg(y) {on} AS r, {', '.join(centred)} FROM base"
    if ridge:
        for k in range(n):
            cells = ", ".join(f"{ridge ** 0.5 if i == k else 0.0!r}::DOUBLE" for i in range(n))
            first += f" UNION ALL SELECT {', '.join('NULL' for _ in LINE_KEY)}, false, false, 0.0, 0.0, {cells}"
    parts.append(f"s0 AS ({first})")
    for k in range(n):
        away = lambda c: f"{c} - sum({c} * g{k}) {on} / sum(g{k} * g{k}) {on} * g{k} AS {c}"  # noqa: E731, B023
        rest = "".join(", " + away(f"g{j}") for j in range(k + 1, n))
        parts.append(f"s{k + 1} AS (SELECT {LINE_SQL}, own, t, y, {away('r')}{rest} FROM s{k})")
    parts.append(f"fit AS (SELECT {LINE_SQL}, t, y, r FROM s{n} WHERE own)")
    return "WITH " + ", ".join(parts)


def _errors(source: str, width: int) -> str:
    """The regression metrics of rows (y, r) with actual value and residual."""
    values = {
        "r2_score": "r2", "adjusted_r2": f"1 - (1 - r2) * (n - 1) / (n - {width} - 1)", "mae": "mae", "mse": "mse", "rmse": "sqrt(mse)",
        "median_absolute_error": "med", "max_error": "worst", "explained_variance": "1 - ve / vy", "residual_mean": "me",
        "residual_std": "sqrt(ve)", "mape": "100 * mape", "pearson_correlation": "rho",
    }
    rows = " UNION ALL ".join(f"SELECT '{k}' AS metric, round(round({v}, 4), 3) AS value FROM z" for k, v in values.items())
    return f""", z AS (SELECT *, 1 - sse / (vy * n) AS r2 FROM (SELECT count(*) AS n, sum(r * r) AS sse, avg(abs(r)) AS mae, avg(r * r) AS mse,
      quantile_cont(abs(r), 0.5) AS med, max(abs(r)) AS worst, var_pop(r) AS ve, var_pop(y) AS vy, avg(r) AS me,
      avg(abs(r) / greatest(abs(y), 2.220446049250313e-16)) AS mape, corr(y, y - r) AS rho FROM {source})) {rows}"""


FLAGS = [f"l_returnflag = '{f}'" for f in "ANR"]
_PREDICTED = _residuals(NUMBERS) + f" SELECT {LINE_SQL}, round(y - r, 5) AS prediction FROM fit"


def _nearest(value: str, columns: list[str]) -> str:
    """CTEs that end in ``near(q, y, v, d, k)``: the five nearest learned rows of every held-out row
    over standardised columns."""
    z = ", ".join(f"({c} - avg({c}) FILTER (WHERE NOT t) OVER ()) / stddev_pop({c}) FILTER (WHERE NOT t) OVER ()" for c in columns)
    return f"""WITH s AS (SELECT vec_id, t, {value} AS v, [{z}] AS x FROM (SELECT *, vec_id % 5 = 0 AS t FROM {embedding_sql(WIDE, 'vec_id', 'label')})),
    pairs AS (SELECT a.vec_id AS q, a.v AS y, b.v, list_distance(a.x, b.x) AS d, b.vec_id AS id FROM s a, s b WHERE a.t AND NOT b.t),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS k FROM pairs) WHERE k <= 5)"""


_VOTES = (
    _nearest("label", COMPONENTS)
    + """, votes AS (SELECT q, y, v, count(*) AS c FROM near GROUP BY ALL),
    said AS (SELECT q, y, v FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, v) AS k FROM votes) WHERE k = 1) """
)


def _best_power(name: str, column: str, key: str, form: str, jacobian: str) -> str:
    """Ever finer grids around the power of the largest likelihood, then mean 0 and variance 1."""
    parts, step, around = [f"x AS (SELECT {key}, {column} AS x FROM {name})"], 0.5, "0.0"
    for i in range(10):
        parts.append(f"g{i} AS (SELECT {around} + {step!r} * k AS l FROM range(-10, 11) t(k))")
        parts.append(
            f"b{i} AS (SELECT l FROM (SELECT l, -count(*) / 2.0 * ln(var_pop({form})) + (l - 1) * sum({jacobian}) AS s FROM x, g{i} GROUP BY l) ORDER BY s DESC LIMIT 1)"
        )
        around, step = f"(SELECT l FROM b{i})", step / 5
    parts.append(f"p AS (SELECT {key}, {form} AS v FROM x, (SELECT l FROM b9))")
    return f"WITH {', '.join(parts)} SELECT {key}, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 2) AS {column} FROM p"


def _unit(size: str) -> str:
    return f"SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cov FROM range(1, {size} + 1) s(a), range(1, {size} + 1) t(b)"


ORACLES = {
    "fit_linear_metrics": _residuals(NUMBERS + FLAGS[:2]) + _errors("(FROM fit WHERE t)", len(NUMBERS + FLAGS)),
    "fit_ridge_metrics": _residuals(NUMBERS + FLAGS, 10.0) + _errors("(FROM fit WHERE t)", len(NUMBERS + FLAGS)),
    "score_lines": _PREDICTED,
    "stream_score_batches": _PREDICTED,
    "fit_knn_confusion": _VOTES + "SELECT 'c' || y AS actual, 'c' || v AS predicted, count(*) AS n FROM said GROUP BY ALL",
    "fit_knn_metrics": _nearest("e0", COMPONENTS[1:])
    + ", fit AS (SELECT q, any_value(y) AS y, any_value(y) - sum(v / d) / sum(1 / d) AS r FROM near GROUP BY q)"
    + _errors("fit", WIDE - 1),
    "pca_trace": f"SELECT round(list_sum([{', '.join(f'var_samp({c})' for c in COMPONENTS)}]), 6) AS total, round(list_sum(["
    + ", ".join(f"{1 if a == b else 2} * power(covar_samp({a}, {b}), 2)" for i, a in enumerate(COMPONENTS) for b in COMPONENTS[i:])
    + f"]), 6) AS squares, 1.0::DOUBLE AS ratio FROM {embedding_sql(WIDE)}",
    "ica_whitened": _unit("(SELECT len(embedding) - 1 FROM embeddings LIMIT 1)"),
    "discriminant_within": _unit("(SELECT count(DISTINCT label) - 1 FROM embeddings)"),
    "smote_ranges": "SELECT quality, max(count(*)) OVER () AS n, "
    + ", ".join(f"min({c}) AS low_{c}, max({c}) AS high_{c}" for c in SIZES)
    + f" FROM {LABELLED_SQL} GROUP BY quality",
    "impute_knn_vectors": f"""WITH s AS (SELECT *, vec_id % 7 = 0 AS gap FROM {embedding_sql(WIDE, 'vec_id')}),
      x AS (SELECT vec_id, gap, e0, [{', '.join(COMPONENTS[1:])}] AS v FROM s),
      near AS (SELECT a.vec_id, b.e0, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v)) AS k
        FROM x a, x b WHERE a.gap AND NOT b.gap),
      fill AS (SELECT vec_id, avg(e0) AS v FROM near WHERE k <= 5 GROUP BY vec_id)
      SELECT vec_id, round(CASE WHEN gap THEN v ELSE e0 END, 6) AS e0, {', '.join(f'round(e{i}, 6) AS e{i}' for i in range(1, WIDE))}
      FROM s LEFT JOIN fill USING (vec_id)""",
    "sample_cap_members": "SELECT least(count(*), 10000) AS rows, least(count(*), 10000) AS known FROM lineitem",
    "train_test_cover": "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, 0.2::DOUBLE AS share FROM orders",
    "scatter_members": "SELECT least(count(*), 2000) AS points, least(count(*), 2000) AS known FROM lineitem",
    "tx_yeojohnson_best": _best_power(
        "customer", "c_acctbal", "c_custkey",
        """CASE WHEN x >= 0 THEN CASE WHEN abs(l) < 1e-12 THEN ln(1 + x) ELSE (pow(x + 1, l) - 1) / l END
          ELSE CASE WHEN abs(l - 2) < 1e-12 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - l) - 1) / (2 - l) END END""",
        "sign(x) * ln(1 + abs(x))",
    ),
    "tx_boxcox_best": _best_power(
        "lineitem", "l_extendedprice", LINE_SQL, "CASE WHEN abs(l) < 1e-12 THEN ln(x) ELSE (pow(x, l) - 1) / l END", "ln(x)"
    ),
    "csv_glob_select": "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders WHERE o_totalprice > 1000",
    "sniffed_csv": "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part",
    "csv_header": "SELECT CAST(column_index - 1 AS INTEGER) AS at, column_name AS name FROM duckdb_columns() WHERE table_name = 'customer'",
    "published": "SELECT * FROM customer",
    "report_tables": "SELECT 'c' || label AS actual, count(*) AS n FROM embeddings WHERE vec_id % 5 = 0 GROUP BY label",
}
