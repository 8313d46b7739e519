"""Preparation steps, one query per operation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import reduce, select
from tabloom.operators.knn_impute import impute_knn
from tabloom.operators.transform import fit_power
from tabloom.plans.prepare import prepare
from tabloom.queries.common import (
    LABELLED_SQL,
    LINEITEM_NUMBERS,
    LINEITEM_X,
    ORDERS_X,
    QueryMap,
    embedding_dims,
    embedding_sql,
    labelled_documents,
    lineitem_x,
    orders_x,
    rounded,
    table,
)
from tabloom.types import column_kinds

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_SQL = ", ".join(KEYS)
NUMS = LINEITEM_NUMBERS


def _on_lineitem(columns, operations, digits=6, values=None):
    """Prepare the given lineitem columns and keep the key beside them."""

    def run(spark, sf):
        df = lineitem_x(spark, sf).select(*KEYS, *columns)
        return rounded(prepare(df, operations, columns, values=values).df, digits, *columns)

    return run


def _on_orders(columns, operations, digits=6, target=None, extra=()):
    def run(spark, sf):
        df = orders_x(spark, sf).select("o_orderkey", *columns, *extra)
        out = prepare(df, operations, columns, target=target).df
        return rounded(out, digits, *[f.name for f in out.schema.fields if f.name in columns and f.dataType.simpleString() == "double"])

    return run


def _acctbal(operations, digits=6):
    def run(spark, sf):
        df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
        return rounded(prepare(df, operations, ["c_acctbal"]).df, digits)

    return run


def _fixed_power(method, lam):
    def run(spark, sf):
        df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
        return rounded(fit_power(df, ["c_acctbal"], method, {"c_acctbal": lam}).apply(df), 6)

    return run


def _column_kinds(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("flag", F.col("l_tax") > 0).withColumn("list", F.array("l_tax"))
    return spark.createDataFrame(list(column_kinds(df).items()), "column_name string, kind string")


def _knn_fill(spark, sf):
    """Customers with every seventh balance missing; two more numbers to measure by."""
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal_n",
        "CAST(c_nationkey AS DOUBLE) AS nation", "CAST(length(c_name) AS DOUBLE) AS name_len",
    )
    numbers = ["bal_n", "nation", "name_len"]
    filled = impute_knn(df.select(*numbers, F.col("c_custkey").cast("string").alias("key")))
    return rounded(filled, 6)


def _smote_counts(spark, sf):
    df = labelled_documents(spark, sf)
    ops = {"imbalanced_data": ["smote"]}
    out = prepare(df, ops, ["n_chars", "text_len", "n_spaces"], target="quality").df
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


def _smote_rows(spark, sf):
    df = labelled_documents(spark, sf)
    return prepare(df, {"imbalanced_data": ["smote"]}, ["n_chars", "text_len", "n_spaces"], target="toxic").df


def _near_copies(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        *KEYS, "l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net",
        "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross", "l_discount",
    )


NEAR = ["l_quantity", "l_extendedprice", "net", "gross", "l_discount"]


def _drop_correlated(spark, sf):
    out = prepare(_near_copies(spark, sf), {"feature_selection": ["correlation_threshold"]}, NEAR).df
    return rounded(out, 6)


def _kbest(spark, sf):
    df = lineitem_x(spark, sf).select(*KEYS, *NUMS, "l_returnflag")
    return prepare(df, {"feature_selection": ["kbest"]}, NUMS, target="l_returnflag").df


def _end_to_end(spark, sf):
    df = lineitem_x(spark, sf).select(*KEYS, "price_n", "qty_o")
    ops = {"scaling": ["standard"], "missing_values": ["median"], "outliers": ["iqr"]}
    return rounded(prepare(df, ops, ["price_n", "qty_o"]).df, 6)


def _end_to_end_encoded(spark, sf):
    df = orders_x(spark, sf).select("o_orderkey", "prio_n", "o_orderstatus")
    ops = {"missing_values": ["mode"], "encoding": ["freq"], "scaling": ["minmax"], "transformations": ["log"]}
    return rounded(prepare(df, ops, ["prio_n", "o_orderstatus"]).df, 6)


def _step_log(spark, sf):
    df = lineitem_x(spark, sf).select(*KEYS, "price_n")
    ops = {"scaling": ["standard"], "missing_values": ["mean"]}
    return prepare(df, ops, ["price_n"]).step_log.drop("ts")


DIMS = 6
E_COLS = [f"e{i}" for i in range(DIMS)]


def _reduced(op, target=None):
    def run(spark, sf):
        df = embedding_dims(spark, sf, DIMS, "vec_id", "label")
        return rounded(prepare(df, {"data_reduction": [op]}, E_COLS, target=target).df, 6)

    return run


def _wide_pca(spark, sf):
    df = embedding_dims(spark, sf, 64, "vec_id")
    return rounded(prepare(df, {"data_reduction": ["pca"]}, [f"e{i}" for i in range(64)]).df, 6)


QUERIES: QueryMap = {
    "drop_attr": lambda s, d: prepare(table(s, d, "part"), {"drop_columns": ["drop_attr"]}, ["p_size", "p_type"]).df,
    "column_kinds": _column_kinds,
    "drop_rows": _on_lineitem(["price_n", "l_tax"], {"missing_values": ["drop_rows"]}),
    "impute_mean": _on_lineitem(["price_n", "l_tax"], {"missing_values": ["mean"]}, 4),
    "impute_median": _on_lineitem(["price_n", "l_tax"], {"missing_values": ["median"]}, 4),
    "impute_mode": _on_orders(["prio_n"], {"missing_values": ["mode"]}),
    "impute_constant": lambda s, d: prepare(
        orders_x(s, d).select("o_orderkey", "prio_n"), {"missing_values": ["constant"]}, ["prio_n"], values={"prio_n": "missing"}
    ).df,
    "impute_knn": _knn_fill,
    "outlier_iqr_clip": _on_lineitem(["qty_o", "price_n"], {"outliers": ["iqr"]}, 4),
    "outlier_zscore_clip": _on_lineitem(["qty_o", "price_n"], {"outliers": ["zscore"]}, 4),
    "outlier_replace_mean": _on_lineitem(["qty_o", "price_n"], {"outliers": ["replace_mean"]}, 4),
    "outlier_replace_median": _on_lineitem(["qty_o", "price_n"], {"outliers": ["replace_median"]}, 4),
    "outlier_replace_mode": _on_lineitem(["qty_o"], {"outliers": ["replace_mode"]}, 4),
    "outlier_replace_constant": _on_lineitem(["qty_o"], {"outliers": ["replace_constant"]}, 4, values={"qty_o": -1.0}),
    "onehot": _on_orders(["prio_n", "o_orderstatus"], {"encoding": ["onehot"]}),
    "label_encode": _on_orders(["prio_n", "o_orderstatus"], {"encoding": ["label"]}),
    "target_encode": _on_orders(["prio_n"], {"encoding": ["target"]}, 4, target="o_totalprice", extra=["o_totalprice"]),
    "freq_encode": _on_orders(["prio_n"], {"encoding": ["freq"]}),
    "ordinal_encode": _on_orders(["prio_n"], {"encoding": ["ordinal"]}),
    "label_encode_wide": lambda s, d: prepare(
        table(s, d, "customer").select("c_custkey", "c_name"), {"encoding": ["label"]}, ["c_name"]
    ).df,
    "scale_minmax": _on_lineitem(["l_extendedprice", "l_tax"], {"scaling": ["minmax"]}),
    "scale_standard": _on_lineitem(["l_extendedprice", "l_tax"], {"scaling": ["zscore_scale"]}),
    "scale_robust": _on_lineitem(["l_extendedprice", "l_tax"], {"scaling": ["robust"]}),
    "scale_maxabs": _on_lineitem(["l_extendedprice", "l_tax"], {"scaling": ["maxabs"]}),
    "tx_log": _acctbal({"transformations": ["log"]}),
    "tx_sqrt": _acctbal({"transformations": ["sqrt"]}),
    "tx_reciprocal": _on_lineitem(["l_discount", "price_n"], {"transformations": ["reciprocal"]}, 8),
    "tx_yeojohnson": _acctbal({"transformations": ["yeojohnson"]}),
    "tx_boxcox": _on_lineitem(["l_extendedprice"], {"transformations": ["boxcox"]}),
    "tx_yeojohnson_lambda": _fixed_power("yeojohnson", 0.8),
    "tx_boxcox_lambda": _fixed_power("boxcox", 0.5),
    "tx_binning": _on_lineitem(["l_extendedprice", "l_discount"], {"transformations": ["binning"]}),
    "select_low_variance": lambda s, d: rounded(select.variance_scores(lineitem_x(s, d), NUMS + ["konst"]), 2),
    "anova_f": lambda s, d: rounded(select.anova_f(lineitem_x(s, d), NUMS, "l_returnflag"), 6),
    "f_regression": lambda s, d: rounded(select.f_regression(lineitem_x(s, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 4),
    "chi2_scores": lambda s, d: rounded(select.chi2_scores(lineitem_x(s, d), NUMS, "l_returnflag"), 4),
    "select_correlation": _drop_correlated,
    "select_kbest": _kbest,
    "select_chi2": lambda s, d: prepare(
        lineitem_x(s, d).select(*KEYS, *NUMS, "l_returnflag"), {"feature_selection": ["chi2"]}, NUMS, target="l_returnflag"
    ).df,
    "drop_low_variance": lambda s, d: prepare(
        lineitem_x(s, d).select(*KEYS, "l_quantity", "l_discount", "konst"),
        {"feature_selection": ["low_variance"]},
        ["l_quantity", "l_discount", "konst"],
    ).df,
    "tree_importance": lambda s, d: rounded(
        select.tree_importance(labelled_documents(s, d), ["n_chars", "text_len", "n_spaces"], "quality", trees=20), 6
    ),
    "covariance": lambda s, d: rounded(reduce.covariance_long(embedding_dims(s, d, DIMS), E_COLS), 6),
    "pca_variance": lambda s, d: rounded(reduce.pca_variance(embedding_dims(s, d, DIMS), E_COLS), 6),
    "pca": _reduced("pca"),
    "pca_wide": _wide_pca,
    "discriminant": _reduced("lda", "label"),
    "ica": _reduced("ica"),
    "smote_class_counts": _smote_counts,
    "smote": _smote_rows,
    "prepare_end_to_end": _end_to_end,
    "prepare_encoded": _end_to_end_encoded,
    "prepare_step_log": _step_log,
}


def _lineitem_sql(stats: str, *exprs: str) -> str:
    return f"SELECT {KEY_SQL}, {', '.join(exprs)} FROM {LINEITEM_X}" + (f", (SELECT {stats} FROM {LINEITEM_X}) AS st" if stats else "")


def _q(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


def _fence_stats(c: str) -> str:
    return f"{_q(c, 0.25)} - 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)}) AS {c}_lo, {_q(c, 0.75)} + 1.5 * ({_q(c, 0.75)} - {_q(c, 0.25)}) AS {c}_hi"


def _replaced(value: str, c: str) -> str:
    return f"round(CASE WHEN {c} < {c}_lo OR {c} > {c}_hi OR {c} IS NULL THEN {value} ELSE {c} END, 4) AS {c}"


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM {LINEITEM_X} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _clip_sql(c: str) -> str:
    return f"round(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_hi), {c}_lo) END, 4) AS {c}"


_PRICE_QTY = ["qty_o", "price_n"]
_FENCES = ", ".join(_fence_stats(c) for c in _PRICE_QTY)
_Z = ", ".join(f"avg({c}) - 3 * stddev_samp({c}) AS {c}_lo, avg({c}) + 3 * stddev_samp({c}) AS {c}_hi" for c in _PRICE_QTY)


def _scaled(centre: str, width: str) -> str:
    cols = ["l_extendedprice", "l_tax"]
    stats = ", ".join(f"{centre.replace('{c}', c)} AS {c}_m, {width.replace('{c}', c)} AS {c}_w" for c in cols)
    return _lineitem_sql(stats, *[f"round(({c} - {c}_m) / {c}_w, 6) AS {c}" for c in cols])


def _power_sql(expr: str) -> str:
    return f"""WITH p AS (SELECT c_custkey, {expr} AS v FROM customer)
    SELECT c_custkey, round((v - m) / s, 6) AS c_acctbal FROM p, (SELECT avg(v) AS m, stddev_pop(v) AS s FROM p)"""


def _bin_sql(c: str) -> str:
    edges = [f"CAST({c} > (SELECT round({_q(c, p)}, 10) FROM lineitem) AS INT)" for p in (0.2, 0.4, 0.6, 0.8)]
    return f"CAST({' + '.join(edges)} AS DOUBLE) AS {c}"


_ANOVA = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f_score
    FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) AS g FROM lineitem)"""
    for c in NUMS
)
_CHI2 = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(sum((o - e) * (o - e) / e), 4) AS chi2 FROM
    (SELECT sum({c}) AS o, count(*) * (SELECT sum({c}) / count(*) FROM lineitem) AS e FROM lineitem GROUP BY l_returnflag)"""
    for c in NUMS
)
_ONEHOT = [("prio_n", v) for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")] + [
    ("o_orderstatus", v) for v in ("O", "P")
]

ORACLES = {
    "drop_attr": "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part",
    "column_kinds": """SELECT * FROM (VALUES ('l_orderkey','numeric'),('l_partkey','numeric'),('l_suppkey','numeric'),
        ('l_linenumber','numeric'),('l_quantity','numeric'),('l_extendedprice','numeric'),('l_discount','numeric'),('l_tax','numeric'),
        ('l_returnflag','categorical'),('l_linestatus','categorical'),('l_shipdate','datetime'),('flag','boolean'),('list','nested')) t(column_name, kind)""",
    "drop_rows": f"SELECT {KEY_SQL}, round(price_n, 6) AS price_n, round(l_tax, 6) AS l_tax FROM {LINEITEM_X} WHERE price_n IS NOT NULL",
    "impute_mean": _lineitem_sql("avg(price_n) AS m", "round(coalesce(price_n, m), 4) AS price_n", "round(l_tax, 4) AS l_tax"),
    "impute_median": _lineitem_sql(f"{_q('price_n', 0.5)} AS m", "round(coalesce(price_n, m), 4) AS price_n", "round(l_tax, 4) AS l_tax"),
    "impute_mode": f"""SELECT o_orderkey, coalesce(prio_n, (SELECT prio_n FROM {ORDERS_X} WHERE prio_n IS NOT NULL
        GROUP BY prio_n ORDER BY count(*) DESC, prio_n LIMIT 1)) AS prio_n FROM {ORDERS_X}""",
    "impute_constant": f"SELECT o_orderkey, coalesce(prio_n, 'missing') AS prio_n FROM {ORDERS_X}",
    "outlier_iqr_clip": _lineitem_sql(_FENCES, *[_clip_sql(c) for c in _PRICE_QTY]),
    "outlier_zscore_clip": _lineitem_sql(_Z, *[_clip_sql(c) for c in _PRICE_QTY]),
    "outlier_replace_mean": _lineitem_sql(
        _FENCES + ", avg(qty_o) AS qm, avg(price_n) AS pm", _replaced("qm", "qty_o"), _replaced("pm", "price_n")
    ),
    "outlier_replace_median": _lineitem_sql(
        _FENCES + f", {_q('qty_o', 0.5)} AS qm, {_q('price_n', 0.5)} AS pm", _replaced("qm", "qty_o"), _replaced("pm", "price_n")
    ),
    "outlier_replace_mode": _lineitem_sql(_FENCES, _replaced(_mode("qty_o"), "qty_o")),
    "outlier_replace_constant": _lineitem_sql(_FENCES, _replaced("-1.0", "qty_o")),
    "onehot": f"SELECT o_orderkey, "
    + ", ".join(f"CAST(coalesce({c} = '{v}', false) AS INT) AS \"{c}_{v}\"" for c, v in _ONEHOT)
    + f" FROM {ORDERS_X}",
    "label_encode": f"""SELECT o_orderkey, dense_rank() OVER (ORDER BY coalesce(prio_n, 'nan')) - 1 AS prio_n,
        dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus FROM {ORDERS_X}""",
    "label_encode_wide": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer",
    "target_encode": f"""SELECT o_orderkey, o_totalprice, round(coalesce(m, (SELECT avg(o_totalprice) FROM orders)), 4) AS prio_n
        FROM {ORDERS_X} o LEFT JOIN (SELECT prio_n AS k, avg(o_totalprice) AS m FROM {ORDERS_X} WHERE prio_n IS NOT NULL GROUP BY prio_n) s ON o.prio_n = s.k""",
    "freq_encode": f"""SELECT o_orderkey, round(coalesce(f, 0), 6) AS prio_n FROM {ORDERS_X} o LEFT JOIN
        (SELECT prio_n AS k, count(*) / (SELECT count(prio_n) FROM {ORDERS_X}) AS f FROM {ORDERS_X} WHERE prio_n IS NOT NULL GROUP BY prio_n) s ON o.prio_n = s.k""",
    "ordinal_encode": f"""SELECT o_orderkey, r AS prio_n FROM {ORDERS_X} o LEFT JOIN
        (SELECT prio_n AS k, dense_rank() OVER (ORDER BY prio_n) - 1 AS r FROM {ORDERS_X} WHERE prio_n IS NOT NULL GROUP BY prio_n) s ON o.prio_n = s.k""",
    "scale_minmax": _scaled("min({c})", "max({c}) - min({c})"),
    "scale_standard": _scaled("avg({c})", "stddev_pop({c})"),
    "scale_robust": _scaled("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "scale_maxabs": _scaled("0.0", "max(abs({c}))"),
    "tx_log": "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS c_acctbal FROM customer",
    "tx_sqrt": "SELECT c_custkey, round(sqrt(greatest(c_acctbal, 0)), 6) AS c_acctbal FROM customer",
    "tx_reciprocal": f"SELECT {KEY_SQL}, round(1 / nullif(l_discount, 0), 8) AS l_discount, round(1 / nullif(price_n, 0), 8) AS price_n FROM {LINEITEM_X}",
    "tx_yeojohnson_lambda": _power_sql(
        "CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.8) - 1) / 0.8 ELSE -(pow(1 - c_acctbal, 1.2) - 1) / 1.2 END"
    ),
    "tx_boxcox_lambda": _power_sql("(pow(greatest(c_acctbal, 0.000001), 0.5) - 1) / 0.5"),
    "tx_binning": f"SELECT {KEY_SQL}, {_bin_sql('l_extendedprice')}, {_bin_sql('l_discount')} FROM lineitem",
    "select_low_variance": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(var_pop({c}), 2) AS variance, 0.1::DOUBLE AS threshold, var_pop({c}) > 0.1 AS kept FROM {LINEITEM_X}"
        for c in NUMS + ["konst"]
    ),
    "anova_f": _ANOVA,
    "f_regression": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(r * r / (1 - r * r) * (n - 2), 4) AS f_score
        FROM (SELECT corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem)"""
        for c in ["l_quantity", "l_discount", "l_tax"]
    ),
    "chi2_scores": _CHI2,
    "select_correlation": f"""SELECT {KEY_SQL}, round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount,
        round(l_extendedprice, 6) AS l_extendedprice FROM lineitem""",
    "select_kbest": f"SELECT {KEY_SQL}, {', '.join(NUMS)}, l_returnflag FROM lineitem",
    "select_chi2": f"SELECT {KEY_SQL}, {', '.join(NUMS)}, l_returnflag FROM lineitem",
    "drop_low_variance": f"SELECT {KEY_SQL}, l_quantity FROM lineitem",
    "covariance": " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_samp({a}, {b}), 6) AS cov FROM {embedding_sql(DIMS)}"
        for a in E_COLS
        for b in E_COLS
    ),
    "smote_class_counts": f"""SELECT quality, (SELECT max(n) FROM (SELECT count(*) AS n FROM {LABELLED_SQL} GROUP BY quality)) AS n
        FROM {LABELLED_SQL} GROUP BY quality""",
    "prepare_end_to_end": f"""WITH a AS (SELECT {KEY_SQL}, coalesce(price_n, (SELECT {_q('price_n', 0.5)} FROM {LINEITEM_X})) AS price_n, qty_o FROM {LINEITEM_X}),
        f AS (SELECT {_FENCES} FROM a),
        b AS (SELECT {KEY_SQL}, greatest(least(price_n, price_n_hi), price_n_lo) AS price_n, greatest(least(qty_o, qty_o_hi), qty_o_lo) AS qty_o FROM a, f),
        s AS (SELECT avg(price_n) AS pm, stddev_pop(price_n) AS ps, avg(qty_o) AS qm, stddev_pop(qty_o) AS qs FROM b)
        SELECT {KEY_SQL}, round((price_n - pm) / ps, 6) AS price_n, round((qty_o - qm) / qs, 6) AS qty_o FROM b, s""",
    "prepare_encoded": f"""WITH a AS (SELECT o_orderkey, o_orderstatus, coalesce(prio_n, (SELECT prio_n FROM {ORDERS_X} WHERE prio_n IS NOT NULL
          GROUP BY prio_n ORDER BY count(*) DESC, prio_n LIMIT 1)) AS prio_n FROM {ORDERS_X}),
        p AS (SELECT prio_n AS k, count(*) / (SELECT count(*) FROM a) AS f FROM a GROUP BY 1),
        t AS (SELECT o_orderstatus AS k, count(*) / (SELECT count(*) FROM a) AS f FROM a GROUP BY 1)
        SELECT o_orderkey, round(ln(1 + (p.f - (SELECT min(f) FROM p)) / (SELECT max(f) - min(f) FROM p)), 6) AS prio_n,
          round(ln(1 + (t.f - (SELECT min(f) FROM t)) / (SELECT max(f) - min(f) FROM t)), 6) AS o_orderstatus
        FROM a JOIN p ON a.prio_n = p.k JOIN t ON a.o_orderstatus = t.k""",
    "prepare_step_log": "SELECT 'scaling' AS step_type, 'standard' AS op_name, ['price_n'] AS attributes UNION ALL SELECT 'missing_values', 'mean', ['price_n']",
}

