"""Registered correlation, collinearity and linear-model queries (COR1-6, VIF1-3, REG1-4, EXP3, linear CV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.operators import correlation as C
from tabscope.operators import factor as Q
from tabscope.operators import linear as L
from tabscope.operators import rows
from tabscope.operators.prepare import fold_of, split_flag
from tabscope.plans import oracle_sql as O
from tabscope.plans.common import rnd
from tabscope.plans.oracle_sql import r6
from tabscope.plans.registry import register
from tabscope.sources import fixtures
from tabscope.sources.tables import read_table

_V = O.with_views
SALES_NUM = ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gross"]
DEFECT_NUM = ["l_orderkey", "l_linenumber", "qty", "price", "discount"]


def _corr_sql(view: str, cols: list[str], by: list[str] | None = None, k: int = 6) -> str:
    by = by or []
    sel = "".join(f"{b}, " for b in by)
    grp = f" GROUP BY {', '.join(by)}" if by else ""
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            r = f"corr({a}, {b})"
            parts.append(
                f"SELECT {sel}{i} AS i, {j} AS j, '{a}' AS feature_a, '{b}' AS feature_b, "
                f"CAST(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n, "
                f"CASE WHEN isnan({r}) THEN NULL ELSE {r6(r, k)} END AS r FROM {view}{grp}")
    return " UNION ALL ".join(parts)


@register("corr_matrix", _V("v_sales") + " " + _corr_sql("v_sales", SALES_NUM))
def q_corr_matrix(spark, sf):
    return rnd(C.corr_long(fixtures.v_sales(spark, sf), SALES_NUM))


@register("corr_matrix_defect", _V("v_defect") + " " + _corr_sql("v_defect", DEFECT_NUM))
def q_corr_matrix_defect(spark, sf):
    return rnd(C.corr_long(fixtures.v_defect(spark, sf), DEFECT_NUM))


_BY_SUPP = ["l_quantity", "l_extendedprice", "net"]


@register("corr_by_supplier", _V("v_sales") + " " + _corr_sql("v_sales", _BY_SUPP, ["l_suppkey"]))
def q_corr_by_supplier(spark, sf):
    return rnd(C.corr_long(fixtures.v_sales(spark, sf).select("l_suppkey", *_BY_SUPP), _BY_SUPP, by=["l_suppkey"]))


def _pairs_cte(view, cols):
    return "pairs AS (" + _corr_sql(view, cols, k=12) + ")"


@register("target_corr", _V("v_sales") + ", " + _pairs_cte("v_sales", SALES_NUM) + f"""
  SELECT {r6('round(coalesce(avg(abs(r)), 0), 3)')} AS avg_correlation FROM pairs WHERE feature_a = 'gross' OR feature_b = 'gross'""")
def q_target_corr(spark, sf):
    corr = C.corr_long(fixtures.v_sales(spark, sf), SALES_NUM)
    return rnd(C.target_corr_mean(corr, "gross"))


@register("max_feature_corr", _V("v_sales") + ", " + _pairs_cte("v_sales", SALES_NUM) + f"""
  SELECT {r6('round(coalesce(max(abs(r)), 0), 3)')} AS max_correlation FROM pairs WHERE feature_a <> 'gross' AND feature_b <> 'gross'""")
def q_max_feature_corr(spark, sf):
    corr = C.corr_long(fixtures.v_sales(spark, sf), SALES_NUM)
    return rnd(C.max_feature_corr(corr, "gross"))


@register("weak_features", _V("v_sales") + ", " + _pairs_cte("v_sales", SALES_NUM) + """
  SELECT CAST(count(*) FILTER (WHERE coalesce(abs(r), 0) < 0.15) AS BIGINT) AS weak_features,
         CAST(count(*) AS BIGINT) AS predictor_count FROM pairs WHERE feature_a = 'gross' OR feature_b = 'gross'""")
def q_weak_features(spark, sf):
    corr = C.corr_long(fixtures.v_sales(spark, sf), SALES_NUM)
    return C.weak_features(corr, "gross")


@register("redundant_pairs", _V("v_sales") + ", " + _pairs_cte("v_sales", SALES_NUM) + f"""
  SELECT i, j, feature_a, feature_b, {r6('abs(r)')} AS correlation FROM pairs WHERE abs(r) > 0.85
  ORDER BY i, j LIMIT 10""")
def q_redundant_pairs(spark, sf):
    corr = C.corr_long(fixtures.v_sales(spark, sf), SALES_NUM)
    return rnd(C.redundant_pairs(corr))


@register("high_corr_pairs", _V("v_sales") + ", " + _pairs_cte("v_sales", SALES_NUM) + f"""
  SELECT feature_a, feature_b, {r6('r')} AS correlation FROM pairs WHERE abs(r) > 0.75""")
def q_high_corr_pairs(spark, sf):
    corr = C.corr_long(fixtures.v_sales(spark, sf), SALES_NUM)
    return rnd(C.high_corr_pairs(corr))


_VIF3 = ["net", "gross", "l_quantity"]


def _vif3_sql(centered: bool) -> str:
    a, b, c = _VIF3
    if centered:
        m = f"""SELECT 1.0 AS p, corr({a},{b}) AS q, corr({a},{c}) AS r, 1.0 AS s, corr({b},{c}) AS t, 1.0 AS u FROM v_sales"""
    else:
        m = f"""SELECT avg({a}*{a}) AS p, avg({a}*{b}) AS q, avg({a}*{c}) AS r, avg({b}*{b}) AS s, avg({b}*{c}) AS t,
                avg({c}*{c}) AS u FROM v_sales"""
    return _V("v_sales") + f""", g AS ({m}),
      d AS (SELECT *, p*(s*u - t*t) - q*(q*u - r*t) + r*(q*t - r*s) AS det FROM g)
      SELECT '{a}' AS feature, '{'std' if centered else 'raw'}' AS basis, {r6('p*(s*u - t*t)/det', 4)} AS vif FROM d
      UNION ALL SELECT '{b}', '{'std' if centered else 'raw'}', {r6('s*(p*u - r*r)/det', 4)} FROM d
      UNION ALL SELECT '{c}', '{'std' if centered else 'raw'}', {r6('u*(p*s - q*q)/det', 4)} FROM d"""


@register("vif_raw", _vif3_sql(False))
def q_vif_raw(spark, sf):
    return rnd(L.vif(fixtures.v_sales(spark, sf), _VIF3, basis="raw"), 4)


@register("vif_std", _vif3_sql(True))
def q_vif_std(spark, sf):
    return rnd(L.vif(fixtures.v_sales(spark, sf), _VIF3, basis="std"), 4)


@register("vif_pruned", _V("v_sales") + """, g AS (SELECT 1.0 AS p, corr(net,gross) AS q, corr(net,l_quantity) AS r, 1.0 AS s,
        corr(gross,l_quantity) AS t, 1.0 AS u FROM v_sales),
      d AS (SELECT *, p*(s*u - t*t) - q*(q*u - r*t) + r*(q*t - r*s) AS det FROM g),
      v AS (SELECT 'net' AS feature, p*(s*u - t*t)/det AS vif FROM d UNION ALL SELECT 'gross', s*(p*u - r*r)/det FROM d
            UNION ALL SELECT 'l_quantity', u*(p*s - q*q)/det FROM d),
      a AS (SELECT max(CASE WHEN vif <= 5 THEN 1 ELSE 0 END) AS anyk FROM v)
      SELECT feature, """ + r6("vif", 4) + """ AS vif, (vif <= 5) OR anyk = 0 AS kept,
             CASE WHEN anyk = 0 THEN 'none_below_threshold' WHEN vif <= 5 THEN 'kept' WHEN vif IS NULL THEN 'undefined'
                  ELSE 'above_threshold' END AS reason FROM v, a""")
def q_vif_pruned(spark, sf):
    return rnd(L.vif_prune(L.vif(fixtures.v_sales(spark, sf), _VIF3, basis="std")), 4)


LIN = ["l_quantity", "l_discount"]


def _analysis(spark, sf, by=None, feats=LIN):
    v = fixtures.v_linear(spark, sf)
    return L.linear_analysis(v, feats, "y", split_flag("l_orderkey", method="mod"), by=by or [])


# Closed-form 2-feature OLS on train rows (l_orderkey % 5 <> 0), scored on test rows.
_OLS2 = _V("v_linear") + """,
  tr AS (SELECT covar_pop(l_quantity, l_quantity) AS c11, covar_pop(l_discount, l_discount) AS c22,
                covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, y) AS c1y, covar_pop(l_discount, y) AS c2y,
                avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(y) AS my, count(*) AS n_train
         FROM v_linear WHERE l_orderkey % 5 <> 0),
  co AS (SELECT *, (c1y*c22 - c2y*c12) / (c11*c22 - c12*c12) AS b1, (c2y*c11 - c1y*c12) / (c11*c22 - c12*c12) AS b2 FROM tr),
  cf AS (SELECT *, my - b1*m1 - b2*m2 AS a FROM co),
  te AS (SELECT v.l_quantity AS x1, v.l_discount AS x2, v.y, v.y - (cf.a + cf.b1*v.l_quantity + cf.b2*v.l_discount) AS e
         FROM v_linear v, cf WHERE v.l_orderkey % 5 = 0),
  ts AS (SELECT count(*) AS n_test, sum(e*e) AS sse, sum((y - (SELECT avg(y) FROM te)) * (y - (SELECT avg(y) FROM te))) AS sst,
                avg(e) AS me FROM te)"""


@register("ols_holdout", _OLS2 + f"""
  SELECT CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, {r6('1 - sse / sst')} AS r2,
         {r6('sqrt(sse / n_test)')} AS rmse,
         CASE WHEN 1 - sse / sst < 0.2 THEN 'critical' WHEN 1 - sse / sst < 0.5 THEN 'warning' ELSE 'ok' END AS severity
  FROM cf, ts""")
def q_ols_holdout(spark, sf):
    return rnd(L.ols_holdout(_analysis(spark, sf)))


@register("ols_coeffs", _OLS2 + f"""
  SELECT 'l_quantity' AS feature, {r6('b1')} AS coef FROM cf UNION ALL SELECT 'l_discount', {r6('b2')} FROM cf
  UNION ALL SELECT '(intercept)', {r6('a')} FROM cf""")
def q_ols_coeffs(spark, sf):
    return rnd(L.ols_coefficients(_analysis(spark, sf)))


# All-rows fit for standardized importance: |b_j| * std_pop(x_j).
_ALL2 = _V("v_linear") + """,
  al AS (SELECT covar_pop(l_quantity, l_quantity) AS c11, covar_pop(l_discount, l_discount) AS c22,
                covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, y) AS c1y, covar_pop(l_discount, y) AS c2y
         FROM v_linear),
  ab AS (SELECT *, (c1y*c22 - c2y*c12) / (c11*c22 - c12*c12) AS b1, (c2y*c11 - c1y*c12) / (c11*c22 - c12*c12) AS b2 FROM al),
  imp AS (SELECT 'l_quantity' AS feature, 0 AS pos, abs(b1) * sqrt(c11) AS importance FROM ab
          UNION ALL SELECT 'l_discount', 1, abs(b2) * sqrt(c22) FROM ab)"""


@register("std_importance", _ALL2 + f"""
  SELECT 'standardized' AS kind, feature, {r6('importance')} AS importance,
         CAST(row_number() OVER (ORDER BY abs(importance) DESC, pos DESC) AS INTEGER) AS rank FROM imp""")
def q_std_importance(spark, sf):
    return rnd(L.importance(_analysis(spark, sf)).where(F.col("kind") == "standardized"))


@register("perm_importance", _OLS2 + f""",
  tm AS (SELECT covar_pop(x1, x1) AS v1, covar_pop(x2, x2) AS v2, covar_pop(e, x1) AS ce1, covar_pop(e, x2) AS ce2,
                var_pop(y) AS vy FROM te),
  pi AS (SELECT 'l_quantity' AS feature, 0 AS pos, (2*b1*ce1 + 2*b1*b1*v1) / vy AS importance FROM cf, tm
         UNION ALL SELECT 'l_discount', 1, (2*b2*ce2 + 2*b2*b2*v2) / vy FROM cf, tm)
  SELECT 'permutation' AS kind, feature, {r6('importance')} AS importance,
         CAST(row_number() OVER (ORDER BY abs(importance) DESC, pos DESC) AS INTEGER) AS rank FROM pi""")
def q_perm_importance(spark, sf):
    return rnd(L.importance(_analysis(spark, sf)).where(F.col("kind") == "permutation"))


@register("r2_band", _V("v_linear", "v_nonlin") + """,
  a AS (SELECT regr_r2(y, l_quantity) AS r2 FROM v_linear), b AS (SELECT regr_r2(y, l_quantity) AS r2 FROM v_nonlin),
  c AS (SELECT regr_r2(y, l_extendedprice) AS r2 FROM v_nonlin)
  SELECT 'linear' AS model, CASE WHEN r2 < 0.2 THEN 'critical' WHEN r2 < 0.5 THEN 'warning' ELSE 'ok' END AS severity FROM a
  UNION ALL SELECT 'nonlin_q', CASE WHEN r2 < 0.2 THEN 'critical' WHEN r2 < 0.5 THEN 'warning' ELSE 'ok' END FROM b
  UNION ALL SELECT 'nonlin_price', CASE WHEN r2 < 0.2 THEN 'critical' WHEN r2 < 0.5 THEN 'warning' ELSE 'ok' END FROM c""")
def q_r2_band(spark, sf):
    lin = fixtures.v_linear(spark, sf)
    non = fixtures.v_nonlin(spark, sf)
    rows = []
    for name, v, x in (("linear", lin, "l_quantity"), ("nonlin_q", non, "l_quantity"), ("nonlin_price", non, "l_extendedprice")):
        r2 = v.agg((F.corr(x, "y") * F.corr(x, "y")).alias("r2"))
        rows.append(r2.select(F.lit(name).alias("model"), L.r2_band(F.col("r2")).alias("severity")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("ols_by_supplier", _V("v_linear") + f""",
  tr AS (SELECT l_suppkey, regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a, count(*) AS n_train
         FROM v_linear WHERE l_orderkey % 5 <> 0 GROUP BY l_suppkey),
  te AS (SELECT v.l_suppkey, v.y, v.y - (tr.a + tr.b * v.l_quantity) AS e FROM v_linear v JOIN tr USING (l_suppkey)
         WHERE v.l_orderkey % 5 = 0),
  s AS (SELECT l_suppkey, count(*) AS n_test, sum(e*e) AS sse, var_pop(y) * count(*) AS sst FROM te GROUP BY l_suppkey)
  SELECT l_suppkey, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, {r6('1 - sse / sst')} AS r2,
         {r6('sqrt(sse / n_test)')} AS rmse,
         CASE WHEN 1 - sse / sst < 0.2 THEN 'critical' WHEN 1 - sse / sst < 0.5 THEN 'warning' ELSE 'ok' END AS severity
  FROM tr JOIN s USING (l_suppkey)""")
def q_ols_by_supplier(spark, sf):
    return rnd(L.ols_holdout(_analysis(spark, sf, by=["l_suppkey"], feats=["l_quantity"]), by=["l_suppkey"]))


@register("ols_cv", _V("v_linear") + f""",
  t AS (SELECT l_quantity AS x1, l_discount AS x2, y, CAST((l_orderkey // 5) % 5 AS INTEGER) AS fold
        FROM v_linear WHERE l_orderkey % 5 <> 0),
  f AS (SELECT DISTINCT fold FROM t),
  tr AS (SELECT f.fold, covar_pop(x1, x1) AS c11, covar_pop(x2, x2) AS c22, covar_pop(x1, x2) AS c12,
                covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my
         FROM f JOIN t ON t.fold <> f.fold GROUP BY f.fold),
  co AS (SELECT *, (c1y*c22 - c2y*c12) / (c11*c22 - c12*c12) AS b1, (c2y*c11 - c1y*c12) / (c11*c22 - c12*c12) AS b2 FROM tr),
  cf AS (SELECT *, my - b1*m1 - b2*m2 AS a FROM co),
  sc AS (SELECT t.fold, 1 - sum((t.y - cf.a - cf.b1*t.x1 - cf.b2*t.x2) * (t.y - cf.a - cf.b1*t.x1 - cf.b2*t.x2))
                           / (var_pop(t.y) * count(*)) AS r2
         FROM t JOIN cf ON t.fold = cf.fold GROUP BY t.fold)
  SELECT CAST(count(*) AS INTEGER) AS folds, {r6('avg(r2)')} AS cv_r2_mean, {r6('stddev_pop(r2)')} AS cv_r2_std FROM sc""")
def q_ols_cv(spark, sf):
    v = fixtures.v_linear(spark, sf)
    train = v.where(~split_flag("l_orderkey", method="mod"))
    return rnd(L.ols_cv(train, LIN, "y", fold_of("l_orderkey", 5, method="mod", stride=5), prepared=False))


_LINES = """SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount AS x2,
  3 * l_quantity - 40 * l_discount + (l_orderkey % 13) AS y FROM lineitem"""
_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]


def _lines(spark, sf):
    li = read_table(spark, sf, "lineitem")
    y = 3 * F.col("l_quantity") - 40 * F.col("l_discount") + F.col("l_orderkey") % 13
    return li.select(*_LINE_ORDER, y.cast("double").alias("y"))


@register("ols_cv_contiguous", f"""
  WITH v AS ({_LINES}),
  i AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, x1, x2) - 1 AS i, count(*) OVER () AS n FROM v),
  t AS (SELECT x1, x2, y, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
                               ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold FROM i),
  f AS (SELECT DISTINCT fold FROM t),
  tr AS (SELECT f.fold, covar_pop(x1, x1) AS c11, covar_pop(x2, x2) AS c22, covar_pop(x1, x2) AS c12,
                covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my
         FROM f JOIN t ON t.fold <> f.fold GROUP BY f.fold),
  co AS (SELECT *, (c1y*c22 - c2y*c12) / (c11*c22 - c12*c12) AS b1, (c2y*c11 - c1y*c12) / (c11*c22 - c12*c12) AS b2 FROM tr),
  cf AS (SELECT *, my - b1*m1 - b2*m2 AS a FROM co),
  sc AS (SELECT t.fold, 1 - sum((t.y - cf.a - cf.b1*t.x1 - cf.b2*t.x2) * (t.y - cf.a - cf.b1*t.x1 - cf.b2*t.x2))
                           / (var_pop(t.y) * count(*)) AS r2
         FROM t JOIN cf ON t.fold = cf.fold GROUP BY t.fold)
  SELECT CAST(count(*) AS INTEGER) AS folds, {r6('avg(r2)')} AS cv_r2_mean, {r6('stddev_pop(r2)')} AS cv_r2_std FROM sc""")
def q_ols_cv_contiguous(spark, sf):
    """Cross-validation over five unshuffled blocks of all rows."""
    folds = rows.contiguous_folds(_lines(spark, sf), _LINE_ORDER, 5)
    return rnd(L.ols_cv(folds, LIN, "y", F.col("fold"), prepared=False))


@register("shuffled_importance", f"""
  WITH v AS ({_LINES}),
  tr AS (SELECT covar_pop(x1, x1) AS c11, covar_pop(x2, x2) AS c22, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y,
                covar_pop(x2, y) AS c2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM v WHERE l_orderkey % 5 <> 0),
  co AS (SELECT *, (c1y*c22 - c2y*c12) / (c11*c22 - c12*c12) AS b1, (c2y*c11 - c1y*c12) / (c11*c22 - c12*c12) AS b2 FROM tr),
  cf AS (SELECT b1, b2, my - b1*m1 - b2*m2 AS a FROM co),
  k AS (SELECT *, concat_ws(':', l_orderkey, l_linenumber, CAST(round(x1 * 100) AS BIGINT), CAST(round(x2 * 100) AS BIGINT)) AS key FROM v WHERE l_orderkey % 5 = 0),
  te AS (SELECT k.*, row_number() OVER (ORDER BY key) AS i FROM k),
  dn AS (SELECT rep, x1 AS d1, x2 AS d2, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws(':', '42', rep, key))) AS i
         FROM k, range(10) r(rep)),
  ba AS (SELECT sum((y - a - b1*x1 - b2*x2) * (y - a - b1*x1 - b2*x2)) AS sse, var_pop(y) * count(*) AS sst FROM te, cf),
  ls AS (SELECT rep, sum((y - a - b1*d1 - b2*x2) * (y - a - b1*d1 - b2*x2)) AS s1,
                sum((y - a - b1*x1 - b2*d2) * (y - a - b1*x1 - b2*d2)) AS s2 FROM te JOIN dn USING (i), cf GROUP BY rep),
  im AS (SELECT 'l_quantity' AS feature, 0 AS pos, (s1 - sse) / sst AS lost FROM ls, ba
         UNION ALL SELECT 'l_discount', 1, (s2 - sse) / sst FROM ls, ba)
  SELECT feature, {r6('avg(lost)')} AS importance, {r6('stddev_pop(lost)')} AS importance_std,
         CAST(row_number() OVER (ORDER BY avg(lost) DESC, pos) AS INTEGER) AS rank FROM im GROUP BY feature, pos""")
def q_shuffled_importance(spark, sf):
    """Ten shuffles of each feature of a fitted linear model, over all test rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assembler = VectorAssembler(inputCols=LIN, outputCol="__features")
    # order and line number repeat in this table; with the features, rows of one key are equal
    d = _lines(spark, sf).withColumns({f"k{i}": F.round(F.col(c) * 100).cast("bigint") for i, c in enumerate(LIN)})
    train = assembler.transform(d.where(~split_flag("l_orderkey", method="mod")))
    model = LinearRegression(featuresCol="__features", labelCol="y", regParam=0.0, solver="normal").fit(train)
    return rnd(rows.shuffled_importance(lambda t: model.transform(assembler.transform(t)).drop("__features"),
                                        d.where(split_flag("l_orderkey", method="mod")), LIN, "y", ["l_orderkey", "l_linenumber", "k0", "k1"]))


@register("pca_two", _V("v_sales") + f""",
  c AS (SELECT abs(corr(net, gross)) AS r FROM v_sales)
  SELECT CAST(CASE WHEN (1 + r) / 2 > 0.95 THEN 1 ELSE 2 END AS INTEGER) AS n_components,
         {r6('CASE WHEN (1 + r) / 2 > 0.95 THEN (1 + r) / 2 ELSE 1.0 END')} AS explained,
         {r6('1 + r')} AS ev_0, {r6('1 - r')} AS ev_1 FROM c""")
def q_pca_two(spark, sf):
    p = L.pca(fixtures.v_sales(spark, sf), ["net", "gross"])
    return rnd(p.select("n_components", "explained", F.col("eigenvalues")[0].alias("ev_0"), F.col("eigenvalues")[1].alias("ev_1")))


# --- wide inputs: the 64-dimension embeddings table (blocked kernels) ---------------------------------

def _embedding_columns(spark, sf):
    from tabscope.sources.tables import read_table
    emb = read_table(spark, sf, "embeddings")
    k = emb.agg(F.max(F.size("embedding")).alias("k")).collect()[0]["k"]  # vector width, one number
    cols = [f"e{i}" for i in range(k)]
    return emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@register("embedding_corr", f"""
  WITH u AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS d, unnest(embedding) AS v FROM embeddings)
  SELECT a.d AS i, b.d AS j, 'e' || a.d AS feature_a, 'e' || b.d AS feature_b, CAST(count(*) AS BIGINT) AS n,
         CASE WHEN isnan(corr(a.v, b.v)) THEN NULL ELSE {r6('corr(a.v, b.v)')} END AS r
  FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.d < b.d GROUP BY a.d, b.d""")
def q_embedding_corr(spark, sf):
    """COR1 on 64 columns: every pair from one blocked pass (per-batch X'X with presence masks)."""
    emb, cols = _embedding_columns(spark, sf)
    return rnd(C.corr_long(emb, cols))


# Whole vectors only, as rows (vec_id, d, v) and as the correlation of every pair of dimensions, both ways round.
_WHOLE = """u0 AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  ok AS (SELECT vec_id FROM u0 GROUP BY vec_id HAVING count(*) FILTER (WHERE isfinite(v)) = (SELECT max(len(embedding)) FROM embeddings)),
  u AS (SELECT u0.* FROM u0 JOIN ok USING (vec_id)),
  c AS (SELECT a.d AS i, b.d AS j, corr(a.v, b.v) AS r, covar_pop(a.v, b.v) AS cov FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.d, b.d)"""


@register("embedding_vif", f"""
  WITH RECURSIVE {_WHOLE},
  m0 AS (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(r ORDER BY j) AS line FROM c GROUP BY i)),
  inv AS (SELECT CAST(1 AS BIGINT) AS p, m FROM m0 UNION ALL
    SELECT p + 1, list_transform(m, lambda line, i: list_transform(line, lambda x, j:
      CASE WHEN i = p AND j = p THEN 1 / m[p][p] WHEN i = p THEN x / m[p][p] WHEN j = p THEN -x / m[p][p]
           ELSE x - line[p] * m[p][j] / m[p][p] END)) FROM inv WHERE p <= len(m)),
  done AS (SELECT m FROM inv WHERE p = len(m) + 1)
  SELECT 'e' || (t.i - 1) AS feature, 'std' AS basis, {r6('m[t.i][t.i]')} AS vif FROM done, (SELECT unnest(range(1, (SELECT len(m) + 1 FROM done))) AS i) t""")
def q_embedding_vif(spark, sf):
    """VIF2 on 64 columns from the blocked moments kernel; the oracle inverts the correlation matrix by Gauss-Jordan steps."""
    emb, cols = _embedding_columns(spark, sf)
    return rnd(L.vif(emb, cols, basis="std"))


# --- QR factors and the range finder ------------------------------------------------------------------

@register("ols_coeffs_qr", _OLS2 + f"""
  SELECT 'l_quantity' AS feature, {r6('b1')} AS coef FROM cf UNION ALL SELECT 'l_discount', {r6('b2')} FROM cf
  UNION ALL SELECT '(intercept)', {r6('a')} FROM cf""")
def q_ols_coeffs_qr(spark, sf):
    """REG1 by a tree of QR factors instead of moments, on the training rows."""
    fit = Q.qr_ols(fixtures.v_linear(spark, sf).where("l_orderkey % 5 <> 0"), LIN, "y")
    names = F.array(*[F.lit(c) for c in [*LIN, "(intercept)"]])
    z = fit.select(F.explode(F.arrays_zip(names.alias("feature"), F.concat("coefficients", F.array("intercept")).alias("coef"))).alias("z"))
    return rnd(z.select("z.feature", "z.coef"))


@register("embedding_pca_qr", f"""
  WITH {_WHOLE}
  SELECT (SELECT count(*) FROM ok) AS n, {r6('sum(CASE WHEN i = j THEN r END)')} AS trace, {r6('sum(r * r)')} AS squares FROM c""")
def q_embedding_pca_qr(spark, sf):
    """EXP3 on 64 columns by QR; the eigenvalues sum to the trace of the correlation matrix, their squares to its squares."""
    p = Q.qr_pca(read_table(spark, sf, "embeddings"), "embedding")
    add = lambda f: F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + f(x))
    return rnd(p.select("n", add(lambda x: x).alias("trace"), add(lambda x: x * x).alias("squares")))


@register("embedding_range", f"""
  WITH {_WHOLE}, n AS (SELECT count(*) AS n FROM ok)
  SELECT CAST(count(DISTINCT i) AS BIGINT) AS directions, {r6('sum(CASE WHEN i = j THEN cov END)')} AS variance, {r6('sum(cov * cov)')} AS squares,
         CAST(1.0 AS DOUBLE) AS explained FROM c""")
def q_embedding_range(spark, sf):
    """The range finder asked for every direction, where it is exact: variances sum to the trace of the covariance matrix."""
    emb = read_table(spark, sf, "embeddings")
    n = Q.qr_factor(emb, "embedding").select("n", "width").first()
    s = Q.range_pca(emb, "embedding", n["width"])
    v = F.col("singular_value") * F.col("singular_value") / n["n"]
    return rnd(s.agg(F.count(F.lit(1)).alias("directions"), F.sum(v).alias("variance"), F.sum(v * v).alias("squares"), F.sum("explained").alias("explained")))
