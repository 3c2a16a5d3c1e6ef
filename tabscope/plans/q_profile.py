"""Registered profiling and quality queries (AGG1-AGG17, PRJ1-2) on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.operators import profile, quality, rows
from tabscope.plans import oracle_sql as O
from tabscope.plans.registry import register
from tabscope.sources import fixtures

DEFECT_COLS = ["l_orderkey", "l_linenumber", "qty", "price", "discount", "code", "flag"]
DEFECT_NUM = ["l_orderkey", "l_linenumber", "qty", "price", "discount"]
DEFECT_STR = ["code", "flag"]


def _r(c, k=6):
    return F.round(F.col(c), k).alias(c)


@register("quality_score", O.with_views("v_defect") + "," + O.quality_parts_ctes("v_defect", DEFECT_COLS, DEFECT_NUM, DEFECT_STR, []) + O.quality_score_select([]))
def q_quality_score(spark, sf):
    return quality.quality_score(fixtures.v_defect(spark, sf))


_BY_FLAG_COLS = [c for c in DEFECT_COLS if c != "flag"]


@register("quality_by_flag", O.with_views("v_defect") + "," + O.quality_parts_ctes("v_defect", _BY_FLAG_COLS, DEFECT_NUM, ["code"], ["flag"]) + O.quality_score_select(["flag"]))
def q_quality_by_flag(spark, sf):
    return quality.quality_score(fixtures.v_defect(spark, sf), by=["flag"])


from tabscope.operators import prepare  # noqa: E402
from tabscope.plans.common import rnd  # noqa: E402
from tabscope.plans.oracle_sql import r6  # noqa: E402
from tabscope.sources.tables import read_table  # noqa: E402

_V = O.with_views


@register("overview", _V("v_defect") + """
  SELECT CAST(count(*) AS BIGINT) AS n_rows, 7 AS n_cols, 5 AS n_numerical, 2 AS n_categorical FROM v_defect""")
def q_overview(spark, sf):
    return profile.overview(fixtures.v_defect(spark, sf))


@register("column_kinds", """
  SELECT * FROM (VALUES (0, 'l_orderkey', 'bigint', 'numerical', true), (1, 'l_linenumber', 'int', 'numerical', true),
    (2, 'qty', 'double', 'numerical', true), (3, 'price', 'double', 'numerical', true),
    (4, 'discount', 'double', 'numerical', true), (5, 'code', 'string', 'categorical', false),
    (6, 'flag', 'string', 'categorical', false)) t(ordinal, "column", dtype, kind, stat_numeric)""")
def q_column_kinds(spark, sf):
    return profile.column_kinds(fixtures.v_defect(spark, sf))


_MISS_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing FROM v_defect" for c in DEFECT_COLS)


@register("missing_by_column", _V("v_defect") + f"""
  SELECT * FROM ({_MISS_UNION}) WHERE n_missing > 0""")
def q_missing_by_column(spark, sf):
    return profile.missing_by_column(fixtures.v_defect(spark, sf))


@register("missing_cell_pct", _V("v_defect") + f"""
  , m AS ({_MISS_UNION}), n AS (SELECT count(*) AS n FROM v_defect)
  SELECT CAST(sum(n_missing) AS BIGINT) AS total_missing, CAST(max(n) * 7 AS BIGINT) AS n_cells,
         {r6('round(sum(n_missing) * 100.0 / greatest(max(n) * 7, 1), 2)')} AS missing_pct FROM m, n""")
def q_missing_cell_pct(spark, sf):
    return rnd(profile.missing_total(fixtures.v_defect(spark, sf)))


_SUM_UNION = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r6(f'avg({c})')} AS mean, {r6(f'quantile_cont({c}, 0.5)')} AS median,
        {r6(f'coalesce(stddev_samp({c}), 0)')} AS std_dev, {r6(f'quantile_cont({c}, 0.25)')} AS q1,
        {r6(f'quantile_cont({c}, 0.75)')} AS q3 FROM v_defect WHERE {c} IS NOT NULL""" for c in DEFECT_NUM)


@register("numeric_summary", _V("v_defect") + f" SELECT * FROM ({_SUM_UNION})")
def q_numeric_summary(spark, sf):
    return rnd(profile.numeric_summary(fixtures.v_defect(spark, sf)))


@register("numeric_summary_by_flag", _V("v_defect") + " " + " UNION ALL ".join(
    f"""SELECT flag, '{c}' AS "column", {r6(f'avg({c})')} AS mean, {r6(f'quantile_cont({c}, 0.5)')} AS median,
        {r6(f'coalesce(stddev_samp({c}), 0)')} AS std_dev, {r6(f'quantile_cont({c}, 0.25)')} AS q1,
        {r6(f'quantile_cont({c}, 0.75)')} AS q3 FROM v_defect WHERE {c} IS NOT NULL GROUP BY flag""" for c in DEFECT_NUM))
def q_numeric_summary_by_flag(spark, sf):
    return rnd(profile.numeric_summary(fixtures.v_defect(spark, sf), by=["flag"]))


@register("validity_gate", """
  SELECT 'lineitem' AS tbl, count(*) >= 10 AS valid,
         CASE WHEN count(*) = 0 THEN 'Dataset is empty' WHEN count(*) < 10 THEN 'Dataset has fewer than 10 rows'
              ELSE 'Dataset is valid' END AS reason FROM lineitem
  UNION ALL
  SELECT 'region', count(*) >= 10,
         CASE WHEN count(*) = 0 THEN 'Dataset is empty' WHEN count(*) < 10 THEN 'Dataset has fewer than 10 rows'
              ELSE 'Dataset is valid' END FROM region""")
def q_validity_gate(spark, sf):
    a = profile.validity_gate(read_table(spark, sf, "lineitem"), target="l_quantity")
    b = profile.validity_gate(read_table(spark, sf, "region"))
    return a.select(F.lit("lineitem").alias("tbl"), "*").unionByName(b.select(F.lit("region").alias("tbl"), "*"))


_TK_COLS = ["l_quantity", "l_discount", "l_tax", "net", "gross", "l_suppkey"]


@register("target_kind", _V("v_sales") + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS target, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
        CASE WHEN count(*) = 0 THEN 'unknown'
             WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) * 1.0 / greatest(count(*), 1) <= 0.05 THEN 'classification'
             ELSE 'regression' END AS target_type FROM v_sales""" for c in _TK_COLS))
def q_target_kind(spark, sf):
    v = fixtures.v_sales(spark, sf)
    out = None
    for c in _TK_COLS:
        t = profile.target_kind(v, c).select(F.lit(c).alias("target"), "n_rows", "n_distinct", "target_type")
        out = t if out is None else out.unionByName(t)
    return out


@register("target_type_by_supplier", _V("v_sales") + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS target, l_suppkey, CAST(count(*) AS BIGINT) AS n_rows,
        CASE WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) * 1.0 / greatest(count(*), 1) <= 0.05 THEN 'classification'
             ELSE 'regression' END AS target_type FROM v_sales GROUP BY l_suppkey""" for c in ["l_quantity", "l_discount", "net", "l_orderkey"]))
def q_target_type_by_supplier(spark, sf):
    """AGG12 from bounded sets: types of four targets for each supplier."""
    v = fixtures.v_sales(spark, sf)
    out = None
    for c in ["l_quantity", "l_discount", "net", "l_orderkey"]:
        t = profile.target_type(v, c, by=["l_suppkey"]).select(F.lit(c).alias("target"), "l_suppkey", "n_rows", "target_type")
        out = t if out is None else out.unionByName(t)
    return out


@register("choose_target", """
  WITH ev AS (SELECT 'event_id' AS c, 0 AS o, count(DISTINCT event_id) AS nd, var_samp(event_id) AS v FROM events
              UNION ALL SELECT 'user_id', 1, count(DISTINCT user_id), var_samp(user_id) FROM events
              UNION ALL SELECT 'value', 2, count(DISTINCT value), var_samp(value) FROM events),
       pick AS (SELECT c FROM ev WHERE nd > 10 ORDER BY v DESC, o LIMIT 1)
  SELECT 'v_sales' AS tbl, 'l_extendedprice' AS target
  UNION ALL SELECT 'part', 'p_retailprice'
  UNION ALL SELECT 'events', c FROM pick""")
def q_choose_target(spark, sf):
    a = profile.choose_target(fixtures.v_sales(spark, sf)).select(F.lit("v_sales").alias("tbl"), "target")
    b = profile.choose_target(read_table(spark, sf, "part")).select(F.lit("part").alias("tbl"), "target")
    c = profile.choose_target(read_table(spark, sf, "events")).select(F.lit("events").alias("tbl"), "target")
    return a.unionByName(b).unionByName(c)


_FQ = ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gross"]


@register("feature_quality", _V("v_sales") + f"""
  SELECT {r6('(1 - (' + ' + '.join(f'CASE WHEN var_samp({c}) < 0.01 THEN 1 ELSE 0 END' for c in _FQ) + ') / 8.0) * 100')} AS feature_quality,
         {r6('1.0')} AS diversity_score FROM v_sales""")
def q_feature_quality(spark, sf):
    return rnd(profile.feature_quality(fixtures.v_sales(spark, sf), target="gross"))


@register("histogram30", _V("v_sales") + f"""
  , r AS (SELECT min(net) AS lo, max(net) AS hi FROM v_sales),
  b AS (SELECT CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((net - r.lo) / (r.hi - r.lo) * 30), 29) END AS INTEGER) AS bin,
               count(*) AS c FROM v_sales, r WHERE net IS NOT NULL GROUP BY ALL),
  g AS (SELECT CAST(i AS INTEGER) AS bin FROM range(30) t(i))
  SELECT g.bin, {r6('r.lo + g.bin * (r.hi - r.lo) / 30')} AS lo,
         {r6('CASE WHEN g.bin = 29 THEN r.hi ELSE r.lo + (g.bin + 1) * (r.hi - r.lo) / 30 END')} AS hi,
         CAST(coalesce(b.c, 0) AS BIGINT) AS count
  FROM g CROSS JOIN r LEFT JOIN b ON g.bin = b.bin""")
def q_histogram30(spark, sf):
    return rnd(profile.histogram(fixtures.v_sales(spark, sf), "net", 30))


@register("pair_bins", _V("v_sales") + """
  , r AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(net) AS yl, max(net) AS yh FROM v_sales
          WHERE l_quantity IS NOT NULL AND net IS NOT NULL)
  SELECT CAST(CASE WHEN xh = xl THEN 0 ELSE least(floor((l_quantity - xl) / (xh - xl) * 10), 9) END AS INTEGER) AS x_bin,
         CAST(CASE WHEN yh = yl THEN 0 ELSE least(floor((net - yl) / (yh - yl) * 10), 9) END AS INTEGER) AS y_bin,
         CAST(count(*) AS BIGINT) AS count
  FROM v_sales, r WHERE l_quantity IS NOT NULL AND net IS NOT NULL GROUP BY ALL""")
def q_pair_bins(spark, sf):
    return profile.pair_bins(fixtures.v_sales(spark, sf), "l_quantity", "net", 10)


@register("drop_null_target", _V("v_defect") + """
  SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders,
         """ + r6("sum(qty)", 4) + """ AS sum_qty FROM v_defect WHERE qty IS NOT NULL""")
def q_drop_null_target(spark, sf):
    d = prepare.drop_null_target(fixtures.v_defect(spark, sf), "qty")
    return rnd(d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"),
                     F.sum("qty").alias("sum_qty")), 4)


@register("clean_impute", _V("v_defect") + f"""
  , m AS (SELECT quantile_cont(qty, 0.5) AS mq, quantile_cont(price, 0.5) AS mp FROM v_defect)
  SELECT l_orderkey, l_linenumber, {r6('coalesce(qty, m.mq, 0)')} AS qty, {r6('coalesce(price, m.mp, 0)')} AS price
  FROM v_defect, m""")
def q_clean_impute(spark, sf):
    v = fixtures.v_defect(spark, sf)
    out = prepare.impute_median(v, ["qty", "price"])
    return rnd(out.select("l_orderkey", "l_linenumber", "qty", "price"))


@register("clean_impute_by_flag", _V("v_defect") + f"""
  , m AS (SELECT flag, quantile_cont(qty, 0.5) AS mq FROM v_defect GROUP BY flag)
  SELECT v.flag, v.l_orderkey, v.l_linenumber, {r6('coalesce(v.qty, m.mq, 0)')} AS qty
  FROM v_defect v JOIN m ON v.flag = m.flag""")
def q_clean_impute_by_flag(spark, sf):
    v = fixtures.v_defect(spark, sf)
    out = prepare.impute_median(v, ["qty"], by=["flag"])
    return rnd(out.select("flag", "l_orderkey", "l_linenumber", "qty"))


@register("inf_to_null", _V("v_defect") + f"""
  SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(q) AS BIGINT) AS n_finite, {r6('sum(q)', 4)} AS sum_finite
  FROM (SELECT CASE WHEN isfinite(qty / discount) THEN qty / discount END AS q FROM v_defect)""")
def q_inf_to_null(spark, sf):
    v = fixtures.v_defect(spark, sf)
    # qty / discount is +inf where discount = 0 (non-ANSI double division) and null where qty is null
    ratio = v.select(F.expr("try_divide(qty, discount)").alias("q0"), "qty", "discount")
    ratio = ratio.select(F.when(F.col("discount") == 0, F.when(F.col("qty") > 0, F.lit(float("inf"))).when(F.col("qty") < 0, F.lit(float("-inf"))).when(F.col("qty") == 0, F.lit(float("nan")))).otherwise(F.col("q0")).alias("q"))
    c = prepare.inf_to_null(ratio, ["q"])
    return rnd(c.agg(F.count(F.lit(1)).alias("n_rows"), F.count("q").alias("n_finite"), F.sum("q").alias("sum_finite")), 4)


@register("one_hot_counts", _V("v_defect") + """
  SELECT CAST(sum(CASE WHEN flag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS flag_N,
         CAST(sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS flag_R,
         CAST(count(*) AS BIGINT) AS n_rows FROM v_defect""")
def q_one_hot_counts(spark, sf):
    enc = prepare.one_hot(fixtures.v_defect(spark, sf).select("flag"), ["flag"])
    return enc.agg(F.sum("flag_N").cast("long").alias("flag_N"), F.sum("flag_R").cast("long").alias("flag_R"),
                   F.count(F.lit(1)).alias("n_rows"))


@register("square_interaction", _V("v_sales") + f"""
  SELECT {r6('sum(l_quantity * l_quantity)', 2)} AS sum_sq, {r6('sum(l_quantity * l_extendedprice)', 2)} AS sum_ia,
         CAST(count(*) AS BIGINT) AS n_rows FROM v_sales""")
def q_square_interaction(spark, sf):
    eng, added = prepare.square_interaction(fixtures.v_sales(spark, sf).select("l_quantity", "l_extendedprice"),
                                            ["l_quantity", "l_extendedprice"])
    return rnd(eng.agg(F.sum(added[0]).alias("sum_sq"), F.sum(added[1]).alias("sum_ia"), F.count(F.lit(1)).alias("n_rows")), 2)


@register("split_counts", _V("v_sales") + """
  SELECT l_orderkey % 5 = 0 AS is_test, CAST(count(*) AS BIGINT) AS n_rows FROM v_sales GROUP BY ALL""")
def q_split_counts(spark, sf):
    v = fixtures.v_sales(spark, sf)
    return v.groupBy(prepare.split_flag("l_orderkey", method="mod").alias("is_test")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("fold_counts", _V("v_sales") + """
  SELECT CAST((l_orderkey // 5) % 5 AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n_rows
  FROM v_sales WHERE l_orderkey % 5 <> 0 GROUP BY ALL""")
def q_fold_counts(spark, sf):
    v = fixtures.v_sales(spark, sf)
    train = v.where(~prepare.split_flag("l_orderkey", method="mod"))
    return train.groupBy(prepare.fold_of("l_orderkey", 5, method="mod", stride=5).alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"))


_ROW_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@register("folds_contiguous", f"""
  WITH t AS (SELECT l_returnflag, l_orderkey, l_quantity,
                    row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(_ROW_ORDER)}) - 1 AS i,
                    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
  f AS (SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
                       ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold FROM t)
  SELECT l_returnflag, CAST(fold AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n_rows, CAST(min(i) AS BIGINT) AS first_row,
         CAST(min(l_orderkey) AS BIGINT) AS least_order, CAST(max(l_orderkey) AS BIGINT) AS greatest_order,
         {r6('sum(l_quantity)', 4)} AS sum_qty FROM f GROUP BY ALL""")
def q_folds_contiguous(spark, sf):
    """SPL2 as unshuffled blocks of the global row order, for each return flag."""
    li = read_table(spark, sf, "lineitem").select("l_returnflag", *_ROW_ORDER)
    nr = rows.number_rows(li, _ROW_ORDER, ["l_returnflag"], "i")
    f = rows.contiguous_folds(nr, ["i"], 5, ["l_returnflag"])
    return rnd(f.groupBy("l_returnflag", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("i").alias("first_row"), F.min("l_orderkey").cast("bigint").alias("least_order"),
        F.max("l_orderkey").cast("bigint").alias("greatest_order"), F.round(F.sum("l_quantity"), 4).alias("sum_qty")))


_STD = ["l_quantity", "l_extendedprice", "net"]


@register("standardized_moments", _V("v_sales") + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r6(f'avg(({c} - m) / s)')} AS mean_z, {r6(f'sum((({c} - m) / s) * (({c} - m) / s))', 3)} AS ss_z
        FROM v_sales, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM v_sales)""" for c in _STD))
def q_standardized_moments(spark, sf):
    z = prepare.standardize(fixtures.v_sales(spark, sf), _STD)
    agg = z.agg(*[F.struct(F.avg(c).alias("mean_z"), F.sum(F.col(c) * F.col(c)).alias("ss_z")).alias(c) for c in _STD])
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.mean_z").alias("mean_z"),
                                                   F.col(f"{c}.ss_z").alias("ss_z")) for c in _STD])).alias("s")).select("s.*")
    return long.select("column", (F.round("mean_z", 6) + 0.0).alias("mean_z"), (F.round("ss_z", 3) + 0.0).alias("ss_z"))


@register("numeric_projection", _V("v_defect") + f"""
  SELECT l_orderkey, l_linenumber, {r6('qty')} AS qty, {r6('price')} AS price, {r6('discount')} AS discount FROM v_defect""")
def q_numeric_projection(spark, sf):
    """PRJ2: statistics-numeric columns only (strings dropped by schema, no job)."""
    return rnd(profile.numeric_projection(fixtures.v_defect(spark, sf)))


@register("fill_zero", _V("v_defect") + f"""
  SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE coalesce(qty, 0) = 0) AS BIGINT) AS n_zero,
         {r6('sum(coalesce(qty, 0))', 4)} AS sum_qty FROM v_defect""")
def q_fill_zero(spark, sf):
    """CLN2: feature nulls -> 0."""
    z = prepare.fill_zero(fixtures.v_defect(spark, sf), ["qty"])
    return rnd(z.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("qty") == 0).alias("n_zero"),
                     F.sum("qty").alias("sum_qty")), 4)


_SALES = ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gross"]


def _signals_sql():
    feats = [c for c in _SALES if c != "gross"]
    pairs = []
    for i in range(len(_SALES)):
        for j in range(i + 1, len(_SALES)):
            a, b = _SALES[i], _SALES[j]
            pairs.append(f"SELECT '{a}' AS fa, '{b}' AS fb, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS r FROM v_sales")
    return (_V("v_sales") + "," + O.quality_parts_ctes("v_sales", _SALES, _SALES, [], []) + f""",
      pr AS ({' UNION ALL '.join(pairs)})
      SELECT CAST(count(*) AS BIGINT) AS n_rows, {len(feats)} AS n_features, {r6('1.0')} AS numeric_ratio,
             CASE WHEN count(*) = 0 THEN 'unknown'
                  WHEN count(DISTINCT gross) <= 20 OR count(DISTINCT gross) * 1.0 / greatest(count(*), 1) <= 0.05 THEN 'classification'
                  ELSE 'regression' END AS target_type,
             (SELECT {r6('round(coalesce(avg(abs(r)), 0), 3)')} FROM pr WHERE fa = 'gross' OR fb = 'gross') AS avg_correlation,
             (SELECT {r6('round(coalesce(max(abs(r)), 0), 3)')} FROM pr WHERE fa <> 'gross' AND fb <> 'gross') AS max_correlation,
             (SELECT {r6('round(round(' + O.OVERALL + ', 1), 1)')} FROM qp) AS data_quality_score,
             {r6('0.0')} AS missing_percentage
      FROM v_sales""")


@register("table_signals", _signals_sql())
def q_table_signals(spark, sf):
    """AGG15: table signals of the collinear view with target gross."""
    from tabscope.plans.evidence import signals
    return rnd(signals(fixtures.v_sales(spark, sf), "gross"))
