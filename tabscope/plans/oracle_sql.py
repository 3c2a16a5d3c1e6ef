"""DuckDB SQL text for the registered queries (the correctness oracle).

Every statement reads the driver tables (pre-registered as views) and
defines the fixture views as CTEs.  Generators build the SQL from column
lists so the Spark plan and the oracle are written independently.
"""

from __future__ import annotations

from collections.abc import Sequence

from tabscope.functions.columns import lexical_kind_sql
from tabscope.sources.fixtures import VIEW_SQL


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(VIEW_SQL[n] for n in names)


def _by_sel(by: Sequence[str]) -> str:
    return "".join(f"{b}, " for b in by)


def _group(by: Sequence[str]) -> str:
    return f"GROUP BY {', '.join(by)}" if by else ""


def _using(by: Sequence[str], left: str, right: str) -> str:
    if not by:
        return "ON TRUE"
    return "ON " + " AND ".join(f"{left}.{b} IS NOT DISTINCT FROM {right}.{b}" for b in by)


def long_numeric(view: str, numeric: Sequence[str], by: Sequence[str], finite: bool = False) -> str:
    """UNION ALL of (by..., col, v) for non-null values."""
    parts = []
    for c in numeric:
        cond = f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))"
        if finite:
            cond += f" AND isfinite(CAST({c} AS DOUBLE))"
        parts.append(f"SELECT {_by_sel(by)}'{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {view} WHERE {cond}")
    return "\n UNION ALL ".join(parts)


def quality_parts_ctes(view: str, cols: Sequence[str], numeric: Sequence[str], strings: Sequence[str], by: Sequence[str], p: str = "") -> str:
    """CTEs qa, qo, qd, qp (parts, unrounded) over ``view``; no leading WITH."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    issues = " + ".join(
        f"CASE WHEN count(DISTINCT {lexical_kind_sql(c)}) > 2 THEN 1 ELSE 0 END" for c in strings) or "0"
    grp = _group(by)
    n_feat = max(len(cols), 1)
    sel_by = _by_sel(by)
    all_cols = ", ".join(list(by) + list(cols))
    return f"""
      {p}qa AS (SELECT {sel_by}count(*) AS n_rows, count(*) FILTER (WHERE {complete}) AS n_complete,
                    {issues} AS issues FROM {view} {grp}),
      {p}qlong AS ({long_numeric(view, numeric, by, finite=True)}),
      {p}qf AS (SELECT {sel_by}col, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
             FROM {p}qlong {_group(list(by) + ['col'])}),
      {p}qo AS (SELECT {''.join(f'l.{b}, ' for b in by)}
                    sum(CASE WHEN l.v < f.q1 - 1.5 * (f.q3 - f.q1) OR l.v > f.q3 + 1.5 * (f.q3 - f.q1) THEN 1 ELSE 0 END) AS outl,
                    count(*) AS vals
             FROM {p}qlong l JOIN {p}qf f ON l.col = f.col {''.join(f' AND l.{b} IS NOT DISTINCT FROM f.{b}' for b in by)}
             WHERE f.n >= 4 AND f.q3 <> f.q1 {_group([f'l.{b}' for b in by])}),
      {p}qd AS (SELECT {sel_by}sum(c) AS n_rows2, count(*) AS n_distinct
             FROM (SELECT {all_cols}, count(*) AS c FROM {view} GROUP BY ALL) {grp}),
      {p}qp AS (SELECT {''.join(f'{p}qa.{b} AS {b}, ' for b in by)} {p}qa.n_rows,
               CAST({p}qa.n_complete * 100.0 / greatest({p}qa.n_rows, 1) AS DOUBLE) AS completeness,
               CAST((1 - ({p}qa.n_rows - {p}qd.n_distinct) * 1.0 / greatest({p}qa.n_rows, 1)) * 100 AS DOUBLE) AS uniqueness,
               CAST(greatest(0.0, 100.0 - {p}qa.issues * 1.0 / {n_feat} * 100.0 * 0.1) AS DOUBLE) AS consistency,
               CAST(CASE WHEN coalesce({p}qo.vals, 0) > 0 THEN (1 - {p}qo.outl * 1.0 / {p}qo.vals) * 100 ELSE 100.0 END AS DOUBLE) AS plausibility,
               CAST({len(numeric) / n_feat * 100!r} AS DOUBLE) AS feature_richness
             FROM {p}qa JOIN {p}qd {_using(by, p + 'qa', p + 'qd')} LEFT JOIN {p}qo {_using(by, p + 'qa', p + 'qo')})"""


def quality_score_select(by: Sequence[str]) -> str:
    overall = "0.25 * completeness + 0.20 * uniqueness + 0.20 * consistency + 0.20 * plausibility + 0.15 * feature_richness"
    grade = ("CASE WHEN round({o}, 1) >= 90 THEN 'A' WHEN round({o}, 1) >= 80 THEN 'B' WHEN round({o}, 1) >= 70 THEN 'C' "
             "WHEN round({o}, 1) >= 60 THEN 'D' ELSE 'F' END").format(o=f"({overall})")
    return f"""
      SELECT {_by_sel(by)}round(completeness, 1) AS completeness, round(uniqueness, 1) AS uniqueness,
             round(consistency, 1) AS consistency, round(plausibility, 1) AS plausibility,
             round(feature_richness, 1) AS feature_richness, round({overall}, 1) AS overall_score,
             {grade} AS grade,
             CASE WHEN {grade} IN ('A', 'B') THEN 'Good quality data with minor outlier concerns'
                  ELSE 'Data quality is moderate and needs improvement before reliable modeling' END AS assessment
      FROM qp"""


def r6(expr: str, k: int = 6) -> str:
    """Rounded double, with -0.0 folded to 0.0 (matches ``rnd`` on the Spark side)."""
    return f"CAST(round(CAST({expr} AS DOUBLE), {k}) + 0.0 AS DOUBLE)"


OVERALL = "0.25 * completeness + 0.20 * uniqueness + 0.20 * consistency + 0.20 * plausibility + 0.15 * feature_richness"


def family_evidence_ctes(p: str, view: str, g: str, x: str, y: str, s: str) -> str:
    """CTEs ending in ``{p}ev``: evidence per segment ``seg`` for one feature ``x`` and target ``y`` of ``view``,
    test rows where ``s % 5 = 0``.  Models: linear on x and polynomial on (x, x^2), both by exact least squares."""
    return f"""
      {p}base AS (SELECT {g} AS seg, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, {s} % 5 = 0 AS is_test FROM {view}),
      {quality_parts_ctes(p + 'base', ['x', 'y'], ['x', 'y'], [], ['seg'], p)},
      {p}dq AS (SELECT seg, round(round({OVERALL}, 1), 1) AS dq FROM {p}qp),
      {p}c AS (SELECT seg, corr(x, y) AS r,
                     round((2 * count(*) - count(x) - count(y)) * 100.0 / greatest(count(*) * 2, 1), 2) AS miss
              FROM {p}base GROUP BY seg),
      {p}tr AS (SELECT seg, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
                      covar_pop(x, x) AS c11, covar_pop(x*x, x*x) AS c22, covar_pop(x, x*x) AS c12,
                      covar_pop(x, y) AS c1y, covar_pop(x*x, y) AS c2y, avg(x) AS m1, avg(x*x) AS m2, avg(y) AS my
               FROM {p}base WHERE NOT is_test GROUP BY seg),
      {p}cf AS (SELECT *, (c1y*c22 - c2y*c12) / (c11*c22 - c12*c12) AS pb1, (c2y*c11 - c1y*c12) / (c11*c22 - c12*c12) AS pb2
               FROM {p}tr),
      {p}cf2 AS (SELECT *, my - pb1*m1 - pb2*m2 AS pa FROM {p}cf),
      {p}te AS (SELECT t.seg, sum((t.y - c.a - c.b*t.x) * (t.y - c.a - c.b*t.x)) AS sse1,
                      sum((t.y - c.pa - c.pb1*t.x - c.pb2*t.x*t.x) * (t.y - c.pa - c.pb1*t.x - c.pb2*t.x*t.x)) AS sse2,
                      var_pop(t.y) * count(*) AS sst
               FROM {p}base t JOIN {p}cf2 c ON t.seg = c.seg WHERE t.is_test GROUP BY t.seg),
      {p}m AS (SELECT seg, 1 - sse1 / sst AS r2, round(1 - sse1 / sst, 3) AS lin3, round(1 - sse2 / sst, 3) AS poly3 FROM {p}te),
      {p}ev0 AS (SELECT c.seg, c.r, c.miss, d.dq, m.r2, m.lin3, greatest(m.lin3, m.poly3) AS best3,
                       CASE WHEN coalesce(abs(c.r), 0) < 0.15 THEN 1 ELSE 0 END AS weak,
                       CASE WHEN abs(c.r) > 0.85 THEN 1 ELSE 0 END AS red,
                       CASE WHEN abs(c.r) > 0.85 THEN abs(c.r) ELSE 0.0 END AS maxred
                FROM {p}c c JOIN {p}dq d ON c.seg = d.seg JOIN {p}m m ON c.seg = m.seg),
      {p}ev AS (SELECT seg,
          CAST(weak AS BIGINT) AS weak_features, CAST(1 AS BIGINT) AS total_features,
          CAST(least(100, greatest(0, round_even(weak * 100.0, 0))) AS INTEGER) AS weak_feature_pct,
          CAST(0.0 AS DOUBLE) AS strongest_correlation,
          CAST(red AS BIGINT) AS redundant_pairs_count, {r6('round(maxred, 2)')} AS max_redundancy_correlation,
          {r6('round(r2, 4)')} AS r2_score, {r6('round(r2 * 100, 1)')} AS r2_percentage,
          {r6('round(dq, 1)')} AS data_quality_score, {r6('round(miss, 1)')} AS missing_percentage,
          {r6('round(lin3, 4)')} AS linear_r2, {r6('round(best3, 4)')} AS best_model_r2,
          {r6('round(best3 - lin3, 4)')} AS nonlinear_gain, {r6('round(greatest(best3 - lin3, 0), 4)')} AS best_improvement,
          weak * 100 > 50 AS has_weak_features, red >= 3 AS has_redundancy, r2 < 0.3 AS poor_model_fit, dq < 70 AS poor_data_quality,
          {r6('round(coalesce(abs(r), 0), 3)')} AS target_correlation, r2 AS r2_raw, r AS r_raw
        FROM {p}ev0)"""


def decision_select(src: str, keys: str) -> str:
    """Decision, severity, confidence, bands and verdict flags over an evidence relation ``src``."""
    dq, miss, red, r2, weak = "data_quality_score", "missing_percentage", "redundant_pairs_count", "r2_score", "weak_feature_pct"
    strong, total, gain, imp = "strongest_correlation", "total_features", "nonlinear_gain", "best_improvement"
    best = "coalesce(best_model_r2, -1.0)"
    conds = [
        f"{dq} < 70 OR {miss} >= 10", f"{r2} < 0.10", f"{red} >= 3",
        f"{weak} >= 80 AND {strong} < 0.12 AND {best} < 0.20",
        f"poor_model_fit AND {gain} >= 0.15 AND {best} >= 0.25",
        f"{total} < 3 AND poor_model_fit AND {weak} >= 85 AND {strong} < 0.10",
        f"{weak} > 50 OR {strong} < 0.15",
    ]
    wconf = f"0.65 + least({weak}, 90) / 300.0"
    outs = [
        ("'DATA_ISSUE'", f"CASE WHEN {dq} < 60 OR {miss} >= 20 THEN 'CRITICAL' ELSE 'HIGH' END",
         f"0.78 + CASE WHEN {dq} < 60 THEN 0.15 ELSE 0.0 END"),
        ("'WEAK_SIGNAL'", "'CRITICAL'", f"CASE WHEN {imp} < 0.05 THEN 0.9 ELSE 0.82 END"),
        ("'MULTICOLLINEARITY'", f"CASE WHEN {red} <= 5 THEN 'HIGH' ELSE 'CRITICAL' END", f"0.74 + least({red}, 8) * 0.02"),
        ("'WEAK_FEATURES'", "'HIGH'", wconf),
        ("'NON_LINEARITY'", f"CASE WHEN {r2} < 0.2 THEN 'HIGH' ELSE 'MEDIUM' END", f"0.69 + least({gain}, 0.5) * 0.3"),
        ("'FEATURE_GAP'", "'HIGH'", "0.70"),
        ("'WEAK_FEATURES'", f"CASE WHEN {weak} > 70 THEN 'HIGH' ELSE 'MEDIUM' END", wconf),
    ]
    dflt = ("'WEAK_FEATURES'", "'LOW'", "0.55")

    def case(i):
        return "CASE " + " ".join(f"WHEN {c} THEN {o[i]}" for c, o in zip(conds, outs)) + f" ELSE {dflt[i]} END"

    dec = case(0)
    return f"""SELECT {keys}, {dec} AS decision, {case(1)} AS severity,
        {r6(f'round(least(1.0, greatest(0.0, {case(2)})), 2)')} AS confidence,
        {r2} AS r2_score, {imp} AS best_improvement, {red} AS redundant_pairs_count,
        CASE WHEN {r2} < 0.1 THEN 'critical' WHEN {r2} < 0.3 THEN 'weak' WHEN {r2} < 0.5 THEN 'moderate' ELSE 'good' END AS model_perf,
        CASE WHEN {weak} > 70 THEN 'critical' WHEN {weak} > 50 THEN 'weak' WHEN {weak} > 30 THEN 'moderate' ELSE 'strong' END AS feature_strength,
        CASE WHEN {red} >= 5 THEN 'critical' WHEN {red} >= 3 THEN 'high' ELSE 'low' END AS multicollinearity,
        CASE WHEN {dq} < 60 THEN 'poor' WHEN {dq} < 75 THEN 'fair' WHEN {dq} < 85 THEN 'good' ELSE 'excellent' END AS data_quality,
        lower({dec}) AS primary_issue, {dec} = 'DATA_ISSUE' AS is_data_problem,
        {dec} IN ('MULTICOLLINEARITY', 'WEAK_FEATURES', 'FEATURE_GAP') AS is_feature_problem,
        {dec} = 'NON_LINEARITY' AS is_model_problem
      FROM {src}"""
