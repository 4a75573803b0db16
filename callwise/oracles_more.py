"""Oracle SQL for the analysis-script, doctor-feature, BI and data-quality queries."""

from __future__ import annotations

from callwise.oracles import hu, hu_units, with_roles

# rep_calls / rep_performance in plain SQL
REP_PERF_CTES = f"""
rep_calls AS (
 SELECT v.rep_id,
  COUNT(*) FILTER (WHERE d.prescribing_potential = 'High') AS "High",
  COUNT(*) FILTER (WHERE d.prescribing_potential = 'Low') AS "Low",
  COUNT(*) FILTER (WHERE d.prescribing_potential = 'Medium') AS "Medium"
 FROM visits v JOIN doctors d ON v.doctor_id = d.doctor_id GROUP BY v.rep_id),
rep_rev AS (
 SELECT v.rep_id, SUM(p.revenue) AS total_revenue
 FROM prescriptions p JOIN visits v ON v.doctor_id = p.doctor_id AND v.product = p.product AND v.month = p.month
 GROUP BY v.rep_id),
rep_perf AS (
 SELECT c.rep_id, c."High", c."Low", c."Medium", c."High" + c."Medium" + c."Low" AS total_calls,
  {hu_units('6 * c."High" + 3 * c."Medium" + c."Low"', '2 * (c."High" + c."Medium" + c."Low")', 1, 2)} AS score_x100,
  {hu('6 * c."High" + 3 * c."Medium" + c."Low"', '2 * (c."High" + c."Medium" + c."Low")', 1, 2)} AS efficiency_score,
  {hu('c."High"', 'c."High" + c."Medium" + c."Low"', 100, 1)} AS high_pct,
  {hu('c."Low"', 'c."High" + c."Medium" + c."Low"', 100, 1)} AS low_pct,
  r.rep_name, r.target_calls, r.experience_yrs,
  CAST(COALESCE(rr.total_revenue, 0) AS BIGINT) AS total_revenue,
  {hu('c."High" + c."Medium" + c."Low"', 'r.target_calls', 100, 1)} AS call_achievement_pct,
  {hu('COALESCE(rr.total_revenue, 0)', 'c."High" + c."Medium" + c."Low"', 1, 0)} AS revenue_per_call
 FROM rep_calls c JOIN reps r ON c.rep_id = r.rep_id LEFT JOIN rep_rev rr ON rr.rep_id = c.rep_id)
"""

PERF_COLS = ('rep_id, "High", "Low", "Medium", total_calls, efficiency_score, high_pct, low_pct, rep_name, '
             'target_calls, experience_yrs, total_revenue, call_achievement_pct, revenue_per_call')


def perf(body: str, extra: str = "") -> str:
    return with_roles(body, REP_PERF_CTES + ("," + extra if extra else ""))


def median_sql(col: str, rel: str) -> str:
    """Interpolated median written out: mean of the two middle values ((a + b) / 2)."""
    return f"""(SELECT (MIN(x) FILTER (WHERE rn = (n + 1) // 2) + MIN(x) FILTER (WHERE rn = (n + 2) // 2)) / 2
 FROM (SELECT {col} AS x, ROW_NUMBER() OVER (ORDER BY {col}) AS rn, COUNT(*) OVER () AS n
       FROM {rel} WHERE {col} IS NOT NULL))"""


SCRIPT_SQL = {
    "kpi_summary": with_roles("""
SELECT CAST((SELECT SUM(revenue) FROM prescriptions) AS BIGINT) AS total_revenue,
 (SELECT COUNT(*) FROM visits) AS total_visits,
 (SELECT COUNT(DISTINCT doctor_id) FROM visits) AS doctors_reached,
 (SELECT COUNT(*) FROM doctors) AS total_doctors,
 (SELECT COUNT(*) FROM visits) / (SELECT COUNT(DISTINCT doctor_id) FROM visits) AS avg_visit_frequency,
 (SELECT product FROM prescriptions GROUP BY product ORDER BY SUM(revenue) DESC, product LIMIT 1) AS top_product"""),
    "rep_efficiency": perf('SELECT rep_id, "High", "Medium", "Low", total_calls, efficiency_score, high_pct, low_pct FROM rep_perf'),
    "rep_revenue": with_roles("""
SELECT v.rep_id, CAST(SUM(p.revenue) AS BIGINT) AS total_revenue
FROM prescriptions p LEFT JOIN visits v ON v.doctor_id = p.doctor_id AND v.product = p.product AND v.month = p.month
WHERE v.rep_id IS NOT NULL GROUP BY v.rep_id"""),
    "rep_performance": perf(f"SELECT {PERF_COLS} FROM rep_perf"),
    "top_reps_by_efficiency": perf("""
SELECT rep_id, rep_name, efficiency_score, high_pct, low_pct, total_revenue FROM rep_perf
ORDER BY efficiency_score DESC NULLS LAST, rep_id LIMIT 5"""),
    "bottom_reps_by_low_pct": perf("""
SELECT rep_id, rep_name, low_pct, high_pct, efficiency_score, total_revenue FROM rep_perf
ORDER BY low_pct DESC NULLS LAST, rep_id LIMIT 5"""),
    "rep_efficiency_chart": perf(f"""
SELECT rep_id, rep_name, efficiency_score, {median_sql('score_x100', 'rep_perf')} / 100.0 AS median_score,
 CASE WHEN score_x100 < {median_sql('score_x100', 'rep_perf')} THEN 'below' ELSE 'above' END AS band
FROM rep_perf ORDER BY efficiency_score DESC NULLS LAST, rep_id LIMIT 12"""),
    "efficiency_by_rep": perf(f"""
SELECT rep_id, rep_name, efficiency_score, {median_sql('score_x100', 'rep_perf')} / 100.0 AS median_score,
 CASE WHEN score_x100 < {median_sql('score_x100', 'rep_perf')} THEN 'below' ELSE 'above' END AS band
FROM rep_perf"""),
    "call_mix_pct": perf("""
SELECT rep_id, "High" / total_calls * 100 AS "High", "Medium" / total_calls * 100 AS "Medium",
 "Low" / total_calls * 100 AS "Low" FROM rep_perf"""),
    "monthly_revenue_pivot": with_roles("""
SELECT month, "CardioMax", "DiabeCure", "NeuroCalm", other, total_revenue, other / 1e6 AS other_m,
 "CardioMax" / 1e6 AS "CardioMax_m", "DiabeCure" / 1e6 AS "DiabeCure_m", "NeuroCalm" / 1e6 AS "NeuroCalm_m",
 total_revenue / 1e6 AS total_revenue_m
FROM (SELECT month,
  CAST(COALESCE(SUM(revenue) FILTER (WHERE product = 'CardioMax'), 0) AS BIGINT) AS "CardioMax",
  CAST(COALESCE(SUM(revenue) FILTER (WHERE product = 'DiabeCure'), 0) AS BIGINT) AS "DiabeCure",
  CAST(COALESCE(SUM(revenue) FILTER (WHERE product = 'NeuroCalm'), 0) AS BIGINT) AS "NeuroCalm",
  CAST(COALESCE(SUM(revenue) FILTER (WHERE product IS NULL OR product NOT IN ('CardioMax', 'DiabeCure', 'NeuroCalm')), 0) AS BIGINT) AS other,
  CAST(SUM(revenue) AS BIGINT) AS total_revenue
 FROM prescriptions GROUP BY month)"""),
    "quarterly_revenue": with_roles("""
SELECT q.quarter, CAST(COALESCE((SELECT SUM(revenue) FROM prescriptions p
  WHERE p.month BETWEEN (q.quarter - 1) * 3 + 1 AND q.quarter * 3), 0) AS BIGINT) AS revenue
FROM (SELECT CAST(range AS INT) AS quarter FROM range(1, 5)) q"""),
    "territory_capture": with_roles(f"""
SELECT replace(territory_name, ' Zone', '') AS short_name, territory_name, market_potential, revenue, capture_pct,
 {median_sql('capture_pct', 'tc')} AS median_capture_pct,
 CASE WHEN capture_pct >= {median_sql('capture_pct', 'tc')} THEN 'above' ELSE 'below' END AS band
FROM tc""", """
tc AS (SELECT t.territory_name, t.market_potential, CAST(SUM(p.revenue) AS BIGINT) AS revenue,
  SUM(p.revenue) / NULLIF(t.market_potential, 0) * 100 AS capture_pct
 FROM prescriptions p JOIN territories t ON p.territory_id = t.territory_id
 GROUP BY t.territory_name, t.market_potential)"""),
    "product_mix_by_territory": with_roles("""
SELECT territory_name, "CardioMax" / tot * 100 AS "CardioMax", "DiabeCure" / tot * 100 AS "DiabeCure",
 "NeuroCalm" / tot * 100 AS "NeuroCalm", other / tot * 100 AS other
FROM (SELECT t.territory_name,
  COALESCE(SUM(p.revenue) FILTER (WHERE p.product = 'CardioMax'), 0) AS "CardioMax",
  COALESCE(SUM(p.revenue) FILTER (WHERE p.product = 'DiabeCure'), 0) AS "DiabeCure",
  COALESCE(SUM(p.revenue) FILTER (WHERE p.product = 'NeuroCalm'), 0) AS "NeuroCalm",
  COALESCE(SUM(p.revenue) FILTER (WHERE p.product IS NULL OR p.product NOT IN ('CardioMax', 'DiabeCure', 'NeuroCalm')), 0) AS other,
  SUM(p.revenue) AS tot
 FROM prescriptions p JOIN territories t ON p.territory_id = t.territory_id GROUP BY t.territory_name)"""),
}

# ---------------------------------------------------------------------------
# doctor features, exact z-scores, level centroids
# ---------------------------------------------------------------------------
FEATURES = ["potential_score", "total_visits", "total_revenue", "unique_products", "months_active"]

FEATURE_CTES = """
doc_visits AS (
 SELECT doctor_id, COUNT(visit_id) AS total_visits, COUNT(DISTINCT product) AS unique_products,
  SUM(duration_min) / COUNT(duration_min) AS avg_duration, SUM(samples_left) AS samples_received
 FROM visits GROUP BY doctor_id),
doc_revenue AS (
 SELECT doctor_id, SUM(revenue) AS total_revenue, SUM(units_prescribed) AS total_units,
  COUNT(DISTINCT month) AS months_active
 FROM prescriptions GROUP BY doctor_id),
feats AS (
 SELECT d.doctor_id, d.potential_score, d.years_in_practice,
  CAST(COALESCE(v.total_visits, 0) AS BIGINT) AS total_visits,
  CAST(COALESCE(v.unique_products, 0) AS BIGINT) AS unique_products,
  COALESCE(v.avg_duration, 0.0) AS avg_duration,
  CAST(COALESCE(v.samples_received, 0) AS BIGINT) AS samples_received,
  CAST(COALESCE(r.total_revenue, 0) AS BIGINT) AS total_revenue,
  CAST(COALESCE(r.total_units, 0) AS BIGINT) AS total_units,
  CAST(COALESCE(r.months_active, 0) AS BIGINT) AS months_active
 FROM doctors d LEFT JOIN doc_visits v ON v.doctor_id = d.doctor_id LEFT JOIN doc_revenue r ON r.doctor_id = d.doctor_id),
moments AS (
 SELECT CAST(COUNT(*) AS HUGEINT) AS n, """ + ", ".join(
    f"SUM(CAST({c} AS HUGEINT)) AS s_{c}, SUM(CAST({c} AS HUGEINT) * {c}) AS ss_{c}" for c in FEATURES) + """
 FROM feats),
scaled AS (
 SELECT f.doctor_id, """ + ", ".join(
    f"CASE WHEN m.n * m.ss_{c} - m.s_{c} * m.s_{c} = 0 THEN 0.0 ELSE "
    f"CAST(m.n * f.{c} - m.s_{c} AS DOUBLE) / sqrt(CAST(m.n * m.ss_{c} - m.s_{c} * m.s_{c} AS DOUBLE)) END AS {c}"
    for c in FEATURES) + """
 FROM feats f, moments m),
levels AS (
 SELECT * FROM (VALUES ('High', 0), ('Medium', 1), ('Low', 2)) t(prescribing_potential, cluster)),
centroids AS (
 SELECT l.cluster, """ + ", ".join(
    f"CASE WHEN m.n * m.ss_{c} - m.s_{c} * m.s_{c} = 0 THEN 0.0 ELSE "
    f"CAST(m.n * g.sg_{c} - g.ng * m.s_{c} AS DOUBLE) / (CAST(g.ng AS DOUBLE) * "
    f"sqrt(CAST(m.n * m.ss_{c} - m.s_{c} * m.s_{c} AS DOUBLE))) END AS c_{c}" for c in FEATURES) + """
 FROM (SELECT d.prescribing_potential, CAST(COUNT(*) AS HUGEINT) AS ng, """ + ", ".join(
    f"SUM(CAST(f.{c} AS HUGEINT)) AS sg_{c}" for c in FEATURES) + """
       FROM feats f JOIN doctors d ON d.doctor_id = f.doctor_id GROUP BY d.prescribing_potential) g
 JOIN levels l ON l.prescribing_potential = g.prescribing_potential, moments m),
dist AS (
 SELECT s.doctor_id, c.cluster, """ + " + ".join(
    f"(s.{c} - c.c_{c}) * (s.{c} - c.c_{c})" for c in FEATURES) + """ AS d2
 FROM scaled s, centroids c),
assigned AS (
 SELECT doctor_id, cluster, round(sqrt(d2), 9) AS distance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY doctor_id ORDER BY d2, cluster) AS rk FROM dist) WHERE rk = 1)
"""


def feat(body: str, extra: str = "") -> str:
    return with_roles(body, FEATURE_CTES + ("," + extra if extra else ""))


DOCTOR_SQL = {
    "doctor_features": feat("""
SELECT doctor_id, potential_score, years_in_practice, total_visits, unique_products, avg_duration,
 samples_received, total_revenue, total_units, months_active FROM feats"""),
    "doctor_features_scaled": feat("SELECT * FROM scaled"),
    "feature_medians": feat(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({median_sql(c, 'feats')} AS DOUBLE) AS median" for c in [*FEATURES, "avg_duration", "total_units"])),
    "nearest_centroid": feat("SELECT doctor_id, cluster, distance FROM assigned"),
    "cluster_profile": feat(f"""
SELECT cluster, n_doctors, {", ".join(FEATURES)},
 CASE WHEN total_revenue > {median_sql('total_revenue', 'prof')} AND total_visits > {median_sql('total_visits', 'prof')}
   THEN '🟢 High Value - Well Covered'
  WHEN total_revenue > {median_sql('total_revenue', 'prof')} THEN '🔵 High Value - Under-visited'
  WHEN total_visits > {median_sql('total_visits', 'prof')} THEN '🔴 Low Value - Over-visited'
  ELSE '🟡 Low Value - Low Coverage' END AS label
FROM prof""", """
prof AS (SELECT a.cluster, COUNT(*) AS n_doctors, """ + ", ".join(
        f"CAST(SUM(f.{c}) AS DOUBLE) / COUNT(f.{c}) AS {c}" for c in FEATURES) + """
 FROM feats f JOIN assigned a ON a.doctor_id = f.doctor_id GROUP BY a.cluster)"""),
}


def more_sql() -> dict[str, str]:
    out = dict(SCRIPT_SQL)
    out.update(DOCTOR_SQL)
    from callwise import oracles_bi
    out.update(oracles_bi.bi_sql())
    from callwise.oracles_kmeans import kmeans_sql
    out.update(kmeans_sql())
    out["fk_orphans"] = oracles_bi.fk_sql(
        REP_PERF_CTES + "," + FEATURE_CTES
        + ", rep_performance AS (SELECT rep_id FROM rep_perf), doctor_segments AS (SELECT doctor_id FROM feats)")
    amounts = {"territories": "market_potential", "reps": "target_calls", "doctors": "potential_score", "prescriptions": "revenue"}
    whole = " UNION ALL ".join(f"SELECT '{t}' AS table_name, 'good' AS outcome, COUNT(*) AS n_rows, CAST(SUM({c}) AS BIGINT) AS amount FROM {t}"
                               for t, c in amounts.items())
    out["csv_intake"] = with_roles(f"""
{whole} UNION ALL
SELECT 'visits', outcome, COUNT(*), CAST(SUM(CASE WHEN outcome = 'good' THEN duration_min END) AS BIGINT) FROM (
 SELECT duration_min, CASE WHEN doctor_id % 50 <> 7 THEN 'good' WHEN duration_min % 2 = 0 THEN 'bad visit_date'
  WHEN samples_left = 0 THEN 'wrong number of fields' ELSE 'good' END AS outcome FROM visits) GROUP BY outcome""")
    out["csv_round_trip"] = perf(f"SELECT {PERF_COLS} FROM rep_perf")
    out["rep_efficiency_streamed"] = SCRIPT_SQL["rep_efficiency"]
    return out
