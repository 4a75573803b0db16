"""Oracle SQL for the BI measures and tables, data-quality checks and draws."""

from __future__ import annotations

from callwise.functions import labels as L
from callwise.oracles import hu, with_roles
from callwise.oracles_more import REP_PERF_CTES

SLICE = {"region": "ASIA", "product": "NeuroCalm", "quarter": 4}


def _draw(keys: list[str], stream: int) -> str:
    """First 13 hex digits of the MD5 of 'stream|key|key...', as a number."""
    text = " || '|' || ".join([f"'{stream}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST('0x' || left(md5({text}), 13) AS BIGINT)"


def _measures(region=None, product=None, quarter=None, by_region=False) -> str:
    rx_where = ["1 = 1"]
    if product is not None:
        rx_where.append(f"p.product = '{product}'")
    if quarter is not None:
        rx_where.append(f"p.quarter = {quarter}")
    reg_where = f"region = '{region}'" if region is not None else "1 = 1"
    key = "region, " if by_region else ""
    extra = REP_PERF_CTES + f""",
rxr AS (SELECT t.region, p.revenue, p.units_prescribed FROM prescriptions p
        LEFT JOIN territories t ON t.territory_id = p.territory_id WHERE {' AND '.join(rx_where)}),
vr AS (SELECT t.region, v.doctor_id, d.prescribing_potential FROM visits v
       LEFT JOIN reps r ON r.rep_id = v.rep_id LEFT JOIN territories t ON t.territory_id = r.territory_id
       LEFT JOIN doctors d ON d.doctor_id = v.doctor_id),
pr AS (SELECT t.region, rp.score_x100 FROM rep_perf rp
       LEFT JOIN reps r ON r.rep_id = rp.rep_id LEFT JOIN territories t ON t.territory_id = r.territory_id),
regions AS (SELECT DISTINCT region FROM (SELECT region FROM rxr UNION ALL SELECT region FROM vr
            UNION ALL SELECT region FROM pr UNION ALL SELECT region FROM territories) WHERE {reg_where}),
agg AS (
 SELECT g.region,
  CAST(COALESCE((SELECT SUM(revenue) FROM rxr WHERE {'rxr.region IS NOT DISTINCT FROM g.region' if by_region else reg_where}), 0) AS BIGINT) AS total_revenue,
  CAST(COALESCE((SELECT SUM(units_prescribed) FROM rxr WHERE {'rxr.region IS NOT DISTINCT FROM g.region' if by_region else reg_where}), 0) AS BIGINT) AS total_units,
  (SELECT COUNT(*) FROM vr WHERE {'vr.region IS NOT DISTINCT FROM g.region' if by_region else reg_where}) AS total_visits,
  (SELECT COUNT(DISTINCT doctor_id) FROM vr WHERE {'vr.region IS NOT DISTINCT FROM g.region' if by_region else reg_where}) AS unique_doctors_visited,
  (SELECT CAST(SUM(score_x100) AS DOUBLE) / (COUNT(score_x100) * 100) FROM pr WHERE {'pr.region IS NOT DISTINCT FROM g.region' if by_region else reg_where}) AS avg_efficiency_score,
  (SELECT SUM(market_potential) FROM territories t WHERE {'t.region IS NOT DISTINCT FROM g.region' if by_region else reg_where}) AS mp,
  (SELECT COUNT(*) FROM vr WHERE prescribing_potential = 'High' AND {'vr.region IS NOT DISTINCT FROM g.region' if by_region else reg_where}) AS high_calls,
  (SELECT COUNT(*) FROM vr WHERE prescribing_potential = 'Low' AND {'vr.region IS NOT DISTINCT FROM g.region' if by_region else reg_where}) AS wasted_calls
 FROM {'regions g' if by_region else '(SELECT NULL AS region) g'})"""
    body = f"""
SELECT {key}total_revenue, total_units, total_visits, unique_doctors_visited,
 CASE WHEN avg_efficiency_score IS NULL THEN NULL ELSE avg_efficiency_score END AS avg_efficiency_score,
 COALESCE(total_revenue / NULLIF(mp, 0), 0.0) * 100 AS market_capture_pct,
 COALESCE(total_revenue / NULLIF(total_visits, 0), 0.0) AS revenue_per_visit,
 COALESCE(high_calls / NULLIF(total_visits, 0), 0.0) * 100 AS high_potential_call_pct,
 wasted_calls
FROM agg"""
    return with_roles(body, extra)


def _rx_filter(region=None, product=None, quarter=None) -> str:
    w = ["1 = 1"]
    if product is not None:
        w.append(f"p.product = '{product}'")
    if quarter is not None:
        w.append(f"p.quarter = {quarter}")
    if region is not None:
        w.append(f"p.territory_id IN (SELECT territory_id FROM territories WHERE region = '{region}')")
    return " AND ".join(w)


def _qoq(region=None, product=None) -> str:
    return with_roles(f"""
SELECT q.quarter, q.revenue, p.revenue AS prev_revenue,
 COALESCE((q.revenue - COALESCE(p.revenue, 0)) / NULLIF(p.revenue, 0), 0.0) * 100 AS growth_pct
FROM qr q LEFT JOIN qr p ON p.quarter = q.quarter - 1""", f"""
qr AS (SELECT p.quarter, CAST(SUM(p.revenue) AS BIGINT) AS revenue FROM prescriptions p
       WHERE {_rx_filter(region, product)} GROUP BY p.quarter)""")


def _rev_by_product(region=None, product=None, quarter=None) -> str:
    f = _rx_filter(region, product, quarter)
    return with_roles(f"""
SELECT p.product, CAST(SUM(p.revenue) AS BIGINT) AS total_revenue,
 {hu('SUM(p.revenue)', f'(SELECT SUM(p.revenue) FROM prescriptions p WHERE {f})', 100, 1)} AS revenue_share_pct
FROM prescriptions p WHERE {f} GROUP BY p.product""")


def _perf(body: str) -> str:
    return with_roles(body, REP_PERF_CTES)


def _pk(table: str, keys: str) -> str:
    k = [x.strip() for x in keys.split(",")]
    null = " OR ".join(f"{x} IS NULL" for x in k)
    return f"""SELECT '{table}' AS table_name, '{keys.replace(' ', '')}' AS key_columns,
 CAST(COUNT(*) AS BIGINT) AS n_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT {keys} FROM {table})) AS n_keys,
 (SELECT COUNT(*) FROM (SELECT {keys} FROM {table} GROUP BY {keys} HAVING COUNT(*) > 1)) AS n_duplicated_keys,
 CAST(COUNT(*) FILTER (WHERE {null}) AS BIGINT) AS n_null_key_rows FROM {table}"""


def _fk(child: str, fk: str, parent: str, pk: str) -> str:
    return f"""SELECT '{child}' AS child_table, '{fk}' AS fk_column, '{parent}' AS parent_table,
 CAST(COUNT(c.{fk}) AS BIGINT) AS orphan_rows, COUNT(DISTINCT c.{fk}) AS orphan_keys
FROM {child} c LEFT JOIN {parent} p ON c.{fk} = p.{pk} WHERE c.{fk} IS NOT NULL AND p.{pk} IS NULL"""


PK_TABLES = [("territories", "territory_id"), ("reps", "rep_id"), ("doctors", "doctor_id"),
             ("visits", "visit_id"), ("prescriptions", "prescription_id"),
             ("prescriptions", "doctor_id, product, month")]
FK_EDGES = [("reps", "territory_id", "territories", "territory_id"),
            ("doctors", "territory_id", "territories", "territory_id"),
            ("visits", "rep_id", "reps", "rep_id"),
            ("visits", "doctor_id", "doctors", "doctor_id"),
            ("prescriptions", "territory_id", "territories", "territory_id"),
            ("prescriptions", "doctor_id", "doctors", "doctor_id"),
            ("rep_performance", "rep_id", "reps", "rep_id"),
            ("doctor_segments", "doctor_id", "doctors", "doctor_id")]

_AFF = ("CASE " + " ".join(f"WHEN product = '{p}' AND specialty = '{sp}' THEN {bp}"
                           for (p, sp), bp in L.AFFINITY_BP.items())
        + f" ELSE {L.AFFINITY_DEFAULT_BP} END")
_MULT = ("CASE prescribing_potential "
         + " ".join(f"WHEN '{k}' THEN {m}" for k, m in L.POTENTIAL_MULTIPLIER_X10.items()) + " END")
_PRICE = "CASE product " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.PRODUCT_PRICE.items()) + " END"
_BOOST, _BOOST_CAP, _CAP = (int(round(10000 * v)) for v in
                            (L.FREQ_BOOST_PER_VISIT, L.FREQ_BOOST_CAP, L.PROBABILITY_CAP))
_SCALE10 = int(round(10 * L.PROBABILITY_SCALE))
EXPECTED_CTE = f"""
expected AS (
 SELECT c.doctor_id, c.product, c.month, c.n_visits, d.prescribing_potential,
  CAST({_AFF.replace('product', 'c.product').replace('specialty', 'd.specialty')} AS DOUBLE) / 10000.0 AS affinity,
  CAST(least({_AFF.replace('product', 'c.product').replace('specialty', 'd.specialty')}
             + least(c.n_visits * {_BOOST}, {_BOOST_CAP}), {_CAP})
       * {_MULT.replace('prescribing_potential', 'd.prescribing_potential')} * {_SCALE10} AS BIGINT) AS p_ppm
 FROM (SELECT doctor_id, product, month, COUNT(visit_id) AS n_visits FROM visits GROUP BY doctor_id, product, month) c
 JOIN doctors d ON d.doctor_id = c.doctor_id)"""
_PIDX = "CASE product WHEN 'CardioMax' THEN 0 WHEN 'DiabeCure' THEN 1 WHEN 'NeuroCalm' THEN 2 ELSE 3 END"


def bi_sql() -> dict[str, str]:
    s = SLICE
    out = {
        "bi_measures": _measures(),
        "bi_measures_sliced": _measures(s["region"], s["product"], s["quarter"]),
        "bi_measures_by_region": _measures(by_region=True),
        "qoq_growth": _qoq(),
        "qoq_growth_sliced": _qoq(s["region"], s["product"]),
        "revenue_by_product": _rev_by_product(),
        "quarterly_revenue_by_product": with_roles("""
SELECT quarter, product, CAST(SUM(revenue) AS BIGINT) AS total_revenue FROM prescriptions GROUP BY quarter, product"""),
        "revenue_by_product_sliced": _rev_by_product(region=s["region"], quarter=s["quarter"]),
        "quarterly_revenue_by_product_sliced": with_roles(f"""
SELECT p.quarter, p.product, CAST(SUM(p.revenue) AS BIGINT) AS total_revenue FROM prescriptions p
WHERE {_rx_filter(region=s["region"])} GROUP BY p.quarter, p.product"""),
        "sales_cube": with_roles("""
SELECT CAST(GROUPING(t.region, p.product, p.quarter, p.month) AS INT) AS gid, t.region, p.product, p.quarter, p.month,
 CAST(SUM(p.revenue) AS BIGINT) AS total_revenue, CAST(SUM(p.units_prescribed) AS BIGINT) AS total_units, COUNT(*) AS n_prescriptions
FROM prescriptions p LEFT JOIN territories t ON t.territory_id = p.territory_id
GROUP BY CUBE (t.region, p.product, p.quarter, p.month)"""),
        "monthly_revenue_sliced": with_roles(f"""
SELECT p.month, CAST(SUM(p.revenue) AS BIGINT) AS total_revenue FROM prescriptions p
WHERE {_rx_filter(s["region"], s["product"])} GROUP BY p.month"""),
        "rep_scorecard_banded": _perf(f"""
SELECT rep_id, rep_name, efficiency_score, high_pct, low_pct, total_calls, call_achievement_pct, total_revenue,
 CASE WHEN score_x100 >= {L.SCORE_BANDS_X100['Green']} THEN 'Green'
  WHEN score_x100 >= {L.SCORE_BANDS_X100['Yellow']} THEN 'Yellow' ELSE 'Red' END AS score_band
FROM rep_perf"""),
        "call_distribution": with_roles("""
SELECT r.rep_name, d.prescribing_potential, COUNT(*) AS call_count
FROM visits v JOIN reps r ON v.rep_id = r.rep_id JOIN doctors d ON v.doctor_id = d.doctor_id
GROUP BY r.rep_name, d.prescribing_potential"""),
        "efficiency_vs_revenue": _perf(
            "SELECT rep_id, rep_name, efficiency_score, total_revenue, total_calls FROM rep_perf"),
        "territory_scorecard": with_roles("""
SELECT t.territory_id, t.territory_name, t.region, t.market_potential,
 CAST(COALESCE(SUM(p.revenue), 0) AS BIGINT) AS total_revenue,
 COALESCE(COALESCE(SUM(p.revenue), 0) / NULLIF(t.market_potential, 0), 0.0) * 100 AS market_capture_pct
FROM territories t LEFT JOIN prescriptions p ON p.territory_id = t.territory_id
GROUP BY t.territory_id, t.territory_name, t.region, t.market_potential"""),
        "visits_month_name": with_roles(
            "SELECT visit_id, monthname(visit_date) AS visit_month_name FROM visits"),
        "rx_quarter_label": with_roles(
            "SELECT prescription_id, concat('Q', CAST(quarter AS VARCHAR)) AS quarter_label FROM prescriptions"),
        "calendar_fields": with_roles("""
SELECT visit_id, visit_date, CAST(month(visit_date) AS INT) AS month, CAST(quarter(visit_date) AS INT) AS quarter
FROM visits"""),
        "formatted_ids": with_roles("""
SELECT 'territory' AS entity, CAST(territory_id AS BIGINT) AS id, printf('T%02d', territory_id) AS code FROM territories
UNION ALL SELECT 'rep', CAST(rep_id AS BIGINT), printf('R%03d', rep_id) FROM reps
UNION ALL SELECT 'doctor', CAST(doctor_id AS BIGINT), printf('D%04d', doctor_id) FROM doctors"""),
        "pk_violations": with_roles("\nUNION ALL\n".join(_pk(t, k) for t, k in PK_TABLES)),
        "expected_rx_probability": with_roles("""
SELECT doctor_id, product, month, CAST(n_visits AS BIGINT) AS n_visits, affinity, p_ppm,
 CAST(p_ppm AS DOUBLE) / 1e6 AS probability FROM expected""", EXPECTED_CTE),
    }
    out["call_plan_sample"] = call_plan_sql()
    return out


def fk_sql(extra_ctes: str) -> str:
    return with_roles("\nUNION ALL\n".join(_fk(*e) for e in FK_EDGES), extra_ctes)


def call_plan_sql() -> str:
    """The call-plan sampler in plain SQL: a recursive CTE runs the successive class draws."""
    from callwise.plans import callplan as cp
    from callwise.functions.labels import REP_STYLE_WEIGHTS as W

    def weight(cls: str) -> str:
        return ("CASE rep_id % 3 " + " ".join(f"WHEN {i} THEN {w[cls]}" for i, w in enumerate(W))
                + " END")
    u = f"(CAST({_draw(['rep_id', 'month', 'j + 1'], cp.S_CLASS)} AS DOUBLE) / 4503599627370496)"
    tot = "(wh * h + wm * m + wl * l)"
    pick = f"(CASE WHEN {u} * {tot} < wh * h THEN 0 WHEN {u} * {tot} < wh * h + wm * m THEN 1 ELSE 2 END)"
    key = ["rep_id", "month", "ci"]
    extra = f"""
sizes AS (
 SELECT territory_id, COUNT(*) FILTER (WHERE prescribing_potential = 'High') AS n_high,
  COUNT(*) FILTER (WHERE prescribing_potential = 'Medium') AS n_medium,
  COUNT(*) FILTER (WHERE prescribing_potential = 'Low') AS n_low
 FROM doctors WHERE prescribing_potential IN ('High', 'Medium', 'Low') GROUP BY territory_id),
rm AS (
 SELECT r.rep_id, r.territory_id, CAST(mm.month AS INT) AS month, s.n_high, s.n_medium, s.n_low,
  least({cp.CALLS_MIN} + {_draw(['r.rep_id', 'mm.month'], cp.S_CALLS)} % {cp.CALLS_SPAN},
        s.n_high + s.n_medium + s.n_low) AS n,
  {weight('High').replace('rep_id', 'r.rep_id')} AS wh, {weight('Medium').replace('rep_id', 'r.rep_id')} AS wm,
  {weight('Low').replace('rep_id', 'r.rep_id')} AS wl
 FROM reps r JOIN sizes s ON s.territory_id = r.territory_id
 CROSS JOIN (SELECT range AS month FROM range(1, {cp.N_MONTHS + 1})) mm),
steps AS (
 SELECT rep_id, territory_id, month, n, wh, wm, wl, 0 AS j, n_high AS h, n_medium AS m, n_low AS l,
  n_high, n_medium, n_low, 0 AS ch, 0 AS cm, 0 AS cl FROM rm
 UNION ALL
 SELECT rep_id, territory_id, month, n, wh, wm, wl, j + 1,
  h - CASE WHEN {pick} = 0 THEN 1 ELSE 0 END, m - CASE WHEN {pick} = 1 THEN 1 ELSE 0 END,
  l - CASE WHEN {pick} = 2 THEN 1 ELSE 0 END, n_high, n_medium, n_low,
  ch + CASE WHEN {pick} = 0 THEN 1 ELSE 0 END, cm + CASE WHEN {pick} = 1 THEN 1 ELSE 0 END,
  cl + CASE WHEN {pick} = 2 THEN 1 ELSE 0 END
 FROM steps WHERE j < n),
per_class AS (
 SELECT rep_id, territory_id, month, 'High' AS cls, 0 AS ci, ch AS c, n_high AS nn FROM steps WHERE j = n
 UNION ALL SELECT rep_id, territory_id, month, 'Medium', 1, cm, n_medium FROM steps WHERE j = n
 UNION ALL SELECT rep_id, territory_id, month, 'Low', 2, cl, n_low FROM steps WHERE j = n),
floyd AS (
 SELECT rep_id, territory_id, month, cls, ci, nn, c, nn - c AS j, CAST([] AS BIGINT[]) AS acc
 FROM per_class WHERE c > 0
 UNION ALL
 SELECT rep_id, territory_id, month, cls, ci, nn, c, j + 1,
  CASE WHEN list_contains(acc, {_draw(key + ['j'], cp.S_PICK)} % (j + 1)) THEN list_append(acc, j)
       ELSE list_append(acc, {_draw(key + ['j'], cp.S_PICK)} % (j + 1)) END
 FROM floyd WHERE j < nn),
picks AS (SELECT rep_id, territory_id, month, cls, unnest(acc) AS rnk FROM floyd WHERE j = nn),
ranked AS (
 SELECT territory_id, prescribing_potential AS cls, doctor_id,
  ROW_NUMBER() OVER (PARTITION BY territory_id, prescribing_potential
                     ORDER BY {_draw(['doctor_id'], cp.S_SALT)} % {cp.SALT_BUCKETS}, doctor_id) - 1 AS rnk
 FROM doctors WHERE prescribing_potential IN ('High', 'Medium', 'Low')),
plan AS (
 SELECT p.rep_id, p.month, r.doctor_id, p.cls AS prescribing_potential,
  CAST('{cp.PLAN_START}' AS DATE) + CAST((p.month - 1) * 30
    + {_draw(['p.rep_id', 'p.month', 'r.doctor_id'], cp.S_DAY)} % {cp.DAY_SPAN} AS INTEGER) AS planned_date
 FROM picks p JOIN ranked r ON r.territory_id = p.territory_id AND r.cls = p.cls AND r.rnk = p.rnk)"""
    body = """
SELECT rep_id, month, doctor_id, prescribing_potential, planned_date,
 CAST(month(planned_date) AS INT) AS planned_month, CAST(quarter(planned_date) AS INT) AS planned_quarter
FROM plan"""
    return with_roles(body, extra).replace("WITH ", "WITH RECURSIVE ", 1)
