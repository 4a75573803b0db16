"""Plain SQL over the registered role views agrees with the role tables."""
from collections import Counter

from callwise.sources.roles import load_roles
from callwise.sources.views import register_role_views


def test_sql_over_views_reads_the_roles(spark, smoke_dir):
    roles = load_roles(spark, smoke_dir)
    register_role_views(spark, roles)
    sql = spark.sql("""
        WITH met AS (SELECT DISTINCT rep_id, doctor_id, quarter FROM visits)
        SELECT region, met.quarter, prescribing_potential AS potential, count(*) AS meetings
        FROM met NATURAL JOIN (SELECT doctor_id, territory_id, prescribing_potential FROM doctors)
        NATURAL JOIN (SELECT territory_id, region FROM territories)
        WHERE rep_id IN (SELECT rep_id FROM reps WHERE experience_yrs > 3)
        GROUP BY ALL""")
    region = {t.territory_id: t.region for t in roles.territories.collect()}
    doctor = {d.doctor_id: (region[d.territory_id], d.prescribing_potential) for d in roles.doctors.collect()}
    senior = {r.rep_id for r in roles.reps.collect() if r.experience_yrs > 3}
    met = {(v.rep_id, v.doctor_id, v.quarter) for v in roles.visits.collect() if v.rep_id in senior}
    expected = Counter((doctor[d][0], q, doctor[d][1]) for _, d, q in met)
    assert expected and {(r.region, r.quarter, r.potential): r.meetings for r in sql.collect()} == expected


def test_sql_over_views_sums_prescriptions(spark, smoke_dir):
    roles = load_roles(spark, smoke_dir)
    register_role_views(spark, roles)
    sql = spark.sql("SELECT product, sum(revenue) AS s FROM prescriptions GROUP BY product")
    expected = Counter()
    for p in roles.prescriptions.collect():
        expected[p.product] += p.revenue
    assert {r["product"]: r.s for r in sql.collect()} == expected
