"""call_plan_sample against a plain-Python run of the same draws on the sf0.001 roles."""
import hashlib
from collections import Counter
from datetime import date, timedelta

import pytest

from callwise.functions.hashing import MODULUS, hash_sql
from callwise.functions.labels import REP_STYLE_WEIGHTS
from callwise.plans import callplan as cp
from callwise.sources.roles import Roles, load_roles


def h(keys, stream):
    text = "|".join(str(k) for k in [stream, *keys])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def brute_force(reps, doctors):
    by_group = {}
    for d in doctors:
        if d["cls"] in cp.CLASSES:
            by_group.setdefault((d["territory_id"], d["cls"]), []).append(d["doctor_id"])
    ranked = {g: sorted(ids, key=lambda i: (h([i], cp.S_SALT) % cp.SALT_BUCKETS, i))
              for g, ids in by_group.items()}
    out = set()
    for rep in reps:
        terr = rep["territory_id"]
        if not any((terr, c) in ranked for c in cp.CLASSES):
            continue  # territory without classified doctors: no row in the size table
        sizes = [len(ranked.get((terr, c), [])) for c in cp.CLASSES]
        w = [REP_STYLE_WEIGHTS[rep["rep_id"] % 3][c] for c in cp.CLASSES]
        for month in range(1, cp.N_MONTHS + 1):
            n = min(cp.CALLS_MIN + h([rep["rep_id"], month], cp.S_CALLS) % cp.CALLS_SPAN, sum(sizes))
            rem, cnt = list(sizes), [0, 0, 0]
            for j in range(1, n + 1):
                u = h([rep["rep_id"], month, j], cp.S_CLASS) / 2 ** 52
                tot = w[0] * rem[0] + w[1] * rem[1] + w[2] * rem[2]
                k = 0 if u * tot < w[0] * rem[0] else 1 if u * tot < w[0] * rem[0] + w[1] * rem[1] else 2
                rem[k] -= 1
                cnt[k] += 1
            for ci, c in enumerate(cp.CLASSES):
                N = sizes[ci]
                chosen = []
                for j in range(N - cnt[ci], N):  # Floyd's uniform c-subset of range(N)
                    t = h([rep["rep_id"], month, ci, j], cp.S_PICK) % (j + 1)
                    chosen.append(j if t in chosen else t)
                for rank in chosen:
                    doc = ranked[(terr, c)][rank]
                    day = h([rep["rep_id"], month, doc], cp.S_DAY) % cp.DAY_SPAN
                    d = date(2024, 1, 1) + timedelta(days=(month - 1) * 30 + day)
                    out.add((rep["rep_id"], month, doc, c, d))
    return out


@pytest.fixture(scope="module")
def roles(spark, smoke_dir):
    return load_roles(spark, smoke_dir)


def test_matches_brute_force(roles):
    got = {(r.rep_id, r.month, r.doctor_id, r.prescribing_potential, r.planned_date)
           for r in cp.call_plan_sample(roles).collect()}
    reps = [r.asDict() for r in roles.reps.select("rep_id", "territory_id").collect()]
    docs = [dict(doctor_id=r.doctor_id, territory_id=r.territory_id, cls=r.prescribing_potential)
            for r in roles.doctors.collect()]
    assert got == brute_force(reps, docs)


def test_plan_invariants(roles):
    plan = cp.call_plan_sample(roles)
    rows = plan.collect()
    keys = [(r.rep_id, r.month, r.doctor_id) for r in rows]
    assert len(keys) == len(set(keys))
    rep_t = {r.rep_id: r.territory_id for r in roles.reps.collect()}
    doc_t = {r.doctor_id: r.territory_id for r in roles.doctors.collect()}
    assert all(rep_t[r.rep_id] == doc_t[r.doctor_id] for r in rows)
    assert all(r.planned_date.month == r.planned_month for r in rows)


def test_class_draws_spread_as_independent_draws(spark):
    """22 draws of a class of probability 1/3: mean 22/3, variance 22 * 2/9 = 4.89."""
    u = f"({hash_sql(['rep', 'month', 'j'], cp.S_CLASS)} / CAST({MODULUS} AS DOUBLE))"
    counts = [r.n for r in spark.sql(f"""
        SELECT rep, month, count_if({u} < 1.0 / 3) AS n
        FROM (SELECT id DIV 264 AS rep, id DIV 22 % 12 AS month, id % 22 AS j FROM range({264 * 400}))
        GROUP BY rep, month""").collect()]
    mean = sum(counts) / len(counts)
    assert len(counts) == 4800 and abs(mean - 22 / 3) < 0.2
    assert 4.4 < sum((c - mean) ** 2 for c in counts) / len(counts) < 5.4


def test_draws_of_neighbouring_keys_are_pairwise_independent(spark):
    a, b = (f"({hash_sql(['id', str(k)], cp.S_PICK)} % 4)" for k in (1, 2))
    seen = Counter((r.a, r.b) for r in spark.sql(f"SELECT {a} AS a, {b} AS b FROM range(32000)").collect())
    assert len(seen) == 16 and all(1800 < n < 2200 for n in seen.values())


def test_rep_style_of_text_ids_is_the_place(spark):
    df = spark.createDataFrame([("R001",), ("R002",), ("R003",), ("R010",)], "rep_id string")
    assert [r.s for r in df.selectExpr(f"{cp.rep_style(df)} AS s").collect()] == [0, 1, 2, 0]


def test_ranked_doctors_are_never_broadcast(spark, tmp_path):
    """They are as many as all doctors, whatever their estimated size."""
    doctors = spark.createDataFrame([(i, i % 3, cp.CLASSES[i % 7 % 3]) for i in range(600)],
                                    "doctor_id long, territory_id int, prescribing_potential string")
    doctors.write.parquet(f"{tmp_path}/doctors")
    doctors = spark.read.parquet(f"{tmp_path}/doctors")       # files have a small estimated size
    reps = spark.createDataFrame([(i, i % 3) for i in range(20)], "rep_id long, territory_id int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        assert "Broadcast" not in cp.ranked_doctors(doctors)._jdf.queryExecution().executedPlan().toString()
        plan = cp.call_plan_sample(Roles(None, reps, doctors, None, None))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [territory_id" in text and "rank" in text.split("SortMergeJoin [territory_id")[1].split("\n")[0]
        got = {(r.rep_id, r.month, r.doctor_id, r.prescribing_potential, r.planned_date) for r in plan.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_force([r.asDict() for r in reps.collect()],
                              [dict(doctor_id=r.doctor_id, territory_id=r.territory_id, cls=r.prescribing_potential) for r in doctors.collect()])
