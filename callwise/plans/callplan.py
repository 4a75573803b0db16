"""Call-plan sampler: for each rep and month, a set of doctors from the rep's
territory drawn without replacement, weighted by doctor potential and rep style.

Weights take one value per potential class (High / Medium / Low) for a given rep,
so sequential weighted sampling without replacement splits into two exact steps,
neither of which looks at (rep, doctor) pairs:

1. How many doctors of each class: the class of each successive draw has
   probability w_c r_c / sum(w r) over the classes' remaining counts r. This is a
   <= 27-step loop per (rep, month), run JVM-side with the ``aggregate`` higher-order
   function over ``sequence(1, n)``.
2. Which doctors within a class: a uniform random c-subset of the class's N ranks
   by Floyd's algorithm (c keyed draws, again one ``aggregate`` over a <= 27-element
   sequence). The picked ranks are equi-joined to the doctors ranked within
   (territory, class).

Given the class counts, every subset of a class is equally likely, which is
exactly the law of successive weighted draws when weights are equal within a
class; so the plan has the distribution of weighted sampling without replacement.

Ranks inside (territory, class) are built without one task per group: a salt
bucket (keyed hash of the doctor) splits each group, ``row_number`` runs per
(group, bucket), and bucket offsets come from a running sum over at most
``SALT_BUCKETS`` counts per group. A territory with a third of all doctors is
therefore ranked by many tasks. The ranked doctors are as many as all doctors, so both joins
on them are merge joins: their estimated size is that of the compressed columns, by which
Spark would broadcast them from the driver.

Work grows with reps x months x draws plus one pass over doctors; the result has
one row per planned call. Draws use keyed MD5 draws, so the plan repeats
exactly run to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwise.functions.hashing import MODULUS, hash_sql
from callwise.functions.labels import REP_STYLE_WEIGHTS
from callwise.sources.roles import Roles

# fixed plan parameters
N_MONTHS = 12
PLAN_START = "2024-01-01"        # month m starts 30 * (m - 1) days later
CALLS_MIN, CALLS_SPAN = 18, 10   # calls per rep-month: 18..27, capped at the doctors available
DAY_SPAN = 28                    # planned day within the 30-day window: 0..27
SALT_BUCKETS = 256
CLASSES = ["High", "Medium", "Low"]

S_CALLS, S_CLASS, S_PICK, S_DAY, S_SALT, S_STYLE = 11, 12, 13, 15, 16, 17


def ranked_doctors(doctors: DataFrame) -> DataFrame:
    """(territory_id, cls, rank, doctor_id): dense 0-based rank by doctor_id within
    (territory, class), skew-safe through salt buckets."""
    d = (doctors.select("doctor_id", "territory_id", F.col("prescribing_potential").alias("cls"))
         .filter(F.col("cls").isin(CLASSES))
         .withColumn("b", F.expr(f"{hash_sql(['doctor_id'], S_SALT)} % {SALT_BUCKETS}")))
    local = d.withColumn("r", F.row_number().over(
        Window.partitionBy("territory_id", "cls", "b").orderBy("doctor_id")) - 1)
    sizes = d.groupBy("territory_id", "cls", "b").agg(F.count(F.lit(1)).alias("nb"))
    offsets = sizes.withColumn("off", F.coalesce(F.sum("nb").over(
        Window.partitionBy("territory_id", "cls").orderBy("b")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(offsets.select("territory_id", "cls", "b", "off").hint("merge"), ["territory_id", "cls", "b"])
            .select("territory_id", "cls", (F.col("off") + F.col("r")).alias("rank"), "doctor_id"))


def _weight(style: str, cls: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {w[cls]}" for i, w in enumerate(REP_STYLE_WEIGHTS))
    return f"(CASE {style} {cases} END)"


def rep_style(reps: DataFrame) -> str:
    """SQL for the style number (efficient, average, inefficient in turn): the rep's place
    in the id list. Integer ids count from 0; a text id ('R001') counts by its number from 1,
    and by a draw where it has none."""
    if dict(reps.dtypes)["rep_id"] != "string":
        return "(rep_id % 3)"
    number = r"CAST(nullif(regexp_extract(rep_id, '([0-9]+)$', 1), '') AS BIGINT)"
    return f"coalesce(pmod({number} - 1, 3), {hash_sql(['rep_id'], S_STYLE)} % 3)"


def call_plan_sample(r: Roles, n_months: int = N_MONTHS) -> DataFrame:
    """rep_id, month, doctor_id, prescribing_potential, planned_date, planned_month, planned_quarter."""
    sizes = (r.doctors.filter(F.col("prescribing_potential").isin(CLASSES))
             .groupBy("territory_id")
             .agg(*[F.count_if(F.col("prescribing_potential") == c).alias(f"n_{c}") for c in CLASSES]))
    # one row per (rep, month): the months are generated per rep, no join
    rm = (r.reps.select("rep_id", "territory_id").join(sizes, "territory_id")
          .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(n_months))))
          .repartition("rep_id", "month"))      # the join leaves a territory's reps to one task
    style = rep_style(r.reps)
    rk = "rep_id"
    n_total = "(n_High + n_Medium + n_Low)"
    rm = rm.withColumn("n", F.expr(
        f"least({CALLS_MIN} + {hash_sql([rk, 'month'], S_CALLS)} % {CALLS_SPAN}, {n_total})"))
    wH, wM, wL = (_weight(style, c) for c in CLASSES)
    u = f"(CAST({hash_sql([rk, 'month', 'j'], S_CLASS)} AS DOUBLE) / {MODULUS})"
    step = f"""aggregate(sequence(1, n),
        named_struct('h', n_High, 'm', n_Medium, 'l', n_Low, 'ch', 0, 'cm', 0, 'cl', 0),
        (acc, j) -> CASE
          WHEN {u} * ({wH} * acc.h + {wM} * acc.m + {wL} * acc.l) < {wH} * acc.h
            THEN named_struct('h', acc.h - 1, 'm', acc.m, 'l', acc.l, 'ch', acc.ch + 1, 'cm', acc.cm, 'cl', acc.cl)
          WHEN {u} * ({wH} * acc.h + {wM} * acc.m + {wL} * acc.l) < {wH} * acc.h + {wM} * acc.m
            THEN named_struct('h', acc.h, 'm', acc.m - 1, 'l', acc.l, 'ch', acc.ch, 'cm', acc.cm + 1, 'cl', acc.cl)
          ELSE named_struct('h', acc.h, 'm', acc.m, 'l', acc.l - 1, 'ch', acc.ch, 'cm', acc.cm, 'cl', acc.cl + 1)
        END)"""
    rm = rm.withColumn("drawn", F.expr(step))
    # one row per (rep, month, class) with its count and class size
    per_class = rm.select(
        "rep_id", "territory_id", "month",
        F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(i).alias("ci"),
                                     F.col(f"drawn.c{c[0].lower()}").alias("c"),
                                     F.col(f"n_{c}").alias("N")) for i, c in enumerate(CLASSES)]))
        .alias("x")).select("rep_id", "territory_id", "month", "x.*").filter(F.col("c") > 0)
    # Floyd: for j = N-c .. N-1 draw t in [0, j]; keep t unless already taken, else keep j
    t = f"({hash_sql([rk, 'month', 'ci', 'j'], S_PICK)} % (j + 1))"
    floyd = (f"aggregate(sequence(N - c, N - 1), CAST(array() AS ARRAY<BIGINT>), "
             f"(acc, j) -> CASE WHEN array_contains(acc, {t}) THEN array_append(acc, j) "
             f"ELSE array_append(acc, {t}) END)")
    picks = (per_class.withColumn("N", F.col("N").cast("bigint")).withColumn("c", F.col("c").cast("bigint"))
             .select("rep_id", "territory_id", "month", "cls", F.explode(F.expr(floyd)).alias("rank")))
    ranked = ranked_doctors(r.doctors)
    plan = picks.join(ranked.hint("merge"), ["territory_id", "cls", "rank"])
    day = F.expr(f"{hash_sql([rk, 'month', 'doctor_id'], S_DAY)} % {DAY_SPAN}")
    planned = F.date_add(F.to_date(F.lit(PLAN_START)), ((F.col("month") - 1) * 30 + day).cast("int"))
    return plan.select("rep_id", "month", "doctor_id", F.col("cls").alias("prescribing_potential"),
                       planned.alias("planned_date")) \
        .withColumn("planned_month", F.month("planned_date").cast("int")) \
        .withColumn("planned_quarter", F.quarter("planned_date").cast("int"))
