"""Scoring of real visits: expected prescription probability per visited cell.

Probabilities are carried as integers (parts per million), so any SQL engine can check
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwise.functions.labels import (AFFINITY_BP, AFFINITY_DEFAULT_BP, FREQ_BOOST_CAP,
                                      FREQ_BOOST_PER_VISIT, POTENTIAL_MULTIPLIER_X10,
                                      PROBABILITY_CAP, PROBABILITY_SCALE)
from callwise.sources.roles import Roles


def product_index(col: str = "product") -> Column:
    return (F.when(F.col(col) == "CardioMax", 0).when(F.col(col) == "DiabeCure", 1)
            .when(F.col(col) == "NeuroCalm", 2).otherwise(3))


def _affinity_bp() -> Column:
    """Product x specialty affinity in basis points (default when the pair is unknown)."""
    e = F.lit(AFFINITY_DEFAULT_BP)
    for (prod, spec), a in reversed(list(AFFINITY_BP.items())):
        e = F.when((F.col("product") == prod) & (F.col("specialty") == spec), F.lit(a)).otherwise(e)
    return e


def _multiplier_x10() -> Column:
    e = F.lit(None).cast("int")
    for level, m in POTENTIAL_MULTIPLIER_X10.items():
        e = F.when(F.col("prescribing_potential") == level, F.lit(m)).otherwise(e)
    return e


def expected_rx_probability(r: Roles) -> DataFrame:
    """For each (doctor, product, month) with visits:
    p = min(affinity + min(0.10 n, 0.30), 0.95) x potential multiplier x 0.8.

    Cells come from a group-by on visits (only non-empty cells exist), the doctor
    attributes from one join; p is exact in parts per million."""
    cells = (r.visits.groupBy("doctor_id", "product", "month")
             .agg(F.count("visit_id").alias("n_visits")))
    d = r.doctors.select("doctor_id", "specialty", "prescribing_potential")
    c = cells.join(d, "doctor_id")
    boost, boost_cap, cap = (int(round(10000 * v)) for v in
                             (FREQ_BOOST_PER_VISIT, FREQ_BOOST_CAP, PROBABILITY_CAP))
    base_bp = F.least(_affinity_bp() + F.least(F.col("n_visits") * boost, F.lit(boost_cap)), F.lit(cap))
    # basis points x (multiplier x 10) x (scale x 10) = parts per million
    p_ppm = base_bp * _multiplier_x10() * int(round(10 * PROBABILITY_SCALE))
    return c.select("doctor_id", "product", "month",
                    F.col("n_visits").cast("bigint").alias("n_visits"),
                    (_affinity_bp().cast("double") / 10000.0).alias("affinity"),
                    p_ppm.cast("bigint").alias("p_ppm"),
                    (p_ppm.cast("double") / 1e6).alias("probability"))
