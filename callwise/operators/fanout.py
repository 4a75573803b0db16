"""Pre-aggregated building blocks for the fan-out joins.

Several KPIs join two one-to-many children of the same parent (visits and
prescriptions of a doctor, reps and prescriptions of a territory) and then
aggregate. Joined as written, the row count is the product of the two fan-outs
(118M rows for one query at sf0.1). The reference *result* depends on that
product (sums repeat once per partner row), so we keep the numbers but compute
them from per-key counts:

    COUNT(child_a) over the join  = n_a * greatest(n_b, 1)
    SUM(child_b.x) over the join  = sum_b(x) * greatest(n_a, 1)

Every helper aggregates first (a partial HashAggregate runs before the shuffle,
so a hot key costs one row per map task, not one row per fact) and joins the
small per-key results afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rep_doctor_visits(visits: DataFrame) -> DataFrame:
    """(rep_id, doctor_id, n_v): visits per rep and doctor."""
    return visits.groupBy("rep_id", "doctor_id").agg(F.count("visit_id").alias("n_v"))


def visit_cells(visits: DataFrame) -> DataFrame:
    """(rep_id, doctor_id, product, month, n_v): visits per rep at prescription grain."""
    return (visits.groupBy("rep_id", "doctor_id", "product", "month")
            .agg(F.count("visit_id").alias("n_v")))


def cells_of(r) -> DataFrame:
    """Visit cells of a Roles: its written summary table when present, else aggregated."""
    cells = getattr(r, "cells", None)
    return cells if cells is not None else visit_cells(r.visits)


def pairs_of(r) -> DataFrame:
    """(rep_id, doctor_id, n_v) of a Roles, rolled up from the cell summary when present."""
    cells = getattr(r, "cells", None)
    if cells is None:
        return rep_doctor_visits(r.visits)
    return cells.groupBy("rep_id", "doctor_id").agg(F.sum("n_v").alias("n_v"))


def doctor_rx(rx: DataFrame) -> DataFrame:
    """(doctor_id, n_p, rx_revenue): prescription rows and revenue per doctor."""
    return (rx.groupBy("doctor_id")
            .agg(F.count(F.lit(1)).alias("n_p"), F.sum("revenue").alias("rx_revenue")))


def doctor_visit_counts(visits: DataFrame) -> DataFrame:
    return visits.groupBy("doctor_id").agg(F.count("visit_id").alias("n_v"))


def cell_revenue(visits: DataFrame, rx: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Visit cells with the revenue of the matching prescription (NULL when none).

    The three-key join matches at most one prescription per cell because
    (doctor_id, product, month) is the prescription grain.
    """
    p = rx.select("doctor_id", "product", "month", "revenue")
    cells = cells if cells is not None else visit_cells(visits)
    return cells.join(p, ["doctor_id", "product", "month"], "left")


def fan(n_a, n_b):
    """n_a * greatest(n_b, 1) with NULL counts read as 0."""
    a = F.coalesce(n_a, F.lit(0))
    b = F.coalesce(n_b, F.lit(0))
    return a * F.greatest(b, F.lit(1))
