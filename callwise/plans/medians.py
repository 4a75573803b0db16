"""Medians of the doctor features over their whole, unbounded domains."""

from __future__ import annotations

from pyspark.sql import DataFrame

from callwise.operators.ranking import exact_median
from callwise.plans.doctors import FEATURES, doctor_features
from callwise.sources.roles import Roles

MEASURED = [*FEATURES, "avg_duration", "total_units"]


def feature_medians(r: Roles, feats: DataFrame | None = None) -> DataFrame:
    """(feature, median): the quadrant lines of a doctor scatter, exact at any size."""
    feats = feats if feats is not None else doctor_features(r)
    rows = [(c, exact_median(feats, c)) for c in MEASURED]
    return feats.sparkSession.createDataFrame(rows, "feature string, median double")
