"""Key checks over the role tables and the two derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from callwise.operators.quality import fk_report, pk_report, union_all
from callwise.plans.doctors import doctor_features
from callwise.plans.reps import rep_performance
from callwise.sources.roles import Roles

PK = [("territories", ["territory_id"]), ("reps", ["rep_id"]), ("doctors", ["doctor_id"]),
      ("visits", ["visit_id"]), ("prescriptions", ["prescription_id"]),
      ("prescriptions", ["doctor_id", "product", "month"])]


def pk_violations(r: Roles) -> DataFrame:
    t = r.as_dict()
    return union_all([pk_report(t[name], name, keys) for name, keys in PK])


def fk_orphans(r: Roles, perf: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """The eight many-to-one edges of the model. ``perf`` and ``segments`` are the written
    scorecard and segment tables; without the latter the feature table, from which it is
    made, stands in for it."""
    t = r.as_dict()
    t["rep_performance"] = perf if perf is not None else rep_performance(r)
    t["doctor_segments"] = segments if segments is not None else doctor_features(r)
    edges = [("reps", "territory_id", "territories", "territory_id"),
             ("doctors", "territory_id", "territories", "territory_id"),
             ("visits", "rep_id", "reps", "rep_id"),
             ("visits", "doctor_id", "doctors", "doctor_id"),
             ("prescriptions", "territory_id", "territories", "territory_id"),
             ("prescriptions", "doctor_id", "doctors", "doctor_id"),
             ("rep_performance", "rep_id", "reps", "rep_id"),
             ("doctor_segments", "doctor_id", "doctors", "doctor_id")]
    return union_all([fk_report(t[c], c, fk, t[p], p, pk) for c, fk, p, pk in edges])
