"""Doctor feature table, exact standardisation, nearest-centroid assignment and
cluster profiles with their median-based labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwise.functions.labels import POTENTIAL_LEVELS, segment_label
from callwise.sources.roles import Roles

FEATURES = ["potential_score", "total_visits", "total_revenue", "unique_products", "months_active"]
FEATURE_COLUMNS = ["doctor_id", "potential_score", "years_in_practice", "total_visits",
                   "unique_products", "avg_duration", "samples_received", "total_revenue",
                   "total_units", "months_active"]


def doctor_features(r: Roles) -> DataFrame:
    """Visit and prescription aggregates per doctor, left joined to all doctors, zero filled.

    Distinct products and active months are counted by grouping on (doctor, product)
    and (doctor, month) first: a two-level aggregate with partial aggregation on both
    levels, instead of an Expand for COUNT(DISTINCT)."""
    vp = (r.visits.groupBy("doctor_id", "product")
          .agg(F.count("visit_id").alias("n"), F.sum("duration_min").alias("dur"),
               F.count("duration_min").alias("n_dur"), F.sum("samples_left").alias("samples")))
    dv = (vp.groupBy("doctor_id")
          .agg(F.sum("n").alias("total_visits"), F.count("product").alias("unique_products"),
               F.sum("dur").alias("dur"), F.sum("n_dur").alias("n_dur"),
               F.sum("samples").alias("samples_received"))
          .withColumn("avg_duration", F.try_divide(F.col("dur").cast("double"),
                                                   F.col("n_dur").cast("double"))))
    pm = (r.prescriptions.groupBy("doctor_id", "month")
          .agg(F.sum("revenue").alias("rev"), F.sum("units_prescribed").alias("units")))
    dr = (pm.groupBy("doctor_id")
          .agg(F.sum("rev").alias("total_revenue"), F.sum("units").alias("total_units"),
               F.count("month").alias("months_active")))
    d = r.doctors.select("doctor_id", "potential_score", "years_in_practice")
    f = d.join(dv, "doctor_id", "left").join(dr, "doctor_id", "left")
    longs = ["total_visits", "unique_products", "samples_received", "total_revenue", "total_units",
             "months_active"]
    return f.select("doctor_id", "potential_score", "years_in_practice",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) if c in longs
                      else F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c == "avg_duration"
                      else F.col(c) for c in FEATURE_COLUMNS[3:]])


def _moments(feats: DataFrame) -> DataFrame:
    """One row: n and, per feature, the sum and the sum of squares as exact decimals."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in FEATURES:
        x = F.col(c).cast("decimal(38,0)")
        aggs += [F.sum(x).alias(f"s_{c}"), F.sum(x * x).alias(f"ss_{c}")]
    return feats.agg(*aggs)


def fit_scaler(feats: DataFrame) -> dict[str, tuple[int, int, float]]:
    """Fit step of the standard scaler: one distributed aggregate, one row back.

    Returns, per feature, (n, S, sqrt(n SS - S^2)) with n and S exact integers; the
    model is 3 numbers per feature whatever the number of doctors."""
    import math
    m = _moments(feats).first()
    n = int(m["n"])
    out = {}
    for c in FEATURES:
        s = int(m[f"s_{c}"] or 0)
        ss = int(m[f"ss_{c}"] or 0)
        out[c] = (n, s, math.sqrt(float(n * ss - s * s)))
    return out


def _exact(v: int) -> Column:
    return F.lit(str(v)).cast("decimal(38,0)")


def z_column(c: str, n: int, s: int, root: float) -> Column:
    """(x - mean) / pop_sd, computed as (n x - S) / sqrt(n SS - S^2).

    The numerator is an exact integer and the root is the correctly rounded square
    root of an exact integer, so the double is the same on any IEEE engine. Zero
    variance gives 0 (the scaler's convention)."""
    if root == 0.0:
        return F.lit(0.0)
    num = (_exact(n) * F.col(c).cast("decimal(38,0)") - _exact(s)).cast("double")
    return num / F.lit(root)


def scale_features(feats: DataFrame, model: dict[str, tuple[int, int, float]]) -> DataFrame:
    """Transform step: a projection with the fitted numbers as literals (no join)."""
    return feats.select("doctor_id", *[z_column(c, *model[c]).alias(c) for c in FEATURES])


def doctor_features_scaled(r: Roles, feats: DataFrame | None = None) -> DataFrame:
    """Standardised model features (population standard deviation), one row per doctor."""
    feats = feats if feats is not None else doctor_features(r)
    return scale_features(feats, fit_scaler(feats))


# ---------------------------------------------------------------------------
# Nearest-centroid assignment with centroids fixed by a rule: one centroid per
# potential level (High = 0, Medium = 1, Low = 2), the mean standardised feature
# vector of that level's doctors. The assignment itself is the predict step of
# k-means: squared distance to every centroid, smallest wins, lower id on ties.
# ---------------------------------------------------------------------------

def level_centroids(r: Roles, feats: DataFrame | None = None,
                    model: dict | None = None) -> list[list[float]]:
    """Per-level mean z-vectors, computed exactly as (n S_g - n_g S) / (n_g sqrt(D)).

    One grouped aggregate returns 3 rows (one per level); the result is K x F floats,
    a bounded model, not data."""
    feats = feats if feats is not None else doctor_features(r)
    model = model if model is not None else fit_scaler(feats)
    pot = r.doctors.select("doctor_id", "prescribing_potential")
    per = {row["prescribing_potential"]: row for row in feats.join(pot, "doctor_id")
           .groupBy("prescribing_potential").agg(
               F.count(F.lit(1)).alias("ng"),
               *[F.sum(F.col(c).cast("decimal(38,0)")).alias(f"sg_{c}") for c in FEATURES]).collect()}
    out = []
    for level in POTENTIAL_LEVELS:
        row = per.get(level)
        if row is None:
            out.append([float("nan")] * len(FEATURES))
            continue
        vec = []
        for c in FEATURES:
            n, s, root = model[c]
            ng, sg = int(row["ng"]), int(row[f"sg_{c}"])
            vec.append(0.0 if root == 0.0 else float(n * sg - ng * s) / (float(ng) * root))
        out.append(vec)
    return out


def nearest_centroid(scaled: DataFrame, centroids: list[list[float]],
                     features: list[str] = FEATURES) -> DataFrame:
    """(doctor_id, cluster, distance): Euclidean distance to the closest centroid.

    A projection only: the K centroids are literals in the expression, so there is no
    join and no shuffle; NaN centroids (empty levels) never win."""
    d2 = []
    for vec in centroids:
        terms = None
        for c, v in zip(features, vec):
            diff = F.col(c) - F.lit(float(v))
            t = diff * diff
            terms = t if terms is None else terms + t
        d2.append(terms)
    best_k = F.lit(0)
    best = d2[0]
    for k in range(1, len(d2)):
        better = (d2[k] < best) | F.isnan(best)
        best_k = F.when(better, F.lit(k)).otherwise(best_k)
        best = F.when(better, d2[k]).otherwise(best)
    return scaled.select("doctor_id", best_k.alias("cluster"),
                         F.round(F.sqrt(best), 9).alias("distance"))


def nearest_level_centroid(r: Roles, feats: DataFrame | None = None) -> DataFrame:
    feats = feats if feats is not None else doctor_features(r)
    model = fit_scaler(feats)
    return nearest_centroid(scale_features(feats, model), level_centroids(r, feats, model))


def cluster_profile(assigned: DataFrame) -> DataFrame:
    """Mean of each raw feature per cluster and the 4-way label against the medians of
    those means (strictly above = high). ``assigned`` holds the features and ``cluster``.

    The profile has one row per cluster (K <= 7), so the medians are window
    aggregates over those K rows; nothing upstream is recomputed."""
    prof = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_doctors"),
        *[(F.sum(c).cast("double") / F.count(c).cast("double")).alias(c) for c in FEATURES])
    every = Window.partitionBy()
    med_rev = F.median("total_revenue").over(every)
    med_vis = F.median("total_visits").over(every)
    return prof.withColumn("label", segment_label(F.col("total_revenue") > med_rev,
                                                  F.col("total_visits") > med_vis))


def cluster_profile_levels(r: Roles, feats: DataFrame | None = None) -> DataFrame:
    """cluster_profile over the fixed level-centroid assignment (deterministic)."""
    feats = feats if feats is not None else doctor_features(r)
    a = nearest_level_centroid(r, feats)
    return cluster_profile(feats.join(a.select("doctor_id", "cluster"), "doctor_id"))


# ---------------------------------------------------------------------------
# The feature table is the hand-off point between the fact aggregates and the
# model: written once per session and input to the shared folder, read back by
# the scaler, the centroid steps and the k-means fits.
# ---------------------------------------------------------------------------
_FEATURES_CACHE: dict[tuple[str, str], DataFrame] = {}


def load_features(spark, sf_dir: str) -> DataFrame:
    from callwise.session import new_output_path
    from callwise.sources.roles import load_roles
    from callwise.session import session_key
    key = (session_key(spark), sf_dir)
    if key not in _FEATURES_CACHE:
        path = new_output_path(spark, "doctor-features")
        f = doctor_features(load_roles(spark, sf_dir))
        f.write.mode("overwrite").parquet(path)
        _FEATURES_CACHE[key] = spark.read.parquet(path).select(*f.columns)
    return _FEATURES_CACHE[key]
