"""K-means doctor segmentation with model selection.

Procedure, as in the analysis script: standardise five features, fit k-means for
K = 2..7 keeping the best of ``n_init`` seeds by inertia, choose K by the largest
silhouette (smallest K on ties), label each cluster by comparing its mean revenue
and visits with the medians over the clusters.

Scale notes
- The standardised vectors are checkpointed to the shared folder once, so a lost
  executor re-reads the checkpoint instead of re-running the feature joins.
- All 60 fits (K x seeds) advance together (``operators.kmeans``): greedy k-means++
  seeding takes two passes a step, Lloyd one pass a step, and a pass returns one row
  for each model and cluster. Scans do not grow with the number of models.
- Silhouette uses ``ClusteringEvaluator`` with squared Euclidean distance, which is
  exact and linear in the number of points (per-cluster sums of vectors and norms).
  The script's plain-Euclidean silhouette needs the distance of every pair of
  doctors, which is quadratic; it is not computed here (see README).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.functions.labels import drop_first_token, segment_action
from callwise.operators import kmeans
from callwise.plans.doctors import (FEATURES, cluster_profile, doctor_features, fit_scaler,
                                   level_centroids, scale_features)
from callwise.sources.roles import Roles, load_roles

K_RANGE = range(2, 8)
N_INIT = 10
SEED = 42
MAX_ITER = 300
TOL = 1e-4   # on the sum over centers of squared center shifts, relative to the mean feature variance


@dataclass
class Selection:
    features: DataFrame          # raw feature table (doctor_features)
    vectors: DataFrame           # doctor_id, h, q, features (checkpointed)
    table: list[tuple]           # (k, inertia, silhouette)
    best_k: int
    centers: np.ndarray          # of the chosen model, in standardised units


def doctor_points(feats: DataFrame, model: dict | None = None) -> DataFrame:
    """Standardised features as the integer vectors of ``operators.kmeans``."""
    return kmeans.points(scale_features(feats, model or fit_scaler(feats)), "doctor_id", FEATURES)


def select_model(r: Roles, k_range=K_RANGE, n_init: int = N_INIT, seed: int = SEED,
                 feats: DataFrame | None = None, workers: int = 6) -> Selection:
    spark = r.doctors.sparkSession
    feats = feats if feats is not None else doctor_features(r)
    scaler = fit_scaler(feats)
    from callwise.session import shared_dir
    shared_dir(spark)  # makes sure a checkpoint folder is set
    stored = doctor_points(feats, scaler).checkpoint(eager=True)
    vectors = stored.withColumn("features", array_to_vector(F.transform("q", lambda x: x.cast("double") / kmeans.UNIT)))

    # standardised features have variance 1, constant ones 0
    mean_var = sum(1.0 for c in FEATURES if scaler[c][2] > 0) / len(FEATURES)
    cached = stored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = kmeans.fit(cached, [(k, seed + i) for k in k_range for i in range(n_init)], MAX_ITER, TOL * mean_var)
        # best of n_init seeds by inertia, first seed on ties
        best = {k: min((f for f in fits if f.k == k), key=lambda f: (f.inertia, f.seed)) for k in k_range}
        evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster",
                                        distanceMeasure="squaredEuclidean")

        def silhouette(k: int) -> float:
            return float(evaluator.evaluate(vectors.withColumn("cluster", kmeans.label_column("q", best[k].centres))))

        # pool threads inherit the caller's job group and local properties
        with ThreadPoolExecutor(max_workers=workers) as pool:
            sils = dict(zip(k_range, pool.map(inheritable_thread_target(spark)(silhouette), k_range)))
    finally:
        cached.unpersist()
    table = [(k, best[k].inertia, sils[k]) for k in k_range]
    best_k = max(table, key=lambda t: (t[2], -t[0]))[0]
    return Selection(feats, vectors, table, best_k, best[best_k].centres)


def kmeans_seeding(r: Roles, feats: DataFrame | None = None, k: int = 3, seed: int = SEED) -> DataFrame:
    """Doctors taken as centres by greedy k-means++, with the summed distances after each step."""
    feats = feats if feats is not None else doctor_features(r)
    p = doctor_points(feats)
    chosen = kmeans.seeded(p, [(k, seed)])[0].picks
    kind = dict(p.dtypes)["doctor_id"]
    return p.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(chosen, 1)],
                                          f"step int, doctor_id {kind}, trial int, cost bigint")


FAR = 1000.0    # a centre out here, in standard deviations, is nobody's nearest


def kmeans_relocation(r: Roles, feats: DataFrame | None = None) -> DataFrame:
    """One Lloyd step from the centroids of the potential levels and a centre that no doctor
    is near: the empty cluster moves to the farthest doctor."""
    feats = feats if feats is not None else doctor_features(r)
    scaler = fit_scaler(feats)
    levels = [c for c in level_centroids(r, feats, scaler) if not np.isnan(c).any()]
    start = np.array(levels + [[FAR] * len(FEATURES)])
    p = doctor_points(feats, scaler)
    centres, n, _ = kmeans.lloyd_step(p, {0: start})[0]
    return p.sparkSession.createDataFrame([(k, int(n[k]), *map(float, c)) for k, c in enumerate(centres)],
                                          "cluster int, n_doctors bigint, " + ", ".join(f"{c} double" for c in FEATURES))


_CACHE: dict[tuple[str, str], Selection] = {}


def cached_selection(spark: SparkSession, sf_dir: str) -> Selection:
    from callwise.session import session_key
    key = (session_key(spark), sf_dir)
    if key not in _CACHE:
        from callwise.plans.doctors import load_features
        _CACHE[key] = select_model(load_roles(spark, sf_dir), feats=load_features(spark, sf_dir))
    return _CACHE[key]


def model_selection_table(sel: Selection) -> DataFrame:
    spark = sel.vectors.sparkSession
    rows = [(k, cost, sil, k == sel.best_k) for k, cost, sil in sel.table]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, selected boolean")


def _assignments(sel: Selection) -> DataFrame:
    """Cluster per doctor, ids renumbered by centroid order so output is stable."""
    centers = np.array(sorted(tuple(float(x) for x in c) for c in sel.centers))
    return sel.vectors.select("doctor_id", kmeans.label_column("q", centers).alias("cluster"))


def doctor_segments(sel: Selection) -> DataFrame:
    """Feature table + cluster + segment label (12 columns).

    The profile has K rows, so its labels come back as a K-entry map and are applied
    as a CASE expression: a join on ``cluster`` would send each whole cluster (a third
    of all doctors or more) to one task."""
    a = sel.features.join(_assignments(sel), "doctor_id")
    labels = {row["cluster"]: row["label"] for row in cluster_profile(a).collect()}
    seg = F.lit(None).cast("string")
    for c, label in sorted(labels.items()):
        seg = F.when(F.col("cluster") == c, F.lit(label)).otherwise(seg)
    return a.select(*sel.features.columns, "cluster", seg.alias("segment"))


_TABLES: dict[tuple[str, str], DataFrame] = {}


def load_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment table of an input folder, written once per session to the shared folder."""
    from callwise.session import new_output_path, session_key
    key = (session_key(spark), sf_dir)
    if key not in _TABLES:
        path = new_output_path(spark, "doctor-segments")
        df = doctor_segments(cached_selection(spark, sf_dir))
        df.write.parquet(path)
        _TABLES[key] = spark.read.parquet(path).select(*df.columns)
    return _TABLES[key]


def cluster_profile_kmeans(sel: Selection) -> DataFrame:
    return cluster_profile(sel.features.join(_assignments(sel), "doctor_id"))


def segment_summary(sel: Selection) -> DataFrame:
    seg = doctor_segments(sel)
    return (seg.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_doctors"),
        F.avg("total_revenue").alias("avg_revenue"),
        F.avg("total_visits").alias("avg_visits"),
        F.avg("potential_score").alias("avg_potential_score"))
        .withColumn("action", segment_action(F.col("segment"))))


def segment_scatter(sel: Selection) -> DataFrame:
    seg = doctor_segments(sel)
    return seg.select("doctor_id", "total_visits",
                      (F.col("total_revenue") / F.lit(1000.0)).alias("revenue_k"),
                      "potential_score", "segment",
                      drop_first_token(F.col("segment")).alias("segment_name"))
