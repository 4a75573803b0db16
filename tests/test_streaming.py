"""The streaming refresh resumes from its state store and ends equal to the batch result."""
import tempfile

from callwise.plans.reps import rep_efficiency
from callwise.sources.roles import load_roles
from callwise.streaming.refresh import refresh_rep_efficiency


def rows(df):
    cols = ["rep_id", "High", "Medium", "Low", "total_calls", "efficiency_score", "high_pct", "low_pct"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_incremental_refresh_equals_batch(spark, smoke_dir):
    r = load_roles(spark, smoke_dir)
    base = tempfile.mkdtemp(prefix="stream-test-")
    src, out, ckpt = f"{base}/visits", f"{base}/out", f"{base}/ckpt"
    v = r.visits.select("rep_id", "doctor_id", "quarter")
    v.filter("quarter <= 2").drop("quarter").write.parquet(f"{src}/part=a")
    schema = spark.read.parquet(f"{src}/part=a").schema
    first = refresh_rep_efficiency(spark, src + "/*", schema, r.doctors, out, ckpt)
    expected_first = rep_efficiency(r.__class__(r.territories, r.reps, r.doctors,
                                                r.visits.filter("quarter <= 2"), r.prescriptions))
    assert rows(first) == rows(expected_first)
    # new files arrive; the same checkpoint continues from the stored counts
    v.filter("quarter > 2").drop("quarter").write.parquet(f"{src}/part=b")
    second = refresh_rep_efficiency(spark, src + "/*", schema, r.doctors, out, ckpt)
    assert rows(second) == rows(rep_efficiency(r))
