"""callwise: field-force effectiveness analytics as Spark DataFrame jobs.

Layout
------
sources/    role loaders (territories, reps, doctors, visits, prescriptions),
            typed schemas, CSV/parquet sinks
functions/  column-level helpers: exact half-up rounding, safe division,
            labels and flags, hash-uniform draws, formatted ids
operators/  reusable relational building blocks: pre-aggregated fan-out,
            fixed-value pivots, shares of a group total, top-k with a tie key,
            size-checked broadcast, data-quality checks, k-means helpers,
            weighted sampling
plans/      the named analyses (KPIs, rep scoring, segmentation, BI measures)
streaming/  incremental refresh of the fact-driven KPIs with Structured Streaming
"""

from callwise.session import get_spark, shared_dir  # noqa: F401
from callwise.sources.roles import Roles, load_roles  # noqa: F401
