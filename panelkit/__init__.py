"""panelkit: staggered-adoption policy panels on Spark.

Layout
------
sources/    loading, fixture panels derived from the driver tables, sinks
functions/  scalar column helpers and driver-side distribution functions
operators/  panel construction, descriptives, joins, regression, DiD estimators
plans/      registered end-to-end queries (Spark side and SQL oracle side)
"""

from panelkit.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
