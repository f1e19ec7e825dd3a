"""assayflow — Spark-native activity-modelling workbench.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a small
MLlib ``Transformer``/``Estimator``) written with built-in Column
expressions, windows, joins and aggregates, so that Catalyst plans and
Spark distributes the work.  Operators that the original workbench ran
"one table at a time" take grouping columns instead, so many tables are
processed in one job.
"""

from assayflow.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
