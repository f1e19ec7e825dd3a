"""Imports every query module so that the registry is complete."""

from assayflow.plans import q_core, q_functions, q_io, q_joins, q_labels, q_metrics, q_readouts, q_stats, q_summaries, q_features, q_misc, q_ml, q_tuning  # noqa: F401
from assayflow.plans.inputs import Tables


def flagship(spark, sf_dir):
    return q_metrics.eval_report(Tables(spark, sf_dir))
