"""Screening a library with stored models: hit rates and per-compound assay sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.session import materialize


def hitrate_tested(compounds: DataFrame, results: DataFrame, id_col: str, assay: str, active: str) -> DataFrame:
    """Hit rate per assay over compounds with a result (missing excluded); one row per hit id.

    Hit ids stay rows (never collected into one array per assay).
    """
    tested = compounds.select(id_col).join(results.select(id_col, assay, active), id_col, "inner").filter(F.col(active).isNotNull())
    st = tested.groupBy(assay).agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col(active) == 1).alias("hits"))
    hits = tested.filter(F.col(active) == 1).select(assay, id_col)
    return hits.join(st, assay).select(assay, id_col, "tested", "hits", (F.col("hits") / F.col("tested")).alias("hitrate"))


def multi_target(compounds: DataFrame, assays: DataFrame, predictions: DataFrame, id_col: str, assay: str, pred: str) -> DataFrame:
    """Per compound: sorted arrays of active, inactive and missing assays.

    Arrays are bounded by the number of assays; the assay list itself is a
    scalar subquery, so no compound x assay product is formed.
    """
    all_assays = assays.agg(F.array_sort(F.collect_set(assay)).alias("a")).scalar()
    p = predictions.filter(F.col(pred).isNotNull()).groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col(pred) == 1, F.col(assay)))).alias("active"),
        F.array_sort(F.collect_list(F.when(F.col(pred) == 0, F.col(assay)))).alias("inactive"),
        F.collect_set(assay).alias("__present"),
    )
    j = compounds.select(id_col).join(p, id_col, "left").withColumn("__all", all_assays)
    empty = F.array().cast("array<string>")
    return j.select(
        id_col,
        F.coalesce("active", empty).alias("active"),
        F.coalesce("inactive", empty).alias("inactive"),
        F.array_sort(F.array_except("__all", F.coalesce("__present", empty))).alias("missing"),
    )


def score_library(model, library: DataFrame, id_col: str, feature_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Apply a fitted model to a library (rows with null features dropped); predictions keep the id."""
    clean = library.filter(F.col(feature_col).isNotNull())
    return model.transform(clean)


def timed_scores(score, library: DataFrame, by: Sequence[str], pred_col: str = "prediction") -> tuple[DataFrame, float, dict]:
    """Scores of a library, computed once: (stored predictions, seconds that the pass took, numbers observed on the way).

    ``score`` maps the library to its predictions.  The pass ends when the predictions are written, so the time is that of
    the scoring; tested and predicted rows are counted by the same pass (``observe``), not by another one.
    """
    import time

    from pyspark.sql import Observation

    seen = Observation()
    began = time.monotonic()
    pred = score(library).select(*by, pred_col).observe(seen, F.count(pred_col).alias("tested"), F.count_if(F.col(pred_col) == 1).alias("predicted"))
    stored = materialize(pred)
    return stored, time.monotonic() - began, seen.get


def library_report(pred: DataFrame, by: Sequence[str], library_size: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """One row per (library, assay, model): tested, predicted actives and hit rate."""
    g = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("tested_compounds"), F.count_if(F.col(pred_col) == 1).alias("n_predicted"))
    return g.join(library_size, [c for c in by if c in library_size.columns]).withColumn(
        "hitrate", F.col("n_predicted") / F.col("tested_compounds")
    )
